"""Fills whose ranges move with the row, whose ends are computed, and whose criteria come from the row, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .formula_queries import book

# orders: A o_orderkey, B o_custkey, C o_orderstatus, D o_totalprice, E o_orderdate, F o_orderpriority
# part: A p_partkey, B p_name, C p_brand, D p_type, E p_size, F p_retailprice


def _six(area: str) -> dict[str, str]:
    return {"v_sum": f"=SUM({area})", "v_average": f"=AVERAGE({area})*COUNT({area})", "v_count": f"=COUNT({area})", "v_min": f"=MIN({area})", "v_max": f"=MAX({area})", "v_over": f'=COUNTIF({area},">150000")'}


_PLACED = "SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders"


def _window(frame: str) -> str:
    return f"""SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS v_sum, round(avg(o_totalprice) OVER w * count(*) OVER w, 2) AS v_average, CAST(count(*) OVER w AS DOUBLE) AS v_count,
  min(o_totalprice) OVER w AS v_min, max(o_totalprice) OVER w AS v_max, CAST(count(*) FILTER (WHERE o_totalprice > 150000) OVER w AS DOUBLE) AS v_over
FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN {frame})"""


def _between(lo: str, hi: str) -> str:
    return f"""WITH o AS ({_PLACED})
SELECT a.o_orderkey, round(sum(b.o_totalprice), 2) AS v_sum, round(avg(b.o_totalprice) * count(*), 2) AS v_average, CAST(count(*) AS DOUBLE) AS v_count, min(b.o_totalprice) AS v_min, max(b.o_totalprice) AS v_max,
  CAST(count(*) FILTER (WHERE b.o_totalprice > 150000) AS DOUBLE) AS v_over
FROM o a JOIN o b ON b.p BETWEEN {lo} AND {hi} GROUP BY a.o_orderkey"""


#: name -> (table, others, formulas, key, SQL)
FILLS = {
    "f3_window_ahead": ("orders", (), _six("D2:D4"), "o_orderkey", _window("CURRENT ROW AND 2 FOLLOWING")),
    "f3_window_around": ("orders", (), _six("D1:D3"), "o_orderkey", _window("1 PRECEDING AND 1 FOLLOWING")),
    "f3_window_wide": ("orders", (), _six("D2:D201"), "o_orderkey", _window("CURRENT ROW AND 199 FOLLOWING")),
    "f3_all_so_far": ("orders", (), _six("$D$2:D2"), "o_orderkey", _window("UNBOUNDED PRECEDING AND CURRENT ROW")),
    "f3_all_so_far_and_two": ("orders", (), _six("D$2:D4"), "o_orderkey", _window("UNBOUNDED PRECEDING AND 2 FOLLOWING")),
    "f3_to_a_fixed_row": ("orders", (), _six("D2:D$101"), "o_orderkey", _between("least(a.p, 99)", "greatest(a.p, 99)")),
    "f3_from_a_later_row": ("orders", (), _six("D$12:D2"), "o_orderkey", _between("least(a.p, 10)", "greatest(a.p, 10)")),
    "f3_several_columns": (
        "orders", (), {"v_across": "=SUM(A2:D2)", "v_block": "=MAX(A2:B4)", "v_filled": "=COUNTA(A1:F2)", "v_blank": "=COUNTBLANK(A2:F3)"}, "o_orderkey",
        """SELECT o_orderkey, round(o_orderkey + o_custkey + o_totalprice, 2) AS v_across, CAST(max(greatest(o_orderkey, o_custkey)) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS DOUBLE) AS v_block,
  12.0::DOUBLE AS v_filled, CASE WHEN lead(o_orderkey) OVER (ORDER BY o_orderkey) IS NULL THEN 6.0 ELSE 0.0 END::DOUBLE AS v_blank FROM orders""",
    ),
    "f3_another_sheet": (
        "nation", ("region",), {"v_sum": "=SUM(region!A2:A4)", "v_name": '=IFERROR(region!B3&"","none")'}, "n_nationkey",
        """WITH n AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY r_regionkey) - 1 AS p FROM region)
SELECT n_nationkey, CAST(coalesce((SELECT sum(r_regionkey) FROM r WHERE r.p BETWEEN n.p AND n.p + 2), 0) AS DOUBLE) AS v_sum, coalesce((SELECT r_name FROM r WHERE r.p = n.p + 1), '') AS v_name FROM n""",
    ),
    "f3_change": ("orders", (), {"v": "=IFERROR(D2-D1,0)"}, "o_orderkey", "SELECT o_orderkey, round(coalesce(o_totalprice - lag(o_totalprice) OVER (ORDER BY o_orderkey), 0), 2) AS v FROM orders"),
    "f3_running_by_key": (
        "orders", (), {"v_nth": "=COUNTIF(B$2:B2,B2)", "v_sum": "=SUMIF(B$2:B2,B2,D$2:D2)", "v_max": "=MAXIFS(D$2:D2,B$2:B2,B2,C$2:C2,C2)"}, "o_orderkey",
        """SELECT o_orderkey, CAST(row_number() OVER w AS DOUBLE) AS v_nth, round(sum(o_totalprice) OVER w, 2) AS v_sum, max(o_totalprice) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS v_max
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""",
    ),
    "f3_window_by_key": (
        "orders", (), {"v": '=COUNTIFS(C2:C11,C2,D2:D11,">"&D2)'}, "o_orderkey",
        f"""WITH o AS ({_PLACED}) SELECT a.o_orderkey, CAST(count(b.p) AS DOUBLE) AS v
FROM o a LEFT JOIN o b ON b.p BETWEEN a.p AND a.p + 9 AND b.o_orderstatus = a.o_orderstatus AND b.o_totalprice > a.o_totalprice GROUP BY a.o_orderkey""",
    ),
    "f2_computed_end": (
        "orders", (), {"v_sum": "=SUM(D2:INDEX(D:D,B2+1))", "v_max": "=MAX(INDEX(D:D,B2+1):INDEX(D:D,B2+41))"}, "o_orderkey",
        f"""WITH o AS ({_PLACED}), s AS (SELECT p, sum(o_totalprice) OVER (ORDER BY p) AS upto FROM o), e AS (SELECT o.*, least(p, o_custkey) AS lo, greatest(p, o_custkey) AS hi FROM o),
m AS (SELECT a.o_orderkey, max(b.o_totalprice) AS v_max FROM o a JOIN o b ON b.p BETWEEN a.o_custkey AND a.o_custkey + 40 GROUP BY a.o_orderkey)
SELECT e.o_orderkey, round(b.upto - coalesce(a.upto, 0), 2) AS v_sum, coalesce(v_max, 0) AS v_max
FROM e JOIN s b ON b.p = least(e.hi, (SELECT max(p) FROM o)) LEFT JOIN s a ON a.p = e.lo - 1 LEFT JOIN m ON m.o_orderkey = e.o_orderkey""",
    ),
    "f6_more_than_mine": (
        "orders", (), {"v_count": '=COUNTIF(D:D,">"&D2)', "v_sum": '=SUMIFS(D:D,D:D,"<="&D2-1000)', "v_average": '=AVERAGEIFS(D:D,E:E,">="&E2)*COUNTIF(E:E,">="&E2)'}, "o_orderkey",
        """SELECT o_orderkey, CAST(count(*) OVER (ORDER BY o_totalprice DESC RANGE UNBOUNDED PRECEDING) - count(*) OVER (PARTITION BY o_totalprice) AS DOUBLE) AS v_count,
  round(coalesce(sum(o_totalprice) OVER (ORDER BY o_totalprice RANGE BETWEEN UNBOUNDED PRECEDING AND 1000.0 PRECEDING), 0), 2) AS v_sum, round(avg(o_totalprice) OVER (ORDER BY o_orderdate DESC RANGE UNBOUNDED PRECEDING) * count(*) OVER (ORDER BY o_orderdate DESC RANGE UNBOUNDED PRECEDING), 2) AS v_average FROM orders""",
    ),
    "f6_more_than_mine_by_key": (
        "orders", (), {"v_count": '=COUNTIFS(D:D,">"&D2,B:B,B2)', "v_sum": '=SUMIFS(D:D,E:E,"<"&E2,B:B,B2)', "v_max": '=MAXIFS(D:D,E:E,"<"&E2,B:B,B2)'}, "o_orderkey",
        """SELECT a.o_orderkey, CAST(count(*) FILTER (WHERE b.o_totalprice > a.o_totalprice) AS DOUBLE) AS v_count, round(coalesce(sum(b.o_totalprice) FILTER (WHERE b.o_orderdate < a.o_orderdate), 0), 2) AS v_sum,
  coalesce(max(b.o_totalprice) FILTER (WHERE b.o_orderdate < a.o_orderdate), 0) AS v_max FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey GROUP BY a.o_orderkey""",
    ),
    "f6_two_inequalities": (
        "orders", (), {"v_count": '=COUNTIFS(D:D,">"&D2,E:E,"<"&E2)', "v_max": '=MAXIFS(D:D,D:D,"<"&D2,E:E,">"&E2,C:C,C2)', "v_near": '=COUNTIFS(D:D,">="&D2-50,D:D,"<="&D2+50)'}, "o_orderkey",
        """SELECT a.o_orderkey, CAST(count(*) FILTER (WHERE b.o_totalprice > a.o_totalprice AND b.o_orderdate < a.o_orderdate) AS DOUBLE) AS v_count,
  coalesce(max(b.o_totalprice) FILTER (WHERE b.o_totalprice < a.o_totalprice AND b.o_orderdate > a.o_orderdate AND b.o_orderstatus = a.o_orderstatus), 0) AS v_max,
  CAST(count(*) FILTER (WHERE b.o_totalprice BETWEEN a.o_totalprice - 50 AND a.o_totalprice + 50) AS DOUBLE) AS v_near
FROM orders a JOIN orders b ON true GROUP BY a.o_orderkey""",
    ),
    "f6_other_than_mine": (
        "orders", (), {"v_count": '=COUNTIF(C:C,"<>"&C2)', "v_sum": '=SUMIFS(D:D,C:C,"<>"&C2,F:F,F2)', "v_max": '=MAXIFS(D:D,C:C,"<>"&C2)'}, "o_orderkey",
        """WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_totalprice) AS s, max(o_totalprice) AS m FROM orders GROUP BY ALL)
SELECT o_orderkey, CAST((SELECT sum(n) FROM g WHERE g.o_orderstatus <> o.o_orderstatus) AS DOUBLE) AS v_count, round((SELECT sum(s) FROM g WHERE g.o_orderstatus <> o.o_orderstatus AND g.o_orderpriority = o.o_orderpriority), 2) AS v_sum,
  (SELECT max(m) FROM g WHERE g.o_orderstatus <> o.o_orderstatus) AS v_max FROM orders o""",
    ),
    "f6_patterns": (
        "part", (), {"v_begins": '=COUNTIF(B:B,LEFT(B2,4)&"*")', "v_holds": '=SUMIFS(E:E,B:B,"*"&MID(B2,3,4)&"*")', "v_not": '=COUNTIF(D:D,"<>"&LEFT(D2,5)&"*")', "v_brand": '=COUNTIFS(D:D,"*"&RIGHT(D2,3),C:C,C2)'}, "p_partkey",
        """SELECT a.p_partkey, CAST(count(*) FILTER (WHERE starts_with(lower(b.p_name), lower(a.p_name[:4]))) AS DOUBLE) AS v_begins, CAST(sum(b.p_size) FILTER (WHERE contains(lower(b.p_name), lower(substring(a.p_name, 3, 4)))) AS DOUBLE) AS v_holds,
  CAST(count(*) FILTER (WHERE NOT starts_with(lower(b.p_type), lower(a.p_type[:5]))) AS DOUBLE) AS v_not, CAST(count(*) FILTER (WHERE ends_with(lower(b.p_type), lower(right(a.p_type, 3))) AND b.p_brand = a.p_brand) AS DOUBLE) AS v_brand
FROM part a JOIN part b ON true GROUP BY a.p_partkey""",
    ),
    "f6_lookup_by_pattern": (
        "part", ("supplier",), {"v_key": '=XLOOKUP("*"&RIGHT(A2,2)&"?",supplier!B:B,supplier!A:A,0,2)', "v_at": '=IFERROR(MATCH(LEFT(B2,3)&"*",B:B,0),0)'}, "p_partkey",
        """WITH q AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS p, right(CAST(p_partkey AS VARCHAR), 2) AS two FROM part),
k AS (SELECT two, min(s_suppkey) AS v_key FROM (SELECT DISTINCT two FROM q) JOIN supplier ON contains(s_name[:length(s_name) - 1], two) AND ends_with(s_name[:length(s_name) - 1], two) GROUP BY two),
f AS (SELECT lower(p_name[:3]) AS head, min(p) AS v_at FROM q GROUP BY 1)
SELECT p_partkey, CAST(coalesce(v_key, 0) AS DOUBLE) AS v_key, CAST(v_at AS DOUBLE) AS v_at FROM q LEFT JOIN k ON k.two = q.two JOIN f ON f.head = lower(p_name[:3])""",
    ),
    "f6_products_by_row": (
        "orders", (), {"v_sum": "=SUMPRODUCT((B:B=B2)*(D:D>D2)*D:D)", "v_count": "=SUMPRODUCT(--(E:E<E2),--(C:C=C2))"}, "o_orderkey",
        """SELECT a.o_orderkey, round(coalesce(sum(b.o_totalprice) FILTER (WHERE b.o_totalprice > a.o_totalprice), 0), 2) AS v_sum, any_value(c.v_count) AS v_count
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
JOIN (SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate RANGE UNBOUNDED PRECEDING) - count(*) OVER (PARTITION BY o_orderstatus, o_orderdate) AS DOUBLE) AS v_count FROM orders) c ON c.o_orderkey = a.o_orderkey
GROUP BY a.o_orderkey""",
    ),
}

#: Results that are sums of money (an average is compared times its count, as it may end in half a digit anywhere), and their digits.
_DIGITS = {"v_sum": 2, "v_average": 2, "v_across": 2, "v": 2}


def _fill(name: str):
    table, others, formulas, key, _ = FILLS[name]

    def run(spark, sf_dir):
        df = book(spark, sf_dir, table, *others).fill(formulas, table, keep=[key])
        return df.withColumns({n: F.round(n, _DIGITS[n]) for n in formulas if n in _DIGITS})

    return run


def queries() -> dict:
    return {name: _fill(name) for name in FILLS}


def oracle_sql() -> dict[str, str]:
    return {name: x[4] for name, x in FILLS.items()}
