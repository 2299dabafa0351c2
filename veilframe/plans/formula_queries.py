"""One query per admitted function, over the star-schema tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..formula import Workbook

ORDER = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "part": ["p_partkey"], "events": ["event_id"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "supplier": ["s_suppkey"]}


def book(spark, sf_dir: str, *tables: str) -> Workbook:
    b = Workbook(spark)
    for t in tables:
        b.add(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"), ORDER[t])
    return b


def rounded(df, v: str, digits: int):
    """A double rounded as SQL does it: times a power of ten, the nearest whole number, halves away from 0; what that overflows stays."""
    if dict(df.dtypes)[v] != "double":
        return F.round(v, digits)
    by = F.lit(10.0**digits)
    y = F.abs(F.col(v) * by)
    down = F.floor(y).cast("double")
    whole = F.when(y < 2.0**52, F.when(y - down >= 0.5, down + 1).otherwise(down)).otherwise(y)  # from 2^52 on there are no halves
    return F.when(y < float("inf"), F.signum(v) * whole / by).otherwise(F.col(v))


def _fill(table, key, formula, others=(), digits=None):
    def run(spark, sf_dir):
        df = book(spark, sf_dir, table, *others).fill({"v": formula}, table, keep=[key])
        return df.withColumn("v", rounded(df, "v", digits)) if digits is not None else df

    return run


def _cell(table, formula, others=(), digits=None):
    def run(spark, sf_dir):
        df = book(spark, sf_dir, table, *others).cell(formula, table, "v")
        return df.withColumn("v", F.round("v", digits)) if digits is not None else df

    return run


def _spill(table, formula, names, others=(), order=False, digits=()):
    def run(spark, sf_dir):
        df = book(spark, sf_dir, table, *others).spill(formula, table, names, order)
        return df.withColumns({n: F.round(n, 4) for n in digits})

    return run


#: function -> (formula on row 2, SQL expression), filled down the orders table.
#: orders: A o_orderkey, B o_custkey, C o_orderstatus, D o_totalprice, E o_orderdate, F o_orderpriority
_D = "CAST(o_orderdate AS DATE)"
ON_ORDERS = {
    "abs": ("=ABS(D2-150000)", "abs(o_totalprice - 150000)"),
    "ceiling_math": ("=CEILING.MATH(D2-150000,100)", "ceil((o_totalprice - 150000) / 100.0) * 100"),
    "floor_math": ("=FLOOR.MATH(D2-150000,100)", "floor((o_totalprice - 150000) / 100.0) * 100"),
    "int": ("=INT(D2-150000)", "floor(o_totalprice - 150000)"),
    "mod": ("=MOD(B2,-7)", "CAST(o_custkey - (-7) * floor(o_custkey / -7.0) AS DOUBLE)"),
    "power": ("=POWER(B2,2)+B2^0.5", "o_custkey ** 2 + sqrt(o_custkey)"),
    "quotient": ("=QUOTIENT(B2,7)", "CAST(o_custkey // 7 AS DOUBLE)"),
    "round": ("=ROUND(B2/8,2)", "floor(round(o_custkey / 8.0 * 100, 9) + 0.5) / 100"),
    "rounddown": ("=ROUNDDOWN(B2/8,1)", "floor(round(o_custkey / 8.0 * 10, 9)) / 10"),
    "roundup": ("=ROUNDUP(B2/8,1)", "ceil(round(o_custkey / 8.0 * 10, 9)) / 10"),
    "mround": ("=MROUND(B2,8)", "floor(o_custkey / 8.0 + 0.5) * 8"),
    "sign": ("=SIGN(B2-700)", "CAST(sign(o_custkey - 700) AS DOUBLE)"),
    "sqrt": ("=SQRT(D2)", "sqrt(o_totalprice)"),
    "trunc": ("=TRUNC(-D2)", "-floor(o_totalprice)"),
    "exp": ("=EXP(B2/1000)", "exp(o_custkey / 1000.0)"),
    "ln": ("=LN(D2)", "ln(o_totalprice)"),
    "log": ("=LOG(D2,2)", "log10(o_totalprice) / log10(2)"),
    "log10": ("=LOG10(D2)", "log10(o_totalprice)"),
    "pi": ("=PI()*A2", "pi() * o_orderkey"),
    "if": ('=IF(D2>150000,"high","low")', "CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END"),
    "ifs": ('=IFS(D2>200000,"a",D2>100000,"b",TRUE,"c")', "CASE WHEN o_totalprice > 200000 THEN 'a' WHEN o_totalprice > 100000 THEN 'b' ELSE 'c' END"),
    "iferror": ("=IFERROR(D2/(B2-B2),-1)", "CAST(-1 AS DOUBLE)"),
    "ifna": ('=IFNA(IF(C2="O",D2,NA()),0)', "CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0.0 END"),
    "and": ('=AND(D2>100000,C2="o")', "o_totalprice > 100000 AND o_orderstatus = 'O'"),
    "or": ('=OR(D2>200000,C2="F")', "o_totalprice > 200000 OR o_orderstatus = 'F'"),
    "not": ("=NOT(D2>100000)", "NOT o_totalprice > 100000"),
    "xor": ('=XOR(D2>100000,C2="F")', "(o_totalprice > 100000) <> (o_orderstatus = 'F')"),
    "switch": ('=SWITCH(C2,"F","final","O","open","other")', "CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END"),
    "true": ("=IF(TRUE(),A2,0)", "CAST(o_orderkey AS DOUBLE)"),
    "false": ("=IF(FALSE(),A2,0)", "CAST(0 AS DOUBLE)"),
    "choose": ('=CHOOSE(MOD(A2,3)+1,"x","y","z")', "CASE o_orderkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END"),
    "column": ("=COLUMN(D2)", "CAST(4 AS DOUBLE)"),
    "left": ("=LEFT(F2,1)", "left(o_orderpriority, 1)"),
    "right": ("=RIGHT(F2,3)", "right(o_orderpriority, 3)"),
    "mid": ("=MID(F2,3,4)", "substring(o_orderpriority, 3, 4)"),
    "len": ("=LEN(F2)", "CAST(length(o_orderpriority) AS DOUBLE)"),
    "find": ('=IFERROR(FIND("U",F2),0)', "CAST(strpos(o_orderpriority, 'U') AS DOUBLE)"),
    "search": ('=IFERROR(SEARCH("u",F2),0)', "CAST(strpos(lower(o_orderpriority), 'u') AS DOUBLE)"),
    "substitute": ('=SUBSTITUTE(F2,"-","_")', "replace(o_orderpriority, '-', '_')"),
    "replace": ('=REPLACE(F2,1,2,"P")', "'P' || substring(o_orderpriority, 3)"),
    "trim": ('=TRIM("  "&F2&"   x ")', "trim(regexp_replace('  ' || o_orderpriority || '   x ', ' +', ' ', 'g'))"),
    "clean": ('=CLEAN(F2)', "regexp_replace(o_orderpriority, '[\\x00-\\x1f]', '', 'g')"),
    "upper": ("=UPPER(F2)", "upper(o_orderpriority)"),
    "lower": ("=LOWER(F2)", "lower(o_orderpriority)"),
    "concat": ('=CONCAT(C2,"-",A2)', "o_orderstatus || '-' || o_orderkey"),
    "textjoin": ('=TEXTJOIN("|",TRUE,C2,"",A2,F2)', "o_orderstatus || '|' || o_orderkey || '|' || o_orderpriority"),
    "text": ('=TEXT(E2,"yyyy-mm-dd")', "strftime(o_orderdate, '%Y-%m-%d')"),
    "text_number_by_row": ('=TEXT(A2,REPT("0",MOD(B2,9)+1))', "lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(length(CAST(o_orderkey AS VARCHAR)), o_custkey % 9 + 1) AS INTEGER), '0')"),
    "text_date_by_row": ('=TEXT(E2,IF(MOD(A2,2)=0,"yyyy/mm/dd","d.m.yy"))', "CASE o_orderkey % 2 WHEN 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%-d.%-m.%y') END"),
    "text_number": ('=TEXT(A2,"00000")', "lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(5, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0')"),
    "value": ('=VALUE("$"&A2&".5")', "CAST(o_orderkey + 0.5 AS DOUBLE)"),
    "numbervalue": ('=NUMBERVALUE(A2&",25",",",".")', "CAST(o_orderkey + 0.25 AS DOUBLE)"),
    "textbefore": ('=TEXTBEFORE(F2,"-")', "CASE WHEN contains(o_orderpriority, '-') THEN split_part(o_orderpriority, '-', 1) END"),
    "textafter": ('=TEXTAFTER(F2,"-")', "CASE WHEN contains(o_orderpriority, '-') THEN substring(o_orderpriority, strpos(o_orderpriority, '-') + 1) END"),
    "exact": ('=EXACT(C2,"f")', "o_orderstatus = 'f'"),
    "rept": ("=REPT(C2,3)", "repeat(o_orderstatus, 3)"),
    "regextest": ('=REGEXTEST(F2,"^[12]")', "regexp_matches(o_orderpriority, '^[12]')"),
    "regexextract": ('=REGEXEXTRACT(F2,"[A-Z]+")', "nullif(regexp_extract(o_orderpriority, '[A-Z]+'), '')"),
    "regexreplace": ('=REGEXREPLACE(F2,"[0-9]","#")', "regexp_replace(o_orderpriority, '[0-9]', '#', 'g')"),
    "date": ("=DATE(YEAR(E2),MONTH(E2)+14,1)", f"CAST(date_trunc('month', {_D}) + INTERVAL 14 MONTH AS DATE)"),
    "datevalue": ('=DATEVALUE(TEXT(E2,"yyyy-mm-dd"))', f"CAST(date_diff('day', DATE '1899-12-30', {_D}) AS DOUBLE)"),
    "day": ("=DAY(E2)", "CAST(day(o_orderdate) AS DOUBLE)"),
    "month": ("=MONTH(E2)", "CAST(month(o_orderdate) AS DOUBLE)"),
    "year": ("=YEAR(E2)", "CAST(year(o_orderdate) AS DOUBLE)"),
    "today": ("=TODAY()-TODAY()", "CAST(0 AS DOUBLE)"),
    "now": ("=IF(NOW()>=TODAY(),1,0)", "CAST(1 AS DOUBLE)"),
    "edate": ("=EDATE(E2,3)", f"CAST({_D} + INTERVAL 3 MONTH AS DATE)"),
    "eomonth": ("=EOMONTH(E2,1)", f"last_day(CAST({_D} + INTERVAL 1 MONTH AS DATE))"),
    "networkdays": ("=NETWORKDAYS(E2,E2+30)", f"(SELECT CAST(count(*) AS DOUBLE) FROM range(31) t(i) WHERE isodow({_D} + CAST(i AS INT)) < 6)"),
    "networkdays_intl": ('=NETWORKDAYS.INTL(E2,E2+30,"0000001")', f"(SELECT CAST(count(*) AS DOUBLE) FROM range(31) t(i) WHERE isodow({_D} + CAST(i AS INT)) < 7)"),
    "workday": ("=WORKDAY(E2,10)", f"(SELECT min(x) FROM (SELECT {_D} + CAST(i AS INT) AS x, count(*) FILTER (WHERE isodow({_D} + CAST(i AS INT)) < 6) OVER (ORDER BY i) AS n FROM range(1, 31) t(i)) WHERE n = 10)"),
    "workday_intl": ("=WORKDAY.INTL(E2,10,11)", f"(SELECT min(x) FROM (SELECT {_D} + CAST(i AS INT) AS x, count(*) FILTER (WHERE isodow({_D} + CAST(i AS INT)) < 7) OVER (ORDER BY i) AS n FROM range(1, 31) t(i)) WHERE n = 10)"),
    "weekday": ("=WEEKDAY(E2,2)", "CAST(isodow(o_orderdate) AS DOUBLE)"),
    "weeknum": ("=WEEKNUM(E2)", f"CAST(floor((dayofyear({_D}) - 1 + dayofweek(CAST(date_trunc('year', {_D}) AS DATE))) / 7) + 1 AS DOUBLE)"),
    "isoweeknum": ("=ISOWEEKNUM(E2)", "CAST(weekofyear(o_orderdate) AS DOUBLE)"),
    "days": ("=DAYS(DATE(2000,1,1),E2)", f"CAST(date_diff('day', {_D}, DATE '2000-01-01') AS DOUBLE)"),
    "datedif": ('=DATEDIF(E2,DATE(2024,6,30),"M")', f"CAST((2024 - year({_D})) * 12 + 6 - month({_D}) - CASE WHEN 30 < day({_D}) THEN 1 ELSE 0 END AS DOUBLE)"),
    "yearfrac": ("=YEARFRAC(E2,DATE(2024,6,30),3)", f"abs(date_diff('day', {_D}, DATE '2024-06-30')) / 365.0"),
    "time": ("=TIME(MOD(A2,30),30,0)", "((o_orderkey % 30 * 3600 + 1800) % 86400) / 86400.0"),
    "isblank": ("=ISBLANK(F2)", "o_orderpriority IS NULL"),
    "isnumber": ("=ISNUMBER(D2)", "o_totalprice IS NOT NULL"),
    "istext": ("=ISTEXT(F2)", "o_orderpriority IS NOT NULL"),
    "iserror": ('=ISERROR(FIND("U",F2))', "strpos(o_orderpriority, 'U') = 0"),
    "isna": ('=ISNA(IF(C2="O",1,NA()))', "o_orderstatus <> 'O'"),
    "islogical": ("=ISLOGICAL(D2>1)", "TRUE"),
    "na": ("=IFNA(NA(),A2)", "CAST(o_orderkey AS DOUBLE)"),
    "n": ("=N(C2)+N(D2>1)+N(A2)", "CAST(o_orderkey + CASE WHEN o_totalprice > 1 THEN 1 ELSE 0 END AS DOUBLE)"),
    "let": ("=LET(x,D2/2,y,x+1,x*y)", "o_totalprice / 2 * (o_totalprice / 2 + 1)"),
    "lambda": ("=LAMBDA(a,b,a*2+b)(A2,1)", "CAST(o_orderkey * 2 + 1 AS DOUBLE)"),
    "arithmetic": ("=-2^2+A2*10%-3/2", "4 + o_orderkey * 10 / 100.0 - 1.5"),
    "comparison": ('=IF(C2<>"o",A2>=5,A2<5)', "CASE WHEN lower(o_orderstatus) <> 'o' THEN o_orderkey >= 5 ELSE o_orderkey < 5 END"),
    "structured": ("=orders[@o_totalprice]/2", "o_totalprice / 2"),
    "scalar_share": ("=D2/SUM(D:D)", "o_totalprice / (SELECT sum(o_totalprice) FROM orders)"),
}
_DIGITS = {"power": 6, "sqrt": 8, "exp": 8, "ln": 8, "log": 8, "log10": 8, "pi": 6, "time": 10, "yearfrac": 8, "let": 2, "scalar_share": 12, "arithmetic": 6, "ceiling_math": 4, "abs": 6, "value": 4, "numbervalue": 4}

#: name -> (table, formula, SQL of one value)
CELLS = {
    "sum": ("lineitem", "=SUM(E:E)", "SELECT sum(l_quantity) AS v FROM lineitem", 2),
    "product": ("region", "=PRODUCT(A3:A6)", "SELECT CAST(product(r_regionkey) AS DOUBLE) AS v FROM region WHERE r_regionkey > 0", 2),
    "sumproduct": ("lineitem", "=SUMPRODUCT(F:F,G:G)", "SELECT sum(l_extendedprice * l_discount) AS v FROM lineitem", 2),
    "sumproduct_test": ("lineitem", '=SUMPRODUCT((I:I="R")*(E:E>10)*F:F)', "SELECT sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 10) AS v FROM lineitem", 2),
    "sumif": ("lineitem", '=SUMIF(E:E,">=30",F:F)', "SELECT sum(l_extendedprice) FILTER (WHERE l_quantity >= 30) AS v FROM lineitem", 2),
    "sumifs": ("lineitem", '=SUMIFS(F:F,I:I,"r",E:E,"<10")', "SELECT sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R' AND l_quantity < 10) AS v FROM lineitem", 2),
    "average": ("orders", "=AVERAGE(D:D)", "SELECT avg(o_totalprice) AS v FROM orders", 6),
    "averageif": ("orders", '=AVERAGEIF(C:C,"F",D:D)', "SELECT avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS v FROM orders", 6),
    "averageifs": ("orders", '=AVERAGEIFS(D:D,C:C,"F",F:F,"1*")', "SELECT avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%') AS v FROM orders", 6),
    "count": ("orders", "=COUNT(A:F)", "SELECT CAST(count(o_orderkey) + count(o_custkey) + count(o_totalprice) + count(o_orderdate) AS DOUBLE) AS v FROM orders", None),
    "counta": ("orders", "=COUNTA(F:F)", "SELECT CAST(count(o_orderpriority) AS DOUBLE) AS v FROM orders WHERE o_orderpriority <> ''", None),
    "countblank": ("orders", "=COUNTBLANK(F:F)", "SELECT CAST(count(*) FILTER (WHERE o_orderpriority IS NULL OR o_orderpriority = '') AS DOUBLE) AS v FROM orders", None),
    "countif": ("orders", '=COUNTIF(F:F,"*urgent")', "SELECT CAST(count(*) FILTER (WHERE lower(o_orderpriority) LIKE '%urgent') AS DOUBLE) AS v FROM orders", None),
    "countifs": ("orders", '=COUNTIFS(C:C,"<>F",D:D,">100000")', "SELECT CAST(count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_totalprice > 100000) AS DOUBLE) AS v FROM orders", None),
    "max": ("orders", "=MAX(D:D)", "SELECT max(o_totalprice) AS v FROM orders", None),
    "min": ("orders", "=MIN(D:D)", "SELECT min(o_totalprice) AS v FROM orders", None),
    "maxifs": ("orders", '=MAXIFS(D:D,C:C,"P")', "SELECT coalesce(max(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0) AS v FROM orders", None),
    "minifs": ("orders", '=MINIFS(D:D,C:C,"nothing")', "SELECT CAST(0 AS DOUBLE) AS v", None),
    "median": ("orders", "=MEDIAN(D:D)", "SELECT median(o_totalprice) AS v FROM orders", 6),
    "mode_sngl": ("lineitem", "=MODE.SNGL(E:E)", "SELECT CAST(q AS DOUBLE) AS v FROM (SELECT l_quantity AS q, count(*) AS n, min((l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)) AS f FROM lineitem GROUP BY 1 ORDER BY n DESC, f LIMIT 1)", None),
    "stdev_s": ("orders", "=STDEV.S(D:D)", "SELECT stddev_samp(o_totalprice) AS v FROM orders", 4),
    "stdev_p": ("orders", "=STDEV.P(D:D)", "SELECT stddev_pop(o_totalprice) AS v FROM orders", 4),
    "var_s": ("lineitem", "=VAR.S(E:E)", "SELECT var_samp(l_quantity) AS v FROM lineitem", 6),
    "var_p": ("lineitem", "=VAR.P(E:E)", "SELECT var_pop(l_quantity) AS v FROM lineitem", 6),
    "large": ("orders", "=LARGE(D:D,5)", "SELECT o_totalprice AS v FROM orders ORDER BY o_totalprice DESC LIMIT 1 OFFSET 4", None),
    "small": ("orders", "=SMALL(D:D,5)", "SELECT o_totalprice AS v FROM orders ORDER BY o_totalprice LIMIT 1 OFFSET 4", None),
    "percentile_inc": ("orders", "=PERCENTILE.INC(D:D,0.9)", "SELECT quantile_cont(o_totalprice, 0.9) AS v FROM orders", 6),
    "quartile_inc": ("orders", "=QUARTILE.INC(D:D,1)", "SELECT quantile_cont(o_totalprice, 0.25) AS v FROM orders", 6),
    "correl": ("lineitem", "=CORREL(E:E,F:F)", "SELECT corr(l_quantity, l_extendedprice) AS v FROM lineitem", 8),
    "rows": ("orders", "=ROWS(A:A)", "SELECT CAST(count(*) AS DOUBLE) AS v FROM orders", None),
    "columns": ("orders", "=COLUMNS(A:F)", "SELECT CAST(6 AS DOUBLE) AS v", None),
    "index": ("orders", "=INDEX(D:D,10)", "SELECT o_totalprice AS v FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 9", None),
    "hlookup": ("orders", '=HLOOKUP("O_TOTALPRICE",A1:F501,3,FALSE)', "SELECT o_totalprice AS v FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 1", None),
    "reduce": ("orders", "=REDUCE(0,D:D,LAMBDA(a,v,a+v/2))", "SELECT sum(o_totalprice / 2) AS v FROM orders", 2),
    "reduce_ordered": ("nation", '=REDUCE("",B2:B6,LAMBDA(a,v,a&LEFT(v,1)))', "SELECT string_agg(left(n_name, 1), '' ORDER BY n_nationkey) AS v FROM nation WHERE n_nationkey < 5", None),
    "match_next": ("orders", "=MATCH(100,A:A)", "SELECT CAST(count(*) AS DOUBLE) AS v FROM orders WHERE o_orderkey <= 100", None),
    "orders_argmax": ("orders", "=INDEX(F:F,MATCH(MAX(D:D),D:D,0))", "SELECT arg_max(o_orderpriority, o_totalprice) AS v FROM orders", None),
    "let_range": ("orders", "=LET(x,D:D,MAX(x)-MIN(x))", "SELECT max(o_totalprice) - min(o_totalprice) AS v FROM orders", 4),
    "sum_product_columns": ("lineitem", "=SUM(F:F*(1-G:G))", "SELECT sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem", 2),
}

#: name -> (table, other tables, formula, key, SQL): filled down, with joins.
JOINS = {
    "sumifs_by_row": ("customer", ("orders",), "=SUMIFS(orders!D:D,orders!B:B,A2)", "c_custkey", "SELECT c_custkey, round(coalesce((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey), 0), 2) AS v FROM customer", 2),
    "countifs_by_row": ("customer", ("orders",), '=COUNTIFS(orders!B:B,A2,orders!C:C,"F")', "c_custkey", "SELECT c_custkey, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS DOUBLE) AS v FROM customer", None),
    "xlookup": ("orders", ("customer",), '=XLOOKUP(B2,customer!A:A,customer!B:B,"none")', "o_orderkey", "SELECT o_orderkey, coalesce((SELECT c_name FROM customer WHERE c_custkey = o_custkey), 'none') AS v FROM orders", None),
    "xlookup_first": ("customer", ("orders",), "=XLOOKUP(A2,orders!B:B,orders!A:A,0)", "c_custkey", "SELECT c_custkey, CAST(coalesce((SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey), 0) AS DOUBLE) AS v FROM customer", None),
    "xlookup_last": ("customer", ("orders",), "=XLOOKUP(A2,orders!B:B,orders!A:A,0,0,-1)", "c_custkey", "SELECT c_custkey, CAST(coalesce((SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey), 0) AS DOUBLE) AS v FROM customer", None),
    "xlookup_next_smaller": ("customer", ("orders",), "=XLOOKUP(A2*7,orders!A:A,orders!D:D,-1,-1)", "c_custkey", "SELECT c_custkey, coalesce((SELECT arg_max(o_totalprice, o_orderkey) FROM orders WHERE o_orderkey <= c_custkey * 7), -1) AS v FROM customer", 4),
    "xlookup_next_larger": ("customer", ("orders",), "=XLOOKUP(A2*7,orders!A:A,orders!D:D,-1,1)", "c_custkey", "SELECT c_custkey, coalesce((SELECT arg_min(o_totalprice, o_orderkey) FROM orders WHERE o_orderkey >= c_custkey * 7), -1) AS v FROM customer", 4),
    "vlookup": ("customer", ("nation",), "=VLOOKUP(C2,nation!A:C,2,FALSE)", "c_custkey", "SELECT c_custkey, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS v FROM customer", None),
    "match": ("customer", ("nation",), "=MATCH(C2,nation!A:A,0)", "c_custkey", "SELECT c_custkey, CAST(c_nationkey + 1 AS DOUBLE) AS v FROM customer", None),
    "xmatch": ("customer", ("nation",), "=XMATCH(C2,nation!A:A)", "c_custkey", "SELECT c_custkey, CAST(c_nationkey + 1 AS DOUBLE) AS v FROM customer", None),
    "index_by_row": ("customer", ("nation",), "=INDEX(nation!B:B,C2+1)", "c_custkey", "SELECT c_custkey, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS v FROM customer", None),
    "rank_eq": ("part", (), "=RANK.EQ(E2,E:E)", "p_partkey", "SELECT p_partkey, CAST(rank() OVER (ORDER BY p_size DESC) AS DOUBLE) AS v FROM part", None),
    "rank_avg": ("part", (), "=RANK.AVG(E2,E:E,1)", "p_partkey", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS v FROM part", None),
    "row": ("orders", (), "=ROW()", "o_orderkey", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) + 1 AS DOUBLE) AS v FROM orders", None),
    "previous_row": ("orders", (), "=D3-D2", "o_orderkey", "SELECT o_orderkey, round(coalesce(lead(o_totalprice) OVER (ORDER BY o_orderkey), 0) - o_totalprice, 4) AS v FROM orders", 4),
    "anchored": ("orders", (), "=D2-$D$2", "o_orderkey", "SELECT o_orderkey, round(o_totalprice - first_value(o_totalprice) OVER (ORDER BY o_orderkey), 4) AS v FROM orders", 4),
    "proper": ("part", (), "=PROPER(B2)", "p_partkey", "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') AS v FROM part", None),
    "hour": ("events", (), "=HOUR(B2)", "event_id", "SELECT event_id, CAST(hour(ts) AS DOUBLE) AS v FROM events", None),
    "minute": ("events", (), "=MINUTE(B2)", "event_id", "SELECT event_id, CAST(minute(ts) AS DOUBLE) AS v FROM events", None),
    "second": ("events", (), "=SECOND(B2)", "event_id", "SELECT event_id, CAST(second(ts) AS DOUBLE) AS v FROM events", None),
}

#: name -> (table, others, formula, names, SQL, columns to round)
SPILLS = {
    "filter": ("orders", (), '=FILTER(A:D,(C:C="F")*(D:D>200000))', ["a", "b", "c", "d"], "SELECT o_orderkey AS a, o_custkey AS b, o_orderstatus AS c, o_totalprice AS d FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000", ()),
    "filter_empty": ("orders", (), '=FILTER(C:C,D:D<0,"none")', ["a"], "SELECT 'none' AS a", ()),
    "sort": ("part", (), "=TAKE(SORT(A:E,5,-1),20)", ["a", "b", "c", "d", "e"], "SELECT row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS _row, p_partkey AS a, p_name AS b, p_brand AS c, p_type AS d, p_size AS e FROM part ORDER BY p_size DESC, p_partkey LIMIT 20", ()),
    "sortby": ("orders", (), "=TAKE(SORTBY(A:B,C:C,1,D:D,-1),20)", ["a", "b"], "SELECT row_number() OVER (ORDER BY lower(o_orderstatus), o_totalprice DESC, o_orderkey) - 1 AS _row, o_orderkey AS a, o_custkey AS b FROM orders ORDER BY lower(o_orderstatus), o_totalprice DESC, o_orderkey LIMIT 20", ()),
    "unique": ("orders", (), "=UNIQUE(C:C)", ["a"], "SELECT row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS _row, o_orderstatus AS a FROM orders GROUP BY o_orderstatus", ()),
    "unique_once": ("orders", (), "=UNIQUE(B:B,,TRUE)", ["a"], "SELECT o_custkey AS a FROM orders GROUP BY o_custkey HAVING count(*) = 1", ()),
    "sequence": ("orders", (), "=SEQUENCE(4,3,10,5)", ["a", "b", "c"], "SELECT i AS _row, CAST(10 + i * 15 AS DOUBLE) AS a, CAST(15 + i * 15 AS DOUBLE) AS b, CAST(20 + i * 15 AS DOUBLE) AS c FROM range(4) t(i)", ()),
    "take": ("orders", (), "=TAKE(A:C,-5,2)", ["a", "b"], "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _row, a, b, FROM (SELECT o_orderkey, o_orderkey AS a, o_custkey AS b FROM orders ORDER BY o_orderkey DESC LIMIT 5)", ()),
    "drop": ("nation", (), "=DROP(A:C,20,1)", ["a", "b"], "SELECT n_nationkey - 20 AS _row, n_name AS a, n_regionkey AS b FROM nation WHERE n_nationkey >= 20", ()),
    "expand": ("region", (), "=EXPAND(A:A,7,2,0)", ["a", "b"], "SELECT i AS _row, CAST(coalesce(r_regionkey, 0) AS INTEGER) AS a, CAST(0 AS DOUBLE) AS b FROM range(7) t(i) LEFT JOIN region ON r_regionkey = i", ()),
    "vstack": ("region", ("nation",), "=VSTACK(B:B,nation!B:B)", ["a"], "SELECT row_number() OVER (ORDER BY p, k) - 1 AS _row, a FROM (SELECT 0 AS p, r_regionkey AS k, r_name AS a FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation)", ()),
    "hstack": ("nation", ("region",), "=HSTACK(B:B,region!B:B)", ["a", "b"], "SELECT n_nationkey AS _row, n_name AS a, r_name AS b FROM nation LEFT JOIN region ON r_regionkey = n_nationkey", ()),
    "tocol": ("region", (), "=TOCOL(A:B)", ["a"], "SELECT r_regionkey * 2 + i AS _row, CASE i WHEN 0 THEN CAST(r_regionkey AS VARCHAR) ELSE r_name END AS a FROM region, range(2) t(i)", ()),
    "torow": ("region", (), "=TOROW(B:B)", ["a", "b", "c", "d", "e"], "SELECT 0 AS _row, max(r_name) FILTER (WHERE r_regionkey = 0) AS a, max(r_name) FILTER (WHERE r_regionkey = 1) AS b, max(r_name) FILTER (WHERE r_regionkey = 2) AS c, max(r_name) FILTER (WHERE r_regionkey = 3) AS d, max(r_name) FILTER (WHERE r_regionkey = 4) AS e FROM region", ()),
    "wraprows": ("nation", (), '=WRAPROWS(B:B,10,"-")', [f"c{i}" for i in range(10)], "SELECT r AS _row, " + ", ".join(f"coalesce((SELECT n_name FROM nation WHERE n_nationkey = r * 10 + {i}), '-') AS c{i}" for i in range(10)) + " FROM range(3) t(r)", ()),
    "wrapcols": ("nation", (), '=WRAPCOLS(B:B,10,"-")', ["a", "b", "c"], "SELECT r AS _row, " + ", ".join(f"coalesce((SELECT n_name FROM nation WHERE n_nationkey = r + {10 * i}), '-') AS {x}" for i, x in enumerate("abc")) + " FROM range(10) t(r)", ()),
    "choosecols": ("nation", (), "=CHOOSECOLS(A:C,2,-1)", ["a", "b"], "SELECT n_nationkey AS _row, n_name AS a, n_regionkey AS b FROM nation", ()),
    "chooserows": ("nation", (), "=CHOOSEROWS(A:B,3,1,-1)", ["a", "b"], "SELECT CASE n_nationkey WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS _row, n_nationkey AS a, n_name AS b FROM nation WHERE n_nationkey IN (0, 2, 24)", ()),
    "groupby": ("orders", (), "=GROUPBY(C:C,D:D,SUM)", ["a", "b"], "SELECT CASE WHEN o_orderstatus IS NULL THEN 'Total' ELSE o_orderstatus END AS a, round(sum(o_totalprice), 4) AS b FROM orders GROUP BY ROLLUP (o_orderstatus)", ("b",)),
    "groupby_average": ("customer", (), "=GROUPBY(E:E,D:D,LAMBDA(x,AVERAGE(x)),0,0)", ["a", "b"], "SELECT row_number() OVER (ORDER BY c_mktsegment) - 1 AS _row, c_mktsegment AS a, round(avg(c_acctbal), 4) AS b FROM customer GROUP BY 2", ("b",)),
    "pivotby": ("orders", (), "=PIVOTBY(F:F,C:C,A:A,COUNT)", ["a", "b", "c", "d", "e"], "SELECT '' AS a, 'F' AS b, 'O' AS c, 'P' AS d, 'Total' AS e UNION ALL SELECT coalesce(o_orderpriority, 'Total'), CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS VARCHAR), CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS VARCHAR), CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS VARCHAR), CAST(count(*) AS VARCHAR) FROM orders GROUP BY ROLLUP (o_orderpriority)", ()),
    "map_two_sheets": ("orders", ("customer",), "=MAP(D:D,customer!D:D,LAMBDA(x,y,x-y))", ["a"], "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _row, o_totalprice FROM orders), c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _row, c_acctbal FROM customer) SELECT _row, round(o_totalprice - c_acctbal, 4) AS a FROM o LEFT JOIN c USING (_row)", ("a",)),
    "map": ("orders", (), "=MAP(D:D,LAMBDA(x,INT(x/1000)))", ["a"], "SELECT floor(o_totalprice / 1000) AS a FROM orders", ()),
    "byrow": ("nation", (), "=BYROW(A:C,LAMBDA(r,SUM(r)))", ["a"], "SELECT n_nationkey AS _row, CAST(n_nationkey + n_regionkey AS DOUBLE) AS a FROM nation", ()),
    "bycol": ("lineitem", (), "=BYCOL(E:H,LAMBDA(c,MAX(c)))", ["a", "b", "c", "d"], "SELECT 0 AS _row, max(l_quantity) AS a, max(l_extendedprice) AS b, max(l_discount) AS c, max(l_tax) AS d FROM lineitem", ()),
    "scan": ("orders", (), "=SCAN(0,D:D,LAMBDA(a,v,a+v))", ["a"], "SELECT row_number() OVER w - 1 AS _row, round(sum(o_totalprice) OVER w, 2) AS a FROM orders WINDOW w AS (ORDER BY o_orderkey)", ()),
    "scan_ordered": ("nation", (), '=SCAN("",B2:B5,LAMBDA(a,v,LEFT(v,1)&a))', ["a"], "SELECT n_nationkey AS _row, (SELECT string_agg(left(m.n_name, 1), '' ORDER BY m.n_nationkey DESC) FROM nation m WHERE m.n_nationkey <= n.n_nationkey) AS a FROM nation n WHERE n_nationkey < 4", ()),
    "makearray": ("orders", (), "=MAKEARRAY(3,4,LAMBDA(r,c,r*10+c))", ["a", "b", "c", "d"], "SELECT i AS _row, CAST((i + 1) * 10 + 1 AS DOUBLE) AS a, CAST((i + 1) * 10 + 2 AS DOUBLE) AS b, CAST((i + 1) * 10 + 3 AS DOUBLE) AS c, CAST((i + 1) * 10 + 4 AS DOUBLE) AS d FROM range(3) t(i)", ()),
    "textsplit": ("orders", (), '=TEXTSPLIT("a,b;c,d",",",";")', ["a", "b"], "SELECT * FROM (VALUES (0, 'a', 'b'), (1, 'c', 'd')) t(_row, a, b)", ()),
    "repeat_rows": ("lineitem", (), "=FILTER(A:E,COUNTIFS(A:A,A:A,B:B,B:B)>1)", ["a", "b", "c", "d", "e"], "SELECT l_orderkey AS a, l_partkey AS b, l_suppkey AS c, l_linenumber AS d, l_quantity AS e FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_partkey) > 1", ()),
    "array_constant": ("orders", (), '={1,2;3,4}', ["a", "b"], "SELECT * FROM (VALUES (0, CAST(1 AS DOUBLE), CAST(2 AS DOUBLE)), (1, CAST(3 AS DOUBLE), CAST(4 AS DOUBLE))) t(_row, a, b)", ()),
}


def queries() -> dict:
    out = {f"fn_{n}": _fill("orders", "o_orderkey", f, digits=_DIGITS.get(n)) for n, (f, _) in ON_ORDERS.items()}
    out |= {f"fn_{n}": _cell(t, f, digits=d) for n, (t, f, _, d) in CELLS.items()}
    out |= {f"fn_{n}": _fill(t, k, f, o, d) for n, (t, o, f, k, _, d) in JOINS.items()}
    for n, (t, o, f, names, sql, digits) in SPILLS.items():
        out[f"fn_{n}"] = _spill(t, f, names, o, order="_row" in sql, digits=digits if n != "scan" else ())
    scan = SPILLS["scan"]
    out["fn_scan"] = lambda spark, d: _spill(scan[0], scan[2], scan[3], order=True)(spark, d).withColumn("a", F.round("a", 2))
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for n, (_, sql) in ON_ORDERS.items():
        v = f"round({sql}, {_DIGITS[n]})" if n in _DIGITS else sql
        out[f"fn_{n}"] = f"SELECT o_orderkey, {v} AS v FROM orders"
    for n, (_, _, sql, d) in CELLS.items():
        out[f"fn_{n}"] = sql if d is None else f"SELECT round(v, {d}) AS v FROM ({sql})"
    for n, (_, _, _, _, sql, d) in JOINS.items():
        out[f"fn_{n}"] = sql
    for n, (_, _, _, _, sql, _) in SPILLS.items():
        out[f"fn_{n}"] = sql
    return out
