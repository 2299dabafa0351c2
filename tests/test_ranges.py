"""Aggregates over other rows, and fills that ask for them, against plain loops."""

import operator
import random

import pytest
from pyspark.sql import functions as F

from veilframe.formula import Workbook
from veilframe.formula.compile import Unsupported
from veilframe.formula.moving import as_regex, pattern_matches
from veilframe.sources import ranges as R

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
STATES = {"v": "sum", "n": "sum", "m": "max"}


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(1)
    points = [(r.choice(["a", "b", "b", "b", None]), r.choice([None, *range(12)]), r.randint(0, 30), float(r.randint(-50, 100)), 1) for _ in range(300)]
    queries = [(r.choice(["a", "b", "c", None]), r.choice([None, *range(-2, 14)]), r.randint(-2, 33), i) for i in range(200)]
    p = spark.createDataFrame(points, "k string, x int, y int, v double, n int").withColumn("m", F.col("v")).cache()
    return points, queries, p, spark.createDataFrame(queries, "k string, x int, y int, _id long").cache()


def compare(df, want):
    got = {t["_id"]: (t["v"], t["n"], t["m"]) for t in df.collect() if t["n"] is not None}
    assert got == {i: (sum(g), len(g), max(g)) for i, g in want.items() if g}


@pytest.mark.parametrize("op", OPS)
def test_below(tables, op):
    points, queries, p, q = tables
    want = {i: [v for k, x, _, v, _ in points if k == kq and None not in (x, xq) and OPS[op](x, xq)] for kq, xq, _, i in queries}
    compare(R.below(p.select("k", "x", "v", "n", "m"), q.select("k", "x", "_id"), ["k"], "x", op, STATES), want)
    want = {i: [v for _, x, _, v, _ in points if None not in (x, xq) and OPS[op](x, xq)] for _, xq, _, i in queries}
    compare(R.below(p.select("x", "v", "n", "m"), q.select("x", "_id"), [], "x", op, STATES), want)


@pytest.mark.parametrize("a,b,leaf", [("<", ">=", 4), (">=", "<=", 64), (">", ">", 1), ("<=", "<", 16)])
def test_below_both(tables, monkeypatch, a, b, leaf):
    points, queries, p, q = tables
    monkeypatch.setattr(R, "LEAF", leaf)
    want = {i: [v for k, x, y, v, _ in points if k == kq and None not in (x, xq) and OPS[a](x, xq) and OPS[b](y, yq)] for kq, xq, yq, i in queries}
    compare(R.below_both(p, q, ["k"], ("x", a), ("y", b), STATES), want)


def test_below_both_sorts_rows_a_fixed_number_of_times(spark, tables, monkeypatch):
    """No running aggregate over copies of rows for each level; points without a value add nothing."""
    points, queries, p, q = tables
    monkeypatch.setattr(R, "LEAF", 32)
    monkeypatch.setattr(R, "below", None)
    some = p.withColumns({n: F.when(F.col("y") % 3 > 0, F.col(n)) for n in STATES})
    want = {i: [v for _, x, y, v, _ in points if y % 3 and None not in (x, xq) and x < xq and y >= yq] for _, xq, yq, i in queries}
    compare(R.below_both(some.drop("k"), q.drop("k"), [], ("x", "<"), ("y", ">="), STATES), want)


@pytest.fixture(scope="module")
def placed(spark):
    r = random.Random(2)
    values = [float(r.randint(-9, 99)) for _ in range(230)]
    return values, spark.createDataFrame([(i, v, 1, v) for i, v in enumerate(values)], "_row long, v double, n int, m double").cache()


@pytest.mark.parametrize("block", [8, 128])
def test_inside(spark, placed, monkeypatch, block):
    values, points = placed
    monkeypatch.setattr(R, "BLOCK", block)
    r = random.Random(3)
    asked = [(i, r.randint(-20, 250), r.randint(-20, 250)) for i in range(150)] + [(1000 + i, i, i + r.randint(0, 30)) for i in range(225)]
    df = R.inside(points, spark.createDataFrame(asked, "_id long, _lo long, _hi long"), STATES, len(values) - 1)
    compare(df, {i: values[max(0, lo) : max(0, hi + 1)] for i, lo, hi in asked})


def test_inside_deals_rows_out_by_their_number(spark, placed, monkeypatch):
    """A task's sorts don't grow with the table: there are more tasks."""
    from veilframe.sources import rows

    values, points = placed
    monkeypatch.setattr(rows, "TASK_ROWS", 16, raising=False)
    monkeypatch.setattr(R, "BLOCK", 8)
    asked = spark.range(230).select(F.col("id").alias("_id"), F.col("id").alias("_lo"), (F.col("id") + 40).alias("_hi"))
    df = R.inside(points, asked, STATES, 229)
    assert df.rdd.getNumPartitions() == 15
    compare(df, {i: values[i : i + 41] for i in range(230)})


def test_inside_sorts_no_queries(spark, placed, monkeypatch):
    """Queries pass by what they look up: many may share an end, and nothing of theirs is put together again by a sort or an aggregate."""
    from veilframe.sources import rows

    values, points = placed
    monkeypatch.setattr(R, "BLOCK", 8)
    asked = spark.range(400).select(F.col("id").alias("_id"), F.lit(3).cast("long").alias("_lo"), F.when(F.col("id") % 2 == 0, 220).otherwise(F.col("id")).cast("long").alias("_hi"))
    asked = asked.withColumn("_lo", F.least("_lo", "_hi"))
    df = R.inside(points, asked, STATES, 229)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    aggregates = [x for x in plan.splitlines() if "HashAggregate" in x or "SortAggregate" in x]
    assert aggregates and not any("_id" in x for x in aggregates)
    compare(df, {i: values[min(3, hi) : hi + 1] for i in range(400) for hi in [220 if i % 2 == 0 else i]})
    monkeypatch.setattr(rows, "TASK_ROWS", 50)
    assert R.inside(points, asked, STATES, 229, 400).rdd.getNumPartitions() == 8  # by the larger of both numbers


def test_positions_are_sorted_by_a_known_number_of_rows(spark, monkeypatch):
    """A sheet's range sort, and one whose rows are known, gets more tasks as it grows, not larger ones."""
    from veilframe.sources import rows

    monkeypatch.setattr(rows, "TASK_ROWS", 16)
    told, ranged = [], rows._ranged
    monkeypatch.setattr(rows, "_ranged", lambda df, keys, *n: told.extend(n) or ranged(df, keys, *n))
    book = Workbook(spark)
    sheet = book.add("t", spark.range(230).withColumn("v", F.col("id") * 2.0), ["id"])
    assert [r._row for r in sheet.rows().orderBy("id").collect()] == list(range(230))
    assert told == [230] and sheet.end == 229
    parts = ranged(spark.range(230), ["id"], 230).groupBy("_part").count().collect()
    assert len(parts) > 8 and max(r["count"] for r in parts) <= 48
    empty = book.add("none", spark.range(0), ["id"])
    assert empty.rows().count() == 0 and empty.end == -1


def test_scans_of_long_sheets_get_more_tasks(spark, monkeypatch):
    """A task that deals its rows out to many holds them all, so it may not read ever more of them; short sheets change nothing."""
    from veilframe.sources import rows

    key = "spark.sql.files.minPartitionNum"
    try:
        Workbook(spark).add("t", spark.range(230), ["id"]).rows()
        assert spark.conf.get(key, None) is None
        monkeypatch.setattr(rows, "SPLIT_ROWS", 16, raising=False)
        for n, least in ((230, 15), (100, 15)):  # never lowered
            assert Workbook(spark).add("t", spark.range(n), ["id"]).rows().count() == n
            assert spark.conf.get(key, None) == str(least)
    finally:
        spark.conf.unset(key)


@pytest.mark.parametrize("lo,hi", [(0, 2), (-5, -1), (-3, 4), (3, 9), (0, 0)])
def test_sliding(spark, placed, monkeypatch, lo, hi):
    values, points = placed
    monkeypatch.setattr(R, "TILE", 16)
    df = R.sliding(points, spark.range(240).select(F.col("id").alias("_row")), lo, hi, STATES)
    compare(df.withColumnRenamed("_row", "_id"), {i: values[max(0, i + lo) : max(0, i + hi + 1)] for i in range(240)})


@pytest.mark.parametrize("offset", [0, -3, 4])
def test_upto(spark, placed, offset):
    values, points = placed
    rows = spark.range(240).select(F.col("id").alias("_row"))
    compare(R.upto(points, rows, offset, STATES, 229).withColumnRenamed("_row", "_id"), {i: values[: max(0, i + offset + 1)] for i in range(240)})
    compare(R.upto(points, rows, offset, STATES, 229, backward=True).withColumnRenamed("_row", "_id"), {i: values[max(0, i + offset) :] for i in range(240)})


def test_no_window_is_over_all_rows_and_nothing_is_nested(spark, placed):
    _, points = placed
    rows = spark.range(240).select(F.col("id").alias("_row"))
    asked = rows.select(F.col("_row").alias("_id"), F.col("_row").alias("_lo"), (F.col("_row") * 2).alias("_hi"))
    for df in (R.sliding(points, rows, 0, 5, STATES), R.inside(points, asked, STATES, 229)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("pattern,fits,fails", [("a*", ["a", "ABC"], ["ba", ""]), ("?b*", ["ab", "xbc"], ["b", "bb b"[:1]]), ("x~*y", ["x*y"], ["xy", "xzy"]), ("~~z", ["~z"], ["z"]), ("a.b", ["A.B"], ["axb"]), ("*", ["", "any\nline"], []), ("a?\n", [], ["ab"]), ("(a)[b]*$", ["(a)[b]c$"], ["ab$"])])
def test_patterns(spark, pattern, fits, fails):
    texts = [t.lower() for t in fits + fails]
    df = spark.createDataFrame([(t, pattern) for t in texts], "t string, p string")
    got = {r.t: r.hit for r in df.select("t", F.rlike("t", as_regex(F.col("p"))).alias("hit")).collect()}
    assert got == {t.lower(): t in fits for t in fits + fails}
    points = spark.createDataFrame([(t, 1.0) for t in fits + fails], "t string, v double")
    found = pattern_matches(points, df.select(F.lower("p").alias("_pattern")).distinct(), "t", {"v": "sum"}, []).collect()
    assert [r.v for r in found] == ([float(len(fits))] if fits else [])


ROWS = [(1, "a", 10.0), (2, "b", 20.0), (3, "a", 30.0), (4, "c", 40.0)]
FILLED = {
    "=SUM(C2:C3)": [30, 50, 70, 40], "=SUM($C$2:C2)": [10, 30, 60, 100], "=SUM(A2:C2)": [11, 22, 33, 44], '=COUNTIF(B:B,"<>"&B2)': [2, 3, 2, 3], '=COUNTIF(B:B,B2&"*")': [2, 1, 2, 1], '=COUNTIF(C:C,">"&C2)': [3, 2, 1, 0],
    "=COUNTIF(B$2:B2,B2)": [1, 1, 2, 1], "=SUM(C2:C$5)": [100, 90, 70, 40], "=SUM(C$3:C2)": [30, 20, 50, 90], "=AVERAGE(C1:C3)": [15, 20, 30, 35], "=MAX(C2:C$3)": [20, 20, 30, 40], "=C2-C1": [None, 10, 10, 10], "=SUM(C2:INDEX(C:C,A2))": [10, 20, 30, 40],
    "=SUM(C$2:INDEX(C:C,5-A2))": [100, 60, 30, 10], '=SUMIFS(C:C,C:C,">="&C2,B:B,B2)': [40, 20, 30, 40], '=MAXIFS(C:C,B:B,"<>"&B2)': [40, 40, 40, 30], '=SUMIFS(C:C,C:C,">="&C2-10,C:C,"<="&C2+10)': [30, 60, 90, 70], "=SUMPRODUCT((B$2:B$5=B2)*C$2:C$5)": [40, 20, 40, 40],
    "=SUMPRODUCT(--(C:C<C2),C:C)": [0, 10, 30, 60], "=COUNTBLANK(C2:C4)": [0, 0, 1, 2], "=COUNTA(B1:B2)": [2, 2, 2, 2], '=XLOOKUP(B2&"?",B:B,A:A,0,2)': [0, 0, 0, 0], '=MATCH("*"&B2,B:B,0)': [1, 2, 1, 4], '=COUNTIF(C2:C3,">15")': [1, 2, 2, 1], '=SUMIF(C2:C4,">"&C2)': [50, 70, 40, 0],
    '=COUNTIFS(C:C,">"&C2,A:A,"<"&A2+2)': [1, 1, 1, 0], "=MIN(C2:C100)": [10, 20, 30, 40], '=COUNTIF(C:C,">"&$C$3)': [2, 2, 2, 2], '=SUMIF(B:B,"<>"&B2&"*",C:C)': [60, 80, 60, 60],
}


def test_filled_formulas(spark):
    book = Workbook(spark)
    book.add("t", spark.createDataFrame(ROWS, "id long, k string, v double"), ["id"])
    names = {f"f{i}": f for i, f in enumerate(FILLED)}
    for some in (list(names)[::3], list(names)[1::3], list(names)[2::3]):  # several at a time, as they share joins
        got = sorted(book.fill({n: names[n] for n in some}, "t").collect(), key=lambda r: r.id)
        assert {names[n]: [r[n] for r in got] for n in some} == {names[n]: FILLED[names[n]] for n in some}


def test_ranges_from_a_fixed_row_on_ask_for_one_order(spark, monkeypatch):
    """B$2:B2 goes by one running aggregate, whichever of its ends is read first."""
    from veilframe.formula import functions

    monkeypatch.setattr(functions, "below_both", None)
    book = Workbook(spark)
    book.add("t", spark.createDataFrame(ROWS, "id long, k string, v double"), ["id"])
    got = sorted(book.fill({"n": "=COUNTIF(B$2:B2,B2)", "m": "=COUNTIF(B2:B$2,B2)", "s": "=SUMIF(B$2:B3,B2,C$2:C3)"}, "t").collect(), key=lambda r: r.id)
    assert [(r.n, r.m, r.s) for r in got] == [(1, 1, 10), (1, 1, 20), (2, 2, 40), (1, 1, 40)]


@pytest.mark.parametrize("formula", ["=MEDIAN(C2:C3)", "=SUM(C2:C3*2)", "=XLOOKUP(A2,A2:A3,C2:C3)", "=SUM(FILTER(C:C,B:B=B2))", "=SORT(C2:C3)", "=SUM(A1:C2 B1:C3)", '=COUNTIFS(A:A,">"&A2,C:C,">"&C2,A:A,"<"&C2)'])
def test_what_isnt_built_is_refused(spark, formula):
    book = Workbook(spark)
    book.add("t", spark.createDataFrame(ROWS, "id long, k string, v double"), ["id"])
    with pytest.raises(Unsupported):
        book.fill({"x": formula}, "t").collect()


def test_cells_that_hold_wildcards_or_operators(spark):
    book = Workbook(spark)
    book.add("t", spark.createDataFrame([(1, "a*"), (2, "ab"), (3, "a*c")], "id long, k string"), ["id"])
    assert [r.n for r in sorted(book.fill({"n": "=COUNTIF(B:B,B2)"}, "t").collect(), key=lambda r: r.id)] == [3, 1, 1]
    book.add("u", spark.createDataFrame([(1, ">1"), (2, "b")], "id long, k string"), ["id"])
    with pytest.raises(Unsupported):
        book.fill({"n": "=COUNTIF(B:B,B2)"}, "u")


def test_fills_of_blank_cells_and_of_no_rows(spark):
    book = Workbook(spark)
    book.add("t", spark.createDataFrame([(1, None, None), (2, "x", 5.0), (3, None, None)], "id long, k string, v double"), ["id"])
    got = sorted(book.fill({"s": "=SUM(C2:C3)", "n": "=COUNT(C$2:C2)", "b": "=COUNTBLANK(B2:C2)", "m": "=MAX(C1:C2)", "d": '=COUNTIF(B:B,"<>"&B2)'}, "t").collect(), key=lambda r: r.id)
    assert [(r.s, r.n, r.b, r.m, r.d) for r in got] == [(5, 0, 2, 0, 1), (5, 1, 0, 5, 2), (0, 1, 2, 5, 1)]
    book.add("e", spark.createDataFrame([], "id long, v double"), ["id"])
    assert book.fill({"s": "=SUM(B$2:B2)", "m": "=MAX(B2:B4)"}, "e").collect() == []


def test_tables_of_a_fill_can_be_freed(spark):
    import os
    from urllib.parse import urlparse

    from veilframe.sources.rows import shared_dir, temporary

    root = urlparse(shared_dir(spark)).path
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with temporary(spark):
        book = Workbook(spark)
        book.add("t", spark.createDataFrame(ROWS, "id long, k string, v double"), ["id"])
        got = book.fill({"s": "=SUM(C$2:C2)"}, "t").collect()
        assert set(os.listdir(root)) > before
    assert sorted(r.s for r in got) == [10, 30, 60, 100] and set(os.listdir(root)) == before


def test_lookups_of_headers_by_row_and_correlation_of_two_sheets(spark):
    book = Workbook(spark)
    book.add("t", spark.createDataFrame([(1, "North", 2.0), (2, "south", 5.0), (3, "east", 1.0)], "id long, k string, v double"), ["id"])
    book.add("r", spark.createDataFrame([(1, 10.0, 20.0), (2, 30.0, 7.0), (3, 31.0, 8.0)], "n long, north double, south double"), ["n"])
    got = sorted(book.fill({"a": "=HLOOKUP(B2,r!B:C,3)", "h": '=IFERROR(HLOOKUP(B2,r!B:C,1),"none")'}, "t").collect(), key=lambda x: x.id)
    assert [(x.a, x.h) for x in got] == [(30, "north"), (7, "south"), (None, "none")]
    x, y = [2.0, 5.0, 1.0], [10.0, 30.0, 31.0]
    mx, my = sum(x) / 3, sum(y) / 3
    want = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
    assert book.cell("=CORREL(C2:C4,r!B2:B4)", "t").first()[0] == pytest.approx(want)
    assert book.cell("=CORREL(C:C,r!B:B)", "t").first()[0] == pytest.approx(want)
    assert book.cell("=CORREL(C2:C3,r!B:B)", "t").first()[0] is None
