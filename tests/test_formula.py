"""Lexer, parser, gate and compiler."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.formula import ALLOWED, FUNCTIONS, Context, FormulaError, Workbook, check
from veilframe.formula import syntax as S
from veilframe.formula.gate import WHY, combined, covered, lineage, qualified, whole_columns
from veilframe.plans.rule_queries import FORMULAS

CTX = Context("Sheet1", [S.Area("Sheet1", 0, 0, 500, 5), S.Area("Regions", 0, 0, 4, 1)], ["Sheet1"], {"Orders": S.Area("Sheet1", 0, 0, 500, 5)})


STOCK = Context("Stock", [S.Area("Stock", 0, 0, 899, 3), S.Area("Rates", 0, 0, 39, 1)], ["Stock", "Rates"], {"Lots": S.Area("Stock", 0, 0, 899, 3)})


@pytest.mark.parametrize("formula,ok", FORMULAS)
def test_gate(formula, ok):
    assert check(formula.format(r=31, n=70213, w="lot"), STOCK).ok is ok


@pytest.mark.parametrize(
    "formula,code",
    [("=WEBSERVICE(A2)", "G-FUNC"), ("=Secret", "G-NAME"), ("=SUM(Z1:Z9)", "G-REF"), ('="http://x"', "G-URL"), ("=Nowhere!A1", "G-EXT"), ("A1", "G-START"), ("=" + "1" * 2001, "G-LEN"), ("=1+", "G-PARSE"), ("=" + "(" * 200 + "1" + ")" * 200, "G-DEPTH"), ("=A1:INDEX(A:A,3)", "G-REF"), ("=LET(A1,2,3)", "G-NAME")],
)
def test_codes(formula, code):
    assert code in {c for c, _ in check(formula, CTX).reasons}


def test_every_function_compiles_and_every_refusal_has_a_reason():
    assert set(FUNCTIONS) == ALLOWED and len(ALLOWED) == 154 and len(WHY) == 25 and not ALLOWED & set(WHY)


def test_unreadable_names_shadow_functions():
    assert not check("=MAP(A2:A3,ABS)", Context("Sheet1", CTX.allowed, names=None)).ok
    assert check("=MAP(A2:A3,ABS)", Context("Sheet1", CTX.allowed)).ok


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_gate_never_raises(text):
    check(text, CTX)
    check("=" + text, CTX)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["A1", "$B$2:C9", '"x"', "SUM(", ")", ",", "+", "&", "{1,2}", "Orders[a]", " ", "%", "@", "#", "LET(x,", "-", "1e5", "'My S'!A1", "TRUE"]), max_size=25))
def test_gate_on_token_soup_and_tokens_cover_the_text(parts):
    text = "=" + "".join(parts)
    check(text, CTX)
    try:
        tokens = S.tokenize(text)
    except FormulaError:
        return
    assert "=" + "".join(t.text for t in tokens) == text


@given(st.integers(0, S.MAX_COLUMN - 1))
def test_letters(i):
    assert S.letters_to_index(S.index_to_letters(i)) == i


def test_addresses():
    assert S.parse_address("'My S'!$A$1:b2") == S.Area("My S", 0, 0, 1, 1)
    assert S.parse_address("C:A").text() == "A:C" and S.parse_address("B3").text() == "B3"
    with pytest.raises(FormulaError):
        S.parse_address("not one!")


def test_union_of_rectangles():
    left, right, low = S.Area("s", 0, 0, 5, 1), S.Area("s", 0, 2, 5, 3), S.Area("s", 6, 0, 9, 3)
    assert covered(S.Area("s", 0, 0, 9, 3), [left, right, low])
    assert not covered(S.Area("s", 0, 0, 9, 3), [left, low])
    assert not covered(S.Area("s", 0, 0, 9, 4), [left, right, low])
    r = random.Random(1)
    for _ in range(200):
        areas = [S.Area("s", a, b, a + r.randrange(4), b + r.randrange(4)) for a, b in ((r.randrange(6), r.randrange(6)) for _ in range(4))]
        t = S.Area("s", 1, 1, 4, 4)
        cells = all(any(a.top <= y <= a.bottom and a.left <= x <= a.right for a in areas) for y in range(1, 5) for x in range(1, 5))
        assert covered(t, areas) is cells


def test_precedence():
    def value(node):
        if isinstance(node, S.Literal):
            return node.value
        if isinstance(node, S.Percent):
            return value(node.operand) / 100
        if isinstance(node, S.Unary):
            return -value(node.operand) if node.op == "-" else value(node.operand)
        a, b = value(node.left), value(node.right)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "^": lambda: a**b, "=": lambda: a == b, "&": lambda: f"{a:g}{b:g}"}[node.op]()

    for text, want in [("=-2^2", 4), ("=2^3^2", 64), ("=1+2*3", 7), ("=50%*2", 1), ("=2*3=6", True), ("=1&2+3", "15"), ("=-(1+2)", -3), ("=10-2-3", 5)]:
        assert value(S.parse(text)) == want, text


def test_helpers():
    assert qualified("=SUM(A1:B2,C:C)", "My S") == "=SUM('My S'!A1:B2,'My S'!C:C)"
    assert whole_columns("=SUM(A:B)+C3") == ["A:B"]
    assert [a.text() for a in lineage('=A1&"B2"&T!C:C', "s")] == ["s!A1", "T!C:C"]
    bad = check("=Secret", CTX)
    assert combined(bad, bad).reasons == bad.reasons and not combined(check("=A2", CTX), bad).ok
    assert check("=A2", CTX, 400).ok and not check("=A2", CTX, 800).ok and check("=$A$2", CTX, 800).ok


@pytest.fixture(scope="module")
def book(spark):
    b = Workbook(spark)
    b.add("T", spark.createDataFrame([(1, "Ana", 10.0, None), (2, "bob", None, "x"), (3, "ANA", -7.5, ""), (4, None, 0.0, "y")], "k int, name string, n double, s string"), ["k"])
    return b


@pytest.mark.parametrize(
    "formula,want",
    [
        ("=SUM(C:C)", 2.5), ("=COUNTA(B:B)", 3), ("=COUNTBLANK(D:D)", 2), ("=COUNT(A:C)", 7), ("=MAX(D:D)", 0), ('=COUNTIF(B:B,"ana")', 2), ('=COUNTIF(B:B,"?n*")', 2), ('=COUNTIF(D:D,"")', 2), ('=COUNTIF(C:C,"<>0")', 3),
        ('=AVERAGEIF(B:B,"nobody",C:C)', None), ('=XLOOKUP("ANA",B:B,A:A)', 1), ('=XLOOKUP("ANA",B:B,A:A,,0,-1)', 3), ('=XLOOKUP("b*",B:B,A:A,,2)', 2), ("=INDEX(C:C,2)", None), ("=SUM(C2:C3)", 10), ("=C2/0", None), ('=IFERROR(1/0,"e")', "e"),
        ("=MOD(-7,3)", 2), ("=MOD(7,-3)", -2), ("=ROUND(2.675,2)", 2.68), ("=ROUND(-2.5,0)", -3), ("=CEILING.MATH(-5.5,2)", -4), ("=CEILING.MATH(-5.5,2,1)", -6), ("=FLOOR.MATH(-5.5,2)", -6), ("=INT(-1.5)", -2), ("=TRUNC(-1.9)", -1), ("=QUOTIENT(-7,2)", -3), ("=MROUND(-7,-2)", -8), ("=MROUND(7,-2)", None),
        ('=PROPER("o\'brien mc-x 2nd")', "O'Brien Mc-X 2Nd"), ('=SUBSTITUTE("a-b-c","-","+",2)', "a-b+c"), ('=TEXTBEFORE("a-b-c","-",-1)', "a-b"), ('=TEXTAFTER("a-b-c","-",2)', "c"), ('=TEXTJOIN(",",TRUE,"a","",B2:B4)', "a,Ana,bob,ANA"), ('=TEXT(1234.5,"#,##0.00")', "1,234.50"), ('=TEXT(0.256,"0.0%")', "25.6%"), ('=VALUE("(1,250.5)")', -1250.5), ('=VALUE("x")', None), ('=SEARCH("?b","xab")', 2), ('="a"="A"', True), ('=EXACT("a","A")', False),
        ("=YEARFRAC(DATE(2024,1,31),DATE(2024,3,1),0)", 31 / 360), ("=YEARFRAC(DATE(2023,1,1),DATE(2024,7,1),1)", 547 / 365.5), ('=DATEDIF(DATE(2024,1,31),DATE(2024,3,1),"MD")', 1), ("=WEEKDAY(DATE(2024,1,1))", 2), ("=WEEKNUM(DATE(2024,1,7))", 2), ("=DATE(2024,14,1)-DATE(2025,1,31)", 1), ("=NETWORKDAYS(DATE(2024,1,1),DATE(2024,1,7))", 5), ("=NETWORKDAYS(DATE(2024,1,7),DATE(2024,1,1))", -5), ("=WORKDAY(DATE(2024,1,5),-1)-DATE(2024,1,4)", 0), ("=WORKDAY(DATE(2024,1,5),1,DATE(2024,1,8))-DATE(2024,1,9)", 0), ("=HOUR(0.5)", 12), ("=NETWORKDAYS(1,7,A:A)", 2),
        ("=REDUCE(1,C2:C2,LAMBDA(a,v,a*v))", 10), ("=LET(f,LAMBDA(x,x*2),f(f(3)))", 12), ('=SWITCH(3,1,"a","z")', "z"), ('=IFS(FALSE,1)', None), ("=XOR(TRUE,TRUE,TRUE)", True), ("=N(TRUE)+N(\"x\")", 1), ("=SUM({1,2;3,4})", 10), ("=ROWS(A1:A10)", 10), ("=ISBLANK(D2)", True), ("=ISERROR(1/0)", True), ("=PERCENTILE.INC(A:A,0.25)", 1.75), ("=MEDIAN(A:A)", 2.5), ("=MODE.SNGL(A:A)", None), ("=LARGE(A:A,9)", None),
    ],
)
def test_values(book, formula, want):
    got = book.cell(formula, "T").first()[0]
    assert got == want or (isinstance(want, (int, float)) and not isinstance(want, bool) and got is not None and math.isclose(got, want, abs_tol=1e-9)), got


def test_fill_down_blanks_count_as_zero_and_empty_text(book):
    rows = book.fill({"a": "=C2+1", "b": '=B2&"!"', "c": "=A1", "d": "=SUMIFS(C:C,B:B,B2)"}, "T", keep=["k"]).orderBy("k").collect()
    assert [r["a"] for r in rows] == [11, 1, -6.5, 1] and [r["b"] for r in rows] == ["Ana!", "bob!", "ANA!", "!"]
    assert [r["d"] for r in rows][:3] == [2.5, 0, 2.5]
    with pytest.raises(FormulaError):
        book.fill({"K": "=1"}, "T")


def test_plans_join_instead_of_looping(book):
    plan = book.fill({"v": "=XLOOKUP(A2,A:A,B:B)"}, "T")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "Cartesian" not in plan


def test_rank_of_rows(book):
    got = {r["k"]: r["v"] for r in book.fill({"v": "=RANK.AVG(A2,A:A)"}, "T", keep=["k"]).collect()}
    assert got == {1: 4, 2: 3, 3: 2, 4: 1}


@pytest.fixture(scope="module")
def numbers_book(spark):
    r = random.Random(12)
    rows = [(k, None if k % 11 == 0 else round(r.uniform(0.9, 1.1), 3)) for k in range(120)]
    b = Workbook(spark)
    b.add("N", spark.createDataFrame(rows, "k int, x double").repartition(5), ["k"])
    return b, [x for _, x in rows]


@pytest.mark.parametrize("merged", [0, 1_000_000])
def test_percentiles_by_ranks(numbers_book, monkeypatch, merged):
    from veilframe.formula import functions

    monkeypatch.setattr(functions, "MERGED_ROWS", merged)
    b, x = numbers_book
    s = sorted(v for v in x if v is not None)

    def want(p):
        at = p * (len(s) - 1)
        return s[math.floor(at)] + (s[math.ceil(at)] - s[math.floor(at)]) * (at - math.floor(at))

    for formula, value in (("=MEDIAN(B:B)", want(0.5)), ("=PERCENTILE.INC(B:B,0.37)", want(0.37)), ("=QUARTILE.INC(B:B,3)", want(0.75)), ("=PERCENTILE.INC(B:B,1)", s[-1]), ("=LARGE(B:B,COUNT(B:B)/2)", s[::-1][len(s) // 2 - 1]), ("=SMALL(B:B,COUNT(B:B))", s[-1]), ("=PERCENTILE.INC(B:B,1/COUNT(B:B))", want(1 / len(s)))):
        assert abs(b.cell(formula, "N").first()[0] - value) < 1e-9, formula
    assert b.cell("=PERCENTILE.INC(B:B,1.5)", "N").first()[0] is None


def test_spread_of_several_values(numbers_book):
    b, _ = numbers_book
    for formula, value in (("=MEDIAN(4,1,3,10)", 3.5), ("=MEDIAN(7,1,3)", 3), ("=STDEV.S(2,4,4,4,5,5,7,9)", math.sqrt(32 / 7)), ("=STDEV.P(2,4,4,4,5,5,7,9)", 2), ("=VAR.S(1,2)", 0.5), ("=VAR.P(1,2)", 0.25)):
        assert abs(b.cell(formula, "N").first()[0] - value) < 1e-9, formula


def test_running_folds(numbers_book, monkeypatch):
    from veilframe.formula import arrays

    b, x = numbers_book
    get = lambda f: [r["v"] for r in b.spill(f, "N", ["v"]).collect()]
    acc = {"+": 2.0, "*": 2.0, "MAX": 1.0, "MIN": 1.0}
    want = {k: [] for k in acc}
    for v in x:
        for k, step in (("+", lambda a, v: a + v), ("*", lambda a, v: a * v), ("MAX", max), ("MIN", min)):
            acc[k] = step(acc[k], v if v is not None else {"*": 1.0, "+": 0.0, "MIN": 0.0}.get(k, acc[k]))
            want[k].append(acc[k])
    for formula, k in (("=SCAN(2,B:B,LAMBDA(a,v,a+v))", "+"), ("=SCAN(1,B:B,LAMBDA(a,v,MAX(a,v)))", "MAX"), ("=SCAN(1,B:B,LAMBDA(a,v,MIN(a,v)))", "MIN")):
        assert all(abs(p - q) < 1e-9 for p, q in zip(get(formula), want[k], strict=True)), formula
    from veilframe.sources import folds

    acc, steps = 1.0, []
    for v in x:
        acc = acc / 2 + (v or 0.0)
        steps.append(acc)
    for few in (arrays.FEW, 5):  # in one array, and passed on from group to group
        monkeypatch.setattr(arrays, "FEW", few)
        monkeypatch.setattr(folds, "GROUP", 7)
        monkeypatch.setattr(folds, "STRIDE", 3)
        assert b.cell("=REDUCE(1,B:B,LAMBDA(a,v,a/2+v))", "N").first()[0] == pytest.approx(steps[-1])
        assert [r["_row"] for r in b.spill("=SCAN(1,B:B,LAMBDA(a,v,a/2+v))", "N", ["v"], order=True).orderBy("_row").collect()] == list(range(len(x)))
        assert [r["v"] for r in b.spill("=SCAN(1,B:B,LAMBDA(a,v,a/2+v))", "N", ["v"], order=True).orderBy("_row").collect()] == pytest.approx(steps)
        assert b.cell('=REDUCE("",B:B,LAMBDA(a,v,RIGHT(a&INT(v),6)))', "N").first()[0] == "".join(str(int(math.floor(v or 0))) for v in x)[-6:]


def test_large_calendars(spark, monkeypatch):
    import datetime as D

    from veilframe.formula import functions

    r = random.Random(8)
    day = lambda: D.date(2024, 1, 1) + D.timedelta(r.randrange(300))
    b = Workbook(spark)
    b.add("t", spark.createDataFrame([(k, day(), day(), r.randint(-30, 30)) for k in range(60)], "k int, a date, b date, n int"), ["k"])
    b.add("h", spark.createDataFrame([(k, day()) for k in range(90)] + [(91, None)], "k int, d date"), ["k"])
    formulas = {"d": "=NETWORKDAYS(B2,C2,h!B:B)", "w": "=WORKDAY(B2,D2,h!B:B)", "i": '=WORKDAY.INTL(B2,D2,"1010000",h!B:B)', "j": "=NETWORKDAYS.INTL(B2,C2,11,h!B:B)"}
    want = sorted(map(tuple, b.fill(formulas, "t").collect()))
    monkeypatch.setattr(functions, "MOST_HOLIDAYS", 3)
    assert sorted(map(tuple, b.fill(formulas, "t").collect())) == want


def test_grouping_forms(spark):
    rows = [(k, "ab"[k % 2], "xyz"[k % 3], float(k), float(k * k), "AB"[k % 2]) for k in range(24)]
    b = Workbook(spark)
    b.add("G", spark.createDataFrame(rows, "k int, a string, b string, v double, w double, c string"), ["k"])
    got = sorted(tuple(r) for r in b.spill("=GROUPBY(B:B,D:D,SUM,0,0,1,E:E>100)", "G", ["a", "v"]).collect())
    assert got == [(x, sum(r[3] for r in rows if r[1] == x and r[4] > 100)) for x in "ab"]
    got = [list(r) for r in b.spill("=PIVOTBY(B:B,B:C,D:E,SUM,0,0,1,0)", "G").collect()]
    heads = sorted({(r[1], r[2]) for r in rows})
    assert got[0][1:] == [h[0] for h in heads for _ in "vw"] and got[1][1:] == [h[1] for h in heads for _ in "vw"] and sorted(r[0] for r in got[2:]) == ["a", "b"]
    for line, x in zip(sorted(got[2:], key=lambda r: r[0]), "ab", strict=True):
        want = [sum(r[i] for r in rows if r[1] == x and (r[1], r[2]) == h) if h[0] == x else None for h in heads for i in (3, 4)]
        assert [None if v is None else float(v) for v in line[1:]] == want
    assert sorted(tuple(r) for r in b.spill("=UNIQUE(B:F,TRUE)", "G").collect()) == sorted(r[1:5] for r in rows)
    assert sorted(tuple(r) for r in b.spill("=UNIQUE(B:F,TRUE,TRUE)", "G").collect()) == sorted(r[2:5] for r in rows)


def test_a_pivot_of_very_many_heads(spark):
    b = Workbook(spark)
    b.add("w", spark.createDataFrame([(k, f"r{k % 3}", f"h{k % 900:05d}", float(k)) for k in range(2700)], "k int, a string, h string, v double"), ["k"])
    got = b.spill("=PIVOTBY(B:B,C:C,D:D,SUM,0,1,1,1)", "w")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" not in plan and "pivotfirst" in plan.lower()
    rows = {r[0]: r for r in got.collect()}
    assert set(rows) == {"", "r0", "r1", "r2", "Total"} and len(rows[""]) == 902
    for j in range(0, 900, 150):
        hits = [k for k in range(2700) if k % 900 == j]
        assert rows[""][j + 1] == f"h{j:05d}" and float(rows["Total"][j + 1]) == sum(hits)
        assert float(rows[f"r{j % 3}"][j + 1]) == sum(hits)  # 900 is a multiple of 3
    assert float(rows["Total"][-1]) == sum(range(2700))


CODES = ["0", "0.00", "#,##0", "#,##0.0", "$#,##0.00", "0%", "0.0%", "000", "0000.00", "0 kg", "-> 0.0 <-", "#", "yyyy-mm-dd", "d.m.yy", "dd mmm yyyy", "dddd, mmmm d", "ddd", "h:mm", "hh:mm:ss", "h:m am/pm", "m/d/yyyy h:mm", "mm:ss"]


def test_text_by_a_format_in_the_row(spark):
    values = [0.0, 1.0, 12.345, 1234567.891, 44927.75, 0.005, 999.995, 45000.061]
    rows = [(i, v, c) for i, (v, c) in enumerate((v, c) for v in values for c in CODES)]
    book = Workbook(spark)
    book.add("t", spark.createDataFrame(rows, "id int, v double, code string"), order=["id"])
    by_row = {r.id: r.x for r in book.fill({"x": "=TEXT(B2,C2)"}, "t").collect()}
    names = {f"x{k}": f'=TEXT(B2,"{c}")' for k, c in enumerate(CODES)}
    constant = {r.id: r for r in book.fill(names, "t").collect()}
    for i, v, c in rows:
        assert by_row[i] == constant[i][f"x{CODES.index(c)}"], (v, c)


def test_text_by_odd_formats(spark):
    book = Workbook(spark)
    odd = ["", None, "0.0.0", "hhh", "yyyyy", "y", "it's d", "[h] {d}", "#,#", "x", "d" * 5000, "-0"]
    book.add("t", spark.createDataFrame([(i, -1234.5, c) for i, c in enumerate(odd)], "id int, v double, code string"), order=["id"])
    book.add("u", spark.createDataFrame([(i, 45000.0, c) for i, c in enumerate(odd)], "id int, v double, code string"), order=["id"])
    got = [r.x for r in sorted(book.fill({"x": "=TEXT(B2,C2)"}, "t").collect(), key=lambda r: r.id)]
    assert got[2] is None and got[8] == "-1,235" and got[11] == "--1235"
    dated = [r.x for r in sorted(book.fill({"x": "=TEXT(B2,C2)"}, "u").collect(), key=lambda r: r.id)]
    assert dated[3:8] == [None, None, None, "it'0 15", "[0] {15}"] and dated[10] is None


def test_map_over_several_origins(spark):
    book = Workbook(spark)
    a, b = [(i, float(i * 3)) for i in range(40)], [(i, float(i)) for i in range(25)]
    book.add("a", spark.createDataFrame(a, "id int, v double").repartition(5), order=["id"])
    book.add("b", spark.createDataFrame(b, "id int, v double").repartition(3), order=["id"])
    of = lambda f, on="a": [r[0] for r in sorted(((r["c1"], r["_row"]) for r in book.spill(f, on).select("*").collect()), key=lambda r: r[1])] if "_row" in book.spill(f, on).columns else [r[0] for r in book.spill(f, on).collect()]
    assert sorted(of("=MAP(B2:B26,b!B2:B26,LAMBDA(x,y,x+y))")) == [4.0 * i for i in range(25)]
    got = of("=MAP(B2:B41,b!B2:B26,LAMBDA(x,y,x-y))")
    assert sorted(x for x in got if x is not None) == [2.0 * i for i in range(25)] and got.count(None) == 15
    assert sorted(of("=MAP(SORT(B2:B41,1,-1),SEQUENCE(40),LAMBDA(x,n,x*1000+n))")) == sorted((39 - i) * 3000.0 + i + 1 for i in range(40))
    assert sorted(of("=MAP(B2:B6,B3:B7,LAMBDA(x,y,x*y))")) == [9.0 * i * (i + 1) for i in range(5)]


def test_exp_and_its_rounding_are_those_of_sql(spark, tmp_path):
    """keys of a larger table, whose powers have more digits than a double, or overflow it."""
    import duckdb

    from veilframe.plans import formula_queries

    spark.range(0, 720_000, 97).selectExpr("id as o_orderkey", "id as o_custkey", "'F' as o_orderstatus", "1.5D as o_totalprice", "timestamp'2020-01-01' as o_orderdate", "'1' as o_orderpriority").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted(db.execute(formula_queries.oracle_sql()["fn_exp"]).fetchall())
    assert sorted(map(tuple, formula_queries.queries()["fn_exp"](spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("formula", ["=SUM(EXP(B:B))", "=REDUCE(0,B:B,LAMBDA(a,x,EXP(a/100)+x/10))", "=SUMIF(B:B,\">\"&EXP(1),B:B)", "=INDEX(B:B,MATCH(EXP(0)+1,B:B,0))", "=SUMPRODUCT(EXP(B:B)*(B:B>1))", "=SUM(MAP(B:B,LAMBDA(x,EXP(x))))", "=EXP(MAX(B:B))"])
def test_exp_stands_wherever_a_function_may(spark, formula):
    xs = [1.0, 2.0, 3.0, 4.0]
    book = Workbook(spark)
    book.add("t", spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double"), ["k"])
    folded = 0.0
    for x in xs:
        folded = math.exp(folded / 100) + x / 10
    want = {"=SUM(E": sum(map(math.exp, xs)), "=REDUC": folded, "=SUMIF": 7.0, "=INDEX": 2.0, "=SUMPR": sum(map(math.exp, xs[1:])), "=SUM(M": sum(map(math.exp, xs)), "=EXP(M": math.exp(4.0)}[formula[:6]]
    assert book.cell(formula, "t").first()[0] == pytest.approx(want, rel=1e-14)
