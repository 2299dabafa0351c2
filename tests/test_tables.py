"""Rules over whole tables against the same rules value by value, with nulls, repeats, long and empty texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions import headers
from veilframe.operators import audit, classify, restore

HEADERS = ["", "FirstName", "E-mail address", "e mail E-Mail", "HTTPServer2Name", "ZIPCode", "dateofbirth", "Straße Größe2", "  ", "Vendor name", "Name", "First", "First seen", "Diagnosis (new)", "x1y2Z", "Product ID", "ID", "ABC", "aBCd", "Driver", "Mailing_e", "E", "Fax no. 12"]


def test_headers_as_columns(spark):
    rows = [(h, t, i, e) for h in [*HEADERS, *HEADERS[:3]] for t, i, e in (("text", 0.9, 0.0), ("number", 0.9, 0.0), ("text", None, 0.6), ("text", 0.1, 0.1))]
    df = spark.createDataFrame([(h, h, t, i, e) for h, t, i, e in rows], "letter string, header string, type string, id_share double, email_share double")
    got = classify.described(df).select("header", "type", "id_share", "email_share", "keywords", "kind", "alias", headers.words(F.col("header")).alias("words")).collect()
    assert len(got) == len(rows)
    for r in got:
        h = r["header"]
        assert r["words"] == classify.header_words(h), h
        assert r["keywords"] == classify.header_keywords(h), h
        assert r["kind"] == classify.token_kind(h, r["type"], r["id_share"] or 0.0, r["email_share"]), h
        assert r["alias"] == classify.alias_for(h, h)
    none = classify.described(spark.createDataFrame([(None, None, None, None, None)], df.schema)).first()
    assert none["keywords"] == [] and none["kind"] == "TEXT" and none["alias"] is None
    assert classify.described(df.limit(0)).count() == 0


def test_reveals_as_columns(spark):
    pairs = [("The pay (net)", "pay"), ("payman", "pay"), ("Cafè x", "cafe"), ("x5", "5"), ("a.b", "a.b"), ("acb", "a.b"), (r"q\E z", r"\E"), ("", "a"), ("a", ""), ("a", " "), (None, "a"), ("a", None), ("pay " * 20_000, "PAY")]
    got = spark.createDataFrame(pairs, "alias string, header string").select("alias", "header", headers.reveals(F.col("alias"), F.col("header")).alias("r")).collect()
    for r in got:
        assert r["r"] == (r["alias"] is not None and r["header"] is not None and classify.reveals(r["alias"], r["header"])), r


def test_refreshed_policies(spark):
    schema = "sheet string, letter string, header string, type string"
    now = spark.createDataFrame([("S", "A", "x", "text"), ("S", "B", None, "text"), ("S", "C", "new", "text"), ("S", "D", "d", "date"), ("S", "A", "x", "text")], schema)
    was = spark.createDataFrame([("S", "A", "x", "text", False, "as_is"), ("S", "B", None, "text", False, "month"), ("S", "C", "old", "text", False, "as_is"), ("S", "D", "d", "date", True, "as_is"), ("S", "D", "d", "date", False, "as_is"), ("T", "A", "x", "text", None, None)], schema + ", private boolean, treatment string")
    got = [(r["letter"], r["private"], r["treatment"]) for r in classify.refreshed(now, was).collect()]
    assert sorted(got) == [("A", False, "as_is"), ("A", False, "as_is"), ("B", False, "as_is"), ("C", True, "stand_in"), ("D", True, "stand_in")]
    assert {r["private"] for r in classify.refreshed(now.withColumn("private", F.lit(False)), was.limit(0)).collect()} == {True}


VALUES = {"PERSON_001": 'Ann "Al" Lee', "ID_0042": "x$1\\", "DEID_TEXT_007": "long", "PERSON_1000": "Bo", "EMAIL_003": ""}
PIECES = ['"', '"PERSON_001"', "PERSON_001", '"a ""PERSON_001"" ID_0042"', "'PERSON_001'!A1", '"TEXT_007 ID_009"', '"PERSON_1000,PERSON_001x EMAIL_003"', "+", "SUM(A1:B2)", "ID_009", '"XPERSON_001 PERSON_001"', '"it\'s"', "&", '"DEID_TEXT_007"', "''"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES[1:-1]), max_size=5).map("&".join), min_size=1, max_size=40))
def test_formulas_restored_by_joins(spark, formulas):
    formulas = ["=" + f for f in formulas]
    df = spark.createDataFrame([(k, f, "extra") for k, f in enumerate([*formulas, None])], "k int, formula string, unknown string")
    tokens = spark.createDataFrame([(t, v) for t, v in VALUES.items()] * 2, "token string, value string")
    for prefix, reserved in (("", ()), ("DEID_", ("ID_009",))):
        got = {r["k"]: (r["formula"], r["unknown"]) for r in restore.restore_formulas(df, "formula", tokens, prefix, reserved).collect()}
        assert got.pop(len(formulas)) == (None, [])
        for k, f in enumerate(formulas):
            want = restore.restore_formula(f, VALUES, prefix, frozenset(reserved))
            assert got[k] == (want[0], list(want[1])), f


def test_long_formulas_and_empty_tables(spark):
    long = '="' + 'a""' * 50_000 + ' PERSON_001"'
    tokens = spark.createDataFrame([(t, v) for t, v in VALUES.items()], "token string, value string")
    df = spark.createDataFrame([(long,), (long,), ("",)], "formula string")
    got = restore.restore_formulas(df, "formula", tokens).collect()
    assert sorted(len(r["formula"]) for r in got) == [0, *[len(long) - 10 + len('Ann ""Al"" Lee')] * 2]
    assert restore.restore_formulas(df.limit(0), "formula", tokens).count() == 0
    assert {r["unknown"][0] for r in restore.restore_formulas(spark.createDataFrame([('="ID_0042"',)], "formula string"), "formula", tokens.limit(0)).collect()} == {"ID_0042"}


def test_resolved_and_segments(spark):
    tokens = spark.createDataFrame([(t, v) for t, v in VALUES.items()] * 2, "token string, value string")
    names = ["PERSON_001", "TEXT_007", "DEID_TEXT_007", "ID_009", "ID_010", None, "PERSON_001"]
    got = [(r["token"], r["value"]) for r in restore.resolved(spark.createDataFrame([(n, "other") for n in names], "token string, value string"), tokens, "DEID_", ("ID_009",)).collect()]
    key = lambda x: (x[0] or "", x[1] or "")
    assert sorted(got, key=key) == sorted(((n, n and restore.resolve(n, VALUES, "DEID_", frozenset({"ID_009"}))) for n in names), key=key)
    texts = ["", "plain", "PERSON_001", "From PERSON_001 to ID_0042.", "XPERSON_12 PERSON_12 A_PERSON_123x", "PERSON_001PERSON_002", "ID_001 " * 3000, None, "ID_123456789012345"]
    rows = restore.text_segments(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text").collect()
    for k, t in enumerate(texts):
        own = [(r["segment"], r["is_token"]) for r in sorted(rows, key=lambda r: r["n"]) if r["k"] == k]
        assert own == restore.segments(t or ""), t


def test_messages(spark):
    found = spark.createDataFrame([(1, "A", "exact"), (1, "A", "word"), (1, "B2", "word"), (2, "C", "exact"), (None, "A", "exact")], "body_id int, column string, kind string")
    got = {r["body_id"]: r["message"] for r in audit.messages(found).collect()}
    for k, hits in ((1, [("B2", "word"), ("A", "exact"), ("A", "word")]), (2, [("C", "exact")]), (None, [("A", "exact")])):
        assert got.pop(k) == audit.Result(False, [], hits).message()
    assert not got


@pytest.mark.parametrize("name", ["p7_shapes", "t15_loose_dates"])
def test_keys_of_many_digits_give_what_the_sql_gives(spark, tmp_path, name):
    """Orders whose keys have six and seven digits, too long for a house's number and for eight digits after 99000000."""
    import duckdb

    from veilframe.plans import catalogue

    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    many = o.withColumn("o_orderkey", o.o_orderkey + 1_234_500).union(o.withColumn("o_orderkey", o.o_orderkey + 123_456))
    many.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted(c.execute(catalogue.oracle_sql()[name]).fetchall())
    assert sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).collect())) == want and want
