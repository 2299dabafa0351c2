"""Rows that arrive: the last ones of each key, also after a new start."""

import random

from pyspark.sql import functions as F

from veilframe.streaming import keep, scan


def brute(rows, most):
    by_key: dict = {}
    for k, place, text in rows:
        if k is not None and place is not None:
            by_key.setdefault(k, {})[place] = text
    return sorted((k, p, d[p]) for k, d in by_key.items() for p in sorted(d)[-most:])


def test_last_rows_go_on_from_the_checkpoint(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randrange(7), p, r.choice(["é", "b", None, 'q"\n'])) for p in range(120)] + [(None, 1, "x"), (3, None, "y")]
    r.shuffle(rows)
    schema = "k long, place long, text string"
    path = lambda x: str(tmp_path / x)

    def arrive(some, to):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(path(to))

    def run(source, to):
        stream = scan.arriving(spark, path(source), schema, 1)
        keep.stored(keep.last_rows(stream, "k", "place", ["text"], 5), path(to), path(to + "-check")).awaitTermination()
        return sorted(map(tuple, keep.current(spark.read.parquet(path(to) + "/*"), "k").select("k", "place", "text").collect()), key=str)

    for at in range(0, 60, 30):
        arrive(rows[at : at + 30], "in")
    assert run("in", "out") == sorted(brute(rows[:60], 5), key=str)
    for at in range(60, len(rows), 30):  # more arrives, and the query starts again
        arrive(rows[at : at + 30], "in")
    again = run("in", "out")
    assert again == sorted(brute(rows, 5), key=str)
    assert run("in", "out") == again  # nothing new
    assert run("in", "whole") == again  # all at once, from the start


def test_a_later_row_of_a_place_replaces_it():
    assert keep._merged([[1, "a"], [2, "b"]], [[2, "c"], [0, "z"]], 2) == [[1, "a"], [2, "c"]]
    assert keep._merged([], [[5, None]], 3) == [[5, None]]


def test_windowed_counts_of_a_table(spark):
    df = spark.range(10).select(F.timestamp_seconds(F.col("id") * 40_000).alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"))
    assert scan.windowed_counts(df).agg(F.sum("n")).first()[0] == 10
