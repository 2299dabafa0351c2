"""Profiles of columns: types, counts and shapes, never values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..formula.syntax import index_to_letters
from ..formula.values import kind_of
from ..functions import shapes

TYPE_SHARE, SAMPLE_CELLS = 0.8, 200
KINDS = ("text", "number", "date", "boolean")


@dataclass(frozen=True)
class ColumnInfo:
    letter: str
    header: str
    type: str
    blank: int
    distinct: int
    avg_words: float | None = None
    max_len: int | None = None


def _kind(dtype: str) -> str:
    return {"bool": "boolean"}.get(kind_of(dtype), kind_of(dtype))


def _same(c: str, dtype: str) -> Column:
    """A column's values as texts that are equal where the values are; null for blank ones."""
    x = F.col(c)
    if dtype in ("float", "double"):
        x = F.when(x == 0, F.lit(0).cast(dtype)).otherwise(x)  # 0 and -0 are equal
    elif dtype == "timestamp":
        x = F.unix_micros(x)  # an hour of autumn is there twice as a text
    return F.when(~shapes.is_blank(F.col(c)), x.cast("string"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """ord, distinct of each column: (column, value) pairs are made distinct in one shuffle, and counted.

    A row gives a pair of two fields for each column, where a distinct count of several columns at once would give a
    whole row for each.
    """
    kinds = dict(df.dtypes)
    pairs = F.array(*(F.struct(F.lit(k).alias("ord"), _same(c, kinds[c]).alias("value")) for k, c in enumerate(columns)))
    return df.select(F.inline(pairs)).where("value IS NOT NULL").distinct().groupBy("ord").agg(F.count("*").alias("distinct"))


def profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row a column: ord, letter, header, type, non_empty, blank, distinct, avg_words, max_len.

    approximate: count distinct values by a sketch, for tables where exact counts of every column cost too much.
    """
    columns = columns or [c for c in df.columns if c != "_row"]
    kinds = {c: _kind(t) for c, t in df.dtypes}
    aggs = []
    for k, c in enumerate(columns):
        full = F.when(~shapes.is_blank(F.col(c)), F.col(c))
        aggs += [F.count("*").alias(f"rows{k}"), F.count(full).alias(f"n{k}")]
        aggs += [F.approx_count_distinct(full).alias(f"d{k}")] if approximate else []
        if kinds[c] == "text":
            aggs += [F.sum(shapes.word_count(full)).alias(f"w{k}"), F.max(F.length(full)).alias(f"m{k}")]
    one = df.agg(*aggs)
    items = []
    for k, c in enumerate(columns):
        n = F.col(f"n{k}")
        words = F.when(n == 0, 0.0).otherwise(F.floor(F.col(f"w{k}") / n * 10 + 0.5) / 10) if kinds[c] == "text" else F.lit(None).cast("double")
        longest = F.coalesce(F.col(f"m{k}"), F.lit(0)) if kinds[c] == "text" else F.lit(None).cast("int")
        items.append(
            F.struct(
                F.lit(k).alias("ord"), F.lit(index_to_letters(k)).alias("letter"), F.lit(c if c.strip() else f"Column {index_to_letters(k)}").alias("header"),
                F.when(n == 0, "empty").otherwise(kinds[c]).alias("type"), n.alias("non_empty"), (F.col(f"rows{k}") - n).alias("blank"), (F.col(f"d{k}") if approximate else F.lit(0).cast("long")).alias("distinct"),
                F.when(n > 0, words).alias("avg_words"), F.when(n > 0, longest).alias("max_len"),
            )
        )
    rows = one.select(F.inline(F.array(*items)))
    if approximate:
        return rows
    counted = F.broadcast(distinct_counts(df, columns))  # a row a column
    names = rows.columns
    return rows.drop("distinct").join(counted, "ord", "left").select(*(F.coalesce("distinct", F.lit(0).cast("long")).alias("distinct") if c == "distinct" else c for c in names))


def infos(df: DataFrame, **options) -> list[ColumnInfo]:
    """The profile on the driver: a row a column."""
    return [ColumnInfo(r["letter"], r["header"], r["type"], r["blank"], r["distinct"], r["avg_words"], r["max_len"]) for r in profile(df, **options).orderBy("ord").collect()]


def cell_kind(value, vtype, fmt):
    """Kind of a dynamic cell from its value, host type and number format (columns)."""
    return (
        F.when(vtype.eqNullSafe("Empty") | shapes.is_blank(value), "empty")
        .when(vtype.isin("Double", "Integer") & shapes.is_date_format(F.coalesce(fmt, F.lit(""))), "date")
        .when(vtype.isin("Double", "Integer"), "number")
        .when(vtype == "String", "text")
        .when(vtype == "Boolean", "boolean")
        .when(vtype == "Error", "error")
        .otherwise("other")
    )


def type_of_kinds(kind, *keys: str):
    """For groups of cells: the first of text, number, date, boolean that four fifths of the non-empty cells have."""
    full = F.count(F.when(kind != "empty", 1))
    out = F.when(full == 0, "empty")
    for k in KINDS:
        out = out.when(F.count(F.when(kind == k, 1)) >= TYPE_SHARE * full, k)
    return out.otherwise("mixed")


def dynamic_kind(text):
    """Kind of a cell that arrives as text: what it reads as."""
    t = F.trim(text)
    return F.when(shapes.is_blank(text), "empty").when(t.rlike(shapes.NUMBER), "number").when(F.lower(t).isin("true", "false"), "boolean").when(F.try_to_date(t, "yyyy-MM-dd").isNotNull(), "date").otherwise("text")


def sample(df: DataFrame, column: str, order: list[str], limit: int = SAMPLE_CELLS) -> DataFrame:
    """The first non-empty cells in row order, as ``text`` and ``value``."""
    c = F.col(column)
    return df.where(~shapes.is_blank(c)).orderBy(*order).limit(limit).select(c.alias("value"), c.cast("string").alias("text"))


def value_patterns(cells: DataFrame, kind: str) -> DataFrame:
    """n, email, phone, ssn, id, free_text of a sample: any e-mail; half phones or social numbers; four fifths ids, nearly all distinct."""
    t = F.col("text")
    candidate = ~F.trim(t).rlike(shapes.DATE_LIKE) if kind == "text" else (F.col("value").cast("double") == F.floor(F.col("value").cast("double"))) if kind == "number" else F.lit(False)
    n = F.count("*")
    return cells.agg(
        n.alias("n"),
        (F.count_if(shapes.contains_email(t)) > 0).alias("email"),
        F.coalesce(F.count_if(shapes.is_phone(t)) / n >= 0.5, F.lit(False)).alias("phone"),
        F.coalesce(F.count_if(shapes.is_ssn(t)) / n >= 0.5, F.lit(False)).alias("ssn"),
        F.coalesce((F.count_if(candidate & shapes.is_id(t)) / n >= 0.8) & (F.countDistinct(t) / n > 0.9), F.lit(False)).alias("id"),
        F.coalesce(F.avg(shapes.word_count(t)) > 6, F.lit(False)).alias("free_text"),
    )


def looks_like_data(first: DataFrame, below: DataFrame, columns: list[str]) -> DataFrame:
    """For each column, whether a supposed header has the shape of the cells below it (most of at most 200); no cells below count as data.

    A number and a word is data only over a column of addresses.
    """
    out = None
    for k, c in enumerate(columns):
        head = first.select(shapes.shape(F.col(c).cast("string")).alias("head"), shapes.number_led(F.col(c).cast("string")).alias("led")).limit(1)
        cells = below.where(~shapes.is_blank(F.col(c))).limit(SAMPLE_CELLS).select(shapes.shape(F.col(c).cast("string")).alias("s"))
        one = cells.crossJoin(F.broadcast(head)).agg(F.count("*").alias("n"), F.count_if(F.col("s") == F.col("head")).alias("same"), F.count_if(F.col("s") == "address").alias("addresses"), F.max("head").alias("head"), F.bool_or("led").alias("led"))
        head_shape = F.coalesce(F.col("head"), head.select("head").scalar())
        one = one.select(F.lit(k).alias("ord"), F.lit(c).alias("column"), head_shape.alias("head"), F.when(head_shape == "empty", False).when(head_shape.isin("identifier", "address"), True).when(F.col("n") == 0, True).when(F.col("led") & (F.col("addresses") * 2 > F.col("n")), True).otherwise((F.col("same") * 2 > F.col("n")) & (head_shape != "text")).alias("data"))
        out = one if out is None else out.union(one)
    return out
