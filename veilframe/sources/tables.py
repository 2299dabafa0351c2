"""Reading selections, finding tables, writing results, and reading logs back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..formula import Workbook
from ..formula.syntax import FormulaError, index_to_letters
from ..functions import shapes
from .rows import numbered, written

#: Columns that are looked through for an empty one.
MOST_COLUMNS = 64


def read_selection(spark: SparkSession, path: str, columns: list[str] | None = None, most_cells: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A table from files; with ``most_cells`` its size is checked by counts before any value is read."""
    df = spark.read.format(fmt).load(path)
    df = df.select(*columns) if columns else df
    if most_cells is not None and (n := df.count()) * len(df.columns) > most_cells:
        raise ValueError(f"{n} rows of {len(df.columns)} columns are more than {most_cells} cells")
    return df


def trimmed(df: DataFrame) -> DataFrame:
    """Without rows and columns that are all blank."""
    full = df.agg(*(F.count(F.when(~shapes.is_blank(F.col(c)), 1)).alias(c) for c in df.columns)).first()
    columns = [c for c in df.columns if full[c]]
    blank = F.lit(True)
    for c in columns:
        blank = blank & shapes.is_blank(F.col(c))
    return df.select(*columns).where(~blank)


def without_totals(df: DataFrame, label: str, words: tuple[str, ...] = ("total", "totals", "grand total", "sum")) -> DataFrame:
    """A table's body: its totals row goes."""
    return df.where(~F.coalesce(F.lower(F.trim(F.col(label).cast("string"))).isin(*words), F.lit(False)))


def expanded(spark: SparkSession, name: str, label: str | None = None) -> DataFrame:
    """The table that a pointer stands in, by its name."""
    df = spark.table(name)
    return without_totals(df, label) if label else df


def rows_between(df: DataFrame, order: list[str], first: int, last: int, columns: list[str] | None = None) -> DataFrame:
    """Rows first..last (from 0) in the order of the keys."""
    r = df if "_row" in df.columns else written(numbered(df, *order), "rows")
    return r.where(F.col("_row").between(first, last)).select(*(columns or [c for c in r.columns if c != "_row"]))


def tables(spark: SparkSession) -> list[tuple[str, list[str]]]:
    """Registered tables and views with their columns."""
    return [(t.name, [c.name for c in spark.catalog.listColumns(t.name)]) for t in spark.catalog.listTables()]


def is_empty(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: whether each column is all blank."""
    return df.agg(*((F.count(F.when(~shapes.is_blank(F.col(c)), 1)) == 0).alias(c) for c in columns or df.columns))


def first_empty_column(df: DataFrame) -> str | None:
    """The letter of the first column that is all blank; the next one after the last if none is."""
    r = is_empty(df, df.columns[:MOST_COLUMNS]).first()
    at = next((k for k, c in enumerate(df.columns[:MOST_COLUMNS]) if r[c]), len(df.columns))
    return index_to_letters(at) if at < MOST_COLUMNS else None


def insert_formula(book: Workbook, sheet: str, column: str, formula: str, fill_down: bool = True, path: str | None = None) -> tuple[DataFrame | None, str]:
    """(result, status): ok, error (some cell failed) or manual (this formula can't be computed here).  Written only to an explicit path."""
    try:
        out = book.fill({column: formula}, sheet) if fill_down else book.cell(formula, sheet, column)
    except FormulaError as e:
        return None, "manual" if e.code.startswith("C-") else "error"
    if path:
        out.write.parquet(path)
        out = book.spark.read.parquet(path)
    return out, "error" if failed(out, column) else "ok"


def failed(df: DataFrame, column: str) -> bool:
    """Whether any cell of a computed column has no value."""
    return bool(df.agg(F.bool_or(F.col(column).isNull())).first()[0])


def scratch(df: DataFrame, name: str) -> DataFrame:
    """A temporary view, cleared first."""
    df.sparkSession.catalog.dropTempView(name)
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def markers(df: DataFrame) -> dict:
    """A test sheet's marker rows: marker, private letters, canaries, from its first three rows (kind, items)."""
    return {r["kind"]: r["items"] for r in df.limit(3).collect()}


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def import_log(texts: DataFrame, column: str = "json") -> tuple[DataFrame, Column]:
    """(entries, number skipped) of exported logs: a list, or an object that holds one under a usual name."""
    # a field that is no string doesn't count
    held = F.coalesce(*(F.from_json(F.get_json_object(column, f"$.{k}"), "array<string>") for k in ("entries", "log", "requests", "records")), F.from_json(column, "array<string>"))
    items = texts.select(F.explode(held).alias("item"))
    string = lambda k: F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json("item"), f"$.{k}", "variant")) == "STRING", F.get_json_object("item", f"$.{k}"))
    read = items.select(string("mode").alias("mode"), string("body").alias("body"))
    return read.where("mode is not null and body is not null"), read.agg(F.count_if(F.col("mode").isNull() | F.col("body").isNull())).scalar()


def same_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two snapshots hold the same rows as often; sums of hashes, so nothing is sorted or collected."""
    if [c.casefold() for c in a.columns] != [c.casefold() for c in b.columns]:
        return a.sparkSession.range(1).select(F.lit(False).alias("same"))
    digest = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64(F.lit(7), *df.columns).cast("decimal(38,0)")).alias("g"))
    x, y = digest(a), digest(b)
    return x.join(y.toDF("m", "k", "j")).select(((F.col("n") == F.col("m")) & F.col("h").eqNullSafe(F.col("k")) & F.col("g").eqNullSafe(F.col("j"))).alias("same"))


def same_workbook(a: list[tuple[str, list[str]]], b: list[tuple[str, list[str]]]) -> bool:
    """Tables and names, whatever their case and order; internal ones (with a leading underscore) aside."""
    plain = lambda x: sorted((n.casefold(), [c.casefold() for c in cols]) for n, cols in x if not n.startswith("_"))
    return plain(a) == plain(b)
