"""What formulas are computed from: sheets, ranges, and typed column expressions.

Errors have no value of their own: a formula that fails on a row gives null there, and the functions that
test for errors test for that.  A blank cell counts as 0 in arithmetic and as "" in text, as in worksheets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rows import numbered, small_splits, written

EPOCH = "1899-12-30"


def kind_of(dtype: str) -> str:
    if dtype in ("string",) or dtype.startswith(("char", "varchar")):
        return "text"
    if dtype in ("date", "timestamp", "timestamp_ntz"):
        return "date"
    if dtype == "boolean":
        return "bool"
    return "number"


@dataclass
class Cell:
    col: Column
    kind: str
    plain: bool = False  # a cell itself: blank if null
    const: bool = False  # the same for every row
    value: object = None  # of a literal


@dataclass
class Row:
    """One row of several cells, as BYROW hands it over."""

    cells: list[Cell]


@dataclass
class Fn:
    params: list[str]
    body: object
    env: dict


class Sheet:
    """A DataFrame under a header row, in the order of its key columns."""

    def __init__(self, name: str, df: DataFrame, order: list[str], columns: list[str] | None = None):
        self.name, self.df, self.order = name, df, order
        self.columns = columns or [c for c in df.columns if c != "_row"]
        self.kinds = {c: kind_of(t) for c, t in df.dtypes}
        self._numbered = df if "_row" in df.columns else None
        self.end: int | None = None  # the last position, once it is known

    def key(self) -> Column:
        return F.col("_row") if "_row" in self.df.columns else F.struct(*self.order)

    def rows(self) -> DataFrame:
        """With ``_row``, the position from 0; computed once."""
        if self._numbered is None:
            n = self.df.count()
            small_splits(self.df.sparkSession, n)
            self._numbered, self.end = written(numbered(self.df, *self.order, rows=n), "rows"), n - 1
        return self._numbered

    def column(self, name: str) -> str:
        for c in self.columns:
            if c.casefold() == name.casefold():
                return c
        raise KeyError(name)


@dataclass
class Vec:
    """Columns of a sheet's data, whole or by position (ends included)."""

    sheet: Sheet
    columns: list[str]
    lo: int | None = None
    hi: int | None = None

    def frame(self) -> DataFrame:
        if self.lo is None:
            return self.sheet.df
        return self.sheet.rows().where(F.col("_row").between(self.lo, self.hi))

    def placed(self) -> DataFrame:
        """With ``_row`` counted from the range's first row."""
        return self.sheet.rows() if self.lo is None else self.frame().withColumn("_row", F.col("_row") - self.lo)

    def cells(self) -> list[Cell]:
        return [Cell(F.col(c), self.sheet.kinds[c], plain=True) for c in self.columns]

    def key(self) -> Column:
        return self.sheet.key()


@dataclass
class Grid:
    """A computed array: columns in order, rows in the order of ``_row`` (dense from 0 if ``dense``)."""

    df: DataFrame
    columns: list[str]
    dense: bool = True

    def frame(self) -> DataFrame:
        return self.df

    def placed(self) -> DataFrame:
        return self.df if self.dense else written(numbered(self.df.withColumnRenamed("_row", "_was"), "_was").drop("_was"), "grid")

    def cells(self) -> list[Cell]:
        kinds = dict(self.df.dtypes)
        return [Cell(F.col(c), kind_of(kinds[c]), plain=True) for c in self.columns]

    def key(self) -> Column:
        return F.col("_row")


@dataclass
class Scope:
    """Rows that an expression is computed for, and the joins it needs first."""

    frame: DataFrame | None
    sheet: Sheet | None = None
    lifted: bool = False  # ranges of the sheet stand for their cell in the row
    lo: int | None = None
    hi: int | None = None
    joins: list = field(default_factory=list)
    windows: dict = field(default_factory=dict)  # aggregates of ranges that move alike: one join for all
    positioned: bool = False

    def build(self) -> DataFrame:
        df = self.frame
        for j in self.joins:
            df = j(df)
        return df


# ---------------------------------------------------------------- conversions


def number(c: Cell) -> Column:
    if c.kind == "number":
        x = c.col.cast("double")
    elif c.kind == "bool":
        x = c.col.cast("int").cast("double")
    elif c.kind == "date":
        x = serial(c.col)
    else:
        x = parsed(c.col)
    return F.coalesce(x, F.lit(0.0)) if c.plain and c.kind != "text" else x


def serial(col: Column) -> Column:
    day = F.datediff(col.cast("date"), F.lit(EPOCH).cast("date")).cast("double")
    t = col.cast("timestamp")
    return day + (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / F.lit(86400.0)


def parsed(col: Column) -> Column:
    """A number written as text: signs, grouping, currency, percent."""
    bare = F.regexp_replace(F.trim(col), r"[$€£¥,\s]", "")
    percent = bare.endswith("%")
    body = F.regexp_replace(bare, "%$", "")
    neg = body.rlike(r"^\(.*\)$")
    body = F.when(neg, F.regexp_replace(body, r"[()]", "")).otherwise(body)
    x = F.when(body.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), body.try_cast("double"))
    x = F.when(neg, -x).otherwise(x)
    return F.when(percent, x / 100).otherwise(x)


def shown(x: Column) -> Column:
    """A number in general format."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def text(c: Cell) -> Column:
    if c.kind == "text":
        x = c.col
    elif c.kind == "bool":
        x = F.upper(c.col.cast("string"))
    else:
        x = shown(serial(c.col) if c.kind == "date" else c.col.cast("double"))
    return F.coalesce(x, F.lit("")) if c.plain else x


def date(c: Cell) -> Column:
    if c.kind == "date":
        return c.col.cast("date")
    if c.kind == "text":
        return F.coalesce(F.try_to_date(c.col, "yyyy-MM-dd"), F.try_to_date(c.col, "M/d/yyyy"))
    return F.date_add(F.lit(EPOCH).cast("date"), F.floor(number(c)).cast("int"))


def stamp(c: Cell) -> Column:
    if c.kind == "date":
        return c.col.cast("timestamp")
    if c.kind == "text":
        return F.coalesce(F.try_to_timestamp(c.col), F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), c.col)))
    return F.timestamp_seconds(F.round((number(c) - 25569) * 86400))


def truth(c: Cell) -> Column:
    if c.kind == "bool":
        return F.coalesce(c.col, F.lit(False)) if c.plain else c.col
    if c.kind == "text":
        return F.when(F.lower(c.col) == "true", True).when(F.lower(c.col) == "false", False)
    return number(c) != 0


def whole(c: Cell) -> Column:
    return F.floor(number(c)).cast("int")


def wildcard(pattern: str) -> str:
    """A worksheet pattern (* ? ~) as a regular expression over the whole text."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "~" and i + 1 < len(pattern):
            i += 1
            ch = "\0" + pattern[i]
        out += {"*": ".*", "?": "."}.get(ch, "".join("\\" + x if not x.isalnum() and x != " " else x for x in ch.lstrip("\0")))
        i += 1
    return f"(?is)^{out}$"
