"""De-identification: stand-in tokens, bins and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, shapes
from ..functions.numbers import render_range
from ..sources.rows import asof, numbered, written
from .classify import Policy, lettered

KINDS = ("PERSON", "EMAIL", "ID", "TEXT")
TOKEN = r"\b(?:[A-Z]+_)?(?:PERSON|EMAIL|ID|TEXT)_\d{3,}\b"
ROW_CAP, MOST_ROWS = 50, 200


def token(prefix, kind: Column, n: Column) -> Column:
    """KIND_nnn, at least three digits, never cut."""
    return F.format_string("%s%s_%03d", F.lit(prefix), kind, n.cast("bigint"))


def token_shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Token-like texts that are already in the data: they are never given out."""
    texts = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    found = df.select(F.explode(texts).alias("t")).where(F.col("t").rlike(TOKEN))
    return found.select(F.explode(F.regexp_extract_all("t", F.lit(f"({TOKEN})"), F.lit(1))).alias("token")).distinct()


def collides(df: DataFrame, columns: list[str]) -> bool:
    return token_shapes(df, columns).limit(1).count() > 0


def private_cells(df: DataFrame, kinds: dict[str, str], row: list[str] | str = "_row") -> DataFrame:
    """value, kind, row, pos of every private cell; kinds: column -> token kind, in column order."""
    at = F.col(row) if isinstance(row, str) else F.struct(*row)
    items = F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for k, (c, kind) in enumerate(kinds.items())))
    return df.select(at.alias("row"), F.inline(items)).where(~shapes.is_blank(F.col("value")))


def token_map(cells: DataFrame, prefix: str = "", reserved: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """value, kind, token: one token for each exact value, of the kind of the cell that reached it first.

    Numbers count per kind in the order of first cells (row, then column), skip ``reserved`` tokens, and go on
    after those of ``known`` (an earlier map of the session).  Values are numbered by a range sort, so that one
    kind with very many values needs no single task.
    """
    first = cells.groupBy("value").agg(F.min(F.struct("row", "pos", "kind")).alias("f"))
    first = first.select("value", F.when(F.col("f.kind").isin(*KINDS), F.col("f.kind")).otherwise("TEXT").alias("kind"), F.col("f.row").alias("row"), F.col("f.pos").alias("pos"))
    if known is not None:
        first = first.join(known.select("value"), "value", "left_anti")
    placed = written(numbered(first, "kind", "row", "pos", name="_n"), "first-cells")
    start = placed.groupBy("kind").agg(F.min("_n").alias("_start"))  # a row a kind
    if known is not None:
        used = known.groupBy("kind").agg(F.max(F.regexp_extract("token", r"_(\d+)$", 1).cast("long")).alias("_used"))
        start = start.join(used, "kind", "left")
    else:
        start = start.withColumn("_used", F.lit(0))
    ranked = placed.join(F.broadcast(start), "kind").withColumn("n", F.col("_n") - F.col("_start") + 1 + F.coalesce("_used", F.lit(0)))
    if reserved is not None:
        taken = reserved.select(F.regexp_extract("token", rf"^{prefix}([A-Z]+)_", 1).alias("kind"), F.regexp_extract("token", r"_(\d+)$", 1).cast("long").alias("t")).where("kind <> ''").distinct()
        taken = written(taken.where(F.col("kind").isin(*KINDS)), "taken")
        if not taken.isEmpty():
            ranked = _around(ranked, taken)
    out = ranked.select("value", "kind", token(prefix, F.col("kind"), F.col("n")).alias("token"))
    return out if known is None else known.select("value", "kind", "token").unionByName(out)


def _around(ranked: DataFrame, taken: DataFrame) -> DataFrame:
    """``ranked`` with n moved past taken numbers (kind, t), in order.

    Before the j-th taken number t of a kind stand t - least - (j - 1) free ones, so a value of that rank or more skips
    j numbers at least: an as-of join of ranks with taken numbers, both in the order of kind and number.
    """
    place = lambda kind, x: F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("long") * (1 << 48) + x
    lowest = ranked.groupBy("kind").agg(F.min("n").alias("_low"))  # a row a kind
    above = numbered(taken.join(F.broadcast(lowest), "kind").where("t >= _low"), "kind", "t", name="_j")
    first = above.groupBy("kind").agg(F.min("_j").alias("_first"))
    skips = above.join(F.broadcast(first), "kind").withColumn("_skip", F.col("_j") - F.col("_first") + 1)
    free = skips.select(place(F.col("kind"), F.col("t") - F.col("_low") - F.col("_skip") + 1).alias("_at"), "_skip")
    none = lowest.select(place(F.col("kind"), F.lit(0)).alias("_at"), F.lit(0).cast("long").alias("_skip"))
    right = free.union(none).groupBy("_at").agg(F.max("_skip").alias("_skip"))
    left = ranked.join(F.broadcast(lowest), "kind").withColumn("_rank", place(F.col("kind"), F.col("n") - F.col("_low")))
    return asof(left, "_rank", right, "_at", "_skip", "_over").withColumn("n", F.col("n") + F.col("_over"))


def tokenised(df: DataFrame, column: str, tokens: DataFrame) -> DataFrame:
    """The column's values replaced by their tokens; blanks stay null."""
    t = tokens.select(F.col("value").alias("_v"), F.col("token").alias("_t"))
    keyed = df.withColumn("_key", F.when(~shapes.is_blank(F.col(column)), F.col(column).cast("string")))
    return keyed.join(t, F.col("_key") == F.col("_v"), "left").withColumn(column, F.col("_t")).drop("_v", "_t", "_key")


def month(c: Column, dtype: str) -> Column:
    """YYYY-MM of a date, a text that is one date in one way, or null."""
    return F.date_format(c, "yyyy-MM") if dtype in ("date", "timestamp", "timestamp_ntz") else dates.text_month(c.cast("string"))


def plain(c: Column, dtype: str) -> Column:
    """What is sent of a column that isn't private: dates as shown, others as they are."""
    return F.date_format(c, "M/d/yyyy") if dtype in ("date", "timestamp", "timestamp_ntz") else c


def treatment_of(policy: Policy, dtype: str) -> str:
    """What a column's cells become; whatever can't be rendered becomes a token."""
    t = policy.effective()
    numeric = dtype in ("int", "bigint", "double", "float", "smallint", "tinyint") or dtype.startswith("decimal")
    return {"range": "range" if numeric else "stand_in"}.get(t, t)


def mask(df: DataFrame, policies: list[Policy], kinds: dict[str, str], row: list[str], cap: int | None = None, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(masked rows, token map).  cap: only the first rows in ``row`` order, between 1 and 200; excluded columns go.

    kinds: token kinds of columns, TEXT where missing.
    """
    columns = [c for c in df.columns if c != "_row"]
    by, types = lettered(columns, policies), dict(df.dtypes)
    if cap is not None:
        df = df.orderBy(*row).limit(max(1, min(MOST_ROWS, cap)))
    treated = {c: treatment_of(by[c], types[c]) for c in columns}
    tokens = {c: kinds.get(c, "TEXT") for c in columns if treated[c] == "stand_in" or treated[c] == "month"}
    reserved = token_shapes(df, columns)
    own = {c: k for c, k in tokens.items()}
    cells = private_cells(df, own, row) if own else None
    if cells is not None and any(treated[c] == "month" for c in own):
        # a month column's cells get tokens only where no month can be read
        late = [c for c in own if treated[c] == "month"]
        shown = df.withColumns({c: F.when(month(F.col(c), types[c]).isNull(), F.col(c).cast("string")) for c in late})
        cells = private_cells(shown, own, row)
    table = token_map(cells, prefix, reserved) if cells is not None else df.sparkSession.createDataFrame([], "value string, kind string, token string")
    table = written(table, "tokens")
    out = df
    for c in columns:
        t = treated[c]
        if t == "exclude":
            out = out.drop(c)
        elif t == "range":
            out = out.withColumn(c, render_range(F.col(c)))
        elif t == "as_is":
            out = out.withColumn(c, plain(F.col(c), types[c]))
        elif t == "month":
            m = month(F.col(c), types[c])
            if types[c] in ("date", "timestamp", "timestamp_ntz"):
                out = out.withColumn(c, m)
            else:
                out = tokenised(out.withColumn("_month", m).withColumn(c, F.when(m.isNull(), F.col(c))), c, table).withColumn(c, F.coalesce("_month", c)).drop("_month")
        else:
            out = tokenised(out, c, table)
    return out, table


def loose_columns(cells: DataFrame) -> DataFrame:
    """column of those whose eight-digit cells are dates; cells: column, value."""
    eight, good = _eight_digit_dates(F.col("value"))
    return cells.groupBy("column").agg(F.count_if(eight).alias("n"), F.count_if(eight & good).alias("good")).where("n > 0 and good * 2 >= n").select("column")


def loose_date_share(df: DataFrame, column: str) -> Column:
    """Whether an eight-digit column holds dates: half its eight-digit values are valid in some reading, placeholders aside."""
    eight, good = _eight_digit_dates(F.col(column))
    return df.agg(F.coalesce(F.count_if(eight & good) * 2 >= F.count_if(eight), F.lit(False)) & (F.count_if(eight) > 0)).scalar()


def with_loose(tokens: DataFrame, cells: DataFrame) -> DataFrame:
    """Tokens with ``loose``: whether a column whose eight digits are dates holds the value; cells: column, value."""
    of = cells.join(F.broadcast(loose_columns(cells)), "column").select("value").distinct().withColumn("loose", F.lit(True))  # a row a column
    return tokens.join(of, "value", "left").withColumn("loose", F.coalesce("loose", F.lit(False)))


def _eight_digit_dates(c: Column) -> tuple[Column, Column]:
    """Whether a cell is eight digits that aren't all alike, and whether they are a day from 1900 to 2100."""
    t = F.trim(c.cast("string"))
    eight = t.rlike(r"^\d{8}$") & ~t.rlike(r"^(\d)\1{7}$")
    ok = lambda fmt: F.try_to_date(t, fmt).between(F.lit("1900-01-01").cast("date"), F.lit("2100-12-31").cast("date"))
    return F.coalesce(eight, F.lit(False)), F.coalesce(ok("yyyyMMdd"), F.lit(False)) | F.coalesce(ok("MMddyyyy"), F.lit(False)) | F.coalesce(ok("ddMMyyyy"), F.lit(False))
