"""Ranges that move as a formula is filled down, ranges with computed ends, and criteria that come from the row.

Each fill row asks for an aggregate over other rows: of positions (a window, all rows so far, two ends of its own), of
equal keys, of values below or above its own, of texts that its pattern fits.  What the row asks is a set of conditions;
``Matched`` picks the plan: a grouped equi-join, a running aggregate over a range sort, cells of two sorts for two
inequalities, tiles for windows of positions, or a join of patterns and texts by their rarest piece.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import ranges as R
from . import syntax as S
from .values import Cell, Row, Sheet, Vec, number, serial, text

#: Operators that a criterion may begin with; longer ones first.
OPERATORS = ("<=", ">=", "<>", "<", ">", "=")


@dataclass
class Moving:
    """Columns of a sheet between two positions of their own for each fill row (ends included)."""

    sheet: Sheet
    columns: list[str]
    lo: tuple[str, object]  # ("fixed", position), ("row", offset from the fill row), ("computed", column)
    hi: tuple[str, object]

    def cells(self) -> list[Cell]:
        return [Cell(F.col(c), self.sheet.kinds[c], plain=True) for c in self.columns]

    def same_rows(self, other) -> bool:
        if not isinstance(other, Moving) or other.sheet is not self.sheet:
            return False
        return all(a[0] == b[0] and (a[1] is b[1] if a[0] == "computed" else a[1] == b[1]) for a, b in ((self.lo, other.lo), (self.hi, other.hi)))


def end_of(sheet: Sheet) -> int:
    """The last position of a sheet; -1 if it has no rows."""
    if sheet.end is None:
        top = sheet.rows().agg(F.max("_row")).first()[0]
        sheet.end = -1 if top is None else top
    return sheet.end


def _position(bound: tuple) -> Column:
    kind, x = bound
    return F.lit(x) if kind == "fixed" else F.col("_row") + x if kind == "row" else x


def moves(ref: S.Ref) -> bool:
    """Whether a filled-down reference covers other rows in each copy: whole columns and rows with $ don't move."""
    a = ref.area
    if a.top is None or a.left is None or (a.top <= 1 and a.bottom >= S.MAX_ROW - 1):
        return False
    return not (ref.fixed[0] and ref.fixed[2])


def of_reference(sheet: Sheet, columns: list[str], ref: S.Ref) -> Moving:
    """A filled-down range, as it stands for the first data row (position 0, row 2 of the sheet)."""
    bound = lambda top, fixed: ("fixed" if fixed else "row", top - 1)
    lo, hi = bound(ref.area.top, ref.fixed[0]), bound(ref.area.bottom, ref.fixed[2])
    if (lo[0], hi[0]) == ("row", "fixed") and lo[1] >= hi[1]:  # B$2:B2 stands in row 2 with either end first; from there on the fixed one is first
        lo, hi = hi, lo
    return Moving(sheet, columns, lo, hi)


# ---------------------------------------------------------------- aggregates of moving ranges


def asking(c, df: DataFrame, *columns) -> DataFrame:
    """Columns of the fill rows: from the sheet where they are its own, so that joins made before aren't made again."""
    try:
        return c.scope.frame.select(*columns)
    except AnalysisException:  # something joined before is asked for
        return df.select(*columns)


def windowed(c, m: Moving, values: dict[str, tuple[Column, str]]) -> None:
    """Joins aggregates of the points inside each fill row's range to the row; values: name -> (column over the range's rows, how).

    All aggregates over ranges with the same ends are computed together.
    """
    (lo_kind, lo), (hi_kind, hi) = m.lo, m.hi
    of = lambda bound: (bound[0], id(bound[1]) if bound[0] == "computed" else bound[1])
    group = c.scope.windows.setdefault((id(m.sheet), of(m.lo), of(m.hi)), {})
    first = not group
    group.update(values)

    def join(df: DataFrame) -> DataFrame:
        states = {n: how for n, (_, how) in group.items()}
        points, end = m.sheet.rows().select("_row", *(v.alias(n) for n, (v, _) in group.items())), end_of(m.sheet)
        rows = c.scope.frame.select("_row")
        if end < 0 or (lo_kind == "fixed" and lo > end):
            got = rows.limit(0).select("_row", *(F.lit(None).cast(dict(points.dtypes)[n]).alias(n) for n in states))
        elif lo_kind == hi_kind == "row" and abs(hi - lo) < R.NARROW:
            got = R.sliding(points, rows, min(lo, hi), max(lo, hi), states)
        elif lo_kind == "fixed" and hi_kind == "row" and lo <= hi:
            got = R.upto(points.where(F.col("_row") >= lo), rows.where(F.col("_row") + hi >= lo), hi, states, end)
        elif lo_kind == "row" and hi_kind == "fixed" and lo <= hi:
            got = _shrinking(points, rows, lo, hi, states, end)
        else:
            a, b = _position(m.lo), _position(m.hi)
            asked = asking(c, df, F.col("_row").alias("_id"), F.least(a, b).cast("long").alias("_lo"), F.greatest(a, b).cast("long").alias("_hi"), (a.isNotNull() & b.isNotNull()).alias("_known"))
            got = R.inside(points, asked.where("_known").drop("_known"), states, end, end_of(c.scope.sheet) + 1).withColumnRenamed("_id", "_row").hint("shuffle_hash")
        return df.join(got, "_row", "left")

    if first:
        c.scope.joins.append(join)


def _shrinking(points, rows, lo, hi, states, end):
    """From a moving row to a fixed one; rows that pass the fixed one have a range that grows below it."""
    within = R.upto(points.where(F.col("_row") <= hi), rows.where(F.col("_row") + lo <= hi), lo, states, min(hi, end), backward=True)
    beyond = R.upto(points.where(F.col("_row") >= hi), rows.where(F.col("_row") + lo > hi), lo, states, end) if hi <= end else None
    return within if beyond is None else within.unionByName(beyond)


def moving_states(c, m: Moving, values: dict[str, tuple[Column, str]]) -> dict[str, Column]:
    """The aggregated columns of the fill row, by name."""
    from .compile import fresh

    names = {n: fresh() for n in values}
    windowed(c, m, {names[n]: v for n, v in values.items()})
    return {n: F.col(names[n]) for n in values}


# ---------------------------------------------------------------- criteria


@dataclass
class Criterion:
    """What a row asks of the cells of a range: ``op`` and a value, or a pattern with * ? ~."""

    op: str
    value: Cell
    pattern: bool = False


def _pieces(node) -> list:
    return [*_pieces(node.left), node.right] if isinstance(node, S.Binary) and node.op == "&" else [node]


def criterion_of(c, node, env) -> Criterion:
    """Reads the operator and wildcards of a criterion's literal parts, before any row is looked at."""
    pieces = _pieces(node)
    op, pattern = "", False
    if isinstance(pieces[0], S.Literal) and pieces[0].kind == "text":
        op = next((o for o in OPERATORS if pieces[0].value.startswith(o)), "")
        rest = pieces[0].value[len(op) :]
        pieces = ([S.Literal(rest, "text")] if rest else []) + pieces[1:]
    pattern = any(map(criterion_of_literals, pieces))
    if not pieces:
        return Criterion(op or "=", Cell(F.lit(""), "text", const=True, value=""))
    if len(pieces) == 1:
        return Criterion(op or "=", c.scalar(pieces[0], env), pattern)
    cells = [c.scalar(p, env) for p in pieces]
    return Criterion(op or "=", Cell(F.concat(*(text(x) for x in cells)), "text", const=all(x.const for x in cells)), pattern)


def criterion_of_literals(node) -> bool:
    """Whether a literal part of a text holds wildcards."""
    return any(isinstance(p, S.Literal) and p.kind == "text" and any(ch in p.value for ch in "*?~") for p in _pieces(node))


def comparable(target: Cell, given: Cell) -> tuple[Column, Column] | None:
    """Both as columns that compare in order; None where no cell of the range can be larger or smaller."""
    numeric = ("number", "date")
    if target.kind in numeric and given.kind in numeric:
        whole = lambda x: serial(x.col) if x.kind == "date" else x.col.cast("double")
        return whole(target), number(given)
    if target.kind == given.kind == "text":
        return F.lower(target.col), F.lower(text(given))
    if target.kind in numeric and given.kind == "text":  # digits in a text
        from .values import parsed

        return (serial(target.col) if target.kind == "date" else target.col.cast("double")), parsed(given.col)
    return None


# ---------------------------------------------------------------- patterns


def as_regex(pattern: Column) -> Column:
    """A worksheet pattern in a column as a regular expression over a lower-cased text."""
    escaped = F.regexp_replace(F.lower(pattern), r"([\\\[\](){}.^$|+])", r"\\$1")
    kept = F.regexp_replace(escaped, "~([*?~])", "\u0001$1")  # an escaped sign stands for itself
    kept = F.regexp_replace(kept, "(?<!\u0001)\\*", "\u0002")
    kept = F.regexp_replace(kept, "(?<!\u0001)\\?", "\u0003")
    kept = F.regexp_replace(kept, "\u0001([*?])", r"\\$1")
    kept = F.regexp_replace(kept, "\u0001~", "~")
    return F.concat(F.lit("(?s)^"), F.translate(F.regexp_replace(F.regexp_replace(kept, "\u0002", ".*"), "\u0003", "."), "\u0001", ""), F.lit("\\z"))


#: Lengths of the pieces by which patterns and texts meet; the ends of a text count as letters of their own.
GRAMS = (1, 2, 3)
_START, _END = "\u0002", "\u0003"


def _grams(x: Column) -> Column:
    """All pieces of a text."""
    none = F.array().cast("array<string>")

    def of(k: int) -> Column:
        return F.when(F.char_length(x) >= k, F.transform(F.sequence(F.lit(1), F.char_length(x) - (k - 1)), lambda i: F.substring(x, i, F.lit(k)))).otherwise(none)

    parts = [of(k) for k in GRAMS]
    return F.array_distinct(F.concat(*parts))


def pattern_matches(points: DataFrame, patterns: DataFrame, key: str, states: dict[str, str], keys: list[str]) -> DataFrame:
    """keys, _pattern and the states of the texts that fit; points: keys, ``key`` (text), states; patterns: keys, _pattern, distinct.

    Each pattern meets only the texts that hold its rarest literal piece, by an equi-join on that piece, and is then
    tried in full.  A pattern of wildcards alone meets all texts; there are as few as kinds of such patterns.
    """
    texts = R.folded(points.where(F.col(key).isNotNull()).withColumn(key, F.lower(key)), [*keys, key], states)
    each = texts.select(key).distinct().withColumn("_gram", F.explode(F.concat(F.array(F.lit("")), _grams(F.concat(F.lit(_START), F.col(key), F.lit(_END))))))
    counts = each.where("_gram <> ''").groupBy("_gram").agg(F.count("*").alias("_n"))
    p = patterns.select("_pattern").distinct()
    plain = F.regexp_replace(F.lower("_pattern"), "~[*?~]", "\u0001")  # an escaped sign parts pieces as well: it is verified later
    bounded = F.concat(F.lit(_START), plain, F.lit(_END))
    pieces = F.flatten(F.transform(F.split(bounded, "[*?\u0001]"), _grams))
    asked = p.select("_pattern", F.explode(F.array_distinct(pieces)).alias("_gram")).where(~F.col("_gram").isin(_START, _END, ""))
    # a piece that no text has leaves its pattern without texts: it counts as the rarest
    rarest = asked.join(counts, "_gram", "left").groupBy("_pattern").agg(F.min_by("_gram", F.coalesce("_n", F.lit(0))).alias("_gram"))
    via = p.join(rarest, "_pattern", "left").select("_pattern", F.coalesce("_gram", F.lit("")).alias("_gram"))
    fits = via.join(each, "_gram").where(F.rlike(key, as_regex(F.col("_pattern")))).select("_pattern", key)
    if keys:
        return R.folded(patterns.join(fits, "_pattern").join(texts, [*keys, key]), [*keys, "_pattern"], states)
    return R.folded(fits.join(texts, key), ["_pattern"], states)


def row_of(c, ref: S.Ref) -> Row:
    """Cells of one row side by side, which moves as a whole."""
    a = ref.area
    return Row([c.reference(S.Ref(S.Area(a.sheet, a.top, k, a.bottom, k), ref.fixed, ref.text)) for k in range(a.left, a.right + 1)])


def fixed_vec(m: Moving) -> Vec | None:
    if m.lo[0] == m.hi[0] == "fixed":
        return Vec(m.sheet, m.columns, min(m.lo[1], m.hi[1]), max(m.lo[1], m.hi[1]))
    return None
