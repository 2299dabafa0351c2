"""Stand-ins back to values: in formulas only inside string literals, in answers anywhere."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..formula.syntax import tokenize
from ..sources.rows import written
from .mask import TOKEN

_TOKEN = re.compile(TOKEN)


def resolve(token: str, values: dict[str, str], prefix: str = "", reserved: frozenset[str] = frozenset()) -> str | None:
    """The value of a token; with a prefix, a look-alike without it is sheet text only if it was there and its prefixed form is no token."""
    if token in values:
        return values[token]
    if prefix and not token.startswith(prefix) and prefix + token in values:
        return values[prefix + token]
    return token if token in reserved else None


def restore_formula(formula: str, values: dict[str, str], prefix: str = "", reserved: frozenset[str] = frozenset()) -> tuple[str, list[str]]:
    """(formula, tokens that are unknown). Quotes in values are doubled; nothing outside literals changes."""
    out, at, unknown = [], 0, []

    def put(m: re.Match) -> str:
        v = resolve(m[0], values, prefix, reserved)
        if v is None:
            unknown.append(m[0])
            return m[0]
        return v.replace('"', '""')

    for t in tokenize(formula):
        if t.kind == "text":
            out += [formula[at : t.at], _TOKEN.sub(put, t.text)]
            at = t.at + len(t.text)
        elif t.kind == "name" and _TOKEN.fullmatch(t.text):
            unknown.append(t.text)
    return "".join([*out, formula[at:]]), list(dict.fromkeys(unknown))


def restore_text(text: str, values: dict[str, str], prefix: str = "", reserved: frozenset[str] = frozenset()) -> str:
    return _TOKEN.sub(lambda m: resolve(m[0], values, prefix, reserved) or m[0], text)


def restore_column(df: DataFrame, column: str, tokens: DataFrame) -> DataFrame:
    """Texts with their tokens replaced.  Rows are numbered, so that repeated and null keys don't matter.

    Only the tokens of a text travel to the map and back; a text without any isn't touched.
    """
    columns = df.columns
    rows = _with_known(df, F.array_distinct(_tokens(F.col(column))), tokens)
    text = F.when(F.col("_known").isNull(), F.col(column)).otherwise(_replaced(F.col(column), lambda p: F.try_element_at("_known", p)))
    return rows.withColumn(column, text).select(columns)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def _with_known(df: DataFrame, wanted: Column, tokens: DataFrame) -> DataFrame:
    """Each row with ``_known``, a map of those of its wanted tokens that are known; null where there are none."""
    rows = written(df.withColumn("_row_of_text", F.monotonically_increasing_id()), "texts")
    values = tokens.select(F.col("token").alias("_token"), F.col("value").alias("_value")).dropDuplicates(["_token"])
    own = rows.select(F.col("_row_of_text").alias("_of"), F.explode(wanted).alias("_token")).join(values, "_token")
    known = own.groupBy("_of").agg(F.map_from_entries(F.collect_list(F.struct("_token", "_value"))).alias("_known"))  # a row's own tokens
    return rows.join(known, F.col("_row_of_text") == F.col("_of"), "left")


def _pieces(text: Column) -> Column:
    """(segment, is_token) of every run of plain text and every token, in order; none of a null."""
    found = _tokens(text)
    piece = lambda s, is_: F.struct(s.alias("segment"), F.lit(is_).alias("is_token"))
    every = F.flatten(F.transform(F.split(text, TOKEN), lambda p, i: F.array(piece(p, False), piece(F.get(found, i), True))))
    return F.filter(every, lambda p: p["segment"] != "")


def _replaced(text: Column, value) -> Column:
    """The text with its tokens' values; ``value`` may be null where it isn't known."""
    return F.array_join(F.transform(_pieces(text), lambda p: F.when(p["is_token"], F.coalesce(value(p["segment"]), p["segment"])).otherwise(p["segment"])), "")


#: Literals and quoted sheet names of a formula, and what is between them.
_STRETCH = r"""("[^"]*+(?:""[^"]*+)*+"?|'[^']*+(?:''[^']*+)*+'?|[^"']+)"""


def restore_formulas(df: DataFrame, column: str, tokens: DataFrame, prefix: str = "", reserved: tuple[str, ...] = ()) -> DataFrame:
    """A column of formulas with the tokens in their literals replaced, and ``unknown``: the tokens (each once, in their order)
    that have no value or stand outside a literal.

    The rules of ``restore_formula``, over a table: formulas meet their tokens by an equi-join, the rest is columns.  With a
    prefix, a look-alike without it means its prefixed form where that is a token, else itself where it is reserved.
    A null formula stays null and has no unknown token; a column named ``unknown`` is replaced.
    """
    columns = [c for c in df.columns if c != "unknown"]
    f = F.col(column)
    found = _tokens(f)
    wanted = F.array_distinct(F.concat(found, F.transform(F.filter(found, lambda t: ~t.startswith(prefix)), lambda t: F.concat(F.lit(prefix), t)))) if prefix else F.array_distinct(found)
    rows = _with_known(df.select(*columns), wanted, tokens)

    def value(t):
        known = F.try_element_at("_known", t)
        if prefix:
            known = F.coalesce(known, F.when(~t.startswith(prefix), F.try_element_at("_known", F.concat(F.lit(prefix), t))))
        return F.coalesce(known, F.when(t.isin(*reserved), t)) if reserved else known

    stretches = F.regexp_extract_all(f, F.lit(_STRETCH), F.lit(1))
    is_token = lambda p: p.rlike(f"^{TOKEN}$")
    put = lambda s: F.when(s.startswith('"'), _replaced(s, lambda t: F.replace(value(t), F.lit('"'), F.lit('""')))).otherwise(s)
    missing = lambda s: F.when(s.startswith('"'), F.filter(_tokens(s), lambda t: value(t).isNull())).when(s.startswith("'"), F.array().cast("array<string>")).otherwise(F.filter(F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}_.$]+)"), F.lit(1)), is_token))
    out = rows.withColumn("_formula", F.array_join(F.transform(stretches, put), "")).withColumn("unknown", F.array_distinct(F.flatten(F.transform(F.coalesce(stretches, F.array().cast("array<string>")), missing))))
    return out.withColumn(column, F.col("_formula")).select(*columns, "unknown")


def resolved(names: DataFrame, tokens: DataFrame, prefix: str = "", reserved: tuple[str, ...] = ()) -> DataFrame:
    """Each row (its column ``token``) with the value of its token, by two equi-joins; null where it has none."""
    values = tokens.select("token", "value").dropDuplicates(["token"])
    a, b = (values.select(F.col("token").alias(f"_t{k}"), F.col("value").alias(f"_v{k}")) for k in "ab")
    longer = F.when(~F.col("token").startswith(prefix), F.concat(F.lit(prefix), "token")) if prefix else F.lit(None).cast("string")
    both = names.withColumn("_longer", longer).join(a, F.col("token") == F.col("_ta"), "left").join(b, F.col("_longer") == F.col("_tb"), "left")
    kept = F.when(F.col("token").isin(*reserved), F.col("token")) if reserved else F.lit(None).cast("string")
    return both.select(*(c for c in names.columns if c != "value"), F.coalesce("_va", "_vb", kept).alias("value"))


def text_segments(df: DataFrame, column: str) -> DataFrame:
    """A row for each run of plain text and each token of every text: the other columns, n (from 0), segment, is_token."""
    others = [c for c in df.columns if c not in (column, "n", "segment", "is_token")]
    return df.select(*others, F.posexplode(_pieces(F.col(column))).alias("n", "_piece")).select(*others, "n", "_piece.segment", "_piece.is_token")


def segments(text: str) -> list[tuple[str, bool]]:
    """Runs of plain text and of tokens."""
    out, at = [], 0
    for m in _TOKEN.finditer(text):
        if m.start() > at:
            out.append((text[at : m.start()], False))
        out.append((m[0], True))
        at = m.end()
    return out + ([(text[at:], False)] if at < len(text) else [])


def cautions(values: DataFrame) -> DataFrame:
    """value, caution: what may not match as typed: patterns inside a value, and values stored as numbers or dates."""
    v = F.col("value")
    found = F.array_compact(F.array(F.when(v.rlike(r"[*?~]"), F.lit("wildcard")), F.when(v.rlike(r"^[+-]?\d+(\.\d+)?$"), F.lit("number")), F.when(v.rlike(r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$"), F.lit("date"))))
    return values.select("value", F.explode(found).alias("caution"))
