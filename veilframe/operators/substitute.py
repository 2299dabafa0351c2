"""Private values in free text replaced by their stand-ins."""

from __future__ import annotations

import re
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.folding import fold_map
from ..functions.folding import fold
from ..functions.variants import accept
from ..sources.rows import written
from . import parts

LEAST_FOLDED = 4
_BLANKS = re.compile(" {2,}")
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


@dataclass(frozen=True)
class Entry:
    value: str
    token: str
    loose: bool = False  # of a column whose eight digits are dates


class Substituter:
    """Longest first, dates leftmost first; whole words; any case and white space from four characters on."""

    def __init__(self, entries: list[Entry], headers: dict[str, str] | None = None):
        """headers: a column's own header -> its alias."""
        import ahocorasick

        self.days: dict[str, Entry] = {}
        self.a = ahocorasick.Automaton()
        known: dict[str, tuple[str, str | None]] = {}
        for e in entries:
            for d in (*dates.text_dates(e.value), *(dates.eight_digits(e.value) if e.loose else ())):
                self.days.setdefault(d, e)
            key = re.sub(r"\s+", " ", fold(e.value).strip())
            if key:
                known.setdefault(key, (e.token, e.value if len(e.value) < LEAST_FOLDED else None))
        for h, alias in (headers or {}).items():
            known.setdefault(re.sub(r"\s+", " ", fold(h).strip()), (alias, None))
        for key, (token, exact) in known.items():
            self.a.add_word(key, (key, token, exact))
        if known:
            self.a.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        low, at, _ = fold_map(text)
        # runs of white space count as one
        flat = _BLANKS.sub(" ", low)
        keep = range(len(low)) if len(flat) == len(low) else [k for k, ch in enumerate(low) if ch != " " or low[k - 1 : k] != " "]
        taken: list[tuple[int, int, str]] = []
        used = bytearray(len(text))  # a mark for each character, so that a place is asked for by itself and not against all spans

        def take(s: int, e: int, token: str) -> None:
            if used.find(1, s, e) < 0:
                used[s:e] = b"\1" * (e - s)
                taken.append((s, e, token))

        for f in dates.find_dates(text) if self.days else ():
            if hit := next((self.days[d] for d in f.dates if d in self.days), None):
                take(f.start, f.end, hit.token)
        found = []
        if len(self.a):
            last = len(flat)
            for end, (key, token, exact) in self.a.iter(flat):
                s, e = end - len(key) + 1, end + 1
                # most matches are inside words: of plain letters that is seen at once
                if e < last and flat[end] in _PLAIN and flat[e] in _PLAIN or s > 0 and flat[s] in _PLAIN and flat[s - 1] in _PLAIN:
                    continue
                if accept(flat, s, e, "word"):
                    a, b = at[keep[s]], at[keep[e - 1]] + 1
                    if exact is None or text[a:b] == exact:
                        found.append((a, b, token))
        for a, b, token in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
            take(a, b, token)
        return sorted(taken)

    def replace(self, text: str) -> str:
        out, at = [], 0
        for a, b, token in self.spans(text):
            out += [text[at:a], token]
            at = b
        return "".join([*out, text[at:]])


#: Values that are sent to every executor at most (about a kB of a task each); more are brought only to the texts that may hold them.
BROADCAST_VALUES = 400_000
#: What a value's match is found by: a run of letters and digits, one ideograph, or one other character.
_RUN = re.compile(r"[぀-鿿]|(?:(?![぀-鿿])\w)+|[^\w\s]")


def substituted(df: DataFrame, column: str, tokens: DataFrame) -> DataFrame:
    """The column with private values replaced; tokens: value, token, and loose (optional: eight digits of it are a date)."""
    tokens = tokens.select("value", "token", F.col("loose") if "loose" in tokens.columns else F.lit(False).alias("loose"))
    if tokens.limit(BROADCAST_VALUES + 1).count() > BROADCAST_VALUES:
        return _substituted_by_join(df, column, tokens)
    rows = df.sparkSession.sparkContext.broadcast(sorted((r["value"], r["token"], r["loose"]) for r in tokens.collect()))  # at most BROADCAST_VALUES rows

    def run(batches):
        s = Substituter([Entry(*r) for r in rows.value])
        for pdf in batches:
            pdf[column] = [None if t is None else s.replace(t) for t in pdf[column]]
            yield pdf

    return df.mapInPandas(run, df.schema)


def _hashed(keys: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(k.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for k in keys], np.uint64)


def _asked_for(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """_row_of_text, key, by: of all runs and days of a text only those leave its task that a filter of the values' own lets through; known: part."""
    asked = rows.sparkSession.sparkContext.broadcast(parts.filter_of(known.select("part").distinct()))

    def of_texts(batches):
        for pdf in batches:
            got = [(r, k, kind) for r, t in zip(pdf["_row_of_text"], pdf[column], strict=True) if t for kind, keys in (("run", set(_RUN.findall(fold(t)))), ("day", {d for f in dates.find_dates(t) for d in f.dates})) for k in keys]
            yield pd.DataFrame([got[k] for k in parts.passed(asked.value, _hashed([x[1] for x in got]))], columns=["_row_of_text", "key", "by"])

    return rows.select("_row_of_text", column).mapInPandas(of_texts, "_row_of_text long, key string, by string")


def _substituted_by_join(df: DataFrame, column: str, tokens: DataFrame) -> DataFrame:
    """Values meet the texts that hold their rarest run (matches are of whole words, so a match has it whole) or one of their days."""
    columns = df.columns
    rows = written(df.withColumn("_row_of_text", F.monotonically_increasing_id()), "texts")

    def of_values(batches):
        for pdf in batches:
            got = [(v, t, bool(l), k, kind) for v, t, l in zip(pdf["value"], pdf["token"], pdf["loose"], strict=True) for kind, keys in (("run", set(_RUN.findall(fold(v)))), ("day", {*dates.text_dates(v), *(dates.eight_digits(v) if l else ())})) for k in keys]
            yield pd.DataFrame(got, columns=["value", "token", "loose", "key", "by"]).assign(part=_hashed([x[3] for x in got]).view(np.int64))

    keyed = tokens.where("value is not null").mapInPandas(of_values, "value string, token string, loose boolean, key string, by string, part long")
    often = keyed.where("by = 'run'").groupBy("key").agg(F.count("*").alias("n"))
    rarest = keyed.where("by = 'run'").join(often, "key").groupBy("value", "token", "loose").agg(F.min_by(F.struct("key", "part"), F.struct("n", "key")).alias("k")).select("value", "token", "loose", "k.key", F.lit("run").alias("by"), "k.part")
    known = written(rarest.unionByName(keyed.where("by = 'day'")), "keys")
    found = _asked_for(rows, column, known).join(known.drop("part"), ["key", "by"]).select(F.col("_row_of_text").alias("_of"), "value", "token", "loose").distinct()
    own = found.groupBy("_of").agg(F.sort_array(F.collect_list(F.struct("value", "token", "loose"))).alias("_entries"))  # what one text may hold

    def run(batches):
        for pdf in batches:
            pdf[column] = [t if t is None or e is None else Substituter([Entry(x["value"], x["token"], x["loose"]) for x in e]).replace(t) for t, e in zip(pdf[column], pdf["_entries"], strict=True)]
            yield pdf[columns]

    return rows.join(own, F.col("_row_of_text") == F.col("_of"), "left").select(*columns, "_entries").mapInPandas(run, df.schema)


def headers_hidden(text: str, aliases: dict[str, str]) -> str:
    return Substituter([], aliases).replace(text)


def frame_of_spans(df: DataFrame, key: str, column: str, tokens: list[Entry]) -> DataFrame:
    """key, start, end, token of every replacement."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        s = Substituter(tokens)
        for pdf in batches:
            yield pd.DataFrame([(k, *x) for k, t in zip(pdf[key], pdf[column], strict=True) if t for x in s.spans(t)], columns=[key, "start", "end", "token"])

    return df.select(key, column).mapInPandas(run, f"{key} {kind}, start int, end int, token string")
