"""Parts of private values in a question: candidates, choices, and their replacement."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folding import fold
from .mask import TOKEN

LEAST, MOST_CANDIDATES, MOST_CELLS = 4, 30, 150
#: Words that are sent to every executor at most; more are joined once the values of each part are chosen.
BROADCAST_WORDS = 10_000
_WORD = re.compile(r"[^\W_]+(?:['’.-][^\W_]+)*")


@dataclass(frozen=True)
class Candidate:
    value: str
    token: str
    kind: str
    count: int
    cells: tuple = ()


@dataclass
class Match:
    fragment: str
    key: str
    spans: list[tuple[int, int]]
    candidates: list[Candidate] = field(default_factory=list)
    more: int = 0

    @property
    def auto(self) -> bool:
        """One candidate of a kind that names something."""
        return len(self.candidates) == 1 and not self.more and self.candidates[0].kind != "TEXT"


def words_of(text: str, headers: list[str] = ()) -> dict[str, Match]:
    """Words of four letters or more, folded, with their places; tokens and column names are left out."""
    blocked = [m.span() for m in re.finditer(TOKEN, text)]
    low = text.lower()
    for h in headers:
        if h.strip():
            blocked += [m.span() for m in re.finditer(rf"(?<![^\W_]){re.escape(h.strip().lower())}(?![^\W_])", low)]
    out: dict[str, Match] = {}
    for m in _WORD.finditer(text):
        pieces = [m.span(), *((m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[^\W_]+", m[0]))]
        for s, e in dict.fromkeys(pieces):
            key = fold(text[s:e])
            if len(key) >= LEAST and not any(s < b and a < e for a, b in blocked):
                out.setdefault(key, Match(text[s:e], key, [])).spans.append((s, e))
    return out


def parts(c):
    """The parts of values, as a column: words of four characters or more that aren't the whole value."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+(?:['’.-][\p{L}\p{N}]+)*)"), F.lit(1))
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(F.array_distinct(F.concat(words, pieces)), lambda w: (F.length(w) >= LEAST) & (w != F.lower(F.trim(c))))


def candidates(words: DataFrame, cells: DataFrame, tokens: DataFrame) -> DataFrame:
    """part, value, token, kind, count, cells, rank, of_all: the values each part may stand for, most frequent first.

    words: part; cells: value and cell (an address).  An equi-join on parts; nothing but the chosen rows is collected.
    """
    per = cells.groupBy("value").agg(F.count("*").alias("count"), F.slice(F.array_sort(F.collect_set("cell")), 1, MOST_CELLS).alias("cells")) if "cell" in cells.columns else cells.groupBy("value").agg(F.count("*").alias("count"))
    asked = words.select("part").distinct()
    few = asked.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    found = per.join(tokens.select("value", "token", "kind"), "value").withColumn("part", F.explode(parts(F.col("value"))))
    if few:
        found = found.join(F.broadcast(asked), "part")  # at most BROADCAST_WORDS rows
    # a part that very many values share is cut to its first ones, and counted, in each task before it is a key
    w = Window.partitionBy("part").orderBy(F.desc("count"), "value")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MOST_CANDIDATES)
    total = found.groupBy("part").agg(F.count("*").alias("of_all"))
    if not few:
        ranked = ranked.join(asked, "part")
    return ranked.join(total, "part")


def find_partial(text: str, cells: DataFrame, tokens: DataFrame, headers: list[str] = ()) -> list[Match]:
    found = words_of(text, headers)
    if not found:
        return []
    spark = cells.sparkSession
    rows = candidates(spark.createDataFrame([(k,) for k in found], "part string"), cells, tokens).orderBy("part", "rank").collect()  # MOST_CANDIDATES rows a word of the question
    out = []
    for key, m in found.items():
        own = [r for r in rows if r["part"] == key]
        if own:
            m.candidates = [Candidate(r["value"], r["token"], r["kind"], r["count"], tuple(r["cells"]) if "cells" in r else ()) for r in own]
            m.more = own[0]["of_all"] - len(own)
            out.append(m)
    inside = lambda m: all(any(o is not m and len(o.fragment) > len(m.fragment) and a <= s and e <= b for o in out for a, b in o.spans) for s, e in m.spans)
    return sorted((m for m in out if not inside(m)), key=lambda m: m.spans[0])


def apply_choices(text: str, matches: list[Match], chosen: dict[str, list[str]]) -> str:
    """Chosen parts become their stand-ins, joined by "or"; only listed candidates count."""
    edits = []
    for m in matches:
        tokens = list(dict.fromkeys(chosen.get(m.key, [])))
        if tokens and set(tokens) <= {c.token for c in m.candidates}:
            edits += [(s, e, " or ".join(tokens)) for s, e in m.spans]
    limit = len(text) + 1
    for s, e, new in sorted(edits, reverse=True):
        if e <= limit:
            text = text[:s] + new + text[e:]
            limit = s
    return text
