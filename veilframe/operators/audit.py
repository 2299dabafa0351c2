"""The audit of requests: structure, and every free text against every form of every private value.

Closed on failure: what can't be parsed or checked is blocked.  Messages name columns, never values.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from weakref import WeakSet

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.folding import fold_at
from ..functions.variants import Form, accept, code_projection, digit_projection, variants
from ..sources.rows import small_batches, spread, written
from . import parts
from .mask import TOKEN, loose_columns

_TOKEN = re.compile(TOKEN.replace(r"\b", ""), re.IGNORECASE)
_MAY_MASK = re.compile(r"_\d{3}")  # what every token holds
_BIN = re.compile(r"^(?:0|0-9|-9-0|([1-9])(0+)-\1(9+)|-([1-9])(9+)--\4(0+))$")
BINS = re.compile(r"(?<![\d-])-?([1-9])(0+|9+)--?\1(0+|9+)(?![\d-])|(?<![\d-])-?[09]--?[09](?![\d-])")
MONTH = re.compile(r"^\d{4}-(0[1-9]|1[0-2])$")
#: Forms that are broadcast to the texts at most (about half a kB of a task each).
BROADCAST_FORMS = 400_000
#: Columns whose forms are broadcast beyond that at most, the smallest first.
BROADCAST_COLUMNS = 1_000
#: Hits that leave a task at a time.
MOST_HITS = 50_000


def is_bin(text: str) -> bool:
    m = _BIN.match(text)
    return bool(m) and (m[2] is None or len(m[2]) == len(m[3])) and (m[5] is None or len(m[5]) == len(m[6]))


# ---------------------------------------------------------------- text


class Matcher:
    """Forms of private values as automata, for many texts."""

    def __init__(self, rows: Iterable[tuple[str, str, str, str]], private_dates: dict[str, set[str]] | None = None):
        """rows: (column, form, kind, rule); private_dates: ISO date -> columns."""
        import ahocorasick

        self.dates, self.automata = private_dates or {}, {}
        owners: dict[tuple[str, str], int] = {}
        own = lambda column, kind: owners.setdefault((column, kind), len(owners))
        groups: dict[str, dict[str, dict[tuple[str, str], str]]] = {}
        for column, form, kind, rule in rows:
            group = rule if rule in ("digits", "code") else "text"
            groups.setdefault(group, {}).setdefault(form, {}).setdefault((column, rule), kind)
        for group, forms in groups.items():
            a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            who = []  # of each form: (owner, whether what stands around a match decides, rule)
            for k, (form, of) in enumerate(forms.items()):
                a.add_word(form, k)
                who.append([(own(column, kind), group == "text" and rule != "any", rule) for (column, rule), kind in of.items()])
            a.make_automaton()
            alone = np.array([x[0][0] if len(x) == 1 and not x[0][1] else -1 for x in who], np.int64)
            self.automata[group] = a, np.fromiter(map(len, forms), np.int64, len(forms)), alone, who
        for column in sorted({c for of in self.dates.values() for c in of}):
            own(column, "date")
        self.owners, self.of_date = list(owners), {c: k for (c, kind), k in owners.items() if kind == "date"}

    def first(self, text: str, free: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, start, end): the earliest hit of each column and kind in ``text``; session tokens are no hits."""
        low, at, _ = fold_at(text)
        masked = [(m.start(), m.end()) for m in _TOKEN.finditer(text)] if _MAY_MASK.search(text) else []
        clear = lambda s, e: not any(s < b and a < e for a, b in masked)
        at = None if isinstance(at, range) else np.array(at)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        some: list[tuple[int, int, int]] = []
        for group, (a, length, alone, who) in self.automata.items():
            body, place = (low, None) if group == "text" else digit_projection(low) if group == "digits" else code_projection(low)
            found = list(a.iter(body))
            if not found:
                continue
            place = place if place is None or at is None else at[place]
            place = np.array(place) if place is not None else at
            first = {k: end for end, k in reversed(found)}
            ks, ends = (np.fromiter(x, np.int64, len(first)) for x in (first.keys(), first.values()))
            starts = ends - length[ks] + 1
            starts, ends = (starts, ends + 1) if place is None else (place[starts], place[ends] + 1)
            plain = alone[ks] >= 0
            for b, e in masked:
                plain &= (starts >= e) | (ends <= b)
            got.append((alone[ks[plain]], starts[plain], ends[plain]))
            rest = set(ks[~plain].tolist())
            seen: dict[int, set[int]] = {}  # owners that a form has been found for
            for end, k in found if rest else ():
                if k not in rest:
                    continue
                s, done = end - int(length[k]) + 1, seen.setdefault(k, set())
                b, e = (s, end + 1) if place is None else (int(place[s]), int(place[end]) + 1)
                for j, (owner, around, rule) in enumerate(who[k]):
                    if j not in done and (not around or accept(body, s, end + 1, rule)) and clear(b, e):
                        done.add(j)
                        some.append((owner, b, e))
                if len(done) == len(who[k]):
                    rest.discard(k)
        for f in dates.find_dates(text) if self.dates else ():
            if (free or not f.weak) and clear(f.start, f.end):
                some += [(self.of_date[column], f.start, f.end) for d in f.dates for column in self.dates.get(d, ())]
        if some:
            got.append(tuple(np.array(x, np.int64) for x in zip(*some, strict=True)))
        if not got:
            return (np.empty(0, np.int64),) * 3
        owner, start, end = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((end, start, owner))
        order = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
        return owner[order], start[order], end[order]

    def hits(self, text: str, free: bool = True) -> list[tuple[str, str, int, int]]:
        """(column, kind, start, end) of the same, by place."""
        found = zip(*(x.tolist() for x in self.first(text, free)), strict=True)
        return [(*self.owners[o], s, e) for o, s, e in sorted(found, key=lambda x: (x[1], x[2], x[0]))]


def forms_of(value: str, canary: bool = False) -> list[tuple[str, str, str]]:
    """(form, kind, rule); of the last four digits of a long number also the hidden spelling."""
    out = [(f.text, f.kind, f.rule) for f in variants(value, canary)]
    digits = re.sub(r"\D", "", value)
    if len(digits) >= 7:
        for mark in ("####", "****", "xxxx"):
            out.append((f"{mark}{digits[-4:]}", "digits", "any"))
            out.append((f"{mark}-{digits[-4:]}", "digits", "any"))
    return out


def dictionary(cells: DataFrame) -> DataFrame:
    """column, form, kind, rule of each private value; cells: column, value, and canary (optional)."""
    has = "canary" in cells.columns

    def run(batches):
        for pdf in batches:
            rows = [(c, *f) for c, v, k in zip(pdf["column"], pdf["value"], pdf["canary"] if has else [False] * len(pdf), strict=True) for f in forms_of(v, bool(k))]
            yield pd.DataFrame(rows, columns=["column", "form", "kind", "rule"])

    values = spread(cells.where("value is not null and value <> ''").distinct())
    d = values.mapInPandas(run, "column string, form string, kind string, rule string")
    return d.groupBy("column", "form", "rule").agg(F.min("kind").alias("kind")).select("column", "form", "kind", "rule")


def date_dictionary(cells: DataFrame) -> DataFrame:
    """column, day of each private value that is a date in some reading; eight digits count where they are dates in half of a column's cells."""

    def run(batches):
        for pdf in batches:
            rows = [(c, d) for c, v, loose in zip(pdf["column"], pdf["value"], pdf["loose"], strict=True) for d in (*dates.text_dates(v), *(dates.eight_digits(v) if loose else ()))]
            yield pd.DataFrame(rows, columns=["column", "day"])

    cells = cells.select("column", "value").where("value is not null")
    marked = cells.distinct().join(F.broadcast(loose_columns(cells).withColumn("loose", F.lit(True))), "column", "left").withColumn("loose", F.coalesce("loose", F.lit(False)))  # a row a column
    return marked.mapInPandas(run, "column string, day string").distinct()


def scan(texts: DataFrame, forms: DataFrame, days: DataFrame | None = None, key: str = "body_id", text: str = "text") -> DataFrame:
    """key, column, kind, start, end: the earliest hit of each key, column and kind.

    Up to BROADCAST_FORMS forms, or else those of the smallest columns, go to every executor and become automata there.  Of
    more, each stretch of a text that may hold a form goes to that form, by an equi-join of parts (``_of_many``); texts
    themselves stay where they are.  Days are joined where they are more than that.
    """
    small_batches(texts.sparkSession)
    kind = dict(texts.dtypes)[key]
    base = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, column string, kind string, start int, end int"
    day_map: dict[str, set[str]] = {}
    few_days = days is None or days.limit(BROADCAST_FORMS + 1).count() <= BROADCAST_FORMS
    if days is not None and few_days:
        for r in days.collect():  # at most BROADCAST_FORMS short rows
            day_map.setdefault(r["day"], set()).add(r["column"])
    forms = written(forms.select("column", "form", "kind", "rule"), "forms")
    few, many = _shared_out(forms)
    once, again = [], []  # hits that are the earliest of their text; hits of which the earliest have to be found
    if few is not None or day_map:
        table = texts.sparkSession.sparkContext.broadcast(None if few is None else few.toArrow())  # at most BROADCAST_FORMS rows

        def run(batches):
            m = Matcher(() if table.value is None else zip(*(table.value[c].to_pylist() for c in ("column", "form", "kind", "rule")), strict=True), day_map)
            for b in batches:
                yield from _hits(b, m)

        once.append(base.mapInArrow(run, schema))
    if many is not None:
        again.append(_of_many(base, many, schema))
    if not few_days:
        again.append(_date_join(base, days, kind))
    # a column's forms are all broadcast or none, but for short ones, and the days of both ways aren't asked for together
    if once and (_short(many) or not base.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()):
        again, once = once + again, []
    out = reduce(DataFrame.unionByName, again) if again else None
    if out is not None:
        first = out.groupBy("key", "column", "kind").agg(F.min(F.struct("start", "end")).alias("at"))
        out = first.select("key", "column", "kind", "at.start", "at.end")
    out = reduce(DataFrame.unionByName, [*once, *([out] if out is not None else [])]) if once or out is not None else texts.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("key", key)


def _stem(form) -> Column:
    return F.translate(form, parts.PARTING, "")


def _short(forms: DataFrame | None) -> bool:
    """Whether there are forms whose stem is too short to be looked up."""
    return forms is not None and not forms.where(F.length(_stem("form")) < parts.SHORT).isEmpty()


def _shared_out(forms: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The forms that are broadcast (with all whose stem is too short, which are few), and those that are looked up; None for no form."""
    n = forms.count()
    if n <= BROADCAST_FORMS:
        return (forms if n else None), None
    small, left = [], BROADCAST_FORMS // 2
    for r in forms.groupBy("column").agg(F.count("*").alias("n")).orderBy("n", "column").limit(BROADCAST_COLUMNS).collect():
        if r["n"] <= left:
            small.append(r["column"])
            left -= r["n"]
    here = F.col("column").isin(small) if small else F.lit(False)
    many = forms.where(~here)
    if not small and not _short(forms):
        return None, forms
    return forms.where(here | (F.length(_stem("form")) < parts.SHORT)), many


def _hits(b: pa.RecordBatch, m: Matcher):
    """Batches of the hits in some texts (key, text), MOST_HITS or one text's own at a time."""
    columns, kinds = (pa.array([o[j] for o in m.owners], pa.string()) for j in (0, 1))
    at, got, n = [], [], 0

    def out():
        owner, start, end = (np.concatenate(x) for x in zip(*got, strict=True))
        key = b.column(0).take(pa.array(np.repeat(at, [len(x[0]) for x in got])))
        return pa.RecordBatch.from_arrays([key, columns.take(pa.array(owner)), kinds.take(pa.array(owner)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["key", "column", "kind", "start", "end"])

    for k in range(b.num_rows):
        if text := b.column(1)[k].as_py():
            found = m.first(text)
            if len(found[0]):
                at.append(k)
                got.append(found)
                n += len(found[0])
        if n >= MOST_HITS:
            yield out()
            at, got, n = [], [], 0
    if got:
        yield out()


def _of_many(base: DataFrame, forms: DataFrame, schema: str) -> DataFrame:
    """Hits of very many forms.

    Each form is known by a part of its stem.  A place of a text that may belong to a stem goes to the stem's forms as a
    short stretch of the text, wide enough for the longest of them and for what stands around it; forms are tried there.
    """
    spark = base.sparkSession
    stems = forms.select(_stem("form").alias("form"), F.lit(0).alias("salt"), F.array("column", F.col("form").alias("f"), "kind", "rule").alias("own")).where(F.length("form") >= parts.SHORT)
    known = parts.chosen(stems).groupBy("part", "form", "size").agg(F.to_json(F.collect_list("own")).alias("own"))  # the spellings of one stem
    known = written(known.select("part", "size", F.length("form").alias("length"), "own"), "stems")
    sizes = known.groupBy("size").agg(F.max("length").alias("length")).collect()  # LONG - SHORT + 1 rows at most
    filter_, sizes, longest = spark.sparkContext.broadcast(parts.filter_of(known.select("part").distinct())), [r["size"] for r in sizes], max((r["length"] for r in sizes), default=0)
    key = base.schema["key"].dataType.simpleString()

    def stretches(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            ends = np.cumsum([len(t or "") for t in texts]) // parts.CHARS
            for first in [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist()] if texts else ():
                last = int(np.searchsorted(ends, ends[first], "right"))
                yield _stretches(b.slice(first, last - first), filter_.value, sizes, longest)

    met = base.where("text <> ''").mapInArrow(stretches, f"key {key}, part long, off int, text string, more int, masked array<int>")
    return met.join(known.select("part", "own"), "part").select("key", "off", "text", "more", "masked", "own").mapInArrow(_tried, schema)


#: Whether a stretch has more of its text before it and behind it.
_BEFORE, _BEHIND = 1, 2


def _stretches(b: pa.RecordBatch, words: np.ndarray, sizes: list[int], longest: int) -> pa.RecordBatch:
    """key, part, off, text, more, masked of the places that may belong to a stem; masked: the ends of session tokens in it."""
    texts = b.column(1).to_pylist()
    folds = [fold_at(t)[:2] for t in texts]
    of, part, left, right = parts.places([f for f, _ in folds], words, sizes, longest)
    off, text, more, masked = [], [], [], []
    tokens = {}
    for k, x, y in zip(of.tolist(), left.tolist(), right.tolist(), strict=True):
        t, at = texts[k], folds[k][1]
        more.append((x > 0) * _BEFORE + (y < len(at) - 1) * _BEHIND)
        x, y = at[x], at[y - 1] + 1 if y < len(at) - 1 else len(t)
        if k not in tokens:
            tokens[k] = [(m.start(), m.end()) for m in _TOKEN.finditer(t)] if _MAY_MASK.search(t) else ()
        off.append(x)
        text.append(t[x:y])
        masked.append([z - x for s, e in tokens[k] if s < y and x < e for z in (s, e)] or None)
    return pa.RecordBatch.from_arrays(
        [b.column(0).take(pa.array(of)), pa.array(part.view(np.int64)), pa.array(off, pa.int32()), pa.array(text, pa.string()), pa.array(more, pa.int32()), pa.array(masked, pa.list_(pa.int32()))],
        names=["key", "part", "off", "text", "more", "masked"],
    )


@lru_cache(4_096)
def _owners(text: str) -> list[list[str]]:
    return json.loads(text)


def _tried(batches):
    """The hits of each stretch's own forms: (key, off, text, more, masked, own) becomes (key, column, kind, start, end)."""
    for b in batches:
        at, got = [], []
        for k, (off, text, more, masked, own) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
            low, place, _ = fold_at(text)
            bodies = {"text": (low, None)}
            clear = lambda s, e, m=masked: not any(s < y and x < e for x, y in zip(m[::2], m[1::2], strict=True))
            for column, form, kind, rule in _owners(own):
                group = rule if rule in ("digits", "code") else "text"
                if group not in bodies:
                    bodies[group] = digit_projection(low) if group == "digits" else code_projection(low)
                body, inner = bodies[group]
                s = body.find(form)
                while s >= 0:
                    e = s + len(form)
                    # near an end that isn't the text's own it isn't known what stands around a match
                    sure = rule == "any" or group != "text" or ((s >= 4 or not more & _BEFORE) and (e + 4 <= len(low) or not more & _BEHIND) and accept(body, s, e, rule))
                    if sure:
                        x, y = (place[s], place[e - 1] + 1) if inner is None else (place[inner[s]], place[inner[e - 1]] + 1)
                        if not masked or clear(x, y):
                            at.append(k)
                            got.append((column, kind, off + x, off + y))
                            break
                    s = body.find(form, s + 1)
        if got:
            columns, kinds, starts, ends = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(columns, pa.string()), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["key", "column", "kind", "start", "end"])


def _date_join(base: DataFrame, days: DataFrame, kind: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            got = [(b, d, f.start, f.end) for b, t in zip(pdf["key"], pdf["text"], strict=True) if t for f in dates.find_dates(t) for d in f.dates]
            yield pd.DataFrame(got, columns=["key", "day", "start", "end"])

    found = base.mapInPandas(run, f"key {kind}, day string, start int, end int")
    return found.join(days, "day").groupBy("key", "column").agg(F.lit("date").alias("kind"), F.min("start").alias("start"), F.min_by("end", "start").alias("end")).select("key", "column", "kind", "start", "end")


# ---------------------------------------------------------------- structure


def structural(masked: DataFrame, treatments: dict[str, str], tokens: DataFrame, key: str) -> DataFrame:
    """key, column of every private cell that is neither a known token, a bin, a month nor null."""
    known = tokens.select(F.col("token").alias("_t"))
    items = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("treatment"), F.col(c).cast("string").alias("cell")) for c, t in treatments.items() if t in ("stand_in", "range", "month") and c in masked.columns]
    if not items:
        return masked.sparkSession.createDataFrame([], f"{key} string, column string")
    from ..functions.numbers import is_bin as bin_column

    cells = masked.select(key, F.inline(F.array(*items))).where("cell is not null")
    wrong = cells.where(((F.col("treatment") == "range") & ~bin_column(F.col("cell"))) | ((F.col("treatment") == "month") & ~F.col("cell").rlike(MONTH.pattern)))
    unknown = cells.where("treatment = 'stand_in'").join(known, F.col("cell") == F.col("_t"), "left_anti")
    return wrong.union(unknown).select(key, "column")


@dataclass
class Expected:
    """What a request may hold, from this side of the wire."""

    model: str
    system: str
    columns: list[dict]  # letter, header, type, private, treatment, note, stats
    tokens: set[str]
    rows_total: int
    mode: str


def messages(found: DataFrame, key: str = "body_id") -> DataFrame:
    """key, message: what is said of each body that a scan found something in; columns are named in order, values never."""
    per = found.groupBy(key).agg(F.array_sort(F.collect_set("column")).alias("_columns"))  # at most a name for each private column
    s = F.when(F.size("_columns") > 1, "s").otherwise("")
    return per.select(key, F.concat(F.lit("private values of column"), s, F.lit(" "), F.array_join("_columns", ", "), F.lit(" are in the text")).alias("message"))


@dataclass
class Result:
    ok: bool
    structural: list[str] = field(default_factory=list)
    hits: list[tuple[str, str]] = field(default_factory=list)
    error: str | None = None

    def message(self) -> str:
        if self.error:
            return self.error
        columns = sorted({c for c, _ in self.hits})
        parts = [f"private values of column{'s' * (len(columns) > 1)} {', '.join(columns)} are in the text"] if columns else []
        return "; ".join(parts + self.structural) or "passed"


#: The keys of a request, of its user turn, and of a column in it, in their order.
ENVELOPE = ("model", "messages", "temperature", "max_tokens", "reasoning", "response_format")
TURN = ("protocol", "mode", "sheet", "table", "range", "columns", "rows", "rows_sent", "rows_total", "context_ranges", "allowed_ranges", "task")
COLUMN = ("letter", "header", "type", "private", "treatment", "note", "stats")


def _envelope(body: str, want: Expected) -> tuple[list[str], dict]:
    data = json.loads(body)
    bad = []
    if json.dumps(data, ensure_ascii=False, separators=(",", ":")) != body:
        bad.append("the body isn't in its canonical form")
    if [k for k in data if k not in ENVELOPE] or not {"model", "messages"} <= set(data):
        bad.append("unknown keys")
    if data.get("model") != want.model:
        bad.append("another model")
    messages = data.get("messages", [])
    roles = [m.get("role") for m in messages]
    if not messages or roles[0] != "system" or messages[0].get("content") != want.system or set(roles[1:]) - {"user", "assistant"} or any(set(m) != {"role", "content"} for m in messages):
        bad.append("unexpected messages")
    turn = json.loads(messages[-1]["content"]) if messages and roles[-1] == "user" else {}
    return bad, turn


def _description(turn: dict, want: Expected) -> list[str]:
    bad = []
    if [k for k in turn if k not in TURN] or turn.get("mode") != want.mode:
        bad.append("an unexpected description")
    columns = turn.get("columns", [])
    if [{k: c.get(k) for k in ("letter", "header", "type", "private", "treatment")} for c in columns] != [{k: c[k] for k in ("letter", "header", "type", "private", "treatment")} for c in want.columns]:
        bad.append("columns differ")
    for c in columns:
        s = c.get("stats", {})
        if set(s) - {"blank", "distinct", "avg_words", "max_len"} or any(not isinstance(v, (int, float)) or isinstance(v, bool) or v < 0 for v in s.values()) or max(s.get("blank", 0), s.get("distinct", 0)) > want.rows_total or s.get("avg_words", 0) > 32_767 or round(s.get("avg_words", 0), 1) != s.get("avg_words", 0):
            bad.append(f"counts of column {c.get('letter')}")
    rows = turn.get("rows")
    if (rows is not None) != (want.mode == "substituted"):
        return [*bad, "rows in the wrong mode"]
    if rows is not None:
        sent = [c for c in want.columns if c["treatment"] != "exclude"]
        if turn.get("rows_sent") != len(rows) or turn.get("rows_total") != want.rows_total or any(len(r) != len(sent) for r in rows):
            bad.append("row counts")
        for k, c in enumerate(sent):
            if c["private"]:
                test = {"stand_in": lambda v: v in want.tokens, "range": lambda v: isinstance(v, str) and is_bin(v) or v in want.tokens, "month": lambda v: isinstance(v, str) and bool(MONTH.match(v)) or v in want.tokens}.get(c["treatment"], lambda v: False)
                if any(r[k] is not None and not test(r[k]) for r in rows if len(r) == len(sent)):
                    bad.append(f"column {c['letter']} isn't replaced everywhere")
    return bad


def _free(turn: dict, want: Expected) -> list[tuple[str, str]]:
    """(path, text) of what is free text in a request: headers, notes, the question, and plain cells."""
    out = [("task", turn.get("task") or ""), ("sheet", turn.get("sheet") or "")]
    out += [(f"columns.{k}.{w}", c.get(w) or "") for k, c in enumerate(turn.get("columns", [])) for w in ("header", "note")]
    sent = [c for c in want.columns if c["treatment"] != "exclude"]
    for r in turn.get("rows") or []:
        out += [(f"rows.{c['letter']}", str(v)) for v, c in zip(r, sent, strict=False) if v is not None and not c["private"]]
    return [(p, t) for p, t in out if t]


#: Keys whose texts come from closed lists and are compared as such.
CLOSED = ("protocol", "mode", "letter", "type", "treatment")


def _leaves(node, path: str = "") -> list[tuple[str, str]]:
    """(path, text) of every text in a turn, wherever it stands; bins are taken out, as they show no value."""
    if isinstance(node, str):
        return [(path, BINS.sub(" ", node))]
    items = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
    return [leaf for k, v in items if k not in CLOSED for leaf in _leaves(v, f"{path}.{k}".lstrip("."))]


def audit(body: str, want: Expected, matcher: Matcher) -> Result:
    """Of one request; never raises."""
    try:
        bad, turn = _envelope(body, want)
        bad += _description(turn, want)
        hits = {(c, k) for _, text in _free(turn, want) for c, k, _, _ in matcher.hits(text)}
        # and once more all that goes out, wherever it stands: what is no free text shows no date by chance
        hits |= {(c, k) for _, text in _leaves(turn) for c, k, _, _ in matcher.hits(text, free=False)}
        for m in json.loads(body)["messages"][1:-1]:
            hits |= {(c, k) for c, k, _, _ in matcher.hits(m["content"])}
        return Result(not bad and not hits, bad, sorted(hits))
    except Exception:  # noqa: BLE001  closed on failure, and no text of an exception goes out
        return Result(False, error="the request couldn't be checked")


def locate(turn: dict, want: Expected, matcher: Matcher) -> list[tuple[str, str, str, int, int]]:
    """(path, column, kind, start, end) of hits, for this side only."""
    return [(p, *h) for p, text in _free(turn, want) for h in matcher.hits(text)]


def passed(bodies: DataFrame, hits: DataFrame, wrong: DataFrame, key: str = "body_id") -> DataFrame:
    """The bodies that neither scan nor structure speaks against."""
    return bodies.join(hits.select(key).union(wrong.select(key)).distinct(), key, "left_anti")


class Audited:
    """A request that passed: made here only, and only the very object may be sent."""

    _issued: WeakSet = WeakSet()

    def __init__(self, body: str, mode: str):
        raise TypeError("requests are issued by issue()")


def issue(body: str, want: Expected, matcher: Matcher) -> Audited | Result:
    r = audit(body, want, matcher)
    if not r.ok:
        return r
    a = object.__new__(Audited)
    a.body, a.mode = body, want.mode
    Audited._issued.add(a)
    return a


def genuine(a) -> bool:
    return isinstance(a, Audited) and a in Audited._issued


__all__ = ["Audited", "Expected", "Form", "Matcher", "Result", "audit", "date_dictionary", "dictionary", "genuine", "is_bin", "issue", "locate", "passed", "scan", "structural"]
