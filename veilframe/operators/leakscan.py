"""The independent leak scan: whether any private value is in any body that goes out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rows import small_batches, written
from . import parts

LEAST, LEAST_DIGITS = 4, 7
#: Forms that every body is compared with one by one at most; more are looked up by a part of theirs.
BROADCAST_VALUES = 200
#: Characters of all forms together up to which each task makes one automaton of them (about 50 bytes a character).
AUTOMATON_CHARS = 4_000_000
#: Bodies that meet one automaton of the forms that they may hold, and hits that leave a task at a time.
ROWS, MOST_HITS = 256, 100_000
#: Forms whose parts are broadcast at most; more are joined by a shuffle.
BROADCAST_PARTS = 20_000
_BIN = r"(?<![\d-])-?([1-9])(0+|9+)--?\1(0+|9+)(?![\d-])|(?<![\d-])-?[09]--?[09](?![\d-])"


def escaped(c: Column) -> Column:
    """As JSON writes it inside a string."""
    out = c
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def variants(values: DataFrame, canaries: DataFrame | None = None) -> DataFrame:
    """id, kind, numeric, variant, form: how a value may show; each form once, the plainest name first."""
    v = F.col("value")
    digits = F.regexp_replace(v, r"\D", "")
    long_ = F.length(v) >= LEAST
    one = lambda rank, name, form, ok: F.when(ok & (F.length(form) >= LEAST), F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("variant"), F.lower(form).alias("form")))
    forms = F.array_compact(F.array(one(0, "exact", v, long_), one(1, "json", escaped(v), long_), one(2, "json2", escaped(escaped(v)), long_), one(3, "digits", digits, F.length(digits) >= LEAST_DIGITS)))
    numeric = v.rlike(r"^-?\d+(\.\d+)?$")
    out = values.select(F.col("value").alias("id"), F.lit("value").alias("kind"), numeric.alias("numeric"), F.inline(forms))
    if canaries is not None:
        out = out.union(canaries.where("value <> ''").select(F.col("value").alias("id"), F.lit("canary"), F.lit(False), F.lit(0), F.lit("canary"), F.lower("value")))
    return out.groupBy("id", "kind", "numeric", "form").agg(F.min(F.struct("rank", "variant")).alias("v")).select("id", "kind", "numeric", "form", F.col("v.rank").alias("rank"), F.col("v.variant").alias("variant"))


def leaks(bodies: DataFrame, values: DataFrame, canaries: DataFrame | None = None, body_id: str = "body_id", body: str = "body") -> DataFrame:
    """body_id, kind, id, variant: each value that a body holds, by its plainest form."""
    return leaks_of(bodies, stored(values, canaries), body_id, body)


def stored(values: DataFrame, canaries: DataFrame | None = None) -> DataFrame:
    """The forms of values and canaries, written once."""
    return written(variants(values.select("value").distinct(), canaries), "forms")


def leaks_of(bodies: DataFrame, forms: DataFrame, body_id: str = "body_id", body: str = "body") -> DataFrame:
    """Leaks of stored forms.

    A number that is only the bound of a bin is no leak: bins are taken out before numbers are looked for.
    A few forms are tried one by one on each body, more are one automaton a task, and beyond AUTOMATON_CHARS bodies
    first meet, by an equi-join of parts, the forms that they may hold.
    """
    texts = bodies.select(F.col(body_id).alias("body_id"), F.lower(body).alias("text"))
    bare = F.regexp_replace("text", _BIN, "|")
    size = forms.agg(F.count("*"), F.sum(F.length("form")), F.max("numeric"), F.min(F.length("form"))).first()
    if size[0] <= BROADCAST_VALUES:
        hit = F.when(F.col("numeric"), F.contains("bare", "form")).otherwise(F.contains("text", "form"))
        found = texts.withColumn("bare", bare).join(F.broadcast(forms), hit)  # at most BROADCAST_VALUES short rows
    else:
        texts = texts.withColumn("bare", bare if size[2] else F.lit(None).cast("string"))
        if size[1] <= AUTOMATON_CHARS:
            found = by_automaton(texts, forms)
        else:
            found = by_parts(texts, forms.where(F.length("form") >= parts.SHORT))
            if size[3] < parts.SHORT:  # there are few so short ones
                found = found.unionByName(by_automaton(texts, forms.where(F.length("form") < parts.SHORT)).select(found.columns))
    return found.groupBy("body_id", "kind", "id").agg(F.min_by("variant", "rank").alias("variant"))


def _finder(forms: list[str], numeric: list[bool]):
    """A function of bodies (body_id, text, bare) that gives their hits, MOST_HITS at a time; each form is looked for where its kind is."""
    import ahocorasick

    automata = [ahocorasick.Automaton(ahocorasick.STORE_INTS) for _ in range(2)]
    for k, (f, n) in enumerate(zip(forms, numeric, strict=True)):
        automata[n].add_word(f, k)
    for a in automata:
        a.make_automaton()

    def find(b: pa.RecordBatch):
        at, form, bare = [], [], []
        for which, a in enumerate(automata):
            for k in range(b.num_rows if len(a) else 0):
                found = {x for _, x in a.iter(text)} if (text := b.column(which + 1)[k].as_py()) else ()
                at += [k] * len(found)
                form += [forms[x] for x in found]
                bare += [which == 1] * len(found)
                if len(at) >= MOST_HITS:
                    yield _batch(b, at, form, bare)
                    at, form, bare = [], [], []
        if at:
            yield _batch(b, at, form, bare)

    return find


def _batch(b: pa.RecordBatch, at: list[int], form: list[str], bare: list[bool]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(form, pa.string()), pa.array(bare, pa.bool_())], names=["body_id", "form", "numeric"])


def by_automaton(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """Bodies (body_id) with the forms that they hold; numbers are looked for without the bins."""
    small_batches(texts.sparkSession)
    known = texts.sparkSession.sparkContext.broadcast(forms.select("form", "numeric").distinct().toArrow())  # at most AUTOMATON_CHARS characters
    kind = texts.select("body_id").schema["body_id"].dataType.simpleString()

    def run(batches):
        find = _finder(known.value["form"].to_pylist(), known.value["numeric"].to_pylist())
        for b in batches:
            yield from find(b)

    return texts.select("body_id", "text", "bare").mapInArrow(run, f"body_id {kind}, form string, numeric boolean").join(forms, ["form", "numeric"])


def by_parts(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """As by_automaton; each body is looked through for those forms only whose rarest part (among all forms' parts) occurs in it or near it."""
    small_batches(texts.sparkSession)
    texts = written(texts.withColumn("_row", F.monotonically_increasing_id()), "bodies")
    rarest = written(parts.chosen(forms.select("form", F.lit(0).alias("salt")).distinct()), "parts")
    near = F.broadcast if rarest.count() <= BROADCAST_PARTS else lambda x: x
    held = parts.met(texts.select("_row", "text", "bare"), rarest, lambda row: [(t, 0) for t in row if t])
    of = held.join(near(rarest), "part").join(forms.select("form", "numeric").distinct(), "form")
    own = of.groupBy(F.col("_row").alias("_of")).agg(F.collect_set(F.struct("form", "numeric")).alias("own"))  # what one body may hold
    kind = texts.select("body_id").schema["body_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                b = whole.slice(first, ROWS)
                both = {(x["form"], x["numeric"]) for o in b.column(3).to_pylist() for x in o}
                yield from _finder([f for f, _ in both], [n for _, n in both])(b)

    met = texts.join(own, F.col("_row") == F.col("_of")).select("body_id", "text", "bare", "own")
    return met.mapInArrow(run, f"body_id {kind}, form string, numeric boolean").join(forms, ["form", "numeric"])


def report(bodies: DataFrame, found: DataFrame, body_id: str = "body_id", mode: str = "mode") -> DataFrame:
    """mode, requests, leaking_requests, leaks."""
    per = found.groupBy("body_id").agg(F.count("*").alias("n"))
    b = bodies.select(F.col(body_id).alias("body_id"), F.col(mode).alias("mode"))
    return b.join(per, "body_id", "left").groupBy("mode").agg(F.count("*").alias("requests"), F.count("n").alias("leaking_requests"), F.coalesce(F.sum("n"), F.lit(0)).alias("leaks"))
