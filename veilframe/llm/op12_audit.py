"""Filter interaction audit by packed bitmaps.

``bitmaps`` builds an index: inside each partition, blocks of up to BLOCK rows of one part hold a NumPy bitset for
each filter (set: the document fails it) and for each label.  ``audit`` goes over the blocks: for each subset of
filters the documents that pass all of it are the AND-NOT of its bitsets, and popcounts of these, and of their AND
with the labels, are summed over blocks and partitions.  The 32 sums of a part give every order of the five
filters: a step removes what passes the filters before it less what passes them and its own.

Filter E needs the whole table: a document passes if its text's digest and id belong to the smallest id of its
text.  Those (digest, id) pairs, one for each distinct text, meet the rows by both, so a text that a third of all
rows share is no single join key, and only ids, digests and bits are shuffled, never texts.

Nulls: a null text is empty, a null source the part "".  A null id is neither smaller nor larger than another, so
its row passes E, and has no labels.  Rows that share an id and a text are equal to each other, not to a smaller
id.  Of several label rows of an id, a label holds if any has it.  An empty table gives an empty result.
Columns that aren't read may have any name.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, held, read, small_batches

FILTERS = "ABCDE"
LABELS = ("quality", "toxic")
#: Rows of a part in one block of the index; each of its bitsets has an eighth as many bytes.
BLOCK = 65_536

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = b"#$%&*|"
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes inside a code point
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _words(raw: bytes) -> tuple[int, int]:
    """Words and distinct words; a long text is split some at a time, at white space."""
    if len(raw) <= CHUNK_BYTES:
        w = raw.split()  # of bytes: at exactly \x20 and \x09-\x0d
        return len(w), len(set(w))
    n, seen, at = 0, set(), 0
    while at < len(raw):
        stop = _SPACE.search(raw, min(at + CHUNK_BYTES, len(raw)))
        end = stop.start() if stop else len(raw)
        w = raw[at:end].split()
        n += len(w)
        seen.update(w)
        at = end
    return n, len(seen)


def failures(raw: bytes) -> int:
    """Bits of the failed filters A to D of one text."""
    n, distinct = _words(raw)
    chars = len(raw.translate(None, _FOLLOWING))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (n < 50) | (100 * distinct < 65 * n) << 1 | (100 * capitals > 5 * chars) << 2 | (len(raw.translate(None, _SIGNS)) < len(raw)) << 3


def _judged(batches):
    for b in batches:
        bits, digest = [], []
        for text in b.column(1):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            bits.append(failures(raw))
            digest.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(digest, pa.binary()), pa.array(bits, pa.int32())], names=["doc_id", "part", "digest", "bits"])


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row per document: part, bits (of failed filters A to E, then of the labels)."""
    small_batches(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"))
    rows = held(own.mapInArrow(_judged, "doc_id long, part string, digest binary, bits int"))
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = [F.max((F.coalesce(labels[c], F.lit(0)) == 1).cast("int")).alias(f"_{c}") for c in LABELS]
    marked = labels.groupBy(labels[id_col].cast("long").alias("doc_id")).agg(*marks)
    known = rows.where("doc_id IS NOT NULL").join(firsts, ["doc_id", "digest"], "left").join(marked, "doc_id", "left")
    copy = F.when(F.col("first").isNull(), 1 << 4).otherwise(0)
    own_marks = [F.coalesce(F.col(f"_{c}"), F.lit(0)) * (1 << (5 + k)) for k, c in enumerate(LABELS)]
    bits = F.col("bits") + copy + own_marks[0] + own_marks[1]
    return known.select("part", bits.cast("int").alias("bits")).unionByName(rows.where("doc_id IS NULL").select("part", "bits"))


# ---------------------------------------------------------------- the index

PLANES = [*FILTERS, *LABELS]
_INDEX = "part string, n int, " + ", ".join(f"{x} binary" for x in PLANES)


def _blocks(batches):
    """Rows of a batch by part, each part's bits packed plane by plane."""
    for b in batches:
        if not len(b):
            continue
        names, code = np.unique(np.array(b.column(0).to_pylist(), object), return_inverse=True)
        order = np.argsort(code, kind="stable")
        bits = b.column(1).to_numpy(zero_copy_only=False)[order]
        edges = np.searchsorted(code[order], np.arange(len(names) + 1))
        parts, sizes, planes = [], [], [[] for _ in PLANES]
        for k, name in enumerate(names.tolist()):
            for at in range(edges[k], edges[k + 1], BLOCK):
                some = bits[at : min(at + BLOCK, edges[k + 1])]
                parts.append(name)
                sizes.append(len(some))
                for p, out in enumerate(planes):
                    out.append(np.packbits((some >> p) & 1).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(sizes, pa.int32()), *(pa.array(x, pa.binary()) for x in planes)], names=["part", "n", *PLANES])


def bitmaps(rows: DataFrame) -> DataFrame:
    """The index of judged rows: part, n, and a bitset of n bits for each filter and label."""
    return rows.select("part", "bits").mapInArrow(_blocks, _INDEX)


def popcounts(n: int, planes: list[np.ndarray]) -> np.ndarray:
    """Of a block, for each subset of filters: documents that pass all of it, and those of them with each label."""
    passing = np.empty((1 << len(FILTERS), len(planes[0])), np.uint8)
    passing[0] = np.packbits(np.ones(n, np.uint8))
    for subset in range(1, len(passing)):
        low = (subset & -subset).bit_length() - 1
        passing[subset] = passing[subset & (subset - 1)] & ~planes[low]
    of = [passing, *(passing & planes[len(FILTERS) + k] for k in range(len(LABELS)))]
    return np.stack([np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in of], axis=1)


_COUNTS = "part string, subset int, passing long, good long, toxic long"


def _counted(batches):
    """Sums of a task's blocks; at most 4,096 parts are held at a time."""
    sums: dict[str, np.ndarray] = {}

    def out():
        total = np.concatenate(list(sums.values()))
        k = 1 << len(FILTERS)
        names = [x for p in sums for x in [p] * k]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.tile(np.arange(k, dtype=np.int32), len(sums))), *(pa.array(total[:, c]) for c in range(3))], names=["part", "subset", "passing", "good", "toxic"])

    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for part, n, *raw in zip(*cols, strict=True):
            got = popcounts(n, [np.frombuffer(x, np.uint8) for x in raw])
            sums[part] = sums[part] + got if part in sums else got
            if len(sums) > 4096:
                yield out()
                sums.clear()
    if sums:
        yield out()


def subset_counts(index: DataFrame) -> DataFrame:
    """part, subset (bits of filters), passing, good, toxic (documents that pass the subset; those of them with a label)."""
    sums = [F.sum(c).alias(c) for c in ("passing", "good", "toxic")]
    return index.mapInArrow(_counted, _COUNTS).groupBy("part", "subset").agg(*sums)


# ---------------------------------------------------------------- orders and steps


def audit(counts: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows of each part."""
    full = (1 << len(FILTERS)) - 1
    of = F.map_from_entries(F.collect_list(F.struct("subset", F.struct("passing", "good", "toxic"))))  # 32 entries
    parts = counts.groupBy("part").agg(of.alias("of"))
    order = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    rows = parts.withColumn("filter_order", F.explode(order)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def mask(upto: Column) -> Column:
        """Bits of the first letters of the order."""
        some = F.substring("filter_order", F.lit(1), upto)
        return sum(((F.instr(some, x) > 0).cast("int") * (1 << k) for k, x in enumerate(FILTERS)), F.lit(0))

    rows = rows.withColumns({"_before": mask(F.col("step") - 1), "_after": mask(F.col("step"))})
    bit = F.col("_after") - F.col("_before")
    at = lambda subset, what="passing": F.col("of")[subset][what]
    lost = lambda what: at(F.col("_before"), what) - at(F.col("_after"), what)
    fails = at(F.lit(0)) - at(bit)
    # a subset of k filters comes before this one in k! (4 - k)! of the orders
    weight = F.array(*(F.lit(w) for w in (24, 6, 4, 6, 24)))
    own = lambda s: F.get(weight, F.bit_count(s)) * (at(s) - at(s + bit))
    others = F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: s.bitwiseAND(bit) == 0)
    shapley = F.aggregate(others, F.lit(0).cast("long"), lambda a, s: a + own(s))
    return rows.select(
        "part", "filter_order", "step", at(F.col("_after")).alias("kept"), lost("passing").alias("removed"), (fails - lost("passing")).alias("redundant"),
        (at(F.lit(full) - bit) - at(F.lit(full))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    return audit(subset_counts(bitmaps(judged(docs, labels, **columns))))


def op12_bitmap_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
     coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic, len(list_filter(fails, lambda x: x)) AS failed FROM f GROUP BY part, fails),
o AS (SELECT '' AS filter_order, 0 AS step UNION ALL SELECT filter_order || x, step + 1 FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE step < 5 AND NOT contains(filter_order, x)),
full_orders AS (SELECT filter_order FROM o WHERE step = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM full_orders),
g AS (
  SELECT c.*, filter_order, step, fails[ascii(filter_order[step]) - 64] AS own,
    list_bool_or([fails[ascii(x) - 64] for x in string_split(filter_order[1:step - 1], '') if x <> '']) AS earlier
  FROM c, s),
r AS (
  SELECT part, filter_order, step, filter_order[step] AS letter,
    sum(n) FILTER (WHERE NOT own AND NOT coalesce(earlier, false)) AS kept,
    sum(n) FILTER (WHERE own AND NOT coalesce(earlier, false)) AS removed,
    sum(n) FILTER (WHERE own AND coalesce(earlier, false)) AS redundant,
    sum(n) FILTER (WHERE own AND failed = 1) AS unique_fails,
    sum(good) FILTER (WHERE own AND NOT coalesce(earlier, false)) AS good_lost,
    sum(toxic) FILTER (WHERE own AND NOT coalesce(earlier, false)) AS toxic_lost
  FROM g GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""
