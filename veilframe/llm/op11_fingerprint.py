"""Document fingerprints by a homomorphic multiset hash.

A text is cut into paragraphs: at line breaks, and inside a line after each word of LONG bytes or more whose hash
is divisible by PICK, so that a text in one line has several as well (short words are the frequent ones, after
which the same few words would follow again and again).  Where a cut falls depends on the word before it alone.
Each paragraph's 512-bit digest gives a wide vector: four lanes that are uniform modulo 2^64, and 256 lanes of
+1 or -1 modulo 2^32.  A text's fingerprint is the sum of its paragraphs' vectors.

* Texts of the same paragraphs, in any order, have equal fingerprints, and others differ but for a chance of 2^-256.
* A paragraph is inserted by adding its vector and deleted by subtracting it; an edited text's fingerprint comes
  from that of the text and the paragraphs that the edit touches.
* The squared length of a difference of signed lanes estimates how many paragraphs differ, so two fingerprints
  give a likeness: twice the product by the sum of squares, about the share of paragraphs in common (the standard
  error is 1/16).

``tail_edits`` needs each row's successor.  Rows are dealt out by ranges of (id, hash of the text), with splitters
from quantiles of the ids; each range also receives the first row of the range after it, so the texts are shuffled
once and no range waits for another.

Nulls: a null text is empty, and the empty text's fingerprint is zero in all lanes; a null id sorts first.  Rows
that share an id follow by the hash of their texts, repeated rows each have a row.  A single row is its own
successor.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, WHITE, id_and_text, partitions, read, run_hashes, runs, text_chunks

#: In a long line every so manieth long word ends a paragraph.
PICK, LONG = 4, 5
CHECKS, LANES = 4, 256
#: Paragraphs whose signs are spread out at a time.
STEP = 8192
#: The id that stands for a null one in the order.
FIRST = -(1 << 63)


# ---------------------------------------------------------------- paragraphs and their vectors


def _windows(data: np.ndarray):
    """Stretches of about CHUNK_BYTES that end before a white space, so that no word is cut."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + 4 * CHUNK_BYTES)
        while end < n and not WHITE[data[end]]:
            more = np.flatnonzero(WHITE[data[end : end + CHUNK_BYTES]])
            end = end + int(more[0]) if len(more) else min(n, end + CHUNK_BYTES)
        yield at, end
        at = end


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all rows' paragraphs, which follow each other without gaps, and the row offsets into them."""
    ends = [offsets[1:][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1]
    for lo, hi in _windows(data):
        part = data[lo:hi]
        inside = offsets[np.searchsorted(offsets, lo, "left") : np.searchsorted(offsets, hi, "right")] - lo
        starts, stops = runs(~WHITE[part], np.concatenate(([0], inside, [hi - lo])))
        picked = (run_hashes(LOWER[part], starts, stops) % np.uint64(PICK) == 0) & (stops - starts >= LONG)
        ends.append(stops[picked] + lo)
    ends = np.unique(np.concatenate(ends))
    return ends, np.searchsorted(ends, offsets, "right")


def digests(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of 64 bytes for each paragraph."""
    raw, at, out = data.tobytes(), 0, []
    for end in ends.tolist():
        out.append(hashlib.blake2b(raw[at:end]).digest())
        at = end
    return np.frombuffer(b"".join(out), np.uint8).reshape(-1, 64)


def summed(d: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the vectors of the paragraphs first:last of each row: lanes modulo 2^64, and signed ones modulo 2^32."""
    checks, lanes = np.zeros((len(first), CHECKS), np.uint64), np.zeros((len(first), LANES), np.int32)
    full = np.flatnonzero(last > first)
    # rows in turn, some paragraphs at a time: a row's may go over several steps
    at, uniform = 0, d[:, :32].copy().view(np.uint64)
    while at < len(full):
        lo = first[full[at]]
        end = max(at + 1, int(np.searchsorted(last[full], lo + STEP, "right")))
        some = full[at:end]
        for begin in range(lo, last[some[-1]], STEP):
            stop = min(begin + STEP, last[some[-1]])
            here = some[(last[some] > begin) & (first[some] < stop)]
            a, b = np.maximum(first[here], begin) - begin, np.minimum(last[here], stop) - begin
            bits = np.unpackbits(d[begin:stop, 32:], axis=1)
            for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                lanes[here[k]] += 2 * bits[x:y].sum(axis=0, dtype=np.int32) - np.int32(y - x)
                checks[here[k]] += uniform[begin + x : begin + y].sum(axis=0, dtype=np.uint64)
        at = end
    return checks, lanes


def packed(checks: np.ndarray, lanes: np.ndarray) -> bytes:
    """A fingerprint as bytes: the size of a signed lane (the least that holds all), the uniform lanes, the signed ones."""
    most = int(np.abs(lanes.astype(np.int64)).max())
    size = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4
    return bytes([size]) + checks.astype("<u8").tobytes() + lanes.astype(f"<i{size}").tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    edge = 1 + 8 * CHECKS
    return np.frombuffer(raw[1:edge], "<u8"), np.frombuffer(raw[edge:], f"<i{raw[0]}").astype(np.int32)


def plus(a: tuple, b: tuple) -> tuple:
    """Insertion of a text's or a set's paragraphs."""
    return a[0] + b[0], a[1] + b[1]


def minus(a: tuple, b: tuple) -> tuple:
    """Deletion."""
    return a[0] - b[0], a[1] - b[1]


def likeness(a: tuple, b: tuple) -> np.ndarray:
    """0 to 1, row by row; 1 exactly for equal fingerprints."""
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    size = (x * x).sum(-1) + (y * y).sum(-1)
    out = np.clip(2 * (x * y).sum(-1) / np.maximum(size, 1), 0, 1 - 2**-20)
    return np.where((a[0] == b[0]).all(-1) & (a[1] == b[1]).all(-1), 1.0, out)


def fingerprint(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Of one text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    ends, at = paragraphs(data, np.array([0, len(data)]))
    checks, lanes = summed(digests(data, ends), at[:1], at[1:])
    return checks[0], lanes[0]


# ---------------------------------------------------------------- tables


def _each(batches):
    for b in batches:
        for t in text_chunks(b):
            ends, at = paragraphs(t.data, t.offsets)
            checks, lanes = summed(digests(t.data, ends), at[:-1], at[1:])
            out = [packed(checks[k], lanes[k]) for k in range(len(t))]
            yield pa.RecordBatch.from_arrays([pa.array(t.ids, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "fingerprint"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (bytes, see ``packed``) of every row."""
    return id_and_text(df, id_col, text_col).mapInArrow(_each, "doc_id long, fingerprint binary")


def _sums(batches):
    """Partial sums by key: at most 4,096 keys are held at a time."""
    open_: dict = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(open_), pa.string()), pa.array([packed(*v) for v in open_.values()], pa.binary())], names=["key", "fingerprint"])

    for b in batches:
        for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            v = unpacked(raw)
            open_[key] = plus(open_[key], v) if key in open_ else v
            if len(open_) > 4096:
                yield out()
                open_.clear()
    if open_:
        yield out()


def set_fingerprints(df: DataFrame, by: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, fingerprint of all paragraphs of the rows of each value of ``by``: sums of sums, so a key of any size is a few rows a task."""
    own = df.select(df[by].cast("string").alias("key"), df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))

    def each(batches):
        for b in batches:
            at = 0
            for t in text_chunks(b):
                ends, rows = paragraphs(t.data, t.offsets)
                checks, lanes = summed(digests(t.data, ends), rows[:-1], rows[1:])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(t)), pa.array([packed(checks[k], lanes[k]) for k in range(len(t))], pa.binary())], names=["key", "fingerprint"])
                at += len(t)

    schema = "key string, fingerprint binary"
    partial = own.mapInArrow(lambda batches: _sums(each(batches)), schema)
    return partial.repartition(partitions(df.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_sorted_sums, schema)


def _sorted_sums(batches):
    last, total = None, None
    for b in batches:
        keys, out = [], []
        for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if total is not None and key != last:
                keys.append(last)
                out.append(packed(*total))
                total = None
            total = unpacked(raw) if total is None else plus(total, unpacked(raw))
            last = key
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.binary())], names=["key", "fingerprint"])
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([packed(*total)], pa.binary())], names=["key", "fingerprint"])


# ---------------------------------------------------------------- rows with their successors


class Ranges:
    """Ranges of (id, hash): splitters from quantiles of the ids; an id that fills several is split by the hash."""

    def __init__(self, quantiles: list[int]):
        ids, counts = np.unique(np.array(quantiles, np.int64), return_counts=True)
        self.ids = np.repeat(ids, counts)
        self.hashes = np.concatenate([[FIRST + k * ((1 << 64) // c) for k in range(c)] for c in counts.tolist()] or [[]]).astype(np.int64)

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        out = lo.copy()
        for a in np.unique(lo[hi > lo]).tolist():
            rows = (lo == a) & (hi > lo)
            out[rows] += np.searchsorted(self.hashes[a : hi[rows][0]], hashes[rows], "right")
        return out


def _first_of_ranges(ranges: Ranges):
    def run(batches):
        least: dict[int, tuple[int, int]] = {}
        for b in batches:
            k, h = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = np.lexsort((h, k))
            at = ranges.of(k[order], h[order])
            found, where = np.unique(at, return_index=True)
            for r, w in zip(found.tolist(), where.tolist(), strict=True):
                here = int(k[order[w]]), int(h[order[w]])
                least[r] = min(least.get(r, here), here)
        if least:
            yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array([v[0] for v in least.values()], pa.int64()), pa.array([v[1] for v in least.values()], pa.int64())], names=["range", "k", "h"])

    return run


def _dealt(ranges: Ranges, before: dict[int, tuple[int, int, int]]):
    """Rows with their range; the first row of a range also goes to the range before.  before: range -> (that range, first id, first hash)."""

    def run(batches):
        for b in batches:
            k, h = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            at = ranges.of(k, h)
            late = [(i, before[r][0]) for i, r in enumerate(at.tolist()) if (k[i], h[i]) == before[r][1:]]
            yield _routed(b, np.arange(len(at)), at, False)
            if late:
                yield _routed(b, np.array([i for i, _ in late]), np.array([r for _, r in late]), True)

    return run


def _routed(b, rows, ranges, late):
    some = b.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array([late] * len(rows)), *some.columns], names=["range", "late", *b.schema.names])


def _followed(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, text, late) in order inside their range; after them, marked late, the first row of the next range."""
    spark = texts.sparkSession
    n = partitions(spark)
    keyed = texts.select("doc_id", "text", F.coalesce("doc_id", F.lit(FIRST)).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    quantiles = texts.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(FIRST)), [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0] or []
    ranges = Ranges(quantiles)
    n = len(quantiles) + 1
    # one row for each range reaches the driver
    least = keyed.select("k", "h").mapInArrow(_first_of_ranges(ranges), "range int, k long, h long").groupBy("range").agg(F.min(F.struct("k", "h")).alias("m")).collect()
    first = {r["range"]: (r["m"]["k"], r["m"]["h"]) for r in least}
    there = sorted(first)
    before = {r: (there[i - 1], *first[r]) for i, r in enumerate(there)}
    rows = keyed.mapInArrow(_dealt(ranges, before), "range int, late boolean, doc_id long, text string, k long, h long")
    return rows.repartitionById(n, F.col("range")).sortWithinPartitions("range", "late", "k", "h").select("doc_id", "text", "late")


class _Doc:
    __slots__ = ("chars", "cut", "digests", "ends", "id", "raw")

    def __init__(self, id_, raw, ends, rows):
        self.id, self.raw, self.ends, self.digests = id_, raw, ends, rows
        self.chars = np.flatnonzero((raw & 0xC0) != 0x80)  # where code points start

    def byte_of(self, char: int) -> int:
        return int(self.chars[char]) if char < len(self.chars) else len(self.raw)


def _documents(ids, texts) -> list[_Doc]:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends, at = paragraphs(data, offsets)
    d = digests(data, ends)
    return [_Doc(ids[k], data[offsets[k] : offsets[k + 1]], ends[at[k] : at[k + 1]] - offsets[k], d[at[k] : at[k + 1]]) for k in range(len(ids))]


_EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _edits(docs: list[_Doc], share: int) -> pa.RecordBatch:
    """Of all but the last, which is the successor of the one before it."""
    tails, shas, kept = [], [], []
    for a, b in zip(docs, docs[1:], strict=False):
        q = len(a.chars) // share
        cut, head = a.byte_of(len(a.chars) - q), b.raw[: b.byte_of(q)].tobytes()
        j = int(np.searchsorted(a.ends, cut, "left"))  # paragraphs that the edit leaves alone
        sha = hashlib.sha256(a.raw[:cut].tobytes())
        sha.update(head)
        shas.append(sha.hexdigest())
        tails.append(a.raw[int(a.ends[j - 1]) if j else 0 : cut].tobytes() + head)
        kept.append(j)
    n = len(tails)
    at = np.concatenate(([0], np.cumsum([len(x.ends) for x in docs])))
    d = np.concatenate([x.digests for x in docs])
    own = summed(d, at[:-1], at[1:])
    gone = summed(d, at[:-2] + np.array(kept, np.int64), at[1:-1])
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in tails])))
    data = np.frombuffer(b"".join(tails), np.uint8)
    ends, rows = paragraphs(data, offsets)
    mine, following = (own[0][:-1], own[1][:-1]), (own[0][1:], own[1][1:])
    edited = plus(minus(mine, gone), summed(digests(data, ends), rows[:-1], rows[1:]))
    raw = lambda x: pa.array([packed(x[0][k], x[1][k]) for k in range(n)], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([x.id for x in docs[:-1]], pa.int64()), pa.array([len(x.chars) for x in docs[:-1]], pa.int64()), pa.array(shas), raw(mine), raw(edited), pa.array(likeness(mine, edited)), pa.array(likeness(mine, following))],
        names=[x.split()[0] for x in _EDITS.split(", ")],
    )


def _walk(share: int):
    def run(batches):
        held: list[_Doc] = []
        ids, texts, size, over = [], [], 0, False
        for b in batches:
            for i, text, late in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if over:
                    break  # repeated rows may follow the first late one
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                ids.append(i)
                texts.append(raw)
                size, over = size + len(raw), late
                if size >= CHUNK_BYTES or len(ids) >= 4096 or over:
                    docs = held + _documents(ids, texts)
                    ids, texts, size = [], [], 0
                    if len(docs) > 1:
                        yield _edits(docs, share)
                    held = docs[-1:]

    return run


def tail_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """Each row's fingerprint, and that of its text with the last 1/share of its code points replaced by the first as many of the next row's.

    The edited fingerprint is kept up to date: the paragraphs that the edit touches are subtracted, the new ones added.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (bytes), near_edited, near_next.
    """
    return _followed(id_and_text(df, id_col, text_col)).mapInArrow(_walk(share), _EDITS)


def shown(raw: bytes) -> str:
    return base64.b64encode(raw).decode()


def op11_multiset_hash(spark, sf_dir: str) -> DataFrame:
    got = tail_edits(read(spark, sf_dir, "documents"))
    return got.withColumns({c: F.translate(F.base64(c), "\r\n", "") for c in ("fingerprint", "edited_fingerprint")})
