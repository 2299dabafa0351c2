"""Which texts may hold which of very many forms, by one part of each form.

A form is looked up by its rarest stretch of 8 characters, or as a whole where it is shorter.  Stretches are hashed by numpy, a
Bloom filter of the forms' parts lets few places of the texts through, and an equi-join of hashes finds the forms.
Neither forms nor texts go through the driver: only a table of counts and the filter do, both of bounded size.

Scans look up stems, which are forms without the signs that may part a number or a code: all spellings of one share it, and
a text is looked through once, whatever the rule of a form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT, LONG = 4, 8
#: Buckets in which the forms' parts are counted, to tell rare ones from frequent ones.
BUCKETS = 1 << 18
#: Bits of the filter for each form, and all of them at most (64 MB).
FILTER_BITS, MOST_BITS = 16, 1 << 29
#: Rows whose texts are looked through together.
ROWS = 64
_A, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _D
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and where each begins (and the last ends)."""
    ends = np.cumsum([0, *map(len, texts)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), ends


def hashes(c: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Of the stretch of so many code points at each place, also across texts."""
    n = max(len(c) - size + 1, 0)
    h = np.full(n, size * 8 + salt + 1, np.uint64)
    for j in range(size if n else 0):
        h *= _A
        h += c[j : j + n]
    return _mixed(h)


def of_forms(forms: list[str], salts: list[int]):
    """(index, size, hash) of all parts by which forms may be looked up: itself, or its stretches of LONG characters; none below SHORT."""
    lengths, salts = np.array([len(f) for f in forms], np.int64), np.array(salts, np.int64)
    for size in range(SHORT, LONG + 1):
        for salt in np.unique(salts):
            which = np.flatnonzero((salts == salt) & ((lengths == size) if size < LONG else (lengths >= LONG)))
            if len(which):
                c, ends = joined([forms[k] for k in which])
                count = np.diff(ends) - size + 1
                at = np.repeat(ends[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
                yield np.repeat(which, count), size, hashes(c, size, int(salt))[at]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def chosen(forms: DataFrame) -> DataFrame:
    """form, salt, part and the part's size of each, and what other columns it has; forms: form and salt (of the kind of text that it is looked for in)."""
    spark = forms.sparkSession
    more = [f for f in forms.schema.fields if f.name not in ("form", "salt")]

    def counts(batches):
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, h in of_forms(*(c.to_pylist() for c in b.columns)):
                n += np.bincount(_bucket(h), minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    per = forms.select("form", "salt").mapInArrow(counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    often = np.zeros(BUCKETS, np.int64)
    often[per["at"].to_numpy()] = per["n"].to_numpy()
    known = spark.sparkContext.broadcast(often)

    def rarest(batches):
        for b in batches:
            for which, size, h in of_forms(*(c.to_pylist() for c in b.columns[:2])):
                order = np.lexsort((h, known.value[_bucket(h)], which))
                first = order[np.flatnonzero(np.diff(which[order], prepend=-1))]
                rows = b.take(pa.array(which[first]))
                yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(h[first].view(np.int64)), pa.array(np.full(len(first), size, np.int32)), *rows.columns[2:]], names=["form", "salt", "part", "size", *(f.name for f in more)])

    schema = ", ".join(["form string, salt int, part long, size int", *(f"`{f.name}` {f.dataType.simpleString()}" for f in more)])
    return forms.select("form", "salt", *(f.name for f in more)).mapInArrow(rarest, schema)


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a part in its word of the filter."""
    return h >> np.uint64(40) & np.uint64(63), h >> np.uint64(50) & np.uint64(63)


def filter_of(parts: DataFrame) -> np.ndarray:
    """A set of bits with two for each part, both in one word; the number of words is a power of two."""
    n = parts.count()
    size = min(MOST_BITS, 1 << max(10, (FILTER_BITS * n).bit_length())) // 64
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned("part", at) % 64).cast("int"))
    words = parts.groupBy(F.pmod("part", F.lit(size)).alias("word")).agg(F.bit_or(one(40).bitwiseOR(one(50))).alias("bits")).toArrow()  # at most MOST_BITS / 64 rows
    out = np.zeros(size, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def passed(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where the filter lets a hash through."""
    a, b = _probes(h)
    w = words[(h & np.uint64(len(words) - 1)).astype(np.int64)]
    return np.flatnonzero(w >> a & w >> b & np.uint64(1))


def met(texts: DataFrame, parts: DataFrame, read: Callable[[tuple], Iterator[tuple[str, int]]]) -> DataFrame:
    """_row and part of every part that a text may hold; texts: _row and further columns, of which ``read`` makes (text, salt)."""
    known = texts.sparkSession.sparkContext.broadcast(filter_of(parts))
    sizes: dict[int, list[int]] = {}
    for salt, size in parts.select("salt", "size").distinct().collect():  # LONG - SHORT + 1 for each salt at most
        sizes.setdefault(salt, []).append(size)

    def run(batches):
        words = known.value
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                b = whole.slice(first, ROWS)
                ids = b.column(0).to_numpy(zero_copy_only=False)
                by: dict[int, tuple[list[int], list[str]]] = {}
                for k, row in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
                    for text, salt in read(row):
                        if salt in sizes:
                            by.setdefault(salt, ([], []))[0].append(k)
                            by[salt][1].append(text)
                for salt, (of, held) in by.items():
                    c, ends = joined(held)
                    for size in sizes[salt]:
                        h = hashes(c, size, salt)
                        at = passed(words, h)
                        row = ids[np.array(of)[np.searchsorted(ends, at, "right") - 1]]
                        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(h[at].view(np.int64))], names=["_row", "part"])

    return texts.mapInArrow(run, "_row long, part long").distinct()


# ---------------------------------------------------------------- stems

#: Signs that stand inside numbers and codes; a stem is without them.
PARTING = " -.()/+_#,'\u00a0\u2009\u202f"
_PARTING = dict.fromkeys(map(ord, PARTING))
_KEPT = np.ones(0x2030 + 1, bool)
_KEPT[list(_PARTING)] = False
#: Characters that accepting a match reads on either side of it at most, with room for one that folds to several.
AROUND = 8
#: Characters of texts that are looked through together.
CHARS = 1 << 18


def stem(form: str) -> str:
    return form.translate(_PARTING)


def places(texts: list[str], words: np.ndarray, sizes: list[int], longest: int):
    """(text, hash, first, last) of each place in folded texts that may belong to a stem: the stretch of the text that any form of such a stem lies in.

    longest: characters of the longest stem; a part below LONG is a whole stem.
    """
    c, ends = joined(texts)
    at = np.flatnonzero(_KEPT[np.minimum(c, 0x2030).astype(np.int64)])
    k = c[at]
    edge = np.searchsorted(at, ends)  # the kept characters before each text's end
    of, hs, left, right = [], [], [], []
    for size in sizes:
        h = hashes(k, size, 0)
        hit = passed(words, h)
        text = np.searchsorted(edge, hit, "right") - 1
        inside = hit + size <= edge[text + 1]
        hit, text = hit[inside], text[inside]
        more = (longest if size == LONG else size) - size
        # the kept characters before and behind the longest stem, or the text's own ends
        a, b = hit - more - 1, hit + size + more
        bound = lambda x: at[np.clip(x, 0, max(len(at) - 1, 0))] if len(at) else x
        of.append(text)
        hs.append(h[hit])
        left.append(np.maximum(np.where(a >= edge[text], bound(a), ends[text]) - AROUND, ends[text]) - ends[text])
        right.append(np.minimum(np.where(b < edge[text + 1], bound(b) + 1, ends[text + 1]) + AROUND, ends[text + 1]) - ends[text])
    got = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (of, hs, left, right)]
    if len(got[0]) < 2:
        return got
    order = np.lexsort(got[::-1])
    got = [x[order] for x in got]
    return [x[np.flatnonzero(np.concatenate([[True], np.any([np.diff(y) != 0 for y in got], axis=0)]))] for x in got]
