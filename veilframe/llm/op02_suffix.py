"""Suffix-array dedup by difference covers, in parts that windows of equal content share.

A byte goes if it is covered by a string of ``width`` bytes that also starts earlier (smaller id, or same
document and earlier start).  Strings are judged on the input.

1. Anchors.  Each window of ``width`` bytes has one anchor: the leftmost smallest hash among its GRAM-byte
   strings.  Equal windows have equal anchors at equal places, so windows only have to meet those of the same
   anchor.  A pass over the corpus deals out anchor hashes and finds those that occur again.
2. Contexts.  Around each repeated anchor the bytes of its windows (about 1.5 x width) are dealt out by the
   anchor.  Equal contexts collapse into their first, in each task and again where they meet; an anchor that
   very many texts share (HOT) is dealt out window by window instead, so that no group grows with the corpus.
   Most of those are known beforehand, from a share of the texts (which decides nothing but the way that they
   are dealt out): their places don't meet at all.
3. Suffix sort.  Contexts of an anchor that still differ are concatenated and sorted by the difference-cover
   algorithm (modulo 3): triples at places 1 and 2 modulo 3 get names in sorted order, the string of names is
   sorted by recursion, the remaining suffixes are merged in by their first byte and the rank that follows.
   Recursion ends once a name spans ``width`` bytes.  Prefixes of adjacent suffixes are then compared, byte by
   byte, and of equal ones all but the earliest are marked.

Documents equal to an earlier one as a whole are known by digest and skip 2 and 3.

Nulls: a null text is empty; a null id comes before all others.  Rows that share an id are each judged
against all others (a row is known by its id and its text); at the same id and start neither is the earlier.  An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, id_and_text, mix, partitions, read, text_chunks
from .op10_jaccard import bucket, deal

WIDTH, GRAM = 100, 32
#: Texts beyond which an anchor is dealt out by window.
HOT = 2_000
#: Bytes of contexts that one suffix sort takes (more only if one anchor has more).
SORT_BYTES = 600_000
#: One text in so many is looked at for hot anchors, and how many of these are looked up at most.
SHARE, HOT_ANCHORS = 16, 100_000
#: Anchors that a task deals out at a time, and contexts that it remembers.
DEALT, SEEN = 200_000, 200_000
#: Bytes of text whose windows are hashed at a time: so few that the arrays stay in a core's cache.
HASHED = 1 << 16
_PLACE = np.uint64((1 << 28) - 1)
_FIRST = -(1 << 63)


# ---------------------------------------------------------------- anchors


def gram_hashes(data: np.ndarray) -> np.ndarray:
    h, base, k = BYTE[data], np.full(1, 0x9E3779B97F4A7C15, np.uint64), 1
    while k < GRAM:
        h = h[:-k] * base + h[k:]
        base, k = base * base, 2 * k
    return mix(h)


def smallest(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def anchors(t, width: int = WIDTH):
    """Per anchor, in order: row, place, hash, first and last window start (places in t.data)."""
    none = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 2
    if len(t.data) < width:
        return none
    h = gram_hashes(t.data)
    place = np.arange(len(h), dtype=np.uint64) & _PLACE
    m = smallest((h & ~_PLACE) | place, width - GRAM + 1)
    ok = np.ones(len(m) + 1, bool)  # windows inside one row; between those of two rows there are others
    for end in t.offsets[1:].tolist():
        ok[max(end - width + 1, 0) : end] = False
    ok[len(m)] = False
    turn = m[1:] != m[:-1]
    new, done = ok[:-1].copy(), ok[:-1].copy()
    new[1:] &= ~ok[:-2] | turn
    done[:-1] &= ~ok[1:-1] | turn
    first, last = np.flatnonzero(new), np.flatnonzero(done)
    if not len(first):
        return none
    at = (m[first] & _PLACE).astype(np.int64)
    at += (first >> 28 << 28) + np.where(at < (first & int(_PLACE)), 1 << 28, 0)
    return np.searchsorted(t.offsets, first, "right") - 1, at, h[at], first, last


def _ids(t) -> np.ndarray:
    return np.array([_FIRST if i is None else i for i in t.ids], np.int64)


def _often(width, least):
    """Anchors that several of a task's texts have, with how many."""

    def run(batches):
        held, n = [], 0

        def some():
            h, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[times >= least].astype(np.int64)), pa.array(times[times >= least])], names=["h", "n"])

        for b in batches:
            for t in text_chunks(b, HASHED):
                row, _, h, _, _ = anchors(t, width)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                held.append(h[np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))] if len(h) else h)
                n += len(held[-1])
                if n >= DEALT:
                    yield some()
                    held, n = [], 0
        if n:
            yield some()

    return run


def hot_anchors(docs: DataFrame, width: int, hot: int, share: int) -> np.ndarray:
    """Anchors that about ``hot`` texts have, by a share of them; sorted."""
    least = max(2, hot // share)
    some = docs.where(F.pmod(F.xxhash64("own", "text"), F.lit(share)) == 0).select(F.col("own").alias("doc_id"), "text")
    often = some.mapInArrow(_often(width, min(16, least)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["h"] for r in often.orderBy(F.desc("n"), "h").limit(HOT_ANCHORS).collect()], np.int64).astype(np.uint64))  # 8 bytes each


def _deal_anchors(keys, width, known):
    """For each bucket the anchors of some documents; of equal texts among these only the first has any.

    Anchors known as hot need no others: their places go along with a bucket's rows, without hashes.
    """

    def pack(ids, cls, row, at, h):
        order = np.lexsort((ids, cls))
        lone = np.ones(len(ids), bool)
        lone[order[1:]] = cls[order[1:]] != cls[order[:-1]]
        use = lone[row]
        row, at, h = row[use], at[use], h[use]
        settled = np.isin(h, known)
        out = [[] for _ in range(6)]
        if settled.any():
            own, n = np.unique(row[settled], return_counts=True)
            order = np.argsort(row[settled], kind="stable")
            for x, y in zip(out, (int(keys[int(h[settled][0] % np.uint64(len(keys)))]), b"", at[settled][order].astype(np.uint32).tobytes(), ids[own].tobytes(), cls[own].tobytes(), n.astype(np.uint32).tobytes()), strict=True):
                x.append(y)
            row, at, h = row[~settled], at[~settled], h[~settled]
        where = bucket(mix(h), len(keys)).astype(np.int64)  # anchors are smallest hashes: their own high bits are all alike
        order = np.argsort(where, kind="stable")
        row, at, h, where = row[order], at[order], h[order], where[order]
        cuts = np.searchsorted(where, np.arange(len(keys) + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            lo, hi = cuts[k], cuts[k + 1]
            first = np.flatnonzero(np.concatenate(([True], row[lo + 1 : hi] != row[lo : hi - 1])))
            own = row[lo:hi][first]
            for x, y in zip(out, (int(keys[k]), h[lo:hi].tobytes(), at[lo:hi].astype(np.uint32).tobytes(), ids[own].tobytes(), cls[own].tobytes(), np.diff(np.append(first, hi - lo)).astype(np.uint32).tobytes()), strict=True):
                x.append(y)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "h", "at", "ids", "cls", "times"])

    def run(batches):
        held, docs, count = [], 0, 0
        join = lambda: pack(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for b in batches:
            base, digests = 0, b.column(b.schema.get_field_index("cls")).to_numpy()
            for t in text_chunks(b, HASHED):
                row, at, h, _, _ = anchors(t, width)
                held.append((_ids(t), digests[base : base + len(t)], row + docs, at - t.offsets[row], h))
                base, docs, count = base + len(t), docs + len(t), count + len(row)
                if count >= DEALT:
                    yield join()
                    held, docs, count = [], 0, 0
        if count:
            yield join()

    return run


def _repeated(hot):
    """(doc, cls, places of repeated anchors with a flag for those of more than ``hot`` texts), for the first document of each text."""

    def run(batches):
        got = [[], [], [], []]
        for b in batches:
            for h, at, ids, cls, times in zip(*(b.column(i) for i in range(1, 6)), strict=True):
                n = np.frombuffer(times.as_buffer(), np.uint32)
                if not h.as_buffer().size:  # places of anchors known as hot
                    places, ends = np.frombuffer(at.as_buffer(), np.uint32).astype(np.int64) << 1 | 1, np.cumsum(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (ids, cls)] + [pa.array([places[z - k : z].tobytes() for k, z in zip(n, ends, strict=True)], pa.binary())], names=["doc", "of", "places"])
                    continue
                got[0].append(np.frombuffer(h.as_buffer(), np.uint64)), got[1].append(np.frombuffer(at.as_buffer(), np.uint32))
                got[2].append(np.repeat(np.frombuffer(ids.as_buffer(), np.int64), n)), got[3].append(np.repeat(np.frombuffer(cls.as_buffer(), np.int64), n))
        if not got[0]:
            return
        h, at, ids, cls = (np.concatenate(x) for x in got)
        order = np.argsort(h, kind="stable")
        again = np.zeros(len(h), bool)
        same = h[order][1:] == h[order][:-1]
        again[order[1:]] |= same
        again[order[:-1]] |= same
        h, at, ids, cls = h[again], at[again], ids[again], cls[again]
        order = np.lexsort((at, ids, cls, h))
        h, at, ids, cls = h[order], at[order], ids[order], cls[order]
        if not len(h):
            return
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])))
        run = np.cumsum(new) - 1
        keep = ids == ids[np.flatnonzero(new)][run]  # other copies of the text are known by digest
        h, at, ids, cls = h[keep], at[keep], ids[keep], cls[keep]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        n = np.diff(np.append(starts, len(h)))
        alone = np.repeat(n == 1, n)
        packed = ((at.astype(np.int64) << 1) | np.repeat(n > hot, n))[~alone]
        ids, cls = ids[~alone], cls[~alone]
        order = np.lexsort((packed, cls, ids))
        packed, ids, cls = packed[order], ids[order], cls[order]
        cuts = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (cls[1:] != cls[:-1])))) if len(ids) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(ids))
        for i in range(0, len(cuts), 4096):
            some = cuts[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(cls[some]), pa.array([packed[a:z].tobytes() for a, z in zip(some, ends[i : i + 4096], strict=True)], pa.binary())], names=["doc", "of", "places"])

    return run


# ---------------------------------------------------------------- contexts


class _Spans:
    """Removed stretches by document (id and digest), given out as one row per document."""

    def __init__(self):
        self.parts, self.ones = [], []

    def __len__(self):
        return len(self.parts) + len(self.ones)

    def add(self, doc, cls, lo, hi):
        self.parts.append((doc, cls, lo, hi))

    def add_one(self, doc, cls, lo, hi):
        self.ones.append((doc, cls, lo, hi))

    def rows(self):
        if not len(self):
            return
        if self.ones:
            self.parts.append(np.array(self.ones, np.int64).T)
        doc, cls, lo, hi = (np.concatenate(x).astype(np.int64) for x in zip(*self.parts, strict=True))
        self.__init__()
        order = np.lexsort((lo, cls, doc))
        doc, cls, lo, hi = doc[order], cls[order], lo[order], hi[order]
        cuts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (cls[1:] != cls[:-1]))))
        for a, z in zip(cuts, np.append(cuts[1:], len(doc)), strict=True):
            yield int(doc[a]), int(cls[a]), *merged(lo[a:z], hi[a:z])


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of stretches sorted by start, as maximal runs."""
    if not len(lo):
        return lo, hi
    top = np.maximum.accumulate(hi)
    new = np.concatenate(([True], lo[1:] > top[:-1]))
    first = np.flatnonzero(new)
    return lo[first], top[np.append(first[1:], len(lo)) - 1]


_CONTEXT = [("key", pa.int64()), ("doc", pa.int64()), ("cls", pa.int64()), ("at", pa.int64()), ("text", pa.binary())]


def _span_rows(spans: _Spans):
    """Finished stretches travel as rows of their own: place -1, the pairs in the bytes."""
    return [(doc, doc, cls, -1, np.stack([lo, hi]).tobytes()) for doc, cls, lo, hi in spans.rows()]


def _contexts(width):
    """Contexts of repeated anchors.  Rows come in ascending id order, so the first of equal contexts is the earliest here."""

    def run(batches):
        seen, spans, rows, size = {}, _Spans(), [], 0
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _CONTEXT, strict=True)], names=[n for n, _ in _CONTEXT])
        for b in batches:
            places, digests = b.column(b.schema.get_field_index("places")), b.column(b.schema.get_field_index("cls")).to_pylist()
            base = 0
            for t in text_chunks(b, HASHED):
                row, at, h, lo, hi = anchors(t, width)
                ids, raw = _ids(t), t.data.tobytes()
                edges = np.searchsorted(row, np.arange(len(t) + 1))
                for i in range(len(t)):
                    wanted = [np.frombuffer(x, np.int64) for x in places[base + i].as_py() or []]
                    if not wanted:
                        continue
                    wanted = np.sort(np.concatenate(wanted))
                    own = at[edges[i] : edges[i + 1]] - t.offsets[i]
                    k = np.searchsorted(own, wanted >> 1)
                    ok = (k < len(own)) & (own[np.minimum(k, len(own) - 1)] == wanted >> 1) if len(own) else np.zeros(len(wanted), bool)
                    doc, cls, off = int(ids[i]), digests[base + i], int(t.offsets[i])
                    k = k[ok] + edges[i]
                    for key, a, z, flag in zip(h[k].view(np.int64).tolist(), lo[k].tolist(), hi[k].tolist(), (wanted[ok] & 1).tolist(), strict=True):
                        for p, q in [(p, p + width) for p in range(a, z + 1)] if flag else ((a, z + width),):
                            text = raw[p:q]
                            mark = hashlib.blake2b(text, digest_size=16).digest()
                            if flag:
                                key = int.from_bytes(mark[:8], "little", signed=True)
                            else:
                                mark += b"+"
                            here = doc, p - off
                            first = seen.setdefault(mark, here)
                            if first < here:
                                spans.add_one(doc, cls, p - off, q - off)
                                continue
                            if first is not here:
                                seen[mark] = here
                            rows.append((key, doc, cls, p - off, text))
                            size += q - p
                    if size >= 4 << 20:
                        yield flush(rows)
                        rows, size = [], 0
                    if len(seen) > SEEN:
                        seen = {}  # equal contexts also collapse where they meet
                base += len(t)
        rows += _span_rows(spans)
        for i in range(0, len(rows), 16384):
            yield flush(rows[i : i + 16384])

    return run


# ---------------------------------------------------------------- difference-cover suffix sort


def _names(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks (from 1) of tuples of small non-negative numbers."""
    key = columns[0].astype(np.int64)
    top = int(key.max(initial=0)) + 1
    for c in columns[1:]:
        most = int(c.max(initial=0)) + 1
        if top * most >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            top = int(key.max(initial=0)) + 1
        key = key * most + c
        top *= most
    return np.unique(key, return_inverse=True)[1] + 1


def _less(key: np.ndarray, *sorted_keys: np.ndarray) -> np.ndarray:
    """How many numbers of the sorted arrays are below each key; keys are looked up in order, which is far faster."""
    order = np.argsort(key)
    k = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = sum(np.searchsorted(x, k, "left") for x in sorted_keys)
    return out


def suffix_ranks(s: np.ndarray, span: int, width: int) -> np.ndarray:
    """Ranks of the suffixes of s (numbers from 1); equal only if equal over ``width`` bytes, where a number spans ``span`` bytes."""
    n = len(s)
    s = np.concatenate((s, np.zeros(3, s.dtype))).astype(np.int64)
    if n < 3:
        return _names(s[:n], s[1 : n + 1], s[2 : n + 2])
    one, two, nil = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    # sort the sampled triples
    sample = np.concatenate((one, two))
    named = _names(s[sample], s[sample + 1], s[sample + 2])
    # recurse on names, until they tell all suffixes apart or span the width
    if int(named.max()) < len(sample) and span * 3 < width:
        gap = np.zeros(1, np.int64)  # between the two halves, below all names
        r = suffix_ranks(np.concatenate((named[: len(one)], gap, named[len(one) :])) + 1, span * 3, width)
        named = np.concatenate((r[: len(one)], r[len(one) + 1 :]))
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = named
    big = int(named.max()) + 1
    # merge the rest: by one number and the rank after it against places 1, by two numbers and a rank against places 2
    k1 = s * big + np.append(rank[1:], 0)
    pair = _names(s[:-1], s[1:])
    k2 = np.append(pair, 0)[: n + 1] * big + np.append(rank[2:], [0])[: n + 1]
    s_nil, s_one, s_two = np.sort(k1[nil]), np.sort(k1[one]), np.sort(k2[two])
    s_nil2 = np.sort(k2[nil])
    below = np.cumsum(np.bincount(named, minlength=big + 1)) - np.bincount(named, minlength=big + 1)
    out = np.empty(n, np.int64)
    out[nil] = _less(k1[nil], s_nil, s_one) + _less(k2[nil], s_two)
    out[one] = below[rank[one]] + _less(k1[one], s_nil)
    out[two] = below[rank[two]] + _less(k2[two], s_nil2)
    return out + 1


def repeats(texts: list[bytes], width: int = WIDTH, ranks: np.ndarray | None = None):
    """For windows of texts that are listed from the earliest to the latest: (text, offset) of those that an earlier text has too.

    ranks: of the texts by place, where some share one; by default each comes after those before it.
    """
    earlier = np.arange(len(texts)) if ranks is None else ranks
    sizes = np.array([len(x) for x in texts])
    data = np.frombuffer(b"".join([x + b"\0" for x in texts]), np.uint8)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    s = data.astype(np.int64) + 2
    s[first + sizes] = 1  # ends, below all bytes
    suffixes = suffix_ranks(s, 1, width)
    count = np.maximum(sizes - width + 1, 0)
    of = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(count.sum()) - np.repeat(np.concatenate(([0], np.cumsum(count)))[:-1], count)
    start = first[of] + offset
    order = np.lexsort((of, suffixes[start]))
    start, of, offset = start[order], of[order], offset[order]
    # compare prefixes of adjacent suffixes
    same = np.zeros(len(start), bool)
    view = np.lib.stride_tricks.sliding_window_view(data, width)
    for i in range(1, len(start), 32768):
        z = min(len(start), i + 32768)
        same[i:z] = (view[start[i:z]] == view[start[i - 1 : z - 1]]).all(1)
    run = np.cumsum(~same) - 1
    least = np.minimum.reduceat(earlier[of], np.flatnonzero(~same)) if len(of) else of
    late = earlier[of] > least[run] if len(of) else np.zeros(0, bool)
    return of[late], offset[late]


def _find(width):
    """Rows sorted by key, document and place -> removed stretches by document."""

    def run(batches):
        spans, groups, size = _Spans(), [], 0
        key, held = None, {}

        def sort():
            texts = [x for g in groups for x in g]
            if texts:
                # groups don't share windows, so an earlier text of the list is one of the same group
                doc, at, cls = (np.array([x[k] for x in texts], np.int64) for k in (0, 1, 2))
                after = np.concatenate(([0], np.cumsum((doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))))
                of, offset = repeats([x[3] for x in texts], width, after)
                spans.add(doc[of], cls[of], at[of] + offset, at[of] + offset + width)
                for i, x in enumerate(texts):  # rows that share an id, with the same bytes at the same place
                    for other in x[4][1:]:
                        own = offset[of == i]
                        spans.add(np.full(len(own), x[0]), np.full(len(own), other), x[1] + own, x[1] + own + width)
            groups.clear()

        for b in batches:
            for k, doc, cls, at, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if at < 0:
                    lo, hi = np.frombuffer(text, np.int64).reshape(2, -1)
                    spans.add(np.full(len(lo), doc), np.full(len(lo), cls), lo, hi)
                    continue
                if k != key:
                    if len(held) > 1:
                        groups.append([(w[0], w[1], w[2][0], x, w[2]) for x, w in held.items()])
                        size += sum(map(len, held))
                        if size >= SORT_BYTES:
                            sort()
                            size = 0
                    key, held = k, {}
                first = held.setdefault(text, (doc, at, [cls]))
                if first[:2] != (doc, at):
                    spans.add_one(doc, cls, at, at + len(text))
                elif cls not in first[2]:
                    first[2].append(cls)
            if len(spans) > 100_000:
                yield from _span_batches(spans)
        if len(held) > 1:
            groups.append([(w[0], w[1], w[2][0], x, w[2]) for x, w in held.items()])
        sort()
        yield from _span_batches(spans)

    return run


def _span_batches(spans):
    rows = [(doc, cls, np.stack([lo, hi]).tobytes()) for doc, cls, lo, hi in spans.rows()]
    for i in range(0, len(rows), 4096):
        some = list(zip(*rows[i : i + 4096], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int64()), pa.array(some[1], pa.int64()), pa.array(some[2], pa.binary())], names=["doc", "cls", "spans"])


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _cut(width):
    def run(batches):
        for b in batches:
            copy = b.column(b.schema.get_field_index("copy")).to_pylist()
            found = b.column(b.schema.get_field_index("found"))
            rows, base = [], 0
            for t in text_chunks(b):
                for i in range(len(t)):
                    raw = t.bytes_of(i)
                    lo = hi = np.zeros(0, np.int64)
                    if copy[base + i]:
                        if len(raw) >= width:
                            lo, hi = np.array([0]), np.array([len(raw)])
                    elif parts := found[base + i].as_py() or []:
                        lo, hi = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in parts], axis=1)
                        order = np.argsort(lo, kind="stable")
                        lo, hi = merged(lo[order], hi[order])
                    kept, at = hashlib.sha256(), 0
                    for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                        kept.update(raw[at:x])
                        at = y
                    kept.update(raw[at:])
                    doc = t.ids[i]
                    rows.append({"doc_id": None if doc is None else int(doc), "n_bytes": len(raw), "n_removed": int((hi - lo).sum()), "n_spans": len(lo), "kept_sha256": kept.hexdigest(), "spans": [{"start": int(x), "end": int(y)} for x, y in zip(lo, hi, strict=True)]})
                base += len(t)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    return run


def repeated_spans(df: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, share: int = SHARE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (UTF-8 byte offsets) of every row."""
    if width < GRAM:
        raise ValueError(f"a window has at least {GRAM} bytes")
    spark, n = df.sparkSession, partitions(df.sparkSession)
    # a row is known by its id and its text's digest: by both, rows that share an id are also dealt apart
    docs = id_and_text(df, id_col, text_col).withColumns({"own": F.coalesce("doc_id", F.lit(_FIRST)), "cls": F.xxhash64("text")})
    keys = deal(spark, n)
    again = docs.select(F.col("own").alias("doc_id"), "text", "cls").mapInArrow(_deal_anchors(keys, width, hot_anchors(docs, width, hot, share)), "bucket long, h binary, at binary, ids binary, cls binary, times binary").repartition(n, "bucket").mapInArrow(_repeated(hot), "doc long, of long, places binary")
    again = again.groupBy("doc", "of").agg(F.collect_list("places").alias("places"))  # a document's own
    digest = docs.select("own", "cls", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    least = digest.groupBy("sha").agg(F.min("own").alias("least"), F.count("*").alias("n")).where("n > 1").select("sha", "least")
    copies = digest.join(least, "sha").where("own > least").select(F.col("own").alias("doc"), F.col("cls").alias("of")).distinct().withColumn("copy", F.lit(True))
    same = lambda x: (F.col("own") == x["doc"]) & (F.col("cls") == x["of"])
    contexts = docs.join(again, same(again)).select("doc_id", "text", "places", "cls", "own").sortWithinPartitions("own").drop("own").mapInArrow(_contexts(width), "key long, doc long, cls long, at long, text binary")
    found = contexts.repartition(n, "key").sortWithinPartitions("key", "doc", "at").mapInArrow(_find(width), "doc long, cls long, spans binary").withColumnRenamed("cls", "of").groupBy("doc", "of").agg(F.collect_list("spans").alias("found"))
    # both joins of the texts are by the same keys, so that the texts are dealt out once
    all_ = docs.join(found, same(found), "left").drop("doc", "of").join(copies, same(copies), "left")
    return all_.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "found").mapInArrow(_cut(width), _CUT)


def op2_suffix_array(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents")).drop("spans")
