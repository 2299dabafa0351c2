"""N-gram Jaccard join: a count-vector R-tree over documents that can have partners at all.

A document's set holds its distinct word shingles (as 64-bit hashes).  Documents with equal sets form a
class, and only classes are joined.

1. Reduction.  If x has a partner at similarity s, at most n - ceil(s n) of its n shingles are in no other
   set.  A third of all shingles (by hash) is dealt out by value to count the classes of each; a class with
   more lone shingles than that has no link and is done.  A shingle that several classes of one task hold is
   settled there and leaves it once, so that no shingle's classes meet in one place.
2. Search.  The rest are dealt out by the shingles of their prefix (the n - ceil(s n) + 1 smallest: linked
   sets share one of them).  Those that meet are points of an R-tree: coordinate g of a point counts the
   shingles of hash group g, and the sum of coordinate minima bounds the overlap from above, for two points
   as for a point and a node's corner of maxima.  A prefix shingle that very many classes share (HOT) is
   dealt out by pairs of parts of them.  Where few pairs are within the bound, all of them are candidates;
   where there are many, a spanning forest of them is, and its trees are noted as groups.
3. Verification.  Candidate pairs are compared exactly, gathered by one of the two (a hub with very many
   pairs in parts).  A group whose members the links join is done.  Of any other, the members outside its
   largest component are compared with all members, in blocks by set size, so that no task holds more than
   two blocks.

Nothing is capped: every pair that could reach the threshold is either verified or already joined by
verified links.

Nulls: a null text, or one without words, has an empty set and links with nothing.  A null id takes part by
its class, also in a class without any id, whose component id is the smallest id that links reach, or null.
Repeated rows return a row each.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, held, id_and_text, mix, partitions, read, shingles, text_chunks, words, written
from .graph import components

#: Coordinates of a point, entries of a tree node, and what a block of a candidate group holds.
GROUPS, NODE, BLOCK_DOCS, BLOCK_SHINGLES = 64, 32, 3_072, 2_000_000
#: Coordinates of the finer points that a block compares before the sets themselves.
FINE = 1024
#: Ids of open classes that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: One of so many shingles, by hash, is counted in the reduction.
COUNTED = np.uint64(3)
#: Shingles that a task deals out at a time.
DEALT = 1_000_000
#: Candidate pairs a member that a list may have before only a spanning forest of them is taken.
SPARSE = 1
#: Buckets of prefix shingles, whatever the number of machines, so that a class has no more rows on more of them; twice as
#: many, again and again, where more than CELL_CLASSES open classes would come to one.
CELLS, CELL_CLASSES = 4096, 8_192
#: Rows of prefixes that a task holds at a time, in whole buckets.
HELD_ROWS = 200_000
#: Classes that share a prefix shingle before it is dealt out by parts, and how many such shingles are looked up at most.
HOT, HOT_SHINGLES = 20_000, 100_000
#: Pairs of one hub that a task compares.
HUB = 5_000
#: Stands for classes whose common shingle was settled in an earlier task.
_MET = -(1 << 63)


def spare(n, percent: int):
    """How many shingles of a set of n a partner may lack."""
    return n - (percent * n + 99) // 100


def class_of(s: np.ndarray) -> int:
    """64-bit identity of a set, as a signed number."""
    return int((mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64))


def sets(t, size: int):
    h, edges = words(t)
    for i in range(len(t)):
        yield i, shingles(h[edges[i] : edges[i + 1]], size)


def deal(spark, n: int) -> np.ndarray:
    """For each of n buckets a number that repartition(n, number) sends to a partition of its own."""
    rows = spark.range(n * 40).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()  # n rows
    own = {r["p"]: r["id"] for r in rows}
    return np.array([own.get(p, n * 40 + p) for p in range(n)], np.int64)


def bucket(s: np.ndarray, n: int) -> np.ndarray:
    return ((s >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _classes(size):
    def run(batches):
        for b in batches:
            at, text_of = 0, b.column(b.schema.get_field_index("by_text"))
            for t in text_chunks(b):
                n, cls, counted = (np.zeros(len(t), np.int64) for _ in range(3))
                for i, s in sets(t, size):
                    n[i], cls[i], counted[i] = len(s), class_of(s), np.count_nonzero(s % COUNTED == 0)
                yield pa.RecordBatch.from_arrays([pa.array(t.ids, pa.int64()), pa.array(n), pa.array(cls), pa.array(counted), text_of.slice(at, len(t))], names=["doc_id", "n", "cls", "counted", "by_text"])
                at += len(t)

    return run


def _dealt(keys, size):
    """For each bucket the counted shingles of some documents, by class; with an empty set, how many of each class are settled here."""

    def pack(s, c):
        order = np.argsort(s, kind="stable")
        same = np.concatenate(([False], s[order][1:] == s[order][:-1]))
        met = np.zeros(len(s), bool)  # in several classes here: a class comes once
        met[order[same]] = True
        met[order[np.flatnonzero(same) - 1]] = True
        own, n = np.unique(c[met], return_counts=True)
        settled = np.unique(s[met])
        s, c = np.concatenate((s[~met], settled)), np.concatenate((c[~met], np.full(len(settled), _MET)))
        at = bucket(s, len(keys)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        s, c, at = s[order], c[order], at[order]
        cuts = np.searchsorted(at, np.arange(len(keys) + 1))
        rows = [[], [], [], []]
        for k in np.flatnonzero(np.diff(cuts)):
            lo, hi = cuts[k], cuts[k + 1]
            first = np.flatnonzero(np.concatenate(([True], c[lo + 1 : hi] != c[lo : hi - 1])))
            rows[0].append(int(keys[k]))
            rows[1].append(s[lo:hi].tobytes())
            rows[2].append(c[lo:hi][first].tobytes())
            rows[3].append(np.diff(np.append(first, hi - lo)).astype(np.uint16 if hi - lo < 65536 else np.uint32).tobytes())
        if len(own):
            rows[0].append(int(keys[int(own[0]) % len(keys)]))
            rows[1].append(b""), rows[2].append(own.tobytes()), rows[3].append(n.astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["bucket", "s", "cls", "times"])

    def run(batches):
        known, all_s, all_c, count = set(), [], [], 0
        for b in batches:
            for t in text_chunks(b):
                for _, s in sets(t, size):
                    c = class_of(s)
                    if len(s) and c not in known:
                        known.add(c)
                        s = s[s % COUNTED == 0]
                        all_s.append(s)
                        all_c.append(np.full(len(s), c, np.int64))
                        count += len(s)
                if count >= DEALT:
                    yield pack(np.concatenate(all_s), np.concatenate(all_c))
                    known, all_s, all_c, count = set(), [], [], 0
        if count:
            yield pack(np.concatenate(all_s), np.concatenate(all_c))

    return run


def _shared(batches):
    """(cell, cls, n, here), packed: how many shingles of a class another class has too, by a bucket, or as settled in one task (here)."""

    def packed(cls, n, here):
        cell = cls.astype(np.uint64) >> np.uint64(52)
        order = np.argsort(cell, kind="stable")
        cls, n, cell = cls[order], n[order].astype(np.int64), cell[order]
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        last = np.append(first[1:], len(cell))
        return pa.RecordBatch.from_arrays([pa.array(cell[first].astype(np.int64)), *(pa.array([x[a:z].tobytes() for a, z in zip(first, last, strict=True)], pa.binary()) for x in (cls, n)), pa.array([here] * len(first))], names=["cell", "cls", "n", "here"])

    s, c = [], []
    for b in batches:
        for x, y, z in zip(*(b.column(i) for i in (1, 2, 3)), strict=True):
            own = np.frombuffer(x.as_buffer(), np.uint64)
            cls, times = np.frombuffer(y.as_buffer(), np.int64), z.as_buffer()
            if not len(own):
                yield packed(cls, np.frombuffer(times, np.uint32), True)
                continue
            times = np.frombuffer(times, np.uint16 if times.size == 2 * len(cls) else np.uint32)
            s.append(own), c.append(np.repeat(cls, times))
    if not s:
        return
    s, c = np.concatenate(s), np.concatenate(c)
    order = np.argsort(s, kind="stable")
    s, c = s[order], c[order]
    edge = np.concatenate(([True], s[1:] != s[:-1], [True]))
    starts = np.flatnonzero(edge)
    differ = np.maximum.reduceat(c, starts[:-1]) != np.minimum.reduceat(c, starts[:-1])
    hit = np.repeat(differ, np.diff(starts)) & (c != _MET)
    # a class may be there twice, from two tasks: each (shingle, class) counts once
    pair = np.lexsort((c[hit], s[hit]))
    s, c = s[hit][pair], c[hit][pair]
    if len(s):
        lone = np.concatenate(([True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])))
        yield packed(*np.unique(c[lone], return_counts=True), False)


def _totals(batches):
    """(cls, shared) of a cell's classes.

    A class that several tasks met sent each of its shingles from each of them or settled it there, so that the
    least of its settled counts, with what the buckets count, is no less than its number of shared shingles.
    """
    got = {True: ([], []), False: ([], [])}
    for b in batches:
        for cls, n, here in zip(b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
            got[here][0].append(np.frombuffer(cls.as_buffer(), np.int64)), got[here][1].append(np.frombuffer(n.as_buffer(), np.int64))
    join = lambda here: [np.concatenate(x) if x else np.zeros(0, np.int64) for x in got[here]]
    (sent, times), (own, settled) = join(False), join(True)
    cls, at = np.unique(np.concatenate((sent, own)), return_inverse=True)
    total = np.bincount(at[: len(sent)], times, len(cls)).astype(np.int64)
    least = np.full(len(cls), np.iinfo(np.int64).max)
    np.minimum.at(least, at[len(sent) :], settled)
    total += np.where(least == np.iinfo(np.int64).max, 0, least)
    for i in range(0, len(cls), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(cls[i : i + 65536]), pa.array(total[i : i + 65536])], names=["cls", "shared"])


def point(s: np.ndarray) -> np.ndarray:
    """Counts by hash group; all 255 where one of them doesn't fit a byte: such a point bounds nothing."""
    c = np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=GROUPS)
    return np.full(GROUPS, 255, np.uint8) if c.max(initial=0) > 254 else c.astype(np.uint8)


def _sets_of(size):
    """(cls, n, set, point) of chosen documents; a row whose text isn't that of its class is left out."""

    def run(batches):
        for b in batches:
            wanted = b.column(b.schema.get_field_index("cls")).to_numpy()
            at = 0
            for t in text_chunks(b):
                rows = []
                for i, s in sets(t, size):
                    if class_of(s) == wanted[at + i]:
                        rows.append((int(wanted[at + i]), len(s), s.tobytes(), point(s).tobytes()))
                at += len(t)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["cls", "n", "s", "point"])

    return run


def prefix_of(s: np.ndarray, percent: int) -> np.ndarray:
    return np.sort(mix(s))[: spare(len(s), percent) + 1]


def _prefix_counts(percent):
    """Prefix shingles that several classes of a task share, with how many."""

    def run(batches):
        held, n = [], 0

        def some():
            s, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= 4
            return pa.RecordBatch.from_arrays([pa.array(s[often].astype(np.int64)), pa.array(times[often])], names=["s", "n"])

        for b in batches:
            for raw in b.column(0):
                held.append(prefix_of(np.frombuffer(raw.as_buffer(), np.uint64), percent))
                n += len(held[-1])
            if n >= DEALT:
                yield some()
                held, n = [], 0
        if n:
            yield some()

    return run


def cells_of(classes: int) -> int:
    cells = CELLS
    while classes > cells * CELL_CLASSES:
        cells *= 2
    return cells


def _parted(prefix: np.ndarray, cls: int, hot: np.ndarray, parts_of: np.ndarray) -> np.ndarray:
    """A prefix's keys: its shingles, and of a hot one a key for each pair of parts that the class' own part is in.  hot: sorted."""
    keys = []
    at = np.minimum(np.searchsorted(hot, prefix), len(hot) - 1)
    found = hot[at] == prefix
    for s, parts in zip(prefix[found], parts_of[at[found]].tolist(), strict=True):
        own, j = cls % parts, np.arange(parts)
        keys.append(mix(s + _BASE * (np.minimum(own, j) * parts + np.maximum(own, j) + 1).astype(np.uint64)))
        prefix = prefix[prefix != s]
    return np.concatenate([prefix, *keys]) if keys else prefix


def _prefixes(percent, hot: dict[int, int], cells: int):
    def run(batches):
        known = np.array(sorted(hot), np.uint64)
        parts_of = np.array([hot[s] for s in known.tolist()], np.int64)
        for b in batches:
            out = [[], [], [], [], []]
            for cls, n, raw, p in zip(*(b.column(i) for i in range(4)), strict=True):
                own, n = prefix_of(np.frombuffer(raw.as_buffer(), np.uint64), percent), n.as_py()
                if hot:
                    own = _parted(own, cls.as_py(), known, parts_of)
                at = bucket(mix(own), cells)  # prefixes are smallest hashes: their own high bits are all alike
                order = np.argsort(at, kind="stable")
                own, at = own[order], at[order]
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                for lo, hi in zip(first, np.append(first[1:], len(at)), strict=True):
                    out[0].append(int(at[lo])), out[1].append(cls.as_py()), out[2].append(n)
                    out[3].append(own[lo:hi].tobytes()), out[4].append(p.as_buffer().to_pybytes())
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.binary())], names=["bucket", "cls", "n", "prefix", "point"])

    return run


class Forest:
    """Union-find over 0..n-1; roots are the smallest members."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        while (flat := self.up[self.up]).tolist() != self.up.tolist():
            self.up = flat
        return self.up


class Tree:
    """A packed R-tree of count vectors: leaves hold NODE points of similar size, the node their maxima."""

    def __init__(self, points: np.ndarray, n: np.ndarray, percent: int):
        order = np.lexsort((points.argmax(1), n))
        self.order, self.points, self.n, self.percent = order, points[order].astype(np.int32), n[order], percent
        cuts = np.arange(0, len(order), NODE)
        self.top = np.maximum.reduceat(self.points, cuts, axis=0)
        self.low, self.high = np.minimum.reduceat(self.n, cuts), np.maximum.reduceat(self.n, cuts)

    def near(self, point: np.ndarray, n: int) -> np.ndarray:
        """Members whose overlap with the point can reach the threshold."""
        p, s = point.astype(np.int32), self.percent
        free = point[0] == 255 and (point == 255).all()
        # overlap >= s/(100+s) * (n + m), and the sizes' ratio within s/100
        fits = (self.low * s <= n * 100) & (self.high * 100 >= n * s)
        nodes = np.flatnonzero(fits)
        if not free and len(nodes):
            bound = np.minimum(self.top[nodes], p).sum(1)
            wild = (self.top[nodes] == 255).all(1)
            nodes = nodes[wild | (bound * (100 + s) >= s * (n + self.low[nodes]))]
        if not len(nodes):
            return nodes
        at = (nodes[:, None] * NODE + np.arange(NODE)).ravel()
        at = at[at < len(self.n)]
        m = self.n[at]
        ok = (m * s <= n * 100) & (m * 100 >= n * s)
        at, m = at[ok], m[ok]
        if not free and len(at):
            bound = np.minimum(self.points[at], p).sum(1)
            wild = (self.points[at] == 255).all(1)
            at = at[wild | (bound * (100 + s) >= s * (n + m))]
        return self.order[at]


def fine_points(sets_: list[np.ndarray]) -> np.ndarray:
    """Counts by FINE hash groups, cut off at 255."""
    out = np.zeros((len(sets_), FINE), np.uint8)
    for i, s in enumerate(sets_):
        out[i] = np.minimum(np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=FINE), 255)
    return out


def _spread(own: np.ndarray, label: np.ndarray, near, forest: Forest, edges: list) -> None:
    """Edges that span the candidate pairs of a list.  label: components so far; near(k): candidates of the list's k-th member."""

    def probe(k):
        others = near(k)
        met, first = np.unique(label[others], return_index=True)
        met, first = met[met != label[k]], first[met != label[k]]
        for j in others[first]:
            forest.join(int(own[k]), int(own[j]))
            edges.append((own[k], own[j], True))
        if len(met):
            label[np.isin(label, met)] = label[k]

    probe(0)
    for k in range(1, len(own)):
        # of two members that aren't joined, one at least is outside the largest component
        if k % 64 == 1:
            kinds, n = np.unique(label, return_counts=True)
            most = label == kinds[n.argmax()]
            main = np.flatnonzero(most)[0]
        if label[k] != label[main]:
            probe(k)


def _candidates(percent, sparse):
    """(a, b, dense): the candidate pairs of some buckets, or edges that span them where there are many; b is the smaller class.  Rows come by bucket."""

    def some_buckets(batches):
        held, rows = [], 0
        for b in batches:
            while len(b):
                if rows < HELD_ROWS:
                    held.append(b.slice(0, min(len(b), HELD_ROWS - rows)))
                    b = b.slice(len(held[-1]))
                    rows += len(held[-1])
                    continue
                # the bucket that is open goes to its end
                last = held[-1].column(0)[len(held[-1]) - 1].as_py()
                more = int(np.searchsorted(b.column(0).to_numpy(), last, "right"))
                if more:
                    held.append(b.slice(0, more))
                    b = b.slice(more)
                if len(b):
                    yield held
                    held, rows = [], 0
        if held:
            yield held

    def run(batches):
        for some in some_buckets(batches):
            yield from pairs_of(some)

    def pairs_of(batches):
        cls, n, keys, points = [], [], [], []
        for b in batches:
            cls.append(b.column(1).to_numpy()), n.append(b.column(2).to_numpy())
            keys += [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(3)]
            points += [np.frombuffer(x.as_buffer(), np.uint8) for x in b.column(4)]
        cls, n, points = np.concatenate(cls), np.concatenate(n), np.stack(points)
        cls, first, of = np.unique(cls, return_index=True, return_inverse=True)  # a class comes once a cell
        n, points = n[first], points[first]
        doc, key = np.repeat(of, [len(k) for k in keys]), np.concatenate(keys)
        order = np.lexsort((doc, key))
        doc, key = doc[order], key[order]
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        long_first = np.argsort(-np.diff(cuts), kind="stable")
        forest, done, edges = Forest(len(cls)), set(), []
        for lo, hi in zip(cuts[long_first], cuts[long_first + 1], strict=True):
            if hi - lo < 2:
                break
            own = doc[lo:hi]
            if (mark := own.tobytes()) in done:
                continue
            done.add(mark)
            label = np.array([forest.find(i) for i in own])
            if (label == label[0]).all():
                continue
            tree = Tree(points[own], n[own], percent)
            near = lambda k, tree=tree, own=own: tree.near(points[own[k]], int(n[own[k]]))
            few, limit = [], sparse * len(own)
            for k in range(len(own)):
                others = near(k)
                few += [(k, j) for j in others[others > k]]
                if len(few) > limit:
                    break
            if len(few) <= limit:
                edges += [(own[k], own[j], False) for k, j in few if label[k] != label[j]]
            else:
                _spread(own, label, near, forest, edges)
        if edges:
            x, y = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
            dense = np.array([e[2] for e in edges])
            a, b = cls[np.maximum(x, y)], cls[np.minimum(x, y)]
            for i in range(0, len(a), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(v[i : i + 65536]) for v in (a, b, dense)], names=["a", "b", "dense"])

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def spanning(sets_: list[np.ndarray], points: np.ndarray, percent: int, known: np.ndarray | None = None) -> Forest:
    """Joins all linked sets; a pair is compared unless it is joined already or the bound rules it out. known: components so far."""
    n = np.array([len(s) for s in sets_], np.int64)
    forest, leaders = Forest(len(sets_)), []
    if known is not None:
        _, first, of = np.unique(known, return_index=True, return_inverse=True)
        for i, j in enumerate(first[of]):
            forest.join(i, int(j))
    for i in range(len(sets_) if known is None else 0):  # a first pass only: most members of a group are linked with one of its first
        for l in leaders:
            if linked(sets_[i], sets_[l], percent):
                forest.join(i, l)
                break
        else:
            if len(leaders) < 8:
                leaders.append(i)
    roots = forest.roots().copy()
    most = np.bincount(roots).argmax()
    if (roots == most).all():
        return forest
    tree, fine = Tree(points, n, percent), fine_points(sets_)
    cut = fine.max(1, initial=0) == 255  # groups of theirs may hold more: no bound
    # of two sets that aren't joined, one at least is outside the largest component: the search starts from each of those
    for i in np.flatnonzero(roots != most):
        near = tree.near(points[i], int(n[i]))
        near = near[roots[near] != roots[i]]
        overlap = np.minimum(fine[near], fine[i]).sum(1, dtype=np.int64)
        near = near[cut[near] | cut[i] | (overlap * (100 + percent) >= percent * (n[near] + n[i]))]
        for j in near:
            if roots[i] != roots[j] and linked(sets_[i], sets_[j], percent):
                forest.join(int(i), int(j))
                low, high = sorted((roots[i], roots[j]))
                roots[roots == high] = low
    return forest


def _compare(percent):
    """Rows sorted by hub, part and side: a hub's set, then those that are compared with it."""

    def run(batches):
        hub = None
        for b in batches:
            links = [[], []]
            for side, x, h, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if side == 0:
                    hub = np.frombuffer(raw.as_buffer().to_pybytes(), np.uint64)
                elif linked(np.frombuffer(raw.as_buffer(), np.uint64), hub, percent):
                    links[0].append(x), links[1].append(h)
            if links[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in links], names=["a", "b"])

    return run


def _verify(percent):
    """Rows sorted by task: one task's documents at a time."""

    def edges(held):
        cls, known = (np.array([h[k] for h in held], np.int64) for k in (0, 3))
        forest = spanning([h[1] for h in held], np.stack([h[2] for h in held]), percent, known)
        roots = forest.roots()
        at = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(cls[roots[at]])], names=["a", "b"])

    def run(batches):
        task, held = None, []
        for b in batches:
            for t, c, s, p, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
                if t != task:
                    if len(held) > 1:
                        yield edges(held)
                    task, held = t, []
                held.append((c, np.frombuffer(s.as_buffer().to_pybytes(), np.uint64), np.frombuffer(p.as_buffer().to_pybytes(), np.uint8), r))
        if len(held) > 1:
            yield edges(held)

    return run


_TASK = "array<struct<grp:bigint,band:int,kind:string,i:int,up:int,j:int>>"


def _tasks(of: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(task, cls, root, s, point): each pair of a group whose sizes can match meets in a task, unless both are of its largest component.

    members: node, grp, root, out (not of the group's largest component).
    """
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent)).cast("int")
    rows = written(of.select("cls", "n").join(members, F.col("cls") == F.col("node")).select("grp", "cls", "n", "root", "out"), "candidates").withColumn("band", band)
    need = lambda docs, n: F.greatest(F.ceil(docs / BLOCK_DOCS), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    of_kind = lambda out: need(F.count_if("out" if out else ~F.col("out")), F.coalesce(F.sum(F.when(F.col("out") == out, F.col("n"))), F.lit(0)))
    size = rows.groupBy("grp", "band").agg(of_kind(True).alias("outs"), of_kind(False).alias("mains"))
    whole = rows.groupBy("grp").agg(need(F.count("*"), F.sum("n")).alias("all_parts")).where("all_parts > 1").select("grp")
    large = size.join(whole, "grp")
    beside = lambda d, name: large.select("grp", (F.col("band") - d).alias("band"), *(F.col(k).alias(f"{k}_{name}") for k in ("outs", "mains")))
    large = written(large.join(beside(1, "above"), ["grp", "band"], "left").join(beside(-1, "below"), ["grp", "band"], "left").na.fill(0), "blocks")
    task = lambda band, kind, i, up, j: F.struct("grp", band.alias("band"), F.lit(kind).alias("kind"), i.cast("int").alias("i"), F.lit(up).alias("up"), j.cast("int").alias("j"))
    each = lambda m, f: F.when(F.col(m) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(m), F.lit(1)) - 1), f)).otherwise(F.array().cast(_TASK))
    small = rows.join(large.select("grp").distinct(), "grp", "left_anti").select("cls", "root", F.array(task(F.lit(-1), "all", F.lit(0), 0, F.lit(0))).alias("tasks"))
    own, here, under = F.col("part"), F.col("band"), F.col("band") - 1
    cut = rows.join(large, ["grp", "band"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.greatest(F.when(F.col("out"), F.col("outs")).otherwise(F.col("mains")), F.lit(1))).cast("int"))
    outs = F.concat(
        each("outs", lambda j: task(here, "outs", F.least(own, j), 0, F.greatest(own, j))), each("mains", lambda k: task(here, "out, main", own, 0, k)),
        each("outs_above", lambda j: task(here, "outs", own, 1, j)), each("mains_above", lambda k: task(here, "out, main", own, 1, k)),
        each("outs_below", lambda i: task(under, "outs", i, 1, own)), each("mains_below", lambda k: task(under, "main, out", k, 1, own)),
    )
    mains = F.concat(each("outs", lambda i: task(here, "out, main", i, 0, own)), each("outs_above", lambda j: task(here, "main, out", own, 1, j)), each("outs_below", lambda i: task(under, "out, main", i, 1, own)))
    placed = small.union(cut.select("cls", "root", F.when(F.col("out"), outs).otherwise(mains).alias("tasks"))).withColumnRenamed("cls", "of")
    return of.join(placed, F.col("cls") == F.col("of")).select(F.explode("tasks").alias("task"), "cls", "root", "s", "point")


def _links(of: DataFrame, edges: DataFrame, percent: int, parts: int) -> DataFrame:
    """The candidate pairs that are links: each meets in a task of its hub b."""
    salts = F.ceil(F.count("*") / HUB).cast("int")
    hubs = edges.groupBy("b").agg(salts.alias("salts"))
    near = F.broadcast if edges.count() <= BROADCAST_IDS else lambda x: x
    pairs = edges.join(hubs, "b").select("a", "b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"))
    compared = of.join(near(pairs), F.col("cls") == F.col("a")).select("b", "salt", F.lit(1).alias("side"), "cls", "s")
    hub = of.join(near(hubs), F.col("cls") == F.col("b")).select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), "cls", "s")
    met = compared.union(hub).repartition(parts, "b", "salt").sortWithinPartitions("b", "salt", "side")
    return met.select("side", "cls", "b", "s").mapInArrow(_compare(percent), "a long, b long")


def _open_members(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, grp, root, out: the members of groups that the links so far don't join."""
    groups = components(edges.where("dense")).select("node", F.col("root").alias("grp"))
    state = written(groups.join(roots.select(F.col("node").alias("of"), "root"), F.col("node") == F.col("of"), "left").select("node", "grp", F.coalesce("root", "node").alias("root")), "group-members")
    sizes = state.groupBy("grp", "root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").select("grp", "main")
    return written(state.join(most, "grp").select("node", "grp", "root", (F.col("root") != F.col("main")).alias("out")), "open-members")


def jaccard_components(df: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (a set's identity) for every row."""
    spark = df.sparkSession
    docs, n_parts = id_and_text(df, id_col, text_col), partitions(df.sparkSession)
    by_text = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    members = held(docs.withColumn("by_text", by_text).mapInArrow(_classes(size), "doc_id long, n long, cls long, counted long, by_text long"))
    classes = members.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("counted").alias("counted"), F.count("*").alias("rows"), F.min("by_text").alias("by_text"))
    keys = deal(spark, n_parts)
    shared = docs.mapInArrow(_dealt(keys, size), "bucket long, s binary, cls binary, times binary").repartition(n_parts, "bucket").mapInArrow(_shared, "cell long, cls binary, n binary, here boolean").repartition(n_parts, "cell").mapInArrow(_totals, "cls long, shared long")
    open_ = classes.join(shared, "cls", "left").where(F.col("counted") - F.coalesce("shared", F.lit(0)) <= F.col("n") - F.floor((F.lit(percent) * F.col("n") + 99) / 100))
    open_ = written(open_.select(F.col("least").alias("by"), "cls", "by_text"), "open-classes")
    n_open = open_.count()
    near = F.broadcast if n_open <= BROADCAST_IDS else lambda x: x
    chosen = docs.join(near(open_.where("by is not null").drop("by_text")), F.col("doc_id") == F.col("by")).select("doc_id", "text", "cls")
    without_id = open_.where("by is null").select("cls", "by_text")
    if not without_id.isEmpty():  # classes that no id names are named by a text of theirs
        texts = docs.where("doc_id is null").select(F.xxhash64("text").alias("by_text"), "text").join(near(without_id), "by_text").groupBy("cls").agg(F.first("text").alias("text"))
        chosen = chosen.union(texts.select(F.lit(None).cast("long").alias("doc_id"), "text", "cls"))
    of = held(chosen.mapInArrow(_sets_of(size), "cls long, n long, s binary, point binary"))
    often = of.select("s").mapInArrow(_prefix_counts(percent), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
    hot = {r["s"] % (1 << 64): -(-r["n"] // HOT) for r in often.orderBy(F.desc("n"), "s").limit(HOT_SHINGLES).collect()}  # 16 bytes each
    entries = of.select("cls", "n", "s", "point").mapInArrow(_prefixes(percent, hot, cells_of(n_open)), "bucket long, cls long, n long, prefix binary, point binary")
    pairs = entries.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_candidates(percent, SPARSE), "a long, b long, dense boolean")
    edges = written(pairs.where("a <> b").groupBy("a", "b").agg(F.max("dense").alias("dense")), "candidate-pairs")
    roots = written(components(_links(of, edges, percent, n_parts)), "roots")
    if not (left := _open_members(edges, roots)).isEmpty():
        tasks = _tasks(of, left, percent)
        links = tasks.repartition(n_parts, "task").sortWithinPartitions("task").select(F.to_json("task").alias("task"), "cls", "s", "point", "root").mapInArrow(_verify(percent), "a long, b long")
        roots = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)), "roots")
    grouped = roots.join(classes, F.col("node") == F.col("cls")).select("cls", "root", "least")
    lowest = grouped.groupBy("root").agg(F.min("least").alias("component"))
    joined = grouped.join(lowest, "root").select(F.col("cls").alias("of"), "component")
    alone = classes.where("rows > 1").join(roots.select(F.col("node").alias("cls")), "cls", "left_anti").select(F.col("cls").alias("of"), F.col("least").alias("component"))
    return members.join(joined.union(alone), (F.col("cls") == F.col("of")) & (F.col("n") > 0), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.col("cls").alias("class_id"))


def op10_count_rtree(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM t WHERE len(w) > 0),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS MATERIALIZED (SELECT doc_id, hash(u) AS h FROM (SELECT doc_id, unnest(s) AS u FROM s)),
r AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
y AS MATERIALIZED (SELECT x.* FROM x SEMI JOIN r USING (h)),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM y a JOIN y b ON a.h = b.h AND a.doc_id <> b.doc_id JOIN n ON n.doc_id = a.doc_id JOIN n m ON m.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, n.n, m.n HAVING 100 * count(*) >= 80 * (n.n + m.n - count(*))),
c AS (SELECT a, b FROM p UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, min(c.b)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id GROUP BY d.doc_id
"""
