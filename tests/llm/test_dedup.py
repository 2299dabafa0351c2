"""Exact, suffix and n-gram duplicates against plain loops."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from fixtures import frame, rows, sentence
from pyspark.sql import functions as F

from veilframe.llm import graph, op02_suffix, op03_exact, op10_jaccard
from veilframe.llm.common import text_chunks


def lower(b: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def check_exact(spark, data, keep):
    got = sorted(map(tuple, op03_exact.exact_groups(frame(spark, data), keep=keep).collect()), key=str)
    groups = {}
    for i, t in data:
        groups.setdefault(lower((t or "").encode()), []).append(i)
    want = []
    for i, t in data:
        key = lower((t or "").encode())
        ids = [x for x in groups[key] if x is not None]
        k = None if not ids else min(ids) if keep == "smallest" else max(ids)
        want.append((i, k, len(groups[key]), i == k, hashlib.sha256(key).hexdigest()))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_odd_rows(spark, keep):
    check_exact(spark, rows(), keep)


def test_exact_repeated_rows_and_hot_text(spark):
    check_exact(spark, [(k, "same TEXT" if k % 3 else f"t{k % 50}") for k in range(600)] + [(1, "same text"), (1, "same text")], "smallest")


def test_exact_empty_table(spark):
    assert op03_exact.exact_groups(frame(spark, [])).collect() == []


# ---------------------------------------------------------------- suffixes


def brute_spans(data, width=100):
    """doc position by position; rows that share an id don't see each other at the same start."""
    first = {}
    texts = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in data]
    for i, raw in texts:
        for p in range(len(raw) - width + 1):
            w = raw[p : p + width]
            if w not in first or (i, p) < first[w]:
                first[w] = (i, p)
    out = []
    for (i, t), (k, raw) in zip(data, texts, strict=True):
        spans = []
        for p in range(len(raw) - width + 1):
            if first[raw[p : p + width]] < (k, p):
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + width
                else:
                    spans.append([p, p + width])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + raw[at:a], b
        kept += raw[at:]
        out.append((i, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def suffix(spark, data, **kw):
    return sorted((tuple(r)[:5] for r in op02_suffix.repeated_spans(frame(spark, data), **kw).collect()), key=str)


def test_suffix_odd_rows(spark):
    assert suffix(spark, rows()) == brute_spans(rows())


def test_suffix_periodic_and_overlapping(spark):
    r = random.Random(2)
    block = sentence(r, 40)
    data = [(1, "ab" * 200), (2, "x" + "ab" * 120), (3, block + block), (4, "zz " + block[10:] + block[:150]), (5, block), (6, "line of text\n" * 30), (7, "line of text\n" * 9)]
    assert suffix(spark, data) == brute_spans(data)


@pytest.mark.parametrize("hot, share", [(1, 16), (20, 1), (4, 2), (2_000, 16)])
def test_suffix_many_variants_of_one_passage(spark, hot, share):
    r = random.Random(3)
    passage = sentence(r, 40)
    data = [(k, sentence(r, 5) + " " + passage + " " + sentence(r, 5)) for k in range(60)] + [(70, passage[30:]), (71, passage + " " + passage), (72, passage), (72, passage), (None, passage + " x"), (72, "one " + passage)]
    assert suffix(spark, data, hot=hot, share=share) == brute_spans(data)


def test_suffix_empty_table_and_repeated_rows(spark):
    assert suffix(spark, []) == []
    data = [(1, sentence(random.Random(1), 40))] * 2 + [(2, sentence(random.Random(1), 40))]
    assert suffix(spark, data) == brute_spans(data)


def test_suffix_rows_that_share_an_id(spark):
    r = random.Random(9)
    a, b = sentence(r, 40), sentence(r, 40)
    data = [(5, a + " x " + b), (5, a + " y"), (5, "zz " + a), (7, b + a), (None, b), (None, a[:150])]
    assert suffix(spark, data) == brute_spans(data)
    # one row of an id is a copy, the other stands nowhere else
    data = [(3, a), (5, a), (5, b), (8, None), (8, a[:120])]
    assert suffix(spark, data) == brute_spans(data)


def test_difference_cover_ranks():
    r = np.random.default_rng(4)
    for n in (1, 2, 3, 5, 30, 200, 900):
        for top in (2, 4, 200):
            s = r.integers(1, top, n)
            ranks = op02_suffix.suffix_ranks(s, 1, 1 << 30)
            order = sorted(range(n), key=lambda i: s[i:].tolist())
            assert np.argsort(ranks, kind="stable").tolist() == order
            assert len(set(ranks.tolist())) == n


def test_anchors_are_hashed_in_small_pieces(monkeypatch):
    """Each window's anchor is the leftmost of its smallest hashes; texts of a batch are hashed in pieces that fit a cache."""
    r = random.Random(5)
    texts = [None if k % 9 == 0 else "".join(r.choice("ab") for _ in range(r.choice([0, 1, 99, 100, 101, 132, 300]))) for k in range(800)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(800)), "text": texts, "cls": list(range(800))})
    sizes, hashes = [], op02_suffix.gram_hashes
    monkeypatch.setattr(op02_suffix, "gram_hashes", lambda data: sizes.append(len(data)) or hashes(data))
    list(op02_suffix._deal_anchors(np.arange(4), 100, np.zeros(0, np.uint64))([batch]))
    assert len(sizes) > 1 and max(sizes) <= 1 << 16
    (t,) = text_chunks(batch)
    want = []
    for i in range(len(t)):
        lo, hi = int(t.offsets[i]), int(t.offsets[i + 1])
        for p in range(lo, hi - 99):
            h = hashes(t.data[p : p + 100]) >> np.uint64(28)
            at = p + int(h.argmin())
            if want and want[-1][:2] == [i, at]:
                want[-1][3] = p
            else:
                want.append([i, at, p, p])
    row, at, _, first, last = op02_suffix.anchors(t)
    assert np.stack([row, at, first, last], 1).tolist() == want


def test_repeats_name_all_but_the_earliest():
    a, b = b"q" * 20 + bytes(range(97, 123)) * 6, bytes(range(97, 123)) * 6 + b"q" * 20
    of, offset = op02_suffix.repeats([a, b], 100)
    assert sorted(zip(of.tolist(), offset.tolist(), strict=True)) == [(1, k) for k in range(57)]


# ---------------------------------------------------------------- n-grams


def brute_components(data, percent=80):
    sets = []
    for i, t in data:
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", lower((t or "").encode())) if x]
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(data)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(data)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    members = {}
    for k, (i, _) in enumerate(data):
        members.setdefault(find(k), []).append(i)
    least = lambda k: min((i for i in members[find(k)] if i is not None), default=None)
    return sorted(((i, len(sets[k]), least(k)) for k, (i, _) in enumerate(data)), key=str)


def jaccard(spark, data, **kw):
    return sorted((tuple(r)[:3] for r in op10_jaccard.jaccard_components(frame(spark, data), **kw).collect()), key=str)


def test_jaccard_odd_rows(spark):
    assert jaccard(spark, rows()) == brute_components(rows())


def test_jaccard_chains_and_border_similarities(spark):
    r = random.Random(7)
    data, base = [], [r.choice("abcdefghijklmnopqrstuvwxyz") + str(k) for k in range(104)]
    for k in range(60):
        w = list(base)
        for x in range(k % 12):
            w[(k * 7 + x * 9) % 104] = f"e{k}-{x}"
        data.append((k, " ".join(w)))
    for k in range(60, 120):
        data.append((k, sentence(r, r.randrange(1, 60))))
    data += [(200 + k, " ".join(base[k * 3 :])) for k in range(12)]
    assert jaccard(spark, data) == brute_components(data)


def test_jaccard_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op10_jaccard, "BLOCK_DOCS", 8)
    r = random.Random(8)
    base = [f"w{k}" for k in range(80)]
    data = []
    for k in range(60):
        w = base[: 80 - k % 14]
        w[k % 60] = f"x{k}"
        data.append((k, " ".join(w)))
    data += [(100 + k, sentence(r, 40)) for k in range(20)]
    assert jaccard(spark, data) == brute_components(data)


def brute_forest(sets, percent=80):
    up = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if op10_jaccard.linked(sets[a], sets[b], percent):
            low, high = sorted((up[a], up[b]))
            up = [low if x == high else x for x in up]
    return up


def spanned(sets):
    return op10_jaccard.spanning(sets, np.stack([op10_jaccard.point(s) for s in sets]), 80).roots().tolist()


def test_spanning_joins_members_of_different_leaders():
    r = np.random.default_rng(2)
    h = np.sort(r.integers(0, 1 << 63, 400).astype(np.uint64))
    windows = [h[k : k + 100] for k in (0, 27, 9, 18)]
    assert spanned(windows) == brute_forest(windows) == [0, 0, 0, 0]
    for _ in range(60):  # chains of edits, in any order
        sets = []
        for _ in range(3):
            s = r.choice(h, 60, replace=False)
            for _ in range(12):
                s = s.copy()
                s[r.integers(0, 60, 6)] = r.integers(0, 1 << 63, 6)
                sets.append(np.unique(s))
        starts = r.permutation(60)[:25]
        sets += [h[k : k + 100] for k in starts]
        sets = [sets[k] for k in r.permutation(len(sets))]
        assert spanned(sets) == brute_forest(sets)


def test_jaccard_windows_in_any_order(spark):
    w = [f"w{k}" for k in range(140)]
    texts = [" ".join(w[k : k + 104]) for k in (0, 27, 9, 18)]
    for k, order in enumerate(itertools.permutations(texts)):
        if k % 6 == 0:
            data = list(enumerate(order))
            assert jaccard(spark, data) == brute_components(data)


def near_copies(r, n=60, size=80):
    base = [f"w{k}" for k in range(size)]
    out = []
    for _ in range(n):
        w = base[: size - r.randrange(14)]
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("sparse, hot, hub, block", [(0, 10, 3, 8), (0, 20_000, 5_000, 6_144), (1_000, 7, 2, 5), (1, 25, 4, 12)])
def test_jaccard_every_way_of_dealing(spark, monkeypatch, sparse, hot, hub, block):
    for name, value in (("SPARSE", sparse), ("HOT", hot), ("HUB", hub), ("BLOCK_DOCS", block), ("BROADCAST_IDS", block), ("HELD_ROWS", hub), ("CELL_CLASSES", 1 if hub < 100 else 8_192), ("CELLS", 4 if hub < 100 else 4_096)):
        monkeypatch.setattr(op10_jaccard, name, value)
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0 if sparse == 1 else 500_000)  # rounds of joins
    r = random.Random(sparse + hot)
    boiler = sentence(r, 60)
    data = list(enumerate(near_copies(r, 50) + [boiler + " " + sentence(r, 14) for _ in range(40)] + [sentence(r, 25) for _ in range(10)]))
    data += [(None, t) for _, t in data[::9]] + [(3, data[7][1])]
    assert jaccard(spark, data) == brute_components(data)


def test_jaccard_classes_without_an_id(spark):
    w = [f"w{k}" for k in range(140)]
    a, b, c = (" ".join(w[k : k + 104]) for k in (0, 9, 18))
    assert jaccard(spark, [(10, a), (None, b)]) == brute_components([(10, a), (None, b)]) == [(10, 100, 10), (None, 100, 10)]
    chain = [(7, a), (None, b), (None, b), (9, c), (None, c.upper()), (None, "else " + sentence(random.Random(1), 30))]
    assert jaccard(spark, chain) == brute_components(chain)
    none = [(None, a), (None, b), (None, a)]
    assert jaccard(spark, none) == brute_components(none)


def test_shared_shingles_are_never_undercounted(monkeypatch):
    monkeypatch.setattr(op10_jaccard, "DEALT", 120)
    r = random.Random(4)
    texts = near_copies(r, 12) + [sentence(r, 30) for _ in range(8)] + near_copies(r, 6)
    texts += texts[:5]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    keys = np.arange(7)
    dealt = list(op10_jaccard._dealt(keys, 5)(batch.slice(k, 5) for k in range(0, len(texts), 5)))
    by_bucket = {}
    for b in dealt:
        for k in range(len(b)):
            by_bucket.setdefault(b.column(0)[k].as_py(), []).append(b.slice(k, 1))
    by_cell = {}
    for rows_ in by_bucket.values():
        for b in op10_jaccard._shared(iter(rows_)):
            for k in range(len(b)):
                by_cell.setdefault(b.column(0)[k].as_py(), []).append(b.slice(k, 1))
    here = any(x for rows_ in by_cell.values() for b in rows_ for x in b.column(3).to_pylist())
    got = {c: n for rows_ in by_cell.values() for b in op10_jaccard._totals(iter(rows_)) for c, n in zip(*(x.to_pylist() for x in b.columns), strict=True)}
    sets = {op10_jaccard.class_of(s): {int(x) for x in s if x % op10_jaccard.COUNTED == 0} for _, s in op10_jaccard.sets(next(op10_jaccard.text_chunks(batch)), 5)}
    for c, s in sets.items():
        true = len({x for x in s if any(x in other for d, other in sets.items() if d != c)})
        assert true <= got.get(c, 0) <= 2 * true
    assert here and len(dealt) > 3


def test_jaccard_empty_table(spark):
    assert jaccard(spark, []) == []


def test_tree_finds_all_that_can_reach_the_threshold():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in r.integers(1, 300, 150)]
    sets += [s[: int(len(s) * 0.9)] for s in sets if len(s) > 20]
    points, n = np.stack([op10_jaccard.point(s) for s in sets]), np.array([len(s) for s in sets])
    tree = op10_jaccard.Tree(points, n, 80)
    for i, s in enumerate(sets):
        near = set(tree.near(points[i], int(n[i])).tolist())
        assert {j for j, t in enumerate(sets) if op10_jaccard.linked(s, t, 80)} <= near


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).select(F.count("*")).first()[0] == 0
