"""Fingerprints, the filter audit and spelling variants against plain loops."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import WORDS, frame, rows, sentence

from veilframe.llm import op11_fingerprint as op11
from veilframe.llm import op12_audit as op12
from veilframe.llm import op13_spelling as op13

# ---------------------------------------------------------------- fingerprints


def brute_edits(data, share=4):
    """In the order of the query; the hash that orders equal ids is Spark's, so they aren't followed here."""
    data = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0))
    out = []
    for k, (i, t) in enumerate(data):
        t, nxt = t or "", data[(k + 1) % len(data)][1] or ""
        q = len(t) // share
        edited = t[: len(t) - q] + nxt[:q]
        a, b, c = map(op11.fingerprint, (t, edited, nxt))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), op11.packed(*a), op11.packed(*b), float(op11.likeness(a, b)), float(op11.likeness(a, c))))
    return out


@pytest.mark.parametrize("partitions", ["4", "1", "13"])
def test_tail_edits(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = [tuple(map(lambda v: bytes(v) if isinstance(v, bytearray) else v, r)) for r in op11.tail_edits(frame(spark)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=str) == sorted(brute_edits(rows()), key=str)


def test_tail_edits_of_a_hot_id_and_of_repeated_rows(spark):
    r = random.Random(3)
    data = [(7, sentence(r, 30)) for _ in range(200)] + [(k, sentence(r, 12)) for k in range(100)] + [(8, "the same row")] * 5
    got = op11.tail_edits(frame(spark, data)).collect()
    assert Counter((x.doc_id, x.n_chars) for x in got) == Counter((i, len(t)) for i, t in data)
    texts = {t: op11.packed(*op11.fingerprint(t)) for _, t in data}
    assert Counter(bytes(x.fingerprint) for x in got) == Counter(texts[t] for _, t in data)
    assert sorted(x.near_next for x in got if x.doc_id == 8)[1:] == [1.0] * 4 or sum(x.near_next == 1.0 for x in got if x.doc_id == 8) >= 4


def test_tail_edits_of_one_row_and_of_none(spark):
    (only,) = op11.tail_edits(frame(spark, [(3, "one two\nthree four")])).collect()
    assert only.near_next == 1.0 and only.edited_sha256 == hashlib.sha256(b"one two\nthree one ").hexdigest()
    assert op11.tail_edits(frame(spark, [])).collect() == []


def test_paragraphs_are_summed_in_any_order_and_can_go_again():
    r = random.Random(1)
    lines = [sentence(r, 9) + "\n" for _ in range(40)]
    whole = op11.fingerprint("".join(lines))
    r.shuffle(lines)
    assert op11.packed(*op11.fingerprint("".join(lines))) == op11.packed(*whole)
    less = op11.minus(whole, op11.fingerprint(lines[0]))
    assert op11.packed(*less) == op11.packed(*op11.fingerprint("".join(lines[1:])))
    assert op11.packed(*op11.plus(less, op11.fingerprint(lines[0]))) == op11.packed(*whole)
    assert all(np.array_equal(x, y) for x, y in zip(op11.unpacked(op11.packed(*whole)), whole, strict=True))


def test_likeness_follows_the_share_in_common():
    r = random.Random(2)
    a = [sentence(r, 9) + "\n" for _ in range(300)]
    b = [sentence(r, 9) + "\n" for _ in range(300)]
    for share in (0.0, 0.25, 0.5, 0.75):
        k = int(300 * share)
        got = float(op11.likeness(op11.fingerprint("".join(a)), op11.fingerprint("".join(a[:k] + b[k:]))))
        assert abs(got - share) < 0.25
    assert op11.likeness(op11.fingerprint(""), op11.fingerprint("")) == 1.0
    assert op11.likeness(op11.fingerprint(""), op11.fingerprint("x")) == 0.0


def test_long_lines_and_very_long_words_are_cut_alike_in_windows(monkeypatch):
    text = "a" * 900 + " " + " ".join(WORDS * 30) + "b" * 700 + "\n" + "é" * 400
    whole = op11.packed(*op11.fingerprint(text))
    monkeypatch.setattr(op11, "CHUNK_BYTES", 16)
    monkeypatch.setattr(op11, "STEP", 3)
    assert op11.packed(*op11.fingerprint(text)) == whole


def test_sets_of_documents(spark):
    data = [r for r in rows() if r[0] is not None]
    df = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in data], "doc_id long, text string, source string")
    got = {r.key: bytes(r.fingerprint) for r in op11.set_fingerprints(df, "source").collect()}
    for key in "ab":
        total = (np.zeros(op11.CHECKS, np.uint64), np.zeros(op11.LANES, np.int32))
        for i, t in data:
            if "ab"[i % 2] == key:
                total = op11.plus(total, op11.fingerprint(t))
        assert got[key] == op11.packed(*total)
    each = {r.doc_id: bytes(r.fingerprint) for r in op11.fingerprints(df).collect()}
    assert each == {i: op11.packed(*op11.fingerprint(t)) for i, t in data}


# ---------------------------------------------------------------- filter audit


def brute_audit(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    marks: dict = {}
    for i, q, x in labels:
        if i is not None:
            m = marks.setdefault(i, [0, 0])
            m[0] |= q == 1
            m[1] |= x == 1
    flags = []
    for i, t, s in docs:
        t = t or ""
        w = words(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        flags.append((s or "", fails, *marks.get(i, [0, 0])))
    out = []
    for part in {f[0] for f in flags}:
        mine = [f for f in flags if f[0] == part]
        total, found = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                total[x] += len(gone)
                fails = [f for f in mine if f[1][x]]
                found.append((part, order, step, len(left), len(gone), len(fails) - len(gone), sum(sum(f[1].values()) == 1 for f in fails), sum(f[2] for f in gone), sum(f[3] for f in gone), x))
        out += [(*f[:-1], total[f[-1]]) for f in found]
    return sorted(out)


def audited(spark, docs, labels):
    d = spark.createDataFrame([(t, i, s, 1, 2, "x", True) for i, t, s in docs], "text string, doc_id long, source string, part int, bits int, digest string, first boolean")
    x = spark.createDataFrame([(*r, 9) for r in labels], "doc_id long, quality int, toxic int, part int")
    return sorted(map(tuple, op12.filter_audit(d, x).collect()))


def test_audit_of_odd_rows(spark):
    r = random.Random(4)
    texts = [None, "", " \t", "One #", sentence(r, 60), sentence(r, 40) + " " + "same " * 60, "CAPS AND MORE", "é" * 30, *(t for _, t in rows())]
    docs = [(k if k % 9 else None, r.choice(texts), r.choice(["a", "b", None, ""])) for k in range(150)] + [(5, "twice", "a")] * 3 + [(6, "twice", "b")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    assert audited(spark, [], []) == []
    docs = [(1, "x", "s")]
    assert audited(spark, docs, []) == brute_audit(docs, [])


def test_words_of_long_texts_are_counted_in_windows(monkeypatch):
    raw = b"\x0b".join(w.encode() for w in WORDS * 9) + b" \r\n"
    whole = op12._words(raw)
    monkeypatch.setattr(op12, "CHUNK_BYTES", 10)
    assert op12._words(raw) == whole == (9 * len(WORDS), len(WORDS))


def test_blocks_of_an_index_hold_their_rows(spark, monkeypatch):
    bits = [(f"p{k % 3}", k % 128) for k in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array([p for p, _ in bits]), pa.array([b for _, b in bits], pa.int32())], names=["part", "bits"])
    monkeypatch.setattr(op12, "BLOCK", 50)
    (index,) = op12._blocks([batch])
    assert sum(index.column(1).to_pylist()) == 1000 and max(index.column(1).to_pylist()) == 50
    (sums,) = op12._counted([index])
    got = {(p, s): c for p, s, c in zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), sums.column(2).to_pylist(), strict=True)}
    assert all(got[f"p{k}", s] == sum(p == f"p{k}" and not b & 31 & s for p, b in bits) for k in range(3) for s in range(32))


# ---------------------------------------------------------------- spelling variants


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=5):
    out, form = [], {}
    for w, n in counts.items():
        found = [x for x in counts if near(w, x)]
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        out.append((w, form[w], n, len(found)))

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, f, root(w), n, k, counts.get(f)) for w, f, n, k in out), key=str)


def vocabulary(seed, size, letters, least, most):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randint(least, most))) for _ in range(size)}
    for w in sorted(words)[:: max(1, size // 60)]:  # chains, and runs of one letter
        k = r.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]}
    return {w: 5 * r.choice([1, 1, 1, 2, 6, 31, 160, 900, 5000]) for w in words if w}


def as_frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("seed,letters,least,most,few", [(1, "ab", 6, 9, 4000), (2, "abcé", 6, 8, 40), (3, "aÿ", 6, 7, 10), (4, "abcdefghij", 6, 7, 60)])
def test_variants(spark, monkeypatch, seed, letters, least, most, few):
    monkeypatch.setattr(op13, "FEW", few)
    counts = vocabulary(seed, 400, letters, least, most)
    got = sorted(map(tuple, op13.variants(as_frame(spark, counts)).collect()), key=str)
    assert got == brute_variants(counts)


def test_variants_in_more_blocks_than_a_half_prefix_has(spark, monkeypatch):
    """All words begin alike, so each is asked for in all blocks."""
    monkeypatch.setattr(op13, "FEW", 5)
    counts = {"aaaaaaaa" + w: n for w, n in vocabulary(5, 150, "ab", 3, 6).items()} | {"x" * 3000: 5, "x" * 2999: 50, "x" * 1500 + "y" + "x" * 1499: 500}
    got = sorted(map(tuple, op13.variants(as_frame(spark, counts)).collect()), key=str)
    assert got == brute_variants(counts)


def test_variants_of_no_words(spark):
    assert op13.variants(as_frame(spark, {})).collect() == []
    assert op13.variants(as_frame(spark, {"lonely": 7})).collect() == [("lonely", None, "lonely", 7, 0, None)]


def brute_words(data, least=6, often=5, modulus=199):
    total = Counter()
    for i, t in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if modulus and h % modulus == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= often}


@pytest.mark.parametrize("modulus", [0, 3, 199])
def test_words(spark, monkeypatch, modulus):
    r = random.Random(6)
    data = rows() + [(k, "É Straße NAÏVETÉ ñandúes ÷×abcdef " + "".join(r.choice(["Longer", "words ", "ÀÉÎ", "-"]) for _ in range(40))) for k in range(30)] + [(1, "repeated rows here")] * 9
    monkeypatch.setattr(op13, "HELD", 20)
    got = {x.word: x.n for x in op13.word_counts(frame(spark, data), typo_one_in=modulus).collect()}
    assert got == brute_words(data, modulus=modulus)


def test_runs_are_found_whole_in_windows(monkeypatch):
    text = "abcdefgh " * 5 + "x" * 50 + " é" + "ü" * 9
    monkeypatch.setattr(op13, "WINDOW", 7)
    assert [w for some in op13._runs(text, 6) for w in some] == re.findall("[A-Za-zÀ-ÿ]{6,}", text)


def test_wavelet_tree_reports_rectangles():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        values = r.permutation(n)
        t = op13.Wavelet(values)
        lo, hi = np.sort(r.integers(0, n + 1, (2, 50)), axis=0)
        low, high = np.sort(r.integers(0, n + 1, (2, 50)), axis=0)
        some = hi > lo
        lo, hi, low, high = lo[some], hi[some], low[some], high[some]
        q, v = t.report(lo, hi, low, high)
        want = {(k, int(x)) for k in range(len(lo)) for x in values[lo[k] : hi[k]] if low[k] <= x < high[k]}
        assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == sorted(want)
