"""Spelling variants by two-dimensional range reporting.

The frequent words of a corpus are points: a word's place in forward order, and its place in the order of the
words read backwards.  The words that differ from a word by one code point at a position are those that begin
with what stands before it and end with what stands after it: an interval of either order, so a rectangle.
For each position the two intervals are intersected in a wavelet tree, which reports the points of a rectangle
with a few steps for each; words of one length have a tree of their own, so a rectangle holds nothing else.

The vocabulary grows with the corpus, so no task holds it.  It is dealt out twice in blocks of even size: by
ranges of forward order for the positions in a word's second half, whose prefix is at least half the word, and
by ranges of backward order for those in its first half.  A word is a point of one block, and is asked for in
the blocks that its half prefix covers, nearly always that one alone.  A block's points are held by its task;
words that come only to ask pass through.

A pair is found once: a replacement at its position, from both words; an insertion from the shorter word, at the
last of the places where it gives the same word.  A word's form is its most frequent near word if that is at least
RATIO times as frequent, so counts rise along forms and a root is found in as many rounds as the logarithm of
the longest such chain has steps.

Nulls: a null text has no words; a null id stands as "" before the colon.  Repeated rows count like any others.
Texts without words, or an empty table, give no words.  Ties between forms go to the smaller word in code-point
order.  Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, partitions, read, written

#: Words of a block, at most; a small vocabulary has a block for each FEW words up to the number of partitions.
BLOCK, FEW = 200_000, 4_000
#: Different words that a task counts before it passes them on.
HELD = 200_000
#: Characters of a text that are taken apart at a time.
WINDOW = 1 << 20
#: Letters of a sampled word that may part two blocks.
SPLITTER = 64
RATIO = 5

_LETTER = re.compile("[A-Za-zÀ-ÿ]")


# ---------------------------------------------------------------- words


def _runs(text: str, least: int):
    """Maximal runs of at least so many letters, window by window; none is cut."""
    run = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")
    at, rest = 0, re.compile("[A-Za-zÀ-ÿ]*")
    while at < len(text):
        end = rest.match(text, min(at + WINDOW, len(text))).end()
        yield run.findall(text, at, end)
        at = end


def _counting(least: int, modulus: int):
    def run(batches):
        total: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not text.is_valid:
                    continue
                small = text.as_buffer().to_pybytes().lower().decode()  # of bytes: A-Z only
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for found in _runs(small, least):
                    for w, n in Counter(found).items():
                        h = zlib.crc32(w.encode(), start)
                        if modulus and h % modulus == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1 :]
                            if len(w) < least:
                                continue
                        total[w] += n
                    if len(total) > HELD:
                        yield out()
                        total.clear()
        if total:
            yield out()

    return run


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, often: int = 5, typo_one_in: int = 0) -> DataFrame:
    """word, n of all words of at least ``least`` letters and ``often`` occurrences, A-Z lower-cased.

    typo_one_in: each run of a document whose crc32 (of "id:run") it divides loses one letter, to plant misspellings; 0: none.
    """
    got = id_and_text(df, id_col, text_col).mapInArrow(_counting(least, typo_one_in), "word string, n long")
    return got.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


# ---------------------------------------------------------------- range reporting


class Wavelet:
    """A wavelet tree over a permutation, as one bit of all values at each level, highest first."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - one))))
            values = np.concatenate((values[one == 0], values[one == 1]))

    def report(self, lo, hi, low, high) -> tuple[np.ndarray, np.ndarray]:
        """All (query, value) with a place in [lo, hi) and a value in [low, high), for arrays of queries."""
        q, v = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for level, z in enumerate(self.zeros):
            width = self.bits - 1 - level
            a, b = z[lo], z[hi]
            halves = []
            for bit, (x, y) in enumerate(((a, b), (z[-1] + lo - a, z[-1] + hi - b))):
                u = v << 1 | bit
                there = (x < y) & ((u << width) < high[q]) & (((u + 1) << width) > low[q])
                halves.append((q[there], x[there], y[there], u[there]))
            q, lo, hi, v = (np.concatenate(pair) for pair in zip(*halves, strict=True))
        return q, v


class Order:
    """Sorted words of one length: for each depth, which words share so long a prefix."""

    def __init__(self, letters: np.ndarray):
        self.keys, self.groups = [], []
        group = np.zeros(len(letters), np.int64)
        for d in range(letters.shape[1]):
            key = group * 256 + letters[:, d]
            group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
            self.keys.append(key)
            self.groups.append(group)
        self.size = len(letters)

    def intervals(self, asked: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Row d: where the words stand that begin with the first d letters of each asked word."""
        n = len(asked)
        lo, hi = np.zeros((depth + 1, n), np.int32), np.zeros((depth + 1, n), np.int32)
        hi[0] = self.size
        open_, group = np.arange(n), np.zeros(n, np.int64)
        for d in range(depth):
            key = group * 256 + asked[open_, d]
            a, b = np.searchsorted(self.keys[d], key, "left"), np.searchsorted(self.keys[d], key, "right")
            there = b > a
            open_, a, b = open_[there], a[there], b[there]
            if not len(open_):
                break
            lo[d + 1, open_], hi[d + 1, open_] = a, b
            group = self.groups[d][a]
        return lo, hi


class Points:
    """Words of one length in a block, as (forward place, backward place)."""

    def __init__(self, words: list[str], counts: list[int]):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words, self.counts = [words[k] for k in order], np.array(counts, np.int64)[order]
        self.letters = letters_of(self.words)
        self.back = np.lexsort(self.letters.T)  # the last letter counts first
        place = np.empty(len(words), np.int64)
        place[self.back] = np.arange(len(words))
        self.forward, self.backward = Order(self.letters), Order(self.letters[self.back, ::-1])
        self.tree = Wavelet(place)

    def near(self, asked: np.ndarray, positions: range, more: int, least: int = 1):
        """(asked word, point, position) of the points that have, at a position, one letter in place of the word's (more=0) or one more."""
        length = asked.shape[1]
        if not len(positions):
            return
        lo, hi = self.forward.intervals(asked, positions[-1])
        rest = length - positions[0] - (1 - more)  # letters after the first position
        low, high = self.backward.intervals(asked[:, ::-1], rest)
        for i in positions:
            tail = length - i - (1 - more)
            some = np.flatnonzero((hi[i] - lo[i] >= least) & (high[tail] - low[tail] >= least))
            if len(some):
                q, v = self.tree.report(lo[i, some].astype(np.int64), hi[i, some].astype(np.int64), low[tail, some], high[tail, some])
                yield some[q], self.back[v], i


def letters_of(words: list[str]) -> np.ndarray:
    """A row of code points for each word; all have one length, and no code point is above 255."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _links(points: dict[int, Points], words: list[str], counts: list[int], own: bool, backward: bool):
    """Pairs of some asked words with the block's points: (word, near word, its count)."""
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    a, b, n = [], [], []
    for length, some in by_length.items():
        asked = letters_of([words[k] for k in some])
        half = length // 2
        first = length - half if backward else half
        if length in points:  # another letter at a position; a word of the block meets itself
            p = points[length]
            for q, v, i in p.near(asked, range(first, length), 0, 2 if own else 1):
                other = p.letters[v, i] != asked[q, i]
                for x, y in zip(q[other].tolist(), v[other].tolist(), strict=True):
                    a.append(words[some[x]])
                    b.append(p.words[y])
                    n.append(int(p.counts[y]))
        if length + 1 in points:  # one letter more; at the last of equal places
            p = points[length + 1]
            for q, v, i in p.near(asked, range(first + backward, length + 1), 1):
                beside = i - 1 if backward else i
                last = p.letters[v, i] != asked[q, beside] if beside < length else np.ones(len(q), bool)
                for x, y in zip(q[last].tolist(), v[last].tolist(), strict=True):
                    a += [words[some[x]], p.words[y]]
                    b += [p.words[y], words[some[x]]]
                    n += [int(p.counts[y]), counts[some[x]]]
    return a, b, n


def _block(backward: bool):
    turn = (lambda x: [w[::-1] for w in x]) if backward else (lambda x: x)
    step = 20_000

    def run(batches):
        def out(words, counts, own):
            for at in range(0, len(words), step):
                a, b, n = _links(points, words[at : at + step], counts[at : at + step], own, backward)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(turn(a), pa.string()), pa.array(turn(b), pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

        own, counts, points = [], [], None
        for b in batches:
            words, n, asks = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            here = asks.count(False)  # the block's own words come first
            own += words[:here]
            counts += n[:here]
            if here < len(words):
                if points is None:
                    points = _points(own, counts)
                    yield from out(own, counts, True)
                yield from out(words[here:], n[here:], False)
        if points is None and own:
            points = _points(own, counts)
            yield from out(own, counts, True)

    return run


def _points(words: list[str], counts: list[int]) -> dict[int, Points]:
    by_length: dict[int, tuple[list, list]] = {}
    for w, n in zip(words, counts, strict=True):
        x = by_length.setdefault(len(w), ([], []))
        x[0].append(w)
        x[1].append(n)
    return {k: Points(*x) for k, x in by_length.items()}


def _dealt(splitters: list[str]):
    """Each word to its block, and to the others that its half prefix covers, there only to ask."""

    def run(batches):
        for b in batches:
            block, row, asks = [], [], []
            for k, w in enumerate(b.column(0).to_pylist()):
                own, half = bisect_right(splitters, w), w[: len(w) // 2]
                for at in range(bisect_right(splitters, half), bisect_right(splitters, half + "Ā") + 1):
                    block.append(at)
                    row.append(k)
                    asks.append(at != own)
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(row, pa.int64())).columns, pa.array(asks, pa.bool_()), pa.array(block, pa.int32())], names=["word", "n", "asks", "block"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n for each two words (word, n; distinct) that differ by one inserted, deleted or replaced code point; both ways round."""
    spark = words.sparkSession
    size = words.count()
    blocks = max(1, ceil(size / BLOCK), min(partitions(spark), ceil(size / FEW)))
    out = None
    for backward in (False, True):
        turned = words.select(F.reverse("word").alias("word"), "n") if backward else words.select("word", "n")
        sampled = turned.where(F.pmod(F.xxhash64("word"), F.lit(max(1, size // (64 * blocks)))) == 0).select(F.substring("word", 1, SPLITTER))
        sample = sorted(r[0] for r in sampled.collect()) if blocks > 1 else []  # about 64 for each block
        splitters = sorted({sample[k * len(sample) // blocks] for k in range(1, blocks)}) if sample else []
        dealt = turned.mapInArrow(_dealt(splitters), "word string, n long, asks boolean, block int").repartitionById(len(splitters) + 1, F.col("block")).sortWithinPartitions("asks")
        links = dealt.select("word", "n", "asks").mapInArrow(_block(backward), "word string, near string, near_n long")
        out = links if out is None else out.unionByName(links)
    return out


# ---------------------------------------------------------------- forms and roots


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, form, root, n_near, form_n of a vocabulary (word, n; distinct), which is read several times: written or held."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    form_n = -F.col("best.less")
    taken = form_n >= ratio * F.col("n")
    forms = written(joined.select("word", "n", F.when(taken, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, form_n).alias("form_n")), "forms")
    roots = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most, least = forms.agg(F.max("n"), F.min("n")).first()
    steps = int(log(most / max(1, least), ratio)) + 1 if most else 0  # counts rise by the ratio at each
    reach = 1
    while reach < steps:
        roots = written(roots, "roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        reach *= 2
    out = forms.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_range_reporting(spark, sf_dir: str) -> DataFrame:
    return variants(written(word_counts(read(spark, sf_dir, "documents"), typo_one_in=199), "words"))


ORACLE = """
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY doc_id, w),
step AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM (SELECT unnest(range(256)) AS i))),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
    lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + (ord(x) >> 6) AS BIGINT), CAST(128 + (ord(x) & 63) AS BIGINT)] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, step),
edited AS (SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM pairs GROUP BY word),
first AS (SELECT pairs.word, any_value(n_near) AS n_near, any_value(most) AS most, min(near) AS near FROM pairs JOIN best ON pairs.word = best.word AND near_n = most GROUP BY pairs.word),
forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * words.n THEN near END AS form, CASE WHEN most >= 5 * words.n THEN most END AS form_n
  FROM words LEFT JOIN first ON first.word = words.word),
chain AS (SELECT word, word AS here FROM words UNION ALL SELECT chain.word, form FROM chain JOIN forms ON forms.word = chain.here WHERE form IS NOT NULL),
ends AS (SELECT chain.word, here AS root FROM chain JOIN forms ON forms.word = chain.here WHERE form IS NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN ends ON ends.word = forms.word
"""
