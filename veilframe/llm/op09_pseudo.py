"""LM scoring by masked pseudo-likelihood.

A small network sees the words on both sides of a place (``window`` on each) and predicts the one between:
each neighbour's embedding goes through a hidden layer, which gives a distribution over word classes and,
with the class, one over its members.  A document's score is the sum of its words' conditional
log-probabilities, each predicted with all its neighbours in place.

The vocabulary is every word of the corpus, with its count.  The network has an entry for each of the most
frequent words and one for any other, which is then told apart by its frequency: its probability is the
entry's times its share of the counts of such words (by absolute discounting, so that a word that the corpus
lacks has some too).  As a neighbour, such a word has an embedding by its hash, one of ``HASHED``.  The counts
of the ``KNOWN`` most frequent of these words go with the model; all others stay a table, which grows with the
corpus, and scoring brings the words of texts to it by a shuffle.

Training is one pass over all texts: rows are dealt over the rounds in turn by their places in the table, so
that copies of a text and rows that share an id fall in all rounds.  Each task trains a copy of the network on
its rows by numpy, and the copies are averaged, weighted by words, between rounds.  ``one_in`` trains on fewer
texts, where asked.  Averages are formed block by block of the parameters, so the driver receives one network
a round, whatever the corpus' size.

Scoring covers whole texts.  Nulls: a null or wordless text has no words and scores 0 with null mean and
perplexity.  Repeated rows return a row each; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, id_and_text, partitions, read, text_chunks, words, written
from .op10_jaccard import bucket, deal

#: Entries are CLASSES x MEMBERS; entry 0 pads a text's ends, entry 1 is any other word.
CLASSES, MEMBERS, DIM, HIDDEN, WINDOW = 32, 32, 8, 32, 2
ONE_IN, ROUNDS, STEP = 1, 3, 2048
#: Embeddings that other words share, by hash.
HASHED = 8192
#: Words without an entry whose counts go with the model (16 bytes each), and what each count is discounted by.
KNOWN, DISCOUNT = 200_000, 0.5
#: Words without a known count that a task deals out at a time.
DEALT = 500_000
#: Parameters that one group averages.
BLOCK = 4096


def shapes() -> list[tuple[str, tuple[int, ...]]]:
    return [("emb", (CLASSES * MEMBERS + HASHED, DIM)), ("w", (2 * WINDOW * DIM, HIDDEN)), ("b", (HIDDEN,)), ("wc", (HIDDEN, CLASSES)), ("bc", (CLASSES,)), ("ec", (CLASSES, HIDDEN)), ("wm", (HIDDEN, MEMBERS)), ("bm", (CLASSES, MEMBERS))]


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


@dataclass
class Vocabulary:
    words: np.ndarray  # sorted hashes of the words with entries
    entries: np.ndarray  # their entries, 2...
    counts: np.ndarray  # by entry
    known: np.ndarray  # sorted hashes of the most frequent other words
    times: np.ndarray  # their counts
    kinds: int  # other words
    rest: DataFrame | None = None  # w, n: the words that are neither


@dataclass
class Model:
    vocabulary: Vocabulary
    flat: np.ndarray

    def ids(self, h: np.ndarray) -> np.ndarray:
        return looked_up(h, self.vocabulary.words, self.vocabulary.entries, 1)


def looked_up(h: np.ndarray, keys: np.ndarray, values: np.ndarray, other: int) -> np.ndarray:
    """The value of each h among sorted keys, or ``other``."""
    if not len(keys):
        return np.full(len(h), other, np.int64)
    k = np.searchsorted(keys, h)
    k[k == len(keys)] = 0
    return np.where(keys[k] == h, values[k], other)


def log_share(n: np.ndarray, all_: float, kinds: int) -> np.ndarray:
    """Log-probability of words without an entry that the corpus has n times (0: nowhere) of ``all_`` such words of so many kinds."""
    return np.log(np.where(n > 0, n - DISCOUNT, (kinds * DISCOUNT + 1) / (kinds + 1)) / (all_ + 1))


def as_neighbours(ids: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Embeddings of words: that of the entry, or one by hash."""
    return np.where(ids == 1, CLASSES * MEMBERS + (h % np.uint64(HASHED)).astype(np.int64), ids)


def contexts(ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """[word, 2 * WINDOW]: the neighbours of each word, 0 beyond its text."""
    n = len(ids)
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    out = np.zeros((n, 2 * WINDOW), np.int64)
    for k, d in enumerate([d for d in range(-WINDOW, WINDOW + 1) if d]):
        at = np.arange(n) + d
        ok = (at >= 0) & (at < n)
        ok[ok] &= row[at[ok]] == row[ok]
        out[ok, k] = ids[at[ok]]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(np.clip(z, -80, 80))
    return z / (z @ np.ones(z.shape[1], z.dtype))[:, None]


def _squashed(z: np.ndarray) -> np.ndarray:
    """Between -1 and 1; its slope is (1 - |result|) squared."""
    return z / (1 + np.abs(z))


def forward(p: dict, ctx: np.ndarray, target: np.ndarray):
    c, m, at = target // MEMBERS, target % MEMBERS, np.arange(len(target))
    x = p["emb"][ctx].reshape(len(ctx), -1)
    h = _squashed(x @ p["w"] + p["b"])
    pc = _softmax(h @ p["wc"] + p["bc"])
    g = _squashed(h + p["ec"][c])
    pm = _softmax(g @ p["wm"] + p["bm"][c])
    return c, m, at, x, h, pc, g, pm


def log_probabilities(p: dict, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of entries."""
    out = np.empty(len(target))
    for i in range(0, len(target), 16384):
        c, m, at, _, _, pc, _, pm = forward(p, ctx[i : i + 16384], target[i : i + 16384])
        out[i : i + 16384] = np.log(np.maximum(pc[at, c], 1e-30)) + np.log(np.maximum(pm[at, m], 1e-30))
    return out


def gradients(p: dict, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of the mean negative log-probability, flat."""
    c, m, at, x, h, pc, g, pm = forward(p, ctx, target)
    n = len(target)
    pc[at, c] -= 1
    pm[at, m] -= 1
    pc /= n
    pm /= n
    by_class = np.zeros((CLASSES, n), np.float32)
    by_class[c, at] = 1
    dg = (pm @ p["wm"].T) * np.square(1 - np.abs(g))
    dh = ((pc @ p["wc"].T) + dg) * np.square(1 - np.abs(h))
    dx = (dh @ p["w"].T).reshape(-1, DIM)
    at = ctx.ravel()[:, None] * DIM + np.arange(DIM)
    emb = np.bincount(at.ravel(), dx.ravel(), p["emb"].size).astype(np.float32)
    parts = {"emb": emb, "w": x.T @ dh, "b": dh.sum(0), "wc": h.T @ pc, "bc": pc.sum(0), "ec": by_class @ dg, "wm": g.T @ pm, "bm": by_class @ pm}
    return np.concatenate([parts[k].ravel() for k, _ in shapes()]).astype(np.float32)


def first_model(counts: np.ndarray, seed: int) -> np.ndarray:
    """Small random numbers, and output biases at the corpus' own frequencies. counts: by entry."""
    r = np.random.default_rng(seed)
    flat = np.concatenate([(r.normal(0, 0.1, shape) if k not in ("b", "bc", "bm") else np.zeros(shape)).ravel() for k, shape in shapes()]).astype(np.float32)
    p, grid = unpack(flat), (counts + 0.5).reshape(CLASSES, MEMBERS)
    p["bc"][:] = np.log(grid.sum(1) / grid.sum())
    p["bm"][:] = np.log(grid / grid.sum(1, keepdims=True))
    return flat


class Adam:
    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n, np.float32), np.zeros(n, np.float32), 0, rate

    def step(self, flat: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        flat -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def vocabulary(docs: DataFrame, entries: int = CLASSES * MEMBERS, known: int = KNOWN) -> Vocabulary:
    """All words of all texts; the most frequent of them are numbered."""

    def run(batches):
        held, n = {}, 0
        for b in batches:
            for t in text_chunks(b):
                h, times = np.unique(words(t)[0], return_counts=True)
                held[n] = (h, times)
                n += 1
                if n >= 32:
                    held, n = {0: _summed(held)}, 1
        if held:
            h, times = _summed(held)
            for i in range(0, len(h), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 65536].astype(np.int64)), pa.array(times[i : i + 65536])], names=["w", "n"])

    all_ = written(docs.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    # the lowest count down to which words still number no more than asked for, by steps of counts (a few hundred rows)
    steps = all_.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 4).alias("step")).agg(F.min("n").alias("low"), F.sum("n").alias("n"), F.count("*").alias("kinds")).orderBy(F.desc("step")).collect()
    total, kinds = sum(r["n"] for r in steps), sum(r["kinds"] for r in steps)
    upto = np.cumsum([r["kinds"] for r in steps])
    taken = int(np.count_nonzero(upto <= entries - 2 + known))
    top = all_.where(F.col("n") >= (steps[taken - 1]["low"] if taken else (1 << 62))).toArrow()  # 16 bytes each
    h, n = top["w"].to_numpy(), top["n"].to_numpy()
    order = np.lexsort((h, -n))
    h, n = h[order].astype(np.uint64), n[order]
    # frequent words are dealt over the classes; entries 0 and 1 are taken
    grid = np.arange(entries).reshape(CLASSES, MEMBERS).T.ravel()
    at = grid[grid > 1][: len(h)]
    counts = np.zeros(entries)
    counts[at] = n[: len(at)]
    counts[1] = total - n[: len(at)].sum()
    order, late = np.argsort(h[: len(at)]), np.argsort(h[len(at) :])
    rest = all_.where(F.col("n") < steps[taken - 1]["low"] if taken else F.lit(True)) if taken < len(steps) else None
    return Vocabulary(h[: len(at)][order], at[order], counts, h[len(at) :][late], n[len(at) :][late], max(0, kinds - len(at)), rest)


def _summed(held: dict) -> tuple[np.ndarray, np.ndarray]:
    h, back = np.unique(np.concatenate([x[0] for x in held.values()]), return_inverse=True)
    return h, np.bincount(back, np.concatenate([x[1] for x in held.values()])).astype(np.int64)


def train(docs: DataFrame, one_in: int = ONE_IN, rounds: int = ROUNDS, rate: float = 0.01, seed: int = 11) -> Model:
    """docs: doc_id, text; its rows keep their order from job to job, as those of a file do."""
    v = vocabulary(docs)
    model = Model(v, first_model(v.counts, seed))
    share = docs.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0) if one_in > 1 else docs
    share = share.withColumn("nth", F.pmod(F.monotonically_increasing_id(), F.lit(rounds)))

    def run(flat, nth, vocabulary):
        def task(batches):
            own, seen, opt = flat.copy(), 0, Adam(len(flat), rate / (1 + nth))
            p, r, model = unpack(own), np.random.default_rng(seed + nth), Model(vocabulary, own)
            for b in batches:
                for t in text_chunks(b):
                    h, edges = words(t)
                    ids = model.ids(h)
                    ctx = contexts(as_neighbours(ids, h), edges)
                    order = r.permutation(len(ids))
                    for i in range(0, len(order), STEP):
                        some = order[i : i + STEP]
                        opt.step(own, gradients(p, ctx[some], ids[some]))
                    seen += len(ids)
            if seen:
                blocks = range(0, len(own), BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(list(range(len(blocks)))), pa.array([float(seen)] * len(blocks)), pa.array([(own[i : i + BLOCK].astype(np.float64) * seen).tobytes() for i in blocks])], names=["block", "seen", "v"])

        return task

    def total(key, batches):
        n, v = 0.0, 0.0
        for b in batches:
            for s, x in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                n, v = n + s, v + np.frombuffer(x.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([n]), pa.array([v.tobytes()])], names=["block", "seen", "v"])

    for nth in range(rounds):
        kind = "block long, seen double, v binary"
        task = run(model.flat, nth, _carried(v))
        got = share.where(F.col("nth") == nth).select("doc_id", "text").mapInArrow(task, kind).groupBy("block").applyInArrow(_one(total), kind).collect()  # one network
        if not got:
            continue  # fewer rows than rounds
        both = np.concatenate([np.frombuffer(bytes(r["v"])) for r in sorted(got, key=lambda r: r["block"])])
        model = Model(v, (both / got[0]["seen"]).astype(np.float32))
    return model


def _carried(v: Vocabulary, known: bool = False) -> Vocabulary:
    """What tasks receive of a vocabulary."""
    none = np.zeros(0, np.uint64)
    return Vocabulary(v.words, v.entries, v.counts, v.known if known else none, v.times if known else none, v.kinds)


def _one(total):
    def run(key, table):
        return pa.Table.from_batches(list(total(key, table.to_batches())))

    return run


def _scores(flat, v: Vocabulary, keys):
    """Rows of two kinds: a text's own score (bucket null), and packs of words whose counts aren't known here, with their texts' keys.

    Of equal rows of a pack, only the first (flag ``first``) deals out its words.
    """
    own_names = ["doc_id", "n", "sum", "text_key", "first", "bucket", "w", "of"]

    def packed(w, of):
        at = bucket(w, len(keys)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        w, of = w[order], of[order]
        cuts = np.searchsorted(at[order], np.arange(len(keys) + 1))
        some = np.flatnonzero(np.diff(cuts))
        none = lambda k: pa.nulls(len(some), k)
        return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.int64()), none(pa.bool_()), pa.array(keys[some]), *(pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()) for x in (w, of))], names=own_names)

    def run(batches):
        p, model, others = unpack(flat), Model(v, flat), float(v.counts[1])
        met, held, count = set(), [], 0
        for b in batches:
            text_keys, base = b.column(b.schema.get_field_index("text_key")).to_numpy(), 0
            for t in text_chunks(b):
                h, edges = words(t)
                ids = model.ids(h)
                lp = log_probabilities(p, contexts(as_neighbours(ids, h), edges), ids)
                n, sums = np.diff(edges), np.zeros(len(t))
                key = text_keys[base : base + len(t)]
                other = np.flatnonzero(ids == 1)
                times = looked_up(h[other], v.known, v.times, 0)
                lp[other] += np.where(times > 0, log_share(np.maximum(times, 1), others, v.kinds), 0)
                full = np.flatnonzero(n)
                if len(full):
                    sums[full] = np.add.reduceat(lp, edges[full])
                first = np.array([not (k in met or met.add(k)) for k in key.tolist()])
                row = np.searchsorted(edges, other[times == 0], "right") - 1
                late = first[row]
                held.append((h[other[times == 0]][late], key[row][late]))
                count += len(held[-1][0])
                none = lambda k, t=t: pa.nulls(len(t), k)
                yield pa.RecordBatch.from_arrays([pa.array(t.ids, pa.int64()), pa.array(n), pa.array(sums), pa.array(key), pa.array(first), none(pa.int64()), none(pa.binary()), none(pa.binary())], names=own_names)
                base += len(t)
                if count >= DEALT:
                    yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    met, held, count = set(), [], 0
        if count:
            yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _dealt_counts(keys):
    """The table of further words in packs by bucket: hashes and counts."""

    def run(batches):
        for b in batches:
            w, n = b.column(0).to_numpy().astype(np.uint64), b.column(1).to_numpy()
            at = bucket(w, len(keys)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(len(keys) + 1))
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(keys[some]), *(pa.array([x[order][cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()) for x in (w, n)), pa.array([True] * len(some))], names=["bucket", "w", "of", "counts"])

    return run


def _shares(others: float, kinds: int):
    """A bucket's words with their counts -> (text_key, part): summed log-shares by text."""

    def run(batches):
        got = {True: ([], []), False: ([], [])}
        for b in batches:
            for w, of, counts in zip(b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                got[counts][0].append(np.frombuffer(w.as_buffer(), np.uint64)), got[counts][1].append(np.frombuffer(of.as_buffer(), np.int64))
        if not got[False][0]:
            return
        w, of = (np.concatenate(x) for x in got[False])
        known, n = (np.concatenate(x) for x in got[True]) if got[True][0] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(known)
        share = log_share(looked_up(w, known[order], n[order], 0), others, kinds)
        key, at = np.unique(of, return_inverse=True)
        part = np.bincount(at, share)
        for i in range(0, len(key), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 65536]), pa.array(part[i : i + 65536])], names=["text_key", "part"])

    return run


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, sum_logprob, mean_logprob, perplexity."""
    v, n = model.vocabulary, partitions(df.sparkSession)
    keys = deal(df.sparkSession, n)
    docs = id_and_text(df, id_col, text_col).withColumn("text_key", F.xxhash64("doc_id", "text"))
    all_ = written(docs.mapInArrow(_scores(model.flat, _carried(v, True), keys), "doc_id long, n long, sum double, text_key long, first boolean, bucket long, w binary, of binary"), "scores")
    own, packs = all_.where("bucket is null"), all_.where("bucket is not null").select("bucket", "w", "of", F.lit(False).alias("counts"))
    if v.rest is not None:
        packs = packs.union(v.rest.select("w", "n").mapInArrow(_dealt_counts(keys), "bucket long, w binary, of binary, counts boolean"))
    parts = packs.repartition(n, "bucket").mapInArrow(_shares(float(v.counts[1]), v.kinds), "text_key long, part double").groupBy("text_key").agg(F.sum("part").alias("part"))
    # equal rows of several packs dealt their words out as often
    dealt = own.where("first").groupBy("text_key").agg(F.count("*").alias("packs"))
    more = parts.join(dealt, "text_key").select(F.col("text_key").alias("of_key"), (F.col("part") / F.col("packs")).alias("more"))
    total = own.join(more, F.col("text_key") == F.col("of_key"), "left").select("doc_id", "n", (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum"))
    mean = F.when(F.col("n") > 0, F.col("sum") / F.col("n"))
    return total.select("doc_id", F.col("n").alias("n_tokens"), F.col("sum").alias("sum_logprob"), mean.alias("mean_logprob"), F.exp(-mean).alias("perplexity"))


def op9_masked_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, train(id_and_text(docs)))
