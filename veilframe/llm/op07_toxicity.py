"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability (logistic, over its distinct words), and the
document's is their noisy-or: 1 - product(1 - p).  Only document labels are learned from; the gradient
shares a document's label out over its sentences, so the model also says which sentences offend.

Words are runs of letters (A-Z lower-cased, all bytes beyond ASCII); a sentence ends at . ! ? or a line end.
Learning reads at most about ``sample`` labelled documents, drawn by a hash of the id; scoring reads whole
texts and nothing else.

Results for odd rows: a null or wordless text scores 0.  Repeated rows return a row each; a document with
several labels is learned from with each.  Among equally offending sentences the first is named.  Empty
tables give an empty result, and without labels every score is 0.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Texts, crc_mod, id_and_text, read, run_hashes, runs, text_chunks

#: Labelled documents that learning reads at most (about).
SAMPLE = 8_000
#: Words kept as features, and the least number of sample documents that hold one.
FEATURES, LEAST_DOCS = 4_096, 4
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
STOP = np.zeros(256, bool)
STOP[[0x21, 0x2E, 0x3F, 0x0A, 0x0D]] = True


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def sentences(t: Texts):
    """Word hashes, the sentence of each word; sentence starts and ends, and the row offsets into sentences."""
    s_start, s_end = runs(~STOP[t.data], t.offsets)
    w_start, w_end = runs(LETTER[t.data], t.offsets)
    return run_hashes(LOWER[t.data], w_start, w_end), np.searchsorted(s_start, w_start, "right") - 1, s_start, s_end, np.searchsorted(s_start, t.offsets)


def once(of: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature counts once in a sentence, so that length by itself adds nothing up."""
    pair = np.unique(of.astype(np.int64) * FEATURES + k)
    return pair // FEATURES, pair % FEATURES


def softplus(z):
    return np.logaddexp(0, z)


def fit(bags: list[tuple[int, np.ndarray, np.ndarray, int]], rounds: int = 400, rate: float = 0.1, l1: float = 2e-5, l2: float = 1e-5) -> Model:
    """bags: (label, word hashes, sentence of each, number of sentences)."""
    if not bags:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -20.0)
    y = np.array([b[0] for b in bags], float)
    lone = [np.unique(b[1]) for b in bags]
    words, at = np.unique(np.concatenate(lone), return_inverse=True)
    doc = np.repeat(np.arange(len(bags)), [len(x) for x in lone])
    there = np.bincount(at, minlength=len(words))
    toxic = np.bincount(at, y[doc], len(words))
    share = y.mean()
    z = np.where(there >= LEAST_DOCS, np.abs(toxic - there * share) / np.sqrt(there * max(share * (1 - share), 1e-9)), -1)
    chosen = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    chosen = chosen[z[chosen] >= 0]
    vocabulary = words[chosen]
    # sentences with a feature, and how many others each document has
    w, s, d, n_others, base = [], [], [], np.zeros(len(bags)), 0
    for i, (_, h, of, n) in enumerate(bags):
        k = np.searchsorted(vocabulary, h)
        k[k == len(vocabulary)] = 0
        hit = (vocabulary[k] == h) if len(vocabulary) else np.zeros(len(h), bool)
        of, k = once(of[hit], k[hit])
        kept, of = np.unique(of, return_inverse=True)
        w.append(k), s.append(of + base), d.append(np.full(len(kept), i))
        n_others[i], base = n - len(kept), base + len(kept)
    w, s, d = (np.concatenate(x) for x in (w, s, d))
    theta, bias = np.zeros(len(vocabulary)), -6.0
    m, v, mb, vb = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    for step in range(1, rounds + 1):
        zs = bias + np.bincount(s, theta[w], base)
        total = np.bincount(d, softplus(zs), len(bags)) + n_others * softplus(bias)
        total = np.maximum(total, 1e-12)
        pull = np.where(y > 0, -np.exp(-total) / -np.expm1(-total), 1.0)  # d loss / d total
        sig = 1 / (1 + np.exp(-zs))
        gs = pull[d] * sig / len(bags)
        g = np.bincount(w, gs[s], len(theta)) + l2 * theta
        gb = gs.sum() + (pull * n_others).sum() / len(bags) / (1 + np.exp(-bias))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.999**step
        scale = rate / (np.sqrt(v / c) + 1e-8)
        theta = theta - scale * m / a
        theta = np.sign(theta) * np.maximum(np.abs(theta) - scale * l1, 0)
        bias -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return Model(vocabulary, theta, float(bias))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """From about ``sample`` labelled documents at most."""
    labels = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    total = labels.count()
    if total > sample:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    # at most about ``sample`` pairs of numbers: small whatever the tables' size
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(labels), "doc_id").select("toxic", F.col("toxic").cast("long").alias("doc_id"), "text")

    def run(batches):
        for b in batches:
            for t in text_chunks(b):
                h, of, _, _, edges = sentences(t)
                cut = np.searchsorted(of, edges)
                yield pa.RecordBatch.from_arrays([pa.array([int(x) for x in t.ids]), pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in range(len(t))]), pa.array([(of[cut[i] : cut[i + 1]] - edges[i]).astype(np.int32).tobytes() for i in range(len(t))]), pa.array(np.diff(edges))], names=["toxic", "h", "of", "n"])

    def whole(batches):
        """The sample is bounded, so that one task can learn from all of it; the driver receives the model alone."""
        bags = []
        for b in batches:
            for y, h, of, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                bags.append((y, np.frombuffer(h.as_py(), np.uint64), np.frombuffer(of.as_py(), np.int32), n))
        m = fit(sorted(bags, key=lambda b: (b[0], b[3], b[1].tobytes())))
        yield pa.RecordBatch.from_arrays([pa.array([m.words.tobytes()]), pa.array([m.weights.tobytes()]), pa.array([m.bias])], names=["words", "weights", "bias"])

    bags = rows.mapInArrow(run, "toxic long, h binary, of binary, n long")
    r = bags.repartition(1).mapInArrow(whole, "words binary, weights binary, bias double").first()
    return fit([]) if r is None else Model(np.frombuffer(bytes(r["words"]), np.uint64), np.frombuffer(bytes(r["weights"])), r["bias"])


def _logits(t: Texts, model: Model):
    """Logit of each sentence, row offsets into sentences, sentence starts and ends; one without any word says nothing."""
    h, of, lo, hi, edges = sentences(t)
    z = np.full(len(lo), model.bias)
    if len(model.words) and len(h):
        k = np.searchsorted(model.words, h)
        k[k == len(model.words)] = 0
        hit = model.words[k] == h
        at, k = once(of[hit], k[hit])
        z += np.bincount(at, model.weights[k], len(lo))
    z[np.bincount(of, minlength=len(lo)) == 0] = -np.inf
    return z, edges, lo, hi


def _total(z: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Noisy-or of each row's sentences."""
    total, full = np.zeros(len(edges) - 1), np.flatnonzero(np.diff(edges))
    if len(full):
        total[full] = np.add.reduceat(softplus(z), edges[full])
    return -np.expm1(-total)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, and the most offending sentence: worst_score, worst_start, worst_end (UTF-8 bytes; null without a sentence)."""

    def run(batches):
        for b in batches:
            for t in text_chunks(b):
                z, edges, lo, hi = _logits(t, model)
                out = [[], [], []]
                for i in range(len(t)):
                    own = z[edges[i] : edges[i + 1]]
                    at = edges[i] + int(own.argmax()) if len(own) and np.isfinite(own.max()) else None
                    out[0].append(None if at is None else float(1 / (1 + np.exp(-z[at]))))
                    out[1].append(None if at is None else int(lo[at] - t.offsets[i]))
                    out[2].append(None if at is None else int(hi[at] - t.offsets[i]))
                yield pa.RecordBatch.from_arrays([pa.array(t.ids, pa.int64()), pa.array(_total(z, edges)), pa.array(out[0], pa.float64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["doc_id", "score", "worst_score", "worst_start", "worst_end"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, score double, worst_score double, worst_start long, worst_end long")


def accepted(df: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that score below the threshold."""
    text_at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            own = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(text_at)], names=["doc_id", "text"])
            good = [_total(*_logits(t, model)[:2]) < threshold for t in text_chunks(own)]
            yield b.filter(pa.array(np.concatenate(good))) if good else b

    return df.mapInArrow(run, df.schema)


def op7_noisy_or(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = learn(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    return score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_score", "worst_start", "worst_end")
