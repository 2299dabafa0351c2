"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector binds (multiplies) its letters' vectors,
each permuted (rotated) by its place; a text's vector bundles (adds) those of all its n-grams.  A language's
prototype bundles the vectors, each at unit length, of its sample texts.  A text gets the language whose
prototype has the largest cosine with its vector; the score is that cosine, at least 0.

Letters are those of the lower-cased text; other characters are a boundary, and n-grams don't reach over one.
Whole texts count.  Learning reads at most about ``sample`` labelled texts, drawn by a hash of the id;
prediction reads text alone.

Results for odd rows: ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
Repeated rows return a row each; equal cosines go to the first language by name.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_and_text, read

#: Symbols: 0 is the boundary, letters share the others by code point.
SYMBOLS, BITS = 1024, 10
CHUNK = 2 << 20
#: Texts that learning reads at most (about); the draw is by a hash of the id.
SAMPLE = 20_000


@lru_cache(1)
def symbols() -> np.ndarray:
    """Symbol of each code point."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(letter, np.arange(0x110000) % (SYMBOLS - 1) + 1, 0).astype(np.int32)


@lru_cache(4)
def letters(dim: int, n: int, seed: int) -> np.ndarray:
    """[place, symbol, dim]: the letters' vectors, permuted by place."""
    base = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))
    return np.stack([np.roll(base, k, axis=1) for k in range(n)])


def bundles(texts: list[str], dim: int, n: int, seed: int) -> np.ndarray:
    """A row per text: the sum of its n-grams' vectors; zeros without a letter."""
    out = np.zeros((len(texts), dim), np.float32)
    joined = "\n".join(["", *(x.lower().replace("\n", " ") for x in texts), ""])
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    row = np.cumsum(code == 10).astype(np.int64) - 1
    symbol = symbols()[code]
    keep = (symbol > 0) | np.concatenate(([True], symbol[:-1] > 0))  # one boundary for a run of them
    symbol, row = symbol[keep].astype(np.int64), row[keep]
    if len(symbol) < n:
        return out
    count = len(symbol) - n + 1
    gram = np.zeros(count, np.int64)
    for k in range(n):
        gram = gram << BITS | symbol[k : k + count]
    ok = np.ones(count, bool)  # a letter between two boundaries is an n-gram, too
    for k in range(1, n - 1):
        ok &= symbol[k : k + count] > 0
    if n == 1:
        ok = symbol > 0
    at = row[1 : 1 + count] if n > 1 else row
    gram, at = gram[ok], at[ok]
    if not len(gram):
        return out
    kinds, gram = np.unique(gram, return_inverse=True)
    table = letters(dim, n, seed)
    bound = table[0][kinds >> BITS * (n - 1)]
    for k in range(1, n):
        bound = bound * table[k][(kinds >> BITS * (n - 1 - k)) & (SYMBOLS - 1)]
    bound = bound.astype(np.float32)
    pair, times = np.unique(at * len(kinds) + gram, return_counts=True)
    at, gram, times = pair // len(kinds), pair % len(kinds), times.astype(np.float32)
    edges = np.searchsorted(at, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        lo, hi = edges[i], edges[i + 1]
        if lo < hi:
            out[i] = times[lo:hi] @ bound[gram[lo:hi]]
    return out


def _steps(batch, col: int):
    """(first row, texts) in steps of a few MB."""
    held, size, first = [], 0, 0
    for i, x in enumerate(batch.column(col)):
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def learn(df: DataFrame, dim: int = 1024, n: int = 3, seed: int = 7, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes by language, from about ``sample`` rows with a language at most."""
    rows = df.select(df[id_col].cast("string").alias("doc_id"), df[text_col].cast("string").alias("text"), df[lang_col].cast("string").alias("lang")).where("lang is not null and text is not null")
    total = rows.count()
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample / total * (1 << 30)))

    def run(batches):
        sums = {}
        for b in batches:
            lang = b.column(1).to_pylist()
            for first, texts in _steps(b, 0):
                v = bundles(texts, dim, n, seed)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(size > 0, size, 1)
                for i in range(len(texts)):
                    sums.setdefault(lang[first + i], np.zeros(dim))
                    sums[lang[first + i]] += v[i]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.tobytes() for s in sums.values()])], names=["lang", "v"])

    def total(key, table):
        v = sum(np.frombuffer(x.as_buffer()) for x in table.column("v"))
        return pa.table({"lang": pa.array([key[0].as_py()]), "v": pa.array([v.tobytes()], pa.binary())})

    sums = rows.select("text", "lang").repartition(16).mapInArrow(run, "lang string, v binary").groupBy("lang").applyInArrow(total, "lang string, v binary")
    found = {r["lang"]: np.frombuffer(bytes(r["v"])) for r in sums.collect()}  # a row a language of the sample
    return {k: (v / np.linalg.norm(v)).astype(np.float32) for k, v in sorted(found.items()) if np.linalg.norm(v) > 0}


def identify(df: DataFrame, prototypes: dict[str, np.ndarray], n: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    names = list(prototypes)
    matrix = np.stack([prototypes[k] for k in names]) if names else np.zeros((0, 8), np.float32)

    def run(batches):
        for b in batches:
            for first, texts in _steps(b, 1):
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                if names:
                    v = bundles(texts, matrix.shape[1], n, seed)
                    size = np.linalg.norm(v, axis=1)
                    cos = (v @ matrix.T) / np.where(size > 0, size, 1)[:, None]
                    best = cos.argmax(1)
                    for i in np.flatnonzero(size > 0):
                        langs[i], scores[i] = names[best[i]], float(min(1.0, max(0.0, cos[i, best[i]])))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(langs), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1_hyperdimensional(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    prototypes = learn(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return identify(docs, prototypes).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
