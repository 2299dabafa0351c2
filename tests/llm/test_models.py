"""Learned operators: accuracy on held-out rows, and odd rows."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from fixtures import frame, rows, sentence
from pyspark.sql import functions as F

from veilframe.llm import op01_language, op07_toxicity, op09_pseudo
from veilframe.llm.common import LOWER, crc_mod, run_hashes


def read(spark, sf_dir, t):
    return spark.read.parquet(f"{sf_dir}/{t}.parquet")


# ---------------------------------------------------------------- language


def test_languages_of_held_out_documents(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    p = op01_language.learn(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    got = op01_language.identify(docs.where(crc_mod(F.col("doc_id"), 4) == 2), p).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_odd_rows(spark):
    df = frame(spark, [(1, None), (2, ""), (3, "12 34 --"), (4, "the thing is here"), (4, "the thing is here"), (None, "the"), (6, "x")])
    p = op01_language.learn(frame(spark, [(1, "the thing is here and there"), (2, None)]))
    got = op01_language.identify(df, p).collect()
    assert len(got) == 7
    by = {r["doc_id"]: r for r in got}
    assert [by[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and by[4]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert op01_language.identify(frame(spark, []), p).collect() == []
    nothing = op01_language.learn(frame(spark, []))
    assert {r["lang_pred"] for r in op01_language.identify(df, nothing).collect()} == {"und"}


def test_bundles_bind_permuted_letters():
    v = op01_language.bundles(["abc"], 64, 3, 7)[0]
    t, s = op01_language.letters(64, 3, 7), op01_language.symbols()
    a, b, c = (int(s[ord(x)]) for x in "abc")
    want = t[0][0] * t[1][a] * t[2][b] + t[0][a] * t[1][b] * t[2][c] + t[0][b].astype(int) * t[1][c] * t[2][0]
    assert np.array_equal(v, want)
    both = op01_language.bundles(["abc abd", "x1y"], 64, 3, 7)
    assert np.array_equal(op01_language.bundles(["abc abd"], 64, 3, 7)[0], both[0])


def test_lone_letters_get_a_language(spark):
    p = op01_language.learn(frame(spark, [(1, "the thing is here and a dog")]))
    got = op01_language.identify(frame(spark, [(1, "x"), (2, "A."), (3, "a b c"), (4, "1 2"), (5, "é")]), p).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "en", 2: "en", 3: "en", 4: "und", 5: "en"}
    assert all(r["score"] > 0 for r in got if r["doc_id"] in (2, 3))
    t, s = op01_language.letters(64, 3, 7), op01_language.symbols()
    assert np.array_equal(op01_language.bundles(["A."], 64, 3, 7)[0], t[0][0] * t[1][int(s[ord("a")])] * t[2][0])


def test_language_of_very_long_and_repeated_texts(spark):
    docs = [(1, "the thing is here and there"), (2, "das ding ist nicht hier und dort")]
    learnt = spark.createDataFrame([(i, t, lang) for (i, t), lang in zip(docs, ("en", "de"), strict=True)], "doc_id long, text string, lang string")
    p = op01_language.learn(learnt)
    assert sorted(p) == ["de", "en"]
    long_ = [(i + 10, (t + " ") * 30_000) for i, t in docs]  # about 900,000 characters
    got = {(r["doc_id"], r["lang_pred"]) for r in op01_language.identify(frame(spark, long_ + long_[:1] + [(None, docs[1][1])]), p).collect()}
    assert got == {(11, "en"), (12, "de"), (None, "de")}


def test_languages_by_plain_loops(spark):
    """Cosines of n-gram sums with the prototypes, gram by gram."""
    texts = ["the cat and the dog", "le chat et le chien", "der hund und die katze", "a", "mixed le dog"]
    learnt = spark.createDataFrame([(k, t, "abc"[k]) for k, t in enumerate(texts[:3])], "doc_id long, text string, lang string")
    p = op01_language.learn(learnt, dim=256)
    t, s = op01_language.letters(256, 3, 7), op01_language.symbols()

    def bundle(text):
        places = [0]
        for ch in text:
            places.append(int(s[ord(ch)]))
        places.append(0)
        v = np.zeros(256)
        for a, b, c in zip(places, places[1:], places[2:], strict=False):
            if b:
                v += t[0][a].astype(float) * t[1][b] * t[2][c]
        return v / np.linalg.norm(v)

    want = []
    for k, text in enumerate(texts):
        cos = {lang: float(bundle(text) @ bundle(texts["abc".index(lang)])) for lang in "abc"}
        best = max(cos, key=cos.get)
        want.append((k, best, max(0.0, cos[best])))
    got = op01_language.identify(frame(spark, list(enumerate(texts))), p).collect()
    for r, w in zip(sorted(got), want, strict=True):
        assert (r["doc_id"], r["lang_pred"]) == w[:2] and abs(r["score"] - w[2]) < 1e-4


# ---------------------------------------------------------------- toxicity


def test_toxic_documents_and_their_sentences(spark):
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    model = op07_toxicity.learn(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    held = docs.join(labels.where(crc_mod(F.col("doc_id"), 5) == 0).select("doc_id", "toxic"), "doc_id")
    got = op07_toxicity.score(held, model).join(held.select("doc_id", "toxic"), "doc_id").toPandas()
    assert ((got.score >= 0.5) == (got.toxic == 1)).mean() > 0.95
    text = "All is well here. You are an idiot and a moron. The end."
    r = op07_toxicity.score(frame(spark, [(1, text)]), model).first()
    assert r["score"] > 0.5 and "idiot" in text.encode()[r["worst_start"] : r["worst_end"]].decode()


def test_noisy_or_by_plain_loops(spark):
    """Every score, and the worst sentence, anew from the learned weights: sentences by their stops, a word once in each."""
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    model = op07_toxicity.learn(docs, labels)
    weights = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))

    def word_hash(w: bytes) -> int:
        raw = np.frombuffer(w, np.uint8)
        return int(run_hashes(LOWER[raw], np.array([0]), np.array([len(raw)]))[0])

    def plain(text):
        passed, worst = 1.0, None
        for m in re.finditer(rb"[^!.?\n\r]+", (text or "").encode()):
            found = re.findall(rb"[A-Za-z\x80-\xff]+", m[0])
            if found:
                z = model.bias + sum(weights.get(h, 0.0) for h in {word_hash(w) for w in found})
                p = 1 / (1 + math.exp(-z))
                passed *= 1 - p
                if worst is None or p > worst[0] + 1e-12:
                    worst = (p, m.start(), m.end())
        return 1 - passed, worst

    data = [*rows(), (50, "You idiot! All is well. You moron? \n Fine."), (51, "ÉÉ idiot\u00e9 moron"), *((r.doc_id, r.text) for r in docs.where("doc_id < 60").collect())]
    data = [(k, t) for k, (_, t) in enumerate(data)]
    got = {r["doc_id"]: r for r in op07_toxicity.score(frame(spark, data), model).collect()}
    for k, t in data:
        score, worst = plain(t)
        assert got[k]["score"] == pytest.approx(score, abs=1e-9)
        assert (worst is None) == (got[k]["worst_score"] is None)
        if worst:
            assert got[k]["worst_score"] == pytest.approx(worst[0], abs=1e-9) and (got[k]["worst_start"], got[k]["worst_end"]) == worst[1:]
    assert any(got[k]["score"] > 0.5 for k in got) and sum(got[k]["score"] > 0.5 for k in got) < len(got) / 2


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (99, 1)], "doc_id long, toxic int")
    model = op07_toxicity.learn(frame(spark, rows()), labels)
    got = op07_toxicity.score(frame(spark, rows()), model).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (5, 6, 7)} == {0.0}
    none = op07_toxicity.learn(frame(spark, []), labels.limit(0))
    assert {r["score"] < 1e-6 for r in op07_toxicity.score(frame(spark, rows()), none).collect()} == {True}
    assert op07_toxicity.score(frame(spark, []), model).collect() == []
    long_ = op07_toxicity.score(frame(spark, [(1, "All is well here. " * 50_000), (1, "All is well here. " * 50_000), (None, "x" * 900_000)]), model).collect()
    assert len(long_) == 3 and all(0 <= r["score"] <= 1 for r in long_) and long_[0]["score"] == long_[1]["score"]
    kept = op07_toxicity.accepted(frame(spark, rows()), none)
    assert kept.count() == len(rows()) and kept.columns == frame(spark, rows()).columns


def test_noisy_or_gradient_learns_the_offending_word():
    r = random.Random(1)
    bags = []
    for k in range(400):
        toxic = k % 2
        h = [np.uint64(r.randrange(1, 60)) for _ in range(24)]
        if toxic:
            h[r.randrange(24)] = np.uint64(777)
        bags.append((toxic, np.array(h, np.uint64), np.repeat(np.arange(4), 6), 4))
    m = op07_toxicity.fit(bags, rounds=200)
    assert m.words[m.weights.argmax()] == 777 and m.weights.max() > 3


# ---------------------------------------------------------------- language model


def test_scores_prefer_real_text(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    model = op09_pseudo.train(docs, one_in=1, rounds=2)
    r = random.Random(4)
    some = [(i, x["text"]) for i, x in enumerate(docs.where("length(text) > 900").orderBy("doc_id").limit(60).collect())]
    mixed = [(i, " ".join(r.sample(t.split(), len(t.split())))) for i, t in some]
    real, shuffled = ({x["doc_id"]: x["mean_logprob"] for x in op09_pseudo.scored(frame(spark, d), model).collect()} for d in (some, mixed))
    assert np.mean([real[i] > shuffled[i] for i, _ in some]) > 0.6


def test_score_is_the_sum_of_conditionals(spark):
    model = op09_pseudo.train(frame(spark, rows()).select("doc_id", "text"), one_in=1, rounds=1)
    text = sentence(random.Random(2), 12)
    got = op09_pseudo.scored(frame(spark, [(1, text), (2, None), (3, " "), (4, "one")]), model).collect()
    by = {x["doc_id"]: x for x in got}
    assert by[1]["n_tokens"] == 12 and by[2]["sum_logprob"] == 0 and by[3]["mean_logprob"] is None and by[2]["perplexity"] is None
    p = op09_pseudo.unpack(model.flat)
    # class and member probabilities of every place add up to one
    ctx = np.array([[0, 0, 3, 4]])
    total = sum(np.exp(op09_pseudo.log_probabilities(p, ctx, np.array([w]))[0]) for w in range(op09_pseudo.CLASSES * op09_pseudo.MEMBERS))
    assert abs(total - 1) < 1e-4
    assert op09_pseudo.scored(frame(spark, []), model).collect() == []
    empty = op09_pseudo.train(frame(spark, []).select("doc_id", "text"), one_in=1, rounds=1)
    assert op09_pseudo.scored(frame(spark, [(1, "a b")]), empty).first()["n_tokens"] == 2


def test_gradient_by_differences():
    r = np.random.default_rng(3)
    flat = op09_pseudo.first_model(r.integers(1, 90, op09_pseudo.CLASSES * op09_pseudo.MEMBERS).astype(float), 5).astype(np.float64)
    ctx, target = r.integers(0, 1024, (6, 2 * op09_pseudo.WINDOW)), r.integers(0, 1024, 6)
    g = op09_pseudo.gradients(op09_pseudo.unpack(flat), ctx, target)
    loss = lambda f: -op09_pseudo.log_probabilities(op09_pseudo.unpack(f), ctx, target).mean()
    for k in np.flatnonzero(np.abs(g) > 1e-3)[:: max(1, int((np.abs(g) > 1e-3).sum() // 25))]:
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g[k]) < 1e-3


def brute_score(model, counts, text):
    """The sum of a text's log-probabilities, number by number."""
    v, p = model.vocabulary, {k: x.astype(float).tolist() for k, x in op09_pseudo.unpack(model.flat).items()}
    entry = dict(zip(v.words.tolist(), v.entries.tolist(), strict=True))
    h, _ = op09_pseudo.words(next(op09_pseudo.text_chunks(pa.record_batch({"doc_id": [1], "text": [text]}))))
    h = h.tolist()
    ids = [entry.get(x, 1) for x in h]
    beside = [op09_pseudo.CLASSES * op09_pseudo.MEMBERS + x % op09_pseudo.HASHED if i == 1 else i for i, x in zip(ids, h, strict=True)]
    others, kinds = sum(n for x, n in counts.items() if x not in entry), sum(x not in entry for x in counts)
    out = 0.0
    for k, target in enumerate(ids):
        x = [e for d in (-2, -1, 1, 2) for e in p["emb"][beside[k + d] if 0 <= k + d < len(ids) else 0]]
        times = lambda vec, mat: [sum(a * row[j] for a, row in zip(vec, mat, strict=True)) for j in range(len(mat[0]))]
        squash = lambda z: z / (1 + abs(z))
        hidden = [squash(a + b) for a, b in zip(times(x, p["w"]), p["b"], strict=True)]
        soft = lambda z, j: z[j] - math.log(sum(map(math.exp, z)))
        c, m = divmod(target, op09_pseudo.MEMBERS)
        out += soft([a + b for a, b in zip(times(hidden, p["wc"]), p["bc"], strict=True)], c)
        g = [squash(a + b) for a, b in zip(hidden, p["ec"][c], strict=True)]
        out += soft([a + b for a, b in zip(times(g, p["wm"]), p["bm"][c], strict=True)], m)
        if target == 1:
            n = counts.get(h[k], 0)
            out += math.log((n - 0.5 if n else (kinds / 2 + 1) / (kinds + 1)) / (others + 1))
    return out


@pytest.mark.parametrize("known", [0, 50, 200_000])
def test_scores_from_the_weights_and_counts(spark, monkeypatch, known):
    """By plain loops over the trained network; with the counts in the model or in the table beside it."""
    r = random.Random(6)
    made = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 6)))
    docs = [(k, " ".join(made() for _ in range(60))) for k in range(40)]
    docs += [(None, docs[3][1]), (None, docs[3][1]), (50, docs[4][1]), (50, docs[4][1]), (4, "one more"), (60, None), (61, "zzzzqqqq"), (62, "x " * 9000)]
    vocabulary = op09_pseudo.vocabulary
    monkeypatch.setattr(op09_pseudo, "vocabulary", lambda d: vocabulary(d, known=known))
    model = op09_pseudo.train(frame(spark, docs).select("doc_id", "text"), rounds=2)
    counts = {}
    for _, t in docs:
        for x in op09_pseudo.words(next(op09_pseudo.text_chunks(pa.record_batch({"doc_id": [1], "text": [t or ""]}))))[0].tolist():
            counts[x] = counts.get(x, 0) + 1
    assert (model.vocabulary.rest is not None) == (known < 200_000) and len(counts) > 1022 + 50
    want = [(i, len((t or "").split()), brute_score(model, counts, t or "")) for i, t in docs + [(70, "nowhere met aaaa")] if len(t or "") < 9000]
    got = [(x["doc_id"], x["n_tokens"], x["sum_logprob"]) for x in op09_pseudo.scored(frame(spark, docs + [(70, "nowhere met aaaa")]), model).where("n_tokens < 5000").collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 * max(1, abs(b[2]))


def test_training_reads_every_row_once(spark, monkeypatch):
    r = random.Random(9)
    few = [(k, sentence(r, 40)) for k in range(3)] + [(None, "again and again"), (5, None)] + [(None, "again and again")] * 4
    docs = frame(spark, few).select("doc_id", "text")
    seen = []
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: [seen.append(x["seen"]) or x if "seen" in self.columns and x["block"] == 0 else x for x in collect(self)])
    op09_pseudo.train(docs)
    assert sum(seen) == sum(len((t or "").split()) for _, t in few)
    one = op09_pseudo.train(frame(spark, [(1, "only these words")]).select("doc_id", "text"))  # whatever its hash, it is trained on
    assert not np.array_equal(one.flat, op09_pseudo.first_model(one.vocabulary.counts, 11))


def test_repeated_texts_score_apart(spark):
    """A text whose words occur once in the corpus, and one that the corpus has twice."""
    r = random.Random(10)
    made = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(9))
    texts = [" ".join(r.choice(("the", made(), made())) for _ in range(60)) for _ in range(120)]
    docs = list(enumerate(texts + texts[:20]))
    got = {x["doc_id"]: x["mean_logprob"] for x in op09_pseudo.scored(frame(spark, docs), op09_pseudo.train(frame(spark, docs).select("doc_id", "text"))).collect()}
    assert np.mean([got[k] for k in range(20)]) > np.mean([got[k] for k in range(20, 120)]) + 0.3
