"""The pipeline's stages against plain loops, on a table with the odd cases and planted ones."""

import os
import random

import corpus_pipeline
import pytest
from fixtures import SCHEMA, frame, rows, sentence
from test_dedup import brute_components, lower
from test_files import check_packing

from veilframe.llm import op07_toxicity
from veilframe.llm.common import shared_dir


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    item = sentence(r, 40)
    data = [x for x in rows() if x[0] is not None]
    data += [(100 + k, sentence(r, 50) + (" you idiot moron." if k % 2 else ".")) for k in range(120)]
    data += [(300, sentence(r, 60) + " " + item + " " + sentence(r, 60)), (301, sentence(r, 80) + " " + " ".join(item.split()[:20])), (302, None), (303, "")]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    frame(spark, data).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, k % 2, 1) for k, i in enumerate(range(100, 220))], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, data


def ids(df):
    return sorted(x["doc_id"] for x in df.select("doc_id").collect())


def test_every_stage(spark, tables):
    folder, data = tables
    docs = frame(spark, data)
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "exact_dedup", "near_duplicates", "decontamination", "packing"]

    kept = stage["toxicity"](spark, docs, folder)
    model = op07_toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {x["doc_id"] for x in op07_toxicity.score(docs, model).collect() if x["score"] >= 0.5}
    assert bad == set(range(101, 220, 2)) and ids(kept) == sorted(i for i, _ in data if i not in bad)
    data = [x for x in data if x[0] not in bad]

    kept = stage["exact_dedup"](spark, kept, folder)
    first = {}
    for i, t in data:
        first.setdefault(lower((t or "").encode()), []).append(i)
    left = {min(v) for v in first.values()}
    assert set(ids(kept)) == left and len(ids(kept)) == len(left)
    data = [x for x in data if x[0] in left]

    kept = stage["near_duplicates"](spark, kept, folder)
    left = {i for i, _, c in brute_components(data) if i == c}
    assert ids(kept) == sorted(left)
    data = [x for x in data if x[0] in left]

    kept = stage["decontamination"](spark, kept, folder)
    data = [x for x in data if x[0] != 300]
    assert ids(kept) == sorted(i for i, _ in data) and kept.columns == docs.columns
    assert sorted(kept.select("doc_id", "text").collect(), key=str) == sorted(((i, t) for i, t in data), key=str)

    check_packing(stage["packing"](spark, kept, folder).collect(), data, 4096)
    shared = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    check_packing(corpus_pipeline.run(spark, folder).collect(), data, 4096)
    left = {x.split("-")[0] for x in set(os.listdir(shared)) - before}
    assert "decontamination" in left and not left & {"toxicity", "exact_dedup", "near_duplicates", "candidates", "roots", "exact", "near", "benchmark"}


def test_repeated_rows_and_empty_tables(spark, tables):
    folder, _ = tables
    twice = frame(spark, [(1, "some text"), (1, "some text"), (2, "SOME text"), (1, "other")])
    got = sorted((x["doc_id"], x["text"]) for x in corpus_pipeline.exact_dedup(spark, twice, folder).collect())
    assert got == [(1, "other"), (1, "some text")]
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.collect() == []


def test_null_and_shared_ids_stand_each_for_itself(spark, tables):
    folder, _ = tables
    r = random.Random(12)
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first()["text"]
    halves = item.split()[:22], item.split()[18:]
    near = sentence(r, 100)
    close = near.rsplit(" ", 1)[0] + " other"
    apart = [sentence(r, 50) + " " + " ".join(h) for h in halves]  # the item only if both count as one document
    bad, clean = [sentence(r, 30) + " " + item for _ in range(2)], [sentence(r, 60) for _ in range(2)]
    data = [(None, bad[0]), (None, clean[0]), (None, apart[0]), (None, apart[1]), (7, bad[1]), (7, clean[1])]
    stage = dict(corpus_pipeline.STAGES)

    def kept(name, data):
        return sorted(((x["doc_id"], x["text"]) for x in stage[name](spark, frame(spark, data), folder).collect()), key=str)

    assert kept("decontamination", data) == sorted([data[1], data[2], data[3], data[5]], key=str)
    got = kept("exact_dedup", [(None, "same"), (None, "Same"), (None, "more"), (1, "A"), (1, "a"), (2, "b"), (1, "B"), (2, "more"), (None, None), (None, "")])
    assert sorted((i, (t or "").lower()) for i, t in got if i is not None) == [(1, "a"), (1, "b"), (2, "more")]
    assert sorted((t or "").lower() for i, t in got if i is None) == ["", "same"]
    got = kept("near_duplicates", [(None, near), (None, close), (3, clean[0]), (3, bad[0]), (3, clean[0] + " more"), (3, bad[1])])
    assert len(got) == 4 and sum(i is None for i, _ in got) == 1 and {(3, bad[0]), (3, bad[1])} <= set(got)
