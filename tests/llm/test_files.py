"""Packing, token files, archives and decontamination."""

import hashlib
import io
import os
import random
import zipfile
import zlib

import numpy as np
import pytest
from fixtures import frame, rows, sentence
from pyspark.sql import functions as F

from veilframe.llm import op04_decontaminate, op05_packing, op06_zip_warc, op08_planes
from veilframe.llm.common import fresh_path, store
from veilframe.llm.tokens import Encoder, default_path


def ids_of(text):
    return Encoder(default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_tokenizer():
    e = Encoder(default_path())
    odd = ["Hello, World. It's <|endoftext|> x... ﬁne naïve\x0bvt 3.14, x,, don'T, WE'LL. ΣΑΣ. <|ENDOFTEXT|>, a<|startoftext|>.", "", " \n\t\r ", "\x1c a\x85b", "İI. I, i", "it's.", "'s, 've"]
    for _ in range(2):
        for t in odd + [x for _, x in rows() if x]:
            assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_level", "small_letters_only"])
def test_encoder_of_other_vocabularies(tmp_path, name):
    """A file that keeps white space or case isn't split at words or folded."""
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    vocab = {c: k for k, c in enumerate([*letters, "[UNK]"])}
    t = Tokenizer(models.BPE(vocab=vocab, merges=[], unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False) if name == "byte_level" else pre_tokenizers.Whitespace()
    if name != "byte_level":
        t.normalizer = normalizers.NFC()
    t.save(str(tmp_path / "t.json"))
    e = Encoder(str(tmp_path / "t.json"))
    assert not e.by_small_letters and e.by_parts is (name != "byte_level")
    for _ in range(2):
        for text in ("Two words, and two Words.", " a  b\n", "", "Words words"):
            assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


# ---------------------------------------------------------------- packing


def check_packing(got, data, size):
    seqs = {}
    by = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append(r)
        by.setdefault(r["doc_id"], []).append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    for i, t in data:
        ids = [*ids_of(t), 1]
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in own] == [(k, len(ids[k : k + size]), crc(ids[k : k + size])) for k in range(0, len(ids), size)]


def test_packing_rows_without_an_id(spark):
    data = [(None, "one two three"), (None, None), (None, "one two three"), (4, "x " * 90), (4, "")]
    got = op05_packing.packed(frame(spark, data), size=64).collect()
    want = sorted(((i, k // 64, k, len(ids[k : k + 64]), crc(ids[k : k + 64])) for i, t in data for ids in [[*ids_of(t), 1]] for k in range(0, len(ids), 64)), key=str)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_odd_rows(spark):
    data = [x for x in rows() if x[0] is not None]
    got = op05_packing.packed(frame(spark, data), size=64).collect()
    check_packing(got, data, 64)
    total = sum(len(ids_of(t)) + 1 for _, t in data)
    assert len({r["sequence_id"] for r in got}) <= -(-total // 64) + 1
    assert op05_packing.packed(frame(spark, [])).collect() == []


def test_packing_repeated_rows(spark):
    got = op05_packing.packed(frame(spark, [(1, "a b c")] * 5), size=64).collect()
    assert len(got) == 5 and len({(r["sequence_id"], r["offset"]) for r in got}) == 5


def test_histogram_is_used_up():
    r = random.Random(1)
    for size in (10, 100, 4096):
        counts = {r.randrange(1, size + 1): r.randrange(1, 40) for _ in range(60)}
        plan = op05_packing.pack_histogram(counts, size)
        used = {}
        for times, bin_ in plan:
            assert sum(l * n for l, n in bin_.items()) <= size
            for l, n in bin_.items():
                used[l] = used.get(l, 0) + n * times
        assert used == counts
        bins = sum(t for t, _ in plan)
        assert bins >= -(-sum(l * n for l, n in counts.items()) // size)


def test_two_replace_the_smallest():
    # greedy takes 6 + 3 (gap 1); 3 goes for 2 + 2, which fill the bin
    plan = op05_packing.pack_histogram({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0] == (1, {6: 1, 2: 2}) or plan[0][1].get(2) == 2


# ---------------------------------------------------------------- token files


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files_round_trip(spark, kind):
    folder = fresh_path(spark, "tokens")
    m = op08_planes.write_token_files(frame(spark), folder, kind=kind, block=97)
    got = op08_planes.read_token_files(spark, folder, m).collect()
    at = 0
    want = []
    for i, t in sorted(rows(), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*ids_of(t), 2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    folder = fresh_path(spark, "tokens")
    assert op08_planes.read_token_files(spark, folder, op08_planes.write_token_files(frame(spark, []), folder)).collect() == []


def test_planes_invert_and_ranges_read():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 64, 1000):
        ids = r.integers(0, 1 << 32, n).astype("<u4")
        for kind in ("byte", "bit"):
            assert np.array_equal(op08_planes.from_planes(op08_planes.to_planes(ids, kind), n), ids)
    out = io.BytesIO()
    w = op08_planes.Writer(out, "bit", 50)
    docs = [r.integers(0, 49000, n).astype("<u4") for n in (0, 10, 200, 3, 0, 49, 51)]
    for k, d in enumerate(docs):
        w.add(k, d.tobytes())
    w.close()

    class File:
        def size(self):
            return len(out.getvalue())

        def read_at(self, n, at):
            return out.getvalue()[at : at + n]

    got = list(op08_planes.Reader(File()).documents(2, 6))
    assert [g[0] for g in got] == [2, 3, 4, 5] and all(np.array_equal(g[2], d) for g, d in zip(got, docs[2:6], strict=True))


# ---------------------------------------------------------------- archives


def pages(spark, data):
    return spark.createDataFrame([(h, i, u, "x", 1) for i, u, h in data], "html string, page_id long, url string, digest string, target long")


PAGES = [(3, "http://a/\r\nx", "p" * 150), (1, None, "p" * 150), (2, "u", "p" * 99), (4, "u", "p" * 99), (5, "u", None), (6, "u", ""), (7, "u", "é" * 60), (8, "u", "é" * 60), (9, "u", "WARC/1.1\r\n\r\n" * 20), (None, "u", "p" * 150), (10, "u", "x" * 200_000)]


def expected(data):
    out = []
    for i, _, h in data:
        raw = (h or "").encode()
        same = [j for j, _, g in data if (g or "").encode() == raw and j is not None]
        first = min(same) if same else None
        revisit = len(raw) >= 100 and first is not None and first != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1, 10_000, 1 << 30])
def test_archives_round_trip(spark, most):
    folder = fresh_path(spark, "warc")
    names = op06_zip_warc.write_packages(pages(spark, PAGES), folder, package_bytes=most)
    got = op06_zip_warc.read_packages(spark, folder, names).drop("url").collect()
    assert sorted(map(tuple, got), key=str) == expected(PAGES)
    folder = fresh_path(spark, "warc")
    assert op06_zip_warc.read_packages(spark, folder, op06_zip_warc.write_packages(pages(spark, []), folder)).collect() == []


def test_directories_as_zipfile_reads_them(spark, tmp_path):
    folder = fresh_path(spark, "warc")
    names = op06_zip_warc.write_packages(pages(spark, PAGES), folder)
    fs, path = store(f"{folder}/{names[0]}")
    z = zipfile.ZipFile(path)
    assert z.testzip() is None and set(z.namelist()) == {op06_zip_warc.DATA, op06_zip_warc.INDEX}
    with fs.open_input_file(path) as f:
        p = op06_zip_warc.Package(f)
        for n in z.namelist():
            first, size = p.locate(n)
            assert f.read_at(size, first) == z.read(n)
    # many entries need the ZIP64 end record
    big = tmp_path / "big.zip"
    with zipfile.ZipFile(big, "w") as w:
        for k in range(66_000):
            w.writestr(f"f{k}", str(k))
    fs, path = store(str(big))
    with fs.open_input_file(path) as f:
        p = op06_zip_warc.Package(f)
        assert len(p.members) == 66_000 and p.range("f65999", 0, 5) == b"65999"
    os.remove(big)


@pytest.mark.parametrize("packed_index", [False, True])
def test_packages_with_several_archives_and_other_indexes(spark, tmp_path, packed_index):
    """Archives of other makers: CDXJ lines, an index of its own format, gzip members and plain records."""
    import gzip

    lines, want = ["!meta 1"], []
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        for archive in ("one.warc.gz", "two.warc"):
            body = b""
            for k in range(5):
                page = k + (10 if archive == "two.warc" else 0)
                raw = op06_zip_warc.record(page, f"http://x.org/{page}", (f"<p>{page}" * 60).encode(), None)
                raw = gzip.compress(raw) if archive.endswith("gz") else raw
                lines.append(f'org,x)/{page} 2020010100000{k} {{"url": "http://x.org/{page}", "filename": "{archive}", "offset": "{len(body)}", "length": "{len(raw)}"}}')
                want.append((page, f"http://x.org/{page}"))
                body += raw
            z.writestr(f"archive/{archive}", body)
        index = "\n".join(lines).encode()
        z.writestr("indexes/index.cdx.gz" if packed_index else "indexes/index.cdxj", gzip.compress(index) if packed_index else index)
        z.writestr("datapackage.json", "{}")
    for ahead in (100, 8 << 20):
        got = [(r["page_id"], r["url"]) for r in op06_zip_warc.read_packages(spark, str(tmp_path), ["a.zip"], ahead).collect()]
        assert sorted(got) == sorted(want)


# ---------------------------------------------------------------- decontamination


def test_contained_items(spark):
    r = random.Random(6)
    items = [(1, sentence(r, 30)), (2, sentence(r, 8)), (3, "short one"), (4, None), (5, ""), (6, sentence(r, 44))]
    w = items[5][1].split()
    w[20] = "changed"  # kills 5 of 40 shingles
    half = items[0][1].split()[:15]
    data = [
        (1, sentence(r, 3000) + " " + items[0][1].upper() + " " + sentence(r, 3000)), (2, " ".join(half) + " " + sentence(r, 50)), (3, sentence(r, 20) + "\n" + items[1][1].replace(" ", "\t ")),
        (4, "Short  ONE"), (5, "a short one here"), (6, " ".join(w)), (7, None), (8, ""), (9, items[0][1] + " " + items[1][1]), (9, items[0][1] + " " + items[1][1]),
    ]
    it = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, h string, q long")
    got = {(x["doc_id"], x["item_id"], x["matched"], x["item_shingles"]) for x in op04_decontaminate.contaminated(frame(spark, data), it).collect()}
    want = set()
    shingles = lambda t: (lambda v: {tuple(v[k : k + 5]) for k in range(max(1, len(v) - 4))} if v else set())((t or "").lower().split())
    for i, t in data:
        for j, u in items:
            q, both = shingles(u), shingles(u) & shingles(t)
            if q and 100 * len(both) >= 80 * len(q):
                want.add((i, j, len(both), len(q)))
    assert got == want and len(want) >= 5
    assert op04_decontaminate.contaminated(frame(spark, []), it).collect() == []
    assert op04_decontaminate.contaminated(frame(spark, data), it.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    it = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    plan = op04_decontaminate.contaminated(frame(spark), it)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_sketch_is_deep_enough(spark):
    """Whatever a containing document lacks, it meets the need of its partition, and most of the sketch."""
    sizes = (1, 2, 3, 5, 6, 9, 30, 31, 32, 63, 64, 104, 500)
    it = spark.createDataFrame([(n, " ".join(f"w{n}-{x}" for x in range(n + 4))) for n in sizes], "doc_id long, text string")
    got = op04_decontaminate.item_sketches(it).groupBy("item_id", "size_class", "spare", "need").agg(F.count("*").alias("depth")).collect()
    assert sorted(r["item_id"] for r in got) == sorted(sizes)
    for r in got:
        q = r["item_id"]
        assert 2 ** r["size_class"] <= q < 2 ** (r["size_class"] + 1) and r["spare"] >= q - -(-80 * q // 100)
        assert r["need"] == r["depth"] - r["spare"] and 2 * r["need"] > r["depth"] and r["depth"] <= q


def test_search_decides_what_is_verified(spark, monkeypatch):
    """Documents that hold too little of a sketch aren't found, and what isn't found isn't returned."""
    r = random.Random(21)
    item = sentence(r, 60)
    w = item.split()
    data = [(1, item), (2, sentence(r, 30) + " " + item), (3, " ".join(w[:20]) + " " + sentence(r, 40)), (4, sentence(r, 60)), (5, " ".join(w[:3]))]
    it = spark.createDataFrame([(1, item)], "item_id long, text string")
    sketches = op04_decontaminate.item_sketches(it.toDF("doc_id", "text"))
    found = op04_decontaminate.candidates(frame(spark, data).select("doc_id", "text"), sketches)
    assert sorted(x["doc_id"] for x in found.collect()) == [1, 2]
    search = op04_decontaminate.candidates
    monkeypatch.setattr(op04_decontaminate, "candidates", lambda *a: search(*a).where("doc_id <> 2"))
    assert [x["doc_id"] for x in op04_decontaminate.contaminated(frame(spark, data), it).collect()] == [1]


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_rows_are_judged_by_themselves(spark, monkeypatch, most):
    monkeypatch.setattr(op04_decontaminate, "BROADCAST_HASHES", most)
    r = random.Random(22)
    item, other = sentence(r, 50), sentence(r, 20)
    w = item.split()
    data = [(None, " ".join(w[:30])), (None, " ".join(w[20:])), (None, item + " end"), (7, " ".join(w[:30])), (7, " ".join(w[20:])), (8, item), (8, item), (8, " ".join(w[:45])), (9, other)]
    it = spark.createDataFrame([(1, item), (1, item), (None, other), (4, None), (5, " ")], "item_id long, text string")
    got = sorted(((x["doc_id"], x["item_id"], x["matched"], x["item_shingles"]) for x in op04_decontaminate.contaminated(frame(spark, data), it).collect()), key=str)
    assert got == sorted([(None, 1, 46, 46), (8, 1, 46, 46), (9, None, 16, 16)], key=str)


def test_a_word_is_encoded_once_for_its_forms():
    """Capitals, also of Latin-1, and stops add no words to encode; the ids are those of the whole texts."""
    from veilframe.llm import tokens

    e = tokens.Encoder(tokens.default_path())
    asked, plain = [], e._ids
    e._ids = lambda parts, *by: asked.extend(parts) or plain(parts, *by)
    texts = ["Éthovar éthovar, ÉTHOVAR. Éthovar.", "Zorblat, zorblat ZORBLAT. zorblat,\nZorblat.", "ΣΑΣ, zorblat. Zorblat", "a.. b., 'S. it's, 3.14. ., %%%. <|endoftext|>. <|ENDOFTEXT|>, Zorblat", "É́. ﬁ, ª. µ, ß. ², ÿ\xa0Ÿ\x85x. ", "", " . , "]
    got = [e.encode([x])[0] for x in texts[:2]]
    assert sorted(asked) == ["zorblat", "éthovar"]
    got += e.encode(texts[2:])
    assert got == plain(texts) and e.encode(texts) == got
    assert e.bare and e._of_words(["zorblat", "éthovar", "ǆ", "3.14", "Σ"]) == plain(["zorblat", "éthovar", "ǆ", "3.14", "Σ"])
