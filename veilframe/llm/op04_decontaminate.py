"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame operations only.

An item is its distinct word shingles (q of them).  A document contains it when it has at least ``percent``
of those, however long it is.

1. Sketches.  Items are partitioned by size (powers of two).  A partition has one spare, the number of
   shingles that a document may lack of its largest items, and one sketch depth, twice that and one: a sketch
   is an item's so many smallest shingle hashes (bottom-k MinHash).
2. Search.  The documents' shingle hashes are joined with the sketches of those partitions whose smallest
   items fit the document's own number of shingles.  A document that contains an item lacks at most the
   partition's spare of its sketch, that is less than half of it; what meets fewer goes no further.
3. Verification.  Only the pairs that the search found are read again: their distinct shingles are compared
   as texts.

Sketches and found pairs are broadcast when there are at most ``BROADCAST_HASHES`` of them, and otherwise
joined by a shuffle.

Nulls: a null text or one without words has no shingle; such an item is in no document.  Fewer than five
words make one shingle, which only an equally short text holds.  Each row is judged by itself: rows that
share an id (or have none) don't add up, and a pair of ids is returned once, with its best row.  Of repeated
items with one id the same holds.  Empty tables give an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, id_and_text, read, written

#: Sketch hashes of 20 bytes each, or pairs: at most about 40 MB go to every executor.
BROADCAST_HASHES = 2_000_000


def _words() -> Column:
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(plain, r"[\x20\x09-\x0D]+"), "")


def _each_shingle(of, size: int) -> Column:
    """An array of one: ``of`` applied to the array of words of every shingle of a row (with repeats).

    The words are bound once, as a lambda's variable, and the result comes out by explode: else the optimiser would split the
    text anew for every shingle, and make the shingles anew for every use of them.
    """
    every = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: of(F.slice(w, i, size)))
    return F.transform(F.array(_words()), every)


def _worded(df: DataFrame) -> DataFrame:
    return df.where("text is not null and text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")


def hashed(df: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, row (the text's own number), h: the hashes of all shingles of a row, in an array; rows without a word are left out."""
    return _worded(df).select("doc_id", F.xxhash64("text").alias("row"), F.explode(_each_shingle(F.xxhash64, size)).alias("h"))


def item_sketches(items: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """item_id, row, h, size_class, spare, need: the sketch hashes of every item, and how many of them a document that contains it has at least."""
    a = hashed(items, size).select(F.col("doc_id").alias("item_id"), "row", F.array_sort(F.array_distinct("h")).alias("h"))
    q = F.size("h")
    size_class = F.floor(F.log2(q.cast("double"))).cast("int")
    largest = F.pow(F.lit(2), F.col("size_class") + 1).cast("int") - 1
    spare = (largest - F.floor((largest * percent + 99) / 100)).cast("int")
    depth = F.least(q, 2 * F.col("spare") + 1)
    a = a.withColumn("size_class", size_class).withColumn("spare", spare)
    return a.select("item_id", "row", "size_class", "spare", (depth - F.col("spare")).alias("need"), F.explode(F.slice("h", 1, depth)).alias("h"))


def candidates(docs: DataFrame, sketches: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """doc_id, row, item_id, item_row: pairs of which the document meets enough of the item's sketch. docs: doc_id, text."""
    near = F.broadcast if sketches.count() <= BROADCAST_HASHES else lambda x: x
    rows = hashed(docs, size)
    own = rows.select("doc_id", "row", F.size("h").alias("n"), F.explode("h").alias("h"))
    known = sketches.select("h", "item_id", F.col("row").alias("item_row"), "size_class", "need")
    fits = F.pow(F.lit(2), "size_class") * percent <= F.col("n") * 100
    met = own.join(near(known), "h").where(fits).select("doc_id", "row", "item_id", "item_row", "need", "h").distinct()
    return met.groupBy("doc_id", "row", "item_id", "item_row").agg(F.count("*").alias("met"), F.first("need").alias("need")).where("met >= need").drop("met", "need")


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, matched, item_shingles, containment: every document with every item that it contains."""
    docs, items = id_and_text(docs, id_col, text_col), id_and_text(items, item_col, item_text_col)
    found = written(candidates(docs, held(item_sketches(items, percent, size)), percent, size), "candidates")
    near = F.broadcast if found.count() <= BROADCAST_HASHES else lambda x: x
    # the search decides which rows are read again, and with which items they are compared
    texts = F.explode(F.transform(_each_shingle(lambda w: F.array_join(w, " "), size), F.array_distinct))
    wanted = found.select(F.col("doc_id").alias("doc"), F.col("row").alias("doc_row")).distinct()
    mine = _worded(docs).withColumn("row", F.xxhash64("text")).join(near(wanted), F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("row") == F.col("doc_row")), "left_semi")
    mine = mine.dropDuplicates(["doc_id", "row"]).join(near(found.withColumnsRenamed({"doc_id": "doc", "row": "doc_row"})), F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("row") == F.col("doc_row")))
    mine = mine.select("doc_id", "item_id", "item_row", texts.alias("doc_shingles"))
    theirs = _worded(items).select(F.col("doc_id").alias("item"), F.xxhash64("text").alias("of_row"), texts.alias("item_shingles")).dropDuplicates(["item", "of_row"])
    both = mine.join(theirs, F.col("item_id").eqNullSafe(F.col("item")) & (F.col("item_row") == F.col("of_row")))
    counted = both.select("doc_id", "item_id", F.size(F.array_intersect("item_shingles", "doc_shingles")).cast("long").alias("matched"), F.size("item_shingles").cast("long").alias("q"))
    exact = counted.where(F.col("matched") * 100 >= F.col("q") * percent).groupBy("doc_id", "item_id").agg(F.max_by(F.struct("matched", "q"), F.col("matched") / F.col("q")).alias("best"))
    return exact.select("doc_id", "item_id", "best.matched", F.col("best.q").alias("item_shingles"), (F.col("best.matched") / F.col("best.q")).alias("containment"))


def op4_minhash_containment(spark, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t WHERE text IS NOT NULL),
s AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM w WHERE len(w) > 0),
q AS (SELECT id, count(*) AS q FROM s WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS matched, q.q AS item_shingles, count(*) / q.q AS containment
FROM s d JOIN s i ON d.kind = 0 AND i.kind = 1 AND d.s = i.s JOIN q ON q.id = i.id
GROUP BY d.id, i.id, q.q HAVING 100 * count(*) >= 80 * q.q
"""
