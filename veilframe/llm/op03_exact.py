"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, an external sort inside each partition places
equals side by side, and full comparisons of neighbours find the runs of equal texts.

The splitters compare the first bytes of a text, then a hash of the whole, then the id: equal texts are
neighbours in that order, yet a text that fills a third of the rows is cut over as many partitions as it
needs.  Only the runs at partition edges (two for each partition) are joined up afterwards, by digest.

Nulls: a null text counts as empty; a null id sorts before all others.  Repeated rows are members of
their group like any others and return a row each.  Other columns are not read.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, id_and_text, partitions, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a text that the splitters hold; the sort itself compares whole texts.
SPLITTER_CHARS = 32

_ROWS = "doc_id long, text_sha256 string, n long, lo long, hi long, edge boolean"


def _neighbours(batches):
    """Rows of a sorted partition -> each row with its run's count, least and greatest id, and whether the run touches an edge."""
    last, ids, first, held = None, [], True, 0

    def flush(edge):
        digest = hashlib.sha256(last).hexdigest()
        known = [i for i in ids if i is not None]
        n, lo, hi = len(ids), min(known, default=None), max(known, default=None)
        for at in range(0, n, 65536):
            some = ids[at : at + 65536]
            k = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([digest] * k), pa.array([n] * k, pa.int64()), pa.array([lo] * k, pa.int64()), pa.array([hi] * k, pa.int64()), pa.array([edge] * k)], names=["doc_id", "text_sha256", "n", "lo", "hi", "edge"])

    pending = []
    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1)):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if raw != last:
                if last is not None:
                    pending += flush(first)
                    held += len(ids)
                    first = False
                last, ids = raw, []
            ids.append(i)
            if held >= 16384:
                yield pa.Table.from_batches(pending).combine_chunks().to_batches()[0]
                pending, held = [], 0
    if last is not None:
        pending += flush(True)
    if pending:
        yield from pa.Table.from_batches(pending).combine_chunks().to_batches()


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the text with A-Z lower-cased).

    keep: which id of equal texts stays, "smallest" or "largest".  If the kept id is on several rows, all are marked kept.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(keep)
    spark = df.sparkSession
    t = id_and_text(df, id_col, text_col).select("doc_id", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).cast("binary").alias("norm"))
    t = t.withColumns({"head": F.substring("norm", 1, SPLITTER_CHARS), "whole": F.xxhash64("norm")})
    ordered = t.repartitionByRange(partitions(spark), "head", "whole", "doc_id").sortWithinPartitions("head", "whole", "norm", "doc_id")
    found = held(ordered.select("doc_id", "norm").mapInArrow(_neighbours, _ROWS))
    edges = found.where("edge").groupBy("text_sha256").agg(F.count("*").alias("all_n"), F.min("lo").alias("all_lo"), F.max("hi").alias("all_hi"))
    # at most two runs of a partition touch its edges: so many digests, whatever the number of rows
    joined = found.join(F.broadcast(edges) if partitions(spark) <= 100_000 else edges, "text_sha256", "left")
    which = F.coalesce("all_lo", "lo") if keep == "smallest" else F.coalesce("all_hi", "hi")
    return joined.select("doc_id", which.alias("keep_id"), F.coalesce("all_n", "n").alias("group_size"), F.col("doc_id").eqNullSafe(which).alias("kept"), "text_sha256")


def op3_content_sort(spark, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"), keep="largest")


ORACLE = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
