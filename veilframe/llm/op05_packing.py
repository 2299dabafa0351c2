"""Best-fit packing: best-two-fit over the length histogram.

Only a document's length matters to packing, and there are at most ``size`` different lengths.  So the
driver packs the histogram (at most ``size`` counts): it fills a bin greedily with the longest that still
fits, then replaces the bin's smallest document with two unpacked ones that fit the widened gap more
tightly, and uses the same bin content as often as the counts allow.  Executors then give every piece the
place that its rank among the pieces of its length stands for.  No list of documents reaches the driver.

Ranks: each task numbers its pieces by length, counts by (task, length) are summed up, and the two are
added; no length, however common, has to meet in one task.

Nulls: a null text is an empty document of one id (the end id).  Repeated rows are packed each.  An empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, read, written
from .tokens import default_path, encoded

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: how many in a bin})] that use up ``counts`` exactly; lengths are 1..size."""
    left = {l: n for l, n in counts.items() if n > 0}
    order, plan = sorted(left), []
    while order:
        used: Counter = Counter()

        def fits(most: int, used=used) -> int:
            """The longest unpacked length of at most ``most``; 0 if none."""
            at = bisect.bisect_right(order, most) - 1
            while at >= 0 and left[order[at]] <= used[order[at]]:
                at -= 1
            return order[at] if at >= 0 else 0

        gap = size
        while gap and (l := fits(gap)):
            many = min(gap // l, left[l] - used[l]) if used else 1
            used[l] += many
            gap -= l * many
        while gap and used:
            least = min(used)
            used[least] -= 1
            wide, best = gap + least, (least, 0, 0)
            for at in range(bisect.bisect_right(order, wide - 1) - 1, -1, -1):
                a = order[at]
                if 2 * a <= best[0]:
                    break
                if left[a] <= used[a]:
                    continue
                used[a] += 1
                b = fits(min(a, wide - a))
                used[a] -= 1
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == wide:
                        break
            if not best[1]:
                used[least] += 1
                break
            used += Counter([best[1], best[2]])
            gap = wide - best[0]
        used = +used
        times = min(left[l] // n for l, n in used.items())
        plan.append((times, dict(used)))
        for l, n in used.items():
            left[l] -= n * times
            if not left[l]:
                del left[l]
                order.pop(bisect.bisect_left(order, l))
    return plan


def slots(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Sorted by (length, first rank): the first sequence, how many of the length in it, and the first offset."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for times, used in plan:
        offset = 0
        for l, n in sorted(used.items(), reverse=True):
            rows.append((l, taken[l], sequence, n, offset))
            taken[l] += n * times
            offset += l * n
        sequence += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 44) + a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "many": a[:, 3], "offset": a[:, 4]}


def _cut(path: str, size: int, end_id: int):
    def run(batches):
        part, seen = TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, rows = batch.column(0), []
            for row, raw in encoded(batch.column(1), path):
                raw += end
                doc = ids[row].as_py()
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    n = min(size, len(raw) // 4 - at // 4)
                    rows.append((doc, k, at // 4, n, zlib.crc32(raw[at : at + 4 * n]), part, seen[n]))
                    seen[n] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _place(table):
    def run(batches):
        s = table.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(s["key"], (length << 44) + rank, "right") - 1
            nth = rank - s["rank"][at]
            sequence, offset = s["sequence"][at] + nth // s["many"][at], s["offset"][at] + nth % s["many"][at] * length
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def packed(df: DataFrame, size: int = 4096, end_id: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: where its ids lie in the document, and where in which sequence."""
    spark = df.sparkSession
    pieces = written(id_and_text(df, id_col, text_col).mapInArrow(_cut(tokenizer or default_path(), size, end_id), _PIECES), "pack-pieces")
    per = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    before = per.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", F.coalesce("base", F.lit(0)).alias("base"))
    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(_place(spark.sparkContext.broadcast(slots(pack_histogram(counts, size)))), _PLACED)


def op5_best_two_fit(spark, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
