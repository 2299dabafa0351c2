"""Row positions.  Spark rows have no order; these give one from a key, without one task seeing all rows."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none and runs in one process."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not (now := sc._jsc.sc().getCheckpointDir()).isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veilframe-"))
        now = sc._jsc.sc().getCheckpointDir()
    return now.get().rstrip("/")


#: Folders made inside temporary(), in this thread.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def temporary(spark: SparkSession):
    """Tables that are written inside go at its end; results that read them have to be stored before."""
    token = _MADE.set([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _MADE.get():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _MADE.reset(token)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Lowers the session's rows per Arrow batch where it is higher: whole texts are large, and both sides hold a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


#: Rows of one task of a scan.  It holds them all while it deals them out to more than 200 others.
SPLIT_ROWS = 1_000_000


def small_splits(spark: SparkSession, rows: int) -> None:
    """Raises the session's least number of tasks of a scan where a table of so many rows needs more: short rows are many in a split of bytes."""
    key, n = "spark.sql.files.minPartitionNum", -(-rows // SPLIT_ROWS)
    if n > int(spark.conf.get(key, None) or spark.sparkContext.defaultParallelism):
        spark.conf.set(key, str(n))


def spread(df: DataFrame) -> DataFrame:
    """Short rows dealt out evenly before costly work on each: adaptive execution would join them into few partitions by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns)


#: Rows of one task where sorts and joins of a whole table by its positions are dealt out.
TASK_ROWS = 250_000


def _parts(df: DataFrame, rows: int) -> int:
    """Partitions for so many rows: TASK_ROWS in each, and no fewer than the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, rows: int, *keys) -> DataFrame:
    """``df``, of about so many rows, dealt by keys: TASK_ROWS a task, where adaptive execution would give each as many as fit its bytes."""
    return df.repartition(_parts(df, rows), *keys)


def _ranged(df: DataFrame, keys: list, rows: int = 0) -> DataFrame:
    """``df`` in partitions by ranges of the keys, with its partition and place in it, written down so that both stay.

    rows: how many it has, if that is known; a task then sorts TASK_ROWS.
    """
    n = _parts(df, rows)
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", at)
    return written(placed, "ranged").withColumns({"_part": F.shiftright("_at", 33), "_local": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")


def numbered(df: DataFrame, *keys, name: str = "_row", rows: int = 0) -> DataFrame:
    """Dense positions from 0 in the order of the keys: a range sort, and the sizes of the partitions before."""
    r = _ranged(df, list(keys), rows)
    sizes = r.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")  # a row a partition
    return r.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


#: Folds whose steps can be taken partition by partition: the aggregate, how two results join, and what nothing gives.
FOLDS = {"sum": (F.sum, lambda a, b: a + b, 0.0), "product": (F.product, lambda a, b: a * b, 1.0), "max": (F.max, F.greatest, None), "min": (F.min, F.least, None)}


def running(df: DataFrame, value, out: str, *keys, fold: str = "sum") -> DataFrame:
    """The running sum (or other fold) of ``value`` in the order of the keys: within partitions, joined with that of those before."""
    agg, join, none = FOLDS[fold]
    r = _ranged(df.withColumn("_v", value), list(keys))
    sums = r.groupBy("_part").agg(agg("_v").alias("_s"))
    above = agg("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    before = sums.withColumn("_before", above if none is None else F.coalesce(above, F.lit(none))).select("_part", "_before")
    w = Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
    return r.join(F.broadcast(before), "_part").withColumn(out, join(F.col("_before"), agg("_v").over(w))).drop("_part", "_local", "_before", "_v")


def asof(left: DataFrame, key: str, right: DataFrame, right_key: str, value: str, out: str, larger: bool = False, exact: bool = True) -> DataFrame:
    """Each left row with the value of the right row of the nearest key at or below (``larger``: above) its own.

    right: distinct keys.  Both sides are sorted together by ranges of the key; each partition carries its last
    right row on, and the partitions' own last rows (one each) are carried over their borders.
    """
    sign = -1 if larger else 1
    cols = left.columns
    side = F.lit(0) if exact else F.lit(2)
    a = left.select(*cols, (F.col(key) * sign).alias("_k"), side.alias("_side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(False).alias("_right"))
    b = right.select(*(F.lit(None).cast(t).alias(c) for c, t in left.dtypes), (F.col(right_key) * sign).alias("_k"), (F.lit(-1) if exact else F.lit(3)).alias("_side"), F.col(value).alias("_v"), F.lit(True).alias("_right"))
    r = _ranged(a.unionByName(b), ["_k", "_side"])
    got = F.when(F.col("_right"), F.struct("_v"))
    w = Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
    ends = r.where("_right").groupBy("_part").agg(F.max_by("_v", "_local").alias("_e"))
    parts = r.select("_part").distinct().join(ends.withColumn("_has", F.struct("_e")), "_part", "left")
    carried = parts.withColumn("_c", F.last("_has", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", "_c")  # a row a partition
    near = F.last(got, ignorenulls=True).over(w)
    found = r.withColumn("_near", near).join(F.broadcast(carried), "_part", "left").where(~F.col("_right") & F.col("_k").isNotNull())
    return found.withColumn(out, F.coalesce(F.col("_near._v"), F.col("_c._e"))).select(*cols, out)
