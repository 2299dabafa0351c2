"""Folds whose steps depend on each other: a state goes over the rows in order, and only the state is handed on.

Rows stand in groups of GROUP, and a job goes over STRIDE groups from the state that the job before it ended with;
it writes the state at the start of each group.  Steps are then taken again inside all groups at once, where each
step is to be kept.  No task holds more than a stride, and the driver holds one state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import fresh_path

#: Rows of a group, and groups that one job goes over.
GROUP, STRIDE = 1_000, 500


def _steps(items: Column, start: Column, step) -> Column:
    """The state after each item, as an array."""
    all_ = F.aggregate(items, F.array(start), lambda a, v: F.concat(a, F.array(step(F.element_at(a, -1), v))))
    return F.slice(all_, 2, F.greatest(F.size(all_) - 1, F.lit(0)))


def passed(placed: DataFrame, value: Column, init: Column, step, keep: bool) -> DataFrame:
    """The last state (column x), or with ``keep`` the state after each row (_row, x); placed: rows with _row, dense from 0.

    step(state, value) -> state, as columns of one type.
    """
    spark = placed.sparkSession
    root = fresh_path(spark, "fold")
    own = placed.select("_row", value.alias("v")).withColumn("_group", F.floor(F.col("_row") / GROUP))
    groups = own.groupBy("_group").agg(F.array_sort(F.collect_list(F.struct("_row", "v"))).alias("items"))  # at most GROUP
    groups = groups.select("_group", F.transform("items", lambda s: s["v"]).alias("items"), F.floor(F.col("_group") / STRIDE).alias("_stride"))
    groups.write.partitionBy("_stride").parquet(f"{root}/groups")
    groups = spark.read.parquet(f"{root}/groups")
    kind = spark.range(1).select(init.alias("x")).schema["x"].dataType
    (state,) = spark.range(1).select(init).first()
    most = groups.agg(F.max("_stride")).first()[0]
    for stride in range(0 if most is None else most + 1):
        here = groups.where(F.col("_stride") == stride).agg(F.array_sort(F.collect_list(F.struct("_group", "items"))).alias("g"))
        start = F.lit(state).cast(kind)
        ends = F.aggregate("g", F.array(start), lambda a, g: F.concat(a, F.array(F.aggregate(g["items"], F.element_at(a, -1), step))))
        rows = here.select(F.posexplode(ends).alias("_k", "start")).select((F.col("_k") + stride * STRIDE).cast("long").alias("_group"), "start")
        rows.write.parquet(f"{root}/starts/_stride={stride}")
        (state,) = spark.read.parquet(f"{root}/starts/_stride={stride}").agg(F.max_by("start", "_group")).first()
    if not keep:
        return spark.range(1).select(F.lit(state).cast(kind).alias("x"))
    if most is None:
        return spark.range(0).select(F.col("id").alias("_row"), F.lit(None).cast(kind).alias("x"))
    # a stride's last state is the next one's first
    starts = spark.read.parquet(f"{root}/starts").where(F.col("_group") < (F.col("_stride") + 1) * STRIDE).select("_group", "start")
    steps = groups.join(starts, "_group").select("_group", F.posexplode(_steps(F.col("items"), F.col("start"), step)).alias("_k", "x"))
    return steps.select((F.col("_group") * GROUP + F.col("_k")).alias("_row"), "x")
