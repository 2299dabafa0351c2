"""An extension: leak scans and counts over data that arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import leakscan


def arriving(spark: SparkSession, path: str, schema, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scan_arrivals(stream: DataFrame, values: DataFrame, out: str, checkpoint: str, key: str, text: str):
    """Scans each batch of new documents and appends its hits; runs through what is there, then stops."""

    forms = leakscan.stored(values)  # once, for all batches

    def one(batch: DataFrame, n: int) -> None:
        # a batch that is run again after a failure replaces its own rows
        leakscan.leaks_of(batch, forms, key, text).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and kind; state older than the watermark goes."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
