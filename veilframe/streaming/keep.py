"""The last rows of each key over data that arrives: histories of conversations, logs of requests.

A key's state is its last rows alone.  It is written with the stream's checkpoint, so a query that starts again goes on
from it; a key that is silent for longer than ``expiry`` loses its state and begins anew.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType


def _merged(held: list[list], new: list[list], most: int) -> list[list]:
    """The last rows by their place (the first field); of rows with one place the one that came last stays."""
    by_place = {row[0]: row for row in [*held, *new]}
    return [by_place[k] for k in sorted(by_place)][-most:]


def last_rows(stream: DataFrame, key: str, place: str, columns: list[str], most: int, expiry_ms: int | None = None) -> DataFrame:
    """key, place, columns: whenever a key gets rows, all its last ``most`` rows by place.

    place: a number or a text; columns: numbers, texts or truth values.  Rows without a key or place are left out.
    expiry_ms: how long a silent key is remembered; None: for ever.
    """
    fields = [place, *columns]
    schema = StructType([stream.schema[key], *(stream.schema[c] for c in fields)])

    def keep(keys, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = json.loads(state.get[0]) if state.exists else []
        for pdf in frames:
            new = pdf[fields].astype(object).where(pdf[fields].notna(), None).values.tolist()
            rows = _merged(rows, [[x.item() if hasattr(x, "item") else x for x in r] for r in new], most)
        state.update((json.dumps(rows, ensure_ascii=False),))
        if expiry_ms is not None:
            state.setTimeoutDuration(expiry_ms)
        out = pd.DataFrame(rows, columns=fields)
        out.insert(0, key, keys[0])
        yield out

    timeout = GroupStateTimeout.NoTimeout if expiry_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    known = stream.where(F.col(key).isNotNull() & F.col(place).isNotNull()).select(key, *fields)
    return known.groupBy(key).applyInPandasWithState(keep, schema, "rows string", "update", timeout)


def stored(rows: DataFrame, out: str, checkpoint: str):
    """Runs through what has arrived, then stops; a batch that is run again replaces its own rows."""

    def one(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/{n:09d}")

    return rows.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(out: DataFrame, key: str) -> DataFrame:
    """What each key's last batch gave; out: the stored rows."""
    last = out.groupBy(key).agg(F.max("batch").alias("batch"))
    return out.join(last, [key, "batch"]).drop("batch")
