"""Streams of the record store's events: an addition, batch reports stay the reference.

The batch queries poll for "recent" rows; here the same rows arrive as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 16) -> DataFrame:
    """New parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and sums per window and kind; rows later than the watermark are left out of closed windows."""
    t = F.col(time).cast("timestamp")
    return (
        events.withColumn("_t", t)
        .withWatermark("_t", late)
        .groupBy(F.window("_t", window).alias("w"), kind)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n", "total")
    )


def once(events: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """Each key's first event within the watermark."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")


def latest_values(events: DataFrame, key: str, order: str, value: str, kind: str = "bigint") -> DataFrame:
    """The newest value per key, updated as events arrive: ``key, at, value``, state of two fields per key."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, v = state.get if state.exists else (None, None)
        for b in batches:
            b = b.dropna(subset=[order])
            if len(b):
                top = b.loc[b[order].idxmax()]
                if at is None or int(top[order]) > at:
                    at, v = int(top[order]), float(top[value])
        if at is not None:
            state.update((at, v))
            yield pd.DataFrame({key: [k[0]], "at": [at], "value": [v]})

    rows = events.select(F.col(key), F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, at long, value double", "at long, value double", "update", GroupStateTimeout.NoTimeout)
