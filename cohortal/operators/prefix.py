"""Running totals in a global order, without ordering all rows in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortal.session import broadcast_if_small, materialize, shuffle_partitions


def running_totals(
    df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Add a running total (this row included) per entry of ``sums``, along ``order`` in each ``by`` group.

    Rows are dealt out by range of (``by``, ``order``). A task sums its own part; the totals of the
    parts before it, one row per group and part, are added. ``order`` has to tell the rows of
    a group apart, and ``by`` must not be null.
    """
    keys = [F.col(c) for c in by]
    dealt = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys, *order)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(*by, "_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    own = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.join(broadcast_if_small(materialize(offsets)), [*by, "_part"])
    return placed.select(*df.columns, *[(F.sum(c).over(own) + F.col(f"_{k}")).alias(k) for k, c in sums.items()])


def running_least(df: DataFrame, order: Sequence[Column], value: str, by: Sequence[str] = ()) -> DataFrame:
    """``value`` replaced by the least up to this row along ``order`` in each ``by`` group, by parts like ``running_totals``."""
    keys = [F.col(c) for c in by]
    dealt = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys, *order)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "_part").agg(F.min(value).alias("_least"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = materialize(parts.select(*by, "_part", F.min("_least").over(before).alias("_least")))
    own = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.join(broadcast_if_small(offsets), [*by, "_part"])
    least = F.least(F.min(value).over(own), F.col("_least"))  # null, before the first part, is left out
    return placed.select(*[least.alias(c) if c == value else F.col(c) for c in df.columns])


def numbered(df: DataFrame, order: Sequence[Column], name: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """Row numbers from 1 in a global order."""
    return running_totals(df, order, {name: F.lit(1).cast("long")}, by)
