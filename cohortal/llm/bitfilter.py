"""A filter of bounded size that spares rows without a partner a shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sixteen bits a key, between 2 MB and 32 MB; more keys only let more rows through.
LEAST_BITS, MOST_BITS, BITS_PER_KEY = 1 << 24, 1 << 28, 16
BUCKET_BITS = 8 * 4096


def bit_array(slots: DataFrame, bits: int) -> np.ndarray:
    """Bits of the numbers in the column ``slot`` (0 to bits - 1) as bytes.

    At most ``bits / BUCKET_BITS`` rows of 4 KB come to the driver.
    """
    buckets = slots.groupBy(F.floor(F.col("slot") / BUCKET_BITS).alias("bucket"))
    found = buckets.agg(F.bitmap_construct_agg(F.col("slot") % BUCKET_BITS).alias("bits")).collect()
    out = np.zeros(max(bits, BUCKET_BITS) // 8, np.uint8)
    for r in found:
        at = r.bucket * (BUCKET_BITS // 8)
        own = np.frombuffer(bytes(r.bits), np.uint8)[: len(out) - at]
        out[at : at + len(own)] = own
    return out


def has_bit(bits: np.ndarray, slot: int | np.ndarray) -> bool | np.ndarray:
    return (bits[slot >> 3] >> (slot & 7)) & 1 == 1


def bit_filter(keys: DataFrame, column: str) -> Callable[[str | Column], Column]:
    """A predicate that is true for every value in ``keys[column]``, and for few others.

    A join has to follow: the filter only leaves out rows. ``keys`` is counted first.
    """
    size = LEAST_BITS
    n = keys.count()
    while size < min(MOST_BITS, BITS_PER_KEY * n):
        size *= 2

    def slot(value: str | Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(size))

    bits = bit_array(keys.select(slot(column).alias("slot")), size)

    @F.pandas_udf("boolean")
    def maybe(slots: pd.Series) -> pd.Series:
        return pd.Series(has_bit(bits, slots.to_numpy(np.int64)), dtype=bool)

    return lambda value: maybe(slot(value))


def marked(rows: DataFrame, column: str, keys: DataFrame, key: str, name: str = "maybe") -> DataFrame:
    """``rows`` with ``name``: true for every value of ``column`` in ``keys[key]``, and for few others.

    The same filter as a broadcast table of at most 8,192 rows of 4 KB, made and read without Python, so that
    a stage that needs Python for something else has one worker a task and not two. ``keys`` is counted first.
    """
    size = LEAST_BITS
    n = keys.count()
    while size < min(MOST_BITS, BITS_PER_KEY * n):
        size *= 2
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    slots = keys.select(slot(key).alias("_slot"))
    bits = slots.groupBy(F.floor(F.col("_slot") / BUCKET_BITS).alias("_bucket")).agg(F.bitmap_construct_agg(F.col("_slot") % BUCKET_BITS).alias("_bits"))
    own = rows.withColumn("_at", slot(column)).withColumn("_bucket", F.floor(F.col("_at") / BUCKET_BITS))
    own = own.join(F.broadcast(bits), "_bucket", "left")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast((_at % {BUCKET_BITS}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1, F.lit(False))
    return own.withColumn("_byte", byte).withColumn(name, hit).select(*rows.columns, name)
