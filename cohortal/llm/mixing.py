"""Mixing sources to target weights by Sainte-Laguë apportionment."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortal.llm.text import n_words
from cohortal.session import broadcast_if_small, materialize


def water_fill(sizes: Sequence[float], weights: Sequence[float], total: float, most: float) -> np.ndarray:
    """Shares of ``total`` by weight, none above ``most`` times its size, the excess reshared."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    target, free, left = np.zeros(len(sizes)), weights > 0, float(total)
    while free.any():
        share = left * weights / weights[free].sum()
        over = free & (share > most * sizes)
        if not over.any():
            target[free] = share[free]
            break
        target[over] = most * sizes[over]
        left, free = left - target[over].sum(), free & ~over
    return target


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> np.ndarray:
    """Seats to the highest quotients votes / (2 s + 1); ties to the earlier party.

    A divisor found by bisection gives all seats but a few, a heap of quotients the rest, so
    that the work does not grow with the number of seats. ``caps`` bounds a party's seats.
    """
    votes = np.asarray(votes, float)
    caps = np.full(len(votes), np.inf) if caps is None else np.asarray(caps, float)
    seats = int(min(seats, caps[votes > 0].sum())) if (votes > 0).any() else 0
    given = np.zeros(len(votes))
    if seats <= 0:
        return given.astype(np.int64)
    of = lambda d: np.minimum(np.floor(votes / d + 0.5), caps)
    low, high = votes.max() / (2.0 * seats + 2), 4.0 * votes.max() + 1  # of(high) gives no seat
    while of(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if of(mid).sum() > seats:
            low = mid
        else:
            high = mid
        if high - low <= 1e-15 * high:
            break
    given = of(high * (1 + 1e-12))
    heap = [(-votes[i] / (2 * given[i] + 1), i) for i in range(len(votes)) if votes[i] > 0 and given[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(int(seats - given.sum())):
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given.astype(np.int64)


def cycled_weights(sizes: DataFrame, source: str, weights: Sequence[float]) -> DataFrame:
    """Weights in turn to the sources by code point, null last. One row per source."""
    order = W.orderBy(F.col(source).asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))


def mix(
    docs: DataFrame,
    size: Column,
    id: str = "doc_id",
    source: str = "source",
    weights: Sequence[float] | DataFrame = (5.0, 2.0, 1.0),
    max_repeats: int = 3,
    block: int = 16,
    docs_per_shard: int = 200,
    max_shards: int = 65_536,
    seed: int = 0,
    keep: tuple[str, ...] = (),
    salt: Column | None = None,
) -> DataFrame:
    """Choose equal-token blocks of every source so that the mix meets target weights.

    1. Each source's size is summed; ``weights`` (a sequence dealt out by source name, or a
       table of source and weight) share the corpus size, no source above ``max_repeats``
       times its size.
    2. Sainte-Laguë gives the blocks to sources by their targets, then each source's blocks
       to its shards by their sizes: integer quotas.
    3. In a shard, documents stand in an order seeded by a hash of the id and ``salt``. Blocks of ``block``
       tokens are cut from this line, which starts over at its end up to ``max_repeats`` times
       (the last block may be short), and a quota takes the first ones.

    One row per input row: ``doc_id``, the ``keep`` columns, ``source``, ``size``,
    ``source_size``, ``target``, ``taken`` (tokens, repeats counted) and ``copies`` (full
    passes, and one more where the last pass reaches the middle of the document).

    Shards number as the rows divided by ``docs_per_shard``, up to ``max_shards``, so a source
    with a third of all rows is spread over as many tasks as it needs; nothing but sums of sources and
    shards reaches one task: a row per source in the apportionment of step 2, a row per
    shard of one source in that of its blocks. Texts are not shuffled unless kept.

    Null sources are a source; null and repeated ids are allowed, and rows of one id spread over
    the shards if their salts differ: equal rows share their place in the order in either order. Documents without tokens take nothing. An empty table
    gives an empty result.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    rows = docs.select(F.col(id).alias("doc_id"), kept.alias("kept"), F.col(source).alias("source"), size.cast("long").alias("size"), (F.lit("") if salt is None else salt.cast("string")).alias("salt"))
    shards = min(max_shards, max(1, math.ceil(docs.count() / docs_per_shard)))
    token = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("salt")))
    rows = rows.withColumn("token", token).drop("salt")
    shard = F.pmod(F.conv(F.substring("token", 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")
    # A key that is never null keeps windows and joins on one partitioning.
    rows = rows.withColumn("shard", shard).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    cells = rows.groupBy("key", "shard").agg(F.first("source").alias("source"), F.sum("size").alias("cell_size"))
    cells = materialize(cells)
    sizes = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    if isinstance(weights, DataFrame):
        w = weights.select(F.col(source).alias("w_source"), F.col("weight").cast("double"))
        sizes = sizes.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source").na.fill({"weight": 0.0})
    else:
        sizes = cycled_weights(sizes, "source", list(weights))

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source"], na_position="last", kind="stable")
        total = float(pdf["source_size"].sum())
        pdf["target"] = water_fill(pdf["source_size"], pdf["weight"], total, max_repeats)
        caps = np.ceil(max_repeats * pdf["source_size"].to_numpy(float) / block)
        pdf["blocks"] = sainte_lague(pdf["target"], round(pdf["target"].sum() / block), caps)
        return pdf[["source", "source_size", "target", "blocks"]]

    kind = dict(rows.dtypes)["source"]
    # One row per source: some tens, and some MB for a hundred thousand.
    by_source = materialize(
        sizes.groupBy(F.lit(0).alias("all")).applyInPandas(
            quotas, f"source {kind}, source_size long, target double, blocks long"
        )
    )

    def per_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        caps = np.ceil(max_repeats * pdf["cell_size"].to_numpy(float) / block)
        pdf["quota"] = sainte_lague(pdf["cell_size"], int(pdf["blocks"].iloc[0]), caps)
        return pdf[["key", "shard", "cell_size", "source_size", "target", "quota"]]

    blocks = by_source.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"), "source_size", "target", "blocks")
    dealt = cells.drop("source").join(broadcast_if_small(blocks), "key").groupBy("key").applyInPandas(
        per_shard, "key string, shard int, cell_size long, source_size long, target double, quota long"
    )
    before = W.partitionBy("key", "shard").orderBy("token", "doc_id", "size")
    placed = rows.withColumn(
        "start", F.coalesce(F.sum("size").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    )
    placed = placed.join(dealt, ["key", "shard"], "left")
    whole = F.nullif(F.col("cell_size"), F.lit(0))
    tokens = F.least(F.col("quota") * F.lit(block), F.col("cell_size") * F.lit(max_repeats))
    passes = F.coalesce(F.floor(tokens / whole), F.lit(0)).cast("long")
    rest = F.coalesce(tokens - passes * whole, F.lit(0)).cast("long")
    part = F.greatest(F.least(F.col("start") + F.col("size"), rest) - F.col("start"), F.lit(0)).cast("long")
    more = ((F.col("size") > 0) & (F.col("start") + F.col("size") / 2 < rest)).cast("long")
    return placed.select(
        "doc_id",
        *[F.col("kept")[c].alias(c) for c in keep],
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * passes + part).cast("long").alias("taken"),
        (passes + more).cast("int").alias("copies"),
    )


def mix_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``mix`` with word counts as sizes and a hash of the text as salt."""
    return mix(docs, n_words(text), salt=F.xxhash64(text), **options)
