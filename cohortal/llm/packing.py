"""Packing sequences into optimal length buckets and token-budget batches."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortal.llm.text import n_words
from cohortal.session import broadcast_if_small, materialize


def optimal_buckets(histogram: Mapping[int, int], n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets that minimise padded tokens in all.

    ``best[k][j]`` is the least padded total of the lengths up to the j-th distinct one in k
    buckets; the last of them spans lengths i+1..j, all padded to the j-th. Padding is that
    total less the tokens, which are the same for every choice. Of equal totals the one with
    the fewest buckets wins, then the lowest bounds.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0 and k > 0), np.int64)
    if not len(lengths):
        return []
    counts = np.concatenate([[0], np.cumsum([histogram[int(x)] for x in lengths])]).astype(np.float64)
    m = len(lengths)
    best = np.full(m + 1, np.inf)
    best[0] = 0
    cut: list[np.ndarray] = []
    for _ in range(min(n_buckets, m)):
        now, at = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        now[0] = 0
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (counts[j] - counts[:j])
            at[j] = int(cost.argmin())
            now[j] = cost[at[j]]
        cut.append(at)
        if now[m] >= best[m]:
            cut.pop()
            break
        best = now
    bounds, j = [], m
    for at in reversed(cut):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(at[j])
    return bounds[::-1]


def pack(
    docs: DataFrame,
    length: Column,
    id: str = "doc_id",
    max_length: int = 2048,
    n_buckets: int = 8,
    budget: int = 65_536,
    rows_per_shard: int = 2_000,
    seed: int = 0,
    salt: Column | None = None,
) -> DataFrame:
    """Cut documents into sequences, bucket these by length and fill batches of each bucket.

    A document longer than ``max_length`` tokens becomes sequences of ``max_length`` and a rest;
    nothing is cut off. The global histogram of sequence lengths (at most ``max_length`` rows)
    decides the bucket bounds by dynamic programming. A batch of a bucket has
    ``budget // bound`` sequences (at least one), so that padded it stays within the budget.

    One row per sequence: ``doc_id, piece, start, n_tokens, bucket`` (its upper bound),
    ``batch`` (number of the batch in its bucket) and ``slot`` (place in the batch). A document
    without tokens has one row of no tokens with bucket 0 and null batch and slot.

    Places in a bucket come from places in its shards plus the sizes of the shards before, so
    no bucket is ordered by one task; shards number as the rows divided by
    ``rows_per_shard``, and their order is random in the seed, the id and ``salt``, so that rows
    of one id spread if their salts differ. Only ids, lengths and salts are shuffled. Null and
    repeated ids are kept, equal rows in either order. An empty table
    gives an empty result.
    """
    n = F.coalesce(length, F.lit(0)).cast("long")
    rows = docs.select(F.col(id).alias("doc_id"), n.alias("n"), (F.lit(0).cast("long") if salt is None else salt).alias("salt"))
    last = F.greatest(F.ceil(F.col("n") / F.lit(float(max_length))).cast("int") - 1, F.lit(0))
    pieces = rows.select("doc_id", "n", "salt", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * max_length
    pieces = pieces.select(
        "doc_id", "piece", "salt", start.alias("start"), F.least(F.col("n") - start, F.lit(max_length)).alias("n_tokens")
    )
    pieces = materialize(pieces)
    counts = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}
    bounds = optimal_buckets(counts, n_buckets)
    shards = max(1, -(-sum(counts.values()) // rows_per_shard))
    bucket = F.lit(0)
    for bound in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound)).otherwise(bucket)
    pieces = pieces.withColumn("bucket", F.when(F.col("n_tokens") > 0, bucket).otherwise(F.lit(0)))
    token = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "piece", "salt")
    pieces = pieces.withColumn("token", token).withColumn("shard", F.pmod("token", F.lit(shards)).cast("int"))
    per_shard = pieces.groupBy("bucket", "shard").agg(F.count("*").alias("rows"))
    # Rows: buckets times shards, a row for some hundred sequences; ordered by bucket.
    earlier = W.partitionBy("bucket").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = materialize(per_shard.withColumn("offset", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows"))
    own = W.partitionBy("bucket", "shard").orderBy("token", "doc_id", "piece", "n_tokens")
    placed = pieces.withColumn("rank", F.row_number().over(own) - 1).join(
        broadcast_if_small(offsets), ["bucket", "shard"]
    )
    place = F.col("offset") + F.col("rank")
    capacity = F.greatest(F.lit(budget).cast("long") / F.nullif(F.col("bucket"), F.lit(0)), F.lit(1)).cast("long")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "n_tokens",
        F.col("bucket").cast("long").alias("bucket"),
        F.when(F.col("bucket") > 0, F.floor(place / capacity)).cast("long").alias("batch"),
        F.when(F.col("bucket") > 0, F.pmod(place, capacity)).cast("long").alias("slot"),
    )


def pack_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``pack`` with word counts as lengths and a hash of the text as salt (null and empty texts: no tokens)."""
    return pack(docs, n_words(text), salt=F.xxhash64(text), **options)
