"""Heads on feature arrays: out-of-fold predictions of ridge and tree models, and manifests of versions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.operators.classify import mean_vectors


def standardised(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Columns less their mean over their population deviation, both of the training rows (0 for a constant)."""
    base = train if train is not None else df
    stats = base.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    z = {c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(z).select(*df.columns)  # one row of statistics


def ridge_out_of_fold(df: DataFrame, features: Sequence[str], target: str, fold: str, alpha: float = 1.0) -> DataFrame:
    """Each row's prediction by a ridge regression of the other folds; features are standardised within the fold's training rows."""
    parts = []
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        vec = lambda d, t=train: standardised(d, features, t).withColumn("_x", array_to_vector(F.array(*features)))
        n, spread = train.agg(F.count("*"), F.stddev_pop(target)).first()
        # The solver divides the penalty by the target's deviation; times it, it acts on the plain target.
        penalty = alpha / n * (spread or 1.0)
        model = LinearRegression(featuresCol="_x", labelCol=target, predictionCol="prediction", regParam=penalty, elasticNetParam=0.0, standardization=False, solver="normal")
        parts.append(model.fit(vec(train)).transform(vec(test)).select(*df.columns, "prediction"))
    return reduce(DataFrame.unionByName, parts)


def r_squared(df: DataFrame, target: str, prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """1 - SSE / SST; null for a constant target."""
    e = F.col(target) - F.col(prediction)
    return df.groupBy(*by).agg((1 - F.sum(e * e) / F.nullif(F.var_pop(target) * F.count("*"), F.lit(0.0))).alias("r2"))


def tree_head_out_of_fold(
    df: DataFrame, views: Sequence[str], label: str, fold: str, n_classes: int = 3, trees: int = 50, depth: int = 8, seed: int = 42
) -> DataFrame:
    """Class probabilities of each row by forests of the other folds, one per view (an array column), averaged.

    A forest stands for the boosted heads of the reference, whose library is not at hand: the plan
    (views, folds, mean) is the same, the numbers are not. Adds ``proba``.
    """
    parts = []
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        out = df.where(F.col(fold) == k)
        for i, v in enumerate(views):
            train = df.where(F.col(fold) != k).select(F.col(label).cast("double").alias("_y"), array_to_vector(v).alias("_x"))
            model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_k")
            scored = model.fit(train).transform(out.withColumn("_x", array_to_vector(v)))
            p = vector_to_array("_p")
            # A class that no training row has gets 0.
            full = F.array(*[F.coalesce(F.get(p, F.lit(c)), F.lit(0.0)) for c in range(n_classes)])
            out = scored.withColumn(f"_v{i}", full).drop("_x", "_p", "_r", "_k")
        proba = reduce(lambda a, b: mean_vectors(a, b), [F.col(f"_v{i}") for i in range(len(views))])
        parts.append(out.withColumn("proba", proba).select(*df.columns, "proba"))
    return reduce(DataFrame.unionByName, parts)


def nested_folds(df: DataFrame, fold: str, label: str, inner: str, most: int = 5) -> DataFrame:
    """Per outer fold the number of inner folds that its training rows allow: ``fold, n_splits`` (1: fit on the training rows).

    No more than the smallest class of the training rows has members.
    """
    n = df.groupBy(fold, label).agg(F.count("*").alias("n"))
    total = n.groupBy(label).agg(F.sum("n").alias("all"))
    folds = n.select(fold).distinct()
    left = folds.crossJoin(F.broadcast(total)).join(n, [fold, label], "left")  # folds times classes
    least = F.min(F.col("all") - F.coalesce("n", F.lit(0)))
    return left.groupBy(fold).agg(F.least(F.lit(most), least).alias("n")).select(fold, F.when(F.col("n") < 2, 1).otherwise(F.col("n")).cast("int").alias(inner))


def refreshed_manifest(old: Mapping, digests: Mapping[str, str], bundle_id: str, created: str) -> dict:
    """A manifest with new component digests; changed bytes need a new id and an ISO date."""
    dt.date.fromisoformat(created)
    parts = [{**c, "sha256": digests.get(c["name"], c["sha256"])} for c in old["components"]]
    unknown = set(digests) - {c["name"] for c in old["components"]}
    if unknown:
        raise ValueError(f"unknown components: {', '.join(sorted(unknown))}")
    if parts != list(old["components"]) and bundle_id == old["bundle_id"]:
        raise ValueError("component bytes changed: a new bundle id is needed")
    return {**old, "components": parts, "bundle_id": bundle_id, "created": created}
