"""Models over folds, and windows over events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.operators import boosting as B
from cohortal.operators import models as L
from cohortal.plans import views as V
from cohortal.plans.registry import query
from cohortal.plans.views import predictions, rounded
from cohortal.session import table
from cohortal.streaming.recent import windowed_counts


@query()
def probing_r2(spark, sf_dir):
    """Out-of-fold R2 of a ridge regression of each target on two scores; held by tests against the closed form."""
    p = predictions(spark, sf_dir)
    parts = [L.r_squared(L.ridge_out_of_fold(p, ["p_nevus", "s_b"], t, "fold"), t).select(F.lit(t).alias("target"), "r2") for t in ("p_mel", "coverage")]
    return rounded(reduce(DataFrame.unionByName, parts))


def two_views(spark, sf_dir) -> DataFrame:
    """Two feature arrays per row, a class of three and a fold of two."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice("embedding", 1, 16).cast("array<double>").alias("a"), F.slice("embedding", 17, 16).cast("array<double>").alias("b"),
        (F.col("label") % 3).cast("int").alias("y"), F.pmod("vec_id", F.lit(2)).cast("int").alias("fold"),
    )


def accuracy_by_fold(out: DataFrame) -> DataFrame:
    hit = F.array_position("proba", F.array_max("proba")) - 1 == F.col("y")
    return rounded(out.groupBy("fold").agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy")))


@query()
def tree_head_accuracy(spark, sf_dir):
    """Accuracy of two-view forests per held-out fold; held by tests."""
    return accuracy_by_fold(L.tree_head_out_of_fold(two_views(spark, sf_dir), ["a", "b"], "y", "fold", trees=20, depth=5))


@query()
def boosted_head_accuracy(spark, sf_dir):
    """Accuracy of two-view boosted trees per held-out fold; held by tests."""
    return accuracy_by_fold(B.boosted_heads(two_views(spark, sf_dir), ["a", "b"], "y", "fold", rounds=5, depth=2))


@query()
def boosted_binary_accuracy(spark, sf_dir):
    """Boosted trees that tell class 1 from 0: class 2 is left out of the fit and of the count; held by tests."""
    return accuracy_by_fold(B.boosted_heads(two_views(spark, sf_dir), ["a"], "y", "fold", exclude=[2], rounds=5, depth=2).where("y < 2"))


@query()
def boosted_probing_r2(spark, sf_dir):
    """Out-of-fold R2 of boosted trees on two scores, where ``probing_r2`` has a line; held by tests."""
    p = predictions(spark, sf_dir).select("fold", "p_mel", F.array("p_nevus", "s_b").alias("x"))
    return rounded(L.r_squared(B.boosted_regression(p, "x", "p_mel", "fold", rounds=6, depth=3), "p_mel").select(F.lit("p_mel").alias("target"), "r2"))


@query(
    """, n AS (SELECT f.fold, c.truth, count(*) FILTER (p.fold <> f.fold) AS n FROM (SELECT DISTINCT fold FROM pred) f, (SELECT DISTINCT truth FROM pred) c, pred p WHERE p.truth = c.truth GROUP BY ALL)
    SELECT fold, CAST(CASE WHEN least(5, min(n)) < 2 THEN 1 ELSE least(5, min(n)) END AS INT) AS n_splits FROM n GROUP BY fold""",
    V.PRED,
)
def nested_fold_plan(spark, sf_dir):
    return L.nested_folds(predictions(spark, sf_dir), "fold", "truth", "n_splits")


@query(
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
)
def event_windows(spark, sf_dir):
    """Hourly counts per kind: the same expression serves a stream of events."""
    w = windowed_counts(table(spark, sf_dir, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
