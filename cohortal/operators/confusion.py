"""Counts and rates of binary and multiclass decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.operators.ranking import ratio


def confusion_counts(df: DataFrame, score: Column, truth: Column, threshold: Column | float, by: Sequence[str] = ()) -> DataFrame:
    """``by, tp, fp, fn, tn``; a score at its threshold counts as positive. Thresholds may vary by row."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred, pos = score >= t, truth == 1
    return df.groupBy(*by).agg(
        F.count_if(pred & pos).alias("tp"),
        F.count_if(pred & ~pos).alias("fp"),
        F.count_if(~pred & pos).alias("fn"),
        F.count_if(~pred & ~pos).alias("tn"),
    )


def rates(counts: DataFrame, undefined: float | None = None) -> DataFrame:
    """Adds sens, spec, ppv, npv, f1, balanced accuracy and Youden's J; ``undefined`` for empty denominators."""
    d = (lambda c: c) if undefined is None else (lambda c: F.coalesce(c, F.lit(undefined)))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumns(
        {
            "sens": d(ratio(tp, tp + fn)),
            "spec": d(ratio(tn, tn + fp)),
            "ppv": d(ratio(tp, tp + fp)),
            "npv": d(ratio(tn, tn + fn)),
            "f1": d(ratio(2 * tp, 2 * tp + fp + fn)),
        }
    )
    return out.withColumns(
        {"balanced_accuracy": (F.col("sens") + F.col("spec")) / 2, "youden_j": F.col("sens") + F.col("spec") - 1}
    )


def wilson(k: Column, n: Column, z: float = 1.96, clamp: bool = True) -> tuple[Column, Column]:
    """Wilson interval of k out of n; null for n = 0."""
    k, n = k.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p, zz = k / n, z * z
    d = 1 + zz / n
    c = (p + zz / (2 * n)) / d
    h = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / d
    if not clamp:
        return c - h, c + h
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), c - h)), F.when(n.isNotNull(), F.least(F.lit(1.0), c + h))


def confusion_matrix(df: DataFrame, truth: str, pred: str, classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """All cells, zeros included: ``true_class, predicted_class, n, row_percentage``."""
    c = F.array(*[F.lit(k) for k in classes])
    grid = df.sparkSession.range(1).select(F.explode(c).alias("true_class")).select("true_class", F.explode(c).alias("predicted_class"))
    n = df.groupBy(F.col(truth).cast("int").alias("true_class"), F.col(pred).cast("int").alias("predicted_class")).agg(F.count("*").alias("n"))
    full = grid.join(n, ["true_class", "predicted_class"], "left").na.fill({"n": 0})
    totals = full.groupBy("true_class").agg(F.sum("n").alias("total"))
    return full.join(totals, "true_class").select(
        "true_class", "predicted_class", "n", (100 * ratio(F.col("n"), F.col("total"))).alias("row_percentage")
    )


def per_class(matrix: DataFrame) -> DataFrame:
    """``class, hits, n_true, n_pred, n`` of each class of a confusion matrix."""
    t = matrix.groupBy(F.col("true_class").alias("class")).agg(
        F.sum("n").alias("n_true"), F.sum(F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0)).alias("hits")
    )
    p = matrix.groupBy(F.col("predicted_class").alias("class")).agg(F.sum("n").alias("n_pred"))
    total = F.broadcast(matrix.agg(F.sum("n").alias("n")))  # one row
    return t.join(p, "class").crossJoin(total)


def summary(matrix: DataFrame, undefined: float | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, kappa, macro and weighted precision, recall and F1.

    ``undefined=None`` leaves classes without a value out of a mean, and an F1 of P + R = 0 is
    undefined; ``undefined=0.0`` counts them as 0.
    """
    c = per_class(matrix)
    fill = (lambda x: x) if undefined is None else (lambda x: F.coalesce(x, F.lit(undefined)))
    c = c.withColumn("p", fill(ratio(F.col("hits"), F.col("n_pred")))).withColumn("raw_r", ratio(F.col("hits"), F.col("n_true")))
    c = c.withColumn("r", fill(F.col("raw_r")))
    c = c.withColumn("f", fill(2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0))))
    n = F.max("n").cast("double")
    s = c.agg(
        F.max("n").alias("n"),
        (F.sum("hits") / F.nullif(n, F.lit(0.0))).alias("accuracy"),
        F.avg("raw_r").alias("balanced_accuracy"),
        (F.sum(F.col("n_true") * F.col("n_pred").cast("double")) / F.nullif(n * n, F.lit(0.0))).alias("pe"),
        F.avg("p").alias("macro_precision"),
        F.avg("r").alias("macro_recall"),
        F.avg("f").alias("macro_f1"),
        (F.sum(F.col("f") * F.col("n_true")) / F.nullif(n, F.lit(0.0))).alias("weighted_f1"),
    )
    return s.withColumn("kappa", (F.col("accuracy") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0))).drop("pe")


def dice(df: DataFrame, truth: str, pred: str, classes: Sequence[int] = (0, 1, 2), undefined: float | None = 0.0) -> DataFrame:
    """Dice per class and its mean: ``class, dice`` with class ``macro`` for the mean."""
    c = per_class(confusion_matrix(df, truth, pred, classes))
    v = ratio(2 * F.col("hits"), F.col("n_true") + F.col("n_pred"))
    each = c.select(F.col("class").cast("string").alias("class"), (v if undefined is None else F.coalesce(v, F.lit(undefined))).alias("dice"))
    return each.unionByName(each.agg(F.avg("dice").alias("dice")).withColumn("class", F.lit("macro")))
