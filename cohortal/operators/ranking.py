"""Ranking metrics: midranks, AUC, DeLong, ROC points and thresholds.

All start from the table of distinct scores with the positives and negatives of each, which an
aggregate makes before anything is ordered, so that the ordered part has as many rows as there
are scores. Truth is 1 for a positive, 0 for a negative; rows with a null score or truth are left out.
An undefined metric is null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.operators.prefix import running_least, running_totals
from cohortal.session import materialize

#: Two-sided 95 % quantile of the normal distribution.
Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0 or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def score_table(df: DataFrame, score: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, score, pos, neg``, running ``pos_le, neg_le`` (scores up to this) and totals ``n_pos, n_neg``."""
    rows = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    each = rows.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg")
    )
    ranked = running_totals(each, [F.col("score")], {"pos_le": F.col("pos"), "neg_le": F.col("neg")}, by)
    totals = [F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")]
    ranked = materialize(ranked)
    if by:
        return ranked.join(ranked.groupBy(*by).agg(*totals), list(by))
    return ranked.crossJoin(F.broadcast(ranked.agg(*totals)))  # one row


def midranks(df: DataFrame, score: str, by: Sequence[str] = (), name: str = "midrank") -> DataFrame:
    """Rows with the mean rank (from 1, ascending) of their score; ties share it."""
    each = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(F.count("*").alias("_n"))
    ranked = running_totals(each, [F.col("_s")], {"_le": F.col("_n")}, by)
    ranked = ranked.select(*[F.col(c).alias(f"_{c}") for c in by], "_s", (F.col("_le") - (F.col("_n") - 1) / 2).alias(name))
    on = F.col(score) == F.col("_s")
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return df.join(ranked, on).select(*df.columns, name)


def quantiles(df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, a column per entry of ``shares``: ``by`` and the names.

    From a row per distinct value with its running count, so no task holds a group's values.
    """
    each = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranked = materialize(running_totals(each, [F.col("_v")], {"_le": F.col("_n")}, by))
    total = ranked.groupBy(*by).agg(F.max("_le").alias("_t"))
    ranked = ranked.join(total, list(by)) if by else ranked.crossJoin(F.broadcast(total))  # one row
    out = []
    for name, q in shares.items():
        h = (F.col("_t") - 1) * F.lit(float(q))
        at = lambda i: F.max(F.when((F.col("_le") - F.col("_n") <= i) & (i < F.col("_le")), F.col("_v")))
        low, high = at(F.floor(h)), at(F.ceil(h))
        out.append((low + (high - low) * (F.max(h) - F.floor(F.max(h)))).alias(name))
    return ranked.groupBy(*by).agg(*out)


def placements(table: DataFrame) -> DataFrame:
    """Adds ``v01`` (share of negatives below a positive of this score, ties half) and ``v10``."""
    return table.withColumn("v01", ratio(F.col("neg_le") - F.col("neg") / 2, F.col("n_neg"))).withColumn(
        "v10", 1 - ratio(F.col("pos_le") - F.col("pos") / 2, F.col("n_pos"))
    )


def _variance(v: str, w: str, n: Column) -> Column:
    """Sample variance of v, each value w times, 0 for a single value; to be used in an aggregate."""
    mean = F.sum(F.col(v) * F.col(w)) / n
    return F.when(n > 1, F.greatest(F.lit(0.0), (F.sum(F.col(v) * F.col(v) * F.col(w)) - n * mean * mean) / (n - 1))).otherwise(0.0)


def roc_auc(df: DataFrame, score: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, n_pos, n_neg, auc`` with its DeLong variance ``var`` and ``ci_low, ci_high`` (95 %)."""
    t = placements(score_table(df, score, truth, by))
    m, n = F.max("n_pos"), F.max("n_neg")
    out = t.groupBy(*by).agg(
        m.alias("n_pos"),
        n.alias("n_neg"),
        (F.sum(F.col("v01") * F.col("pos")) / F.nullif(m, F.lit(0))).alias("auc"),
        (_variance("v01", "pos", m) / F.nullif(m, F.lit(0)) + _variance("v10", "neg", n) / F.nullif(n, F.lit(0))).alias("var"),
    )
    h = F.lit(Z95) * F.sqrt("var")
    out = out.withColumn("ci_low", F.when(F.col("auc").isNotNull(), F.greatest(F.lit(0.0), F.col("auc") - h)))
    return out.withColumn("ci_high", F.when(F.col("auc").isNotNull(), F.least(F.lit(1.0), F.col("auc") + h)))


def paired_delong(df: DataFrame, base: str, new: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Difference of two AUCs on the same rows: ``by, auc_base, auc_new, delta, var, z``.

    Each row takes its placement value from the score table of either model; variances are
    those of the differences. ``z`` is null where the variance is 0.
    """
    rows = df.where(F.col(base).isNotNull() & F.col(new).isNotNull() & F.col(truth).isNotNull())
    rows = rows.select(*by, F.col(base).cast("double").alias("s_a"), F.col(new).cast("double").alias("s_b"), F.col(truth).alias("y"))
    for k in ("a", "b"):
        t = placements(score_table(rows, f"s_{k}", "y", by))
        t = t.select(*by, F.col("score").alias(f"s_{k}"), F.col("v01").alias(f"p_{k}"), F.col("v10").alias(f"n_{k}"))
        rows = rows.join(t, [*by, f"s_{k}"])
    pos, neg = F.col("y") == 1, F.col("y") == 0
    d01, d10 = F.when(pos, F.col("p_b") - F.col("p_a")), F.when(neg, F.col("n_b") - F.col("n_a"))
    part = lambda d, c: F.coalesce(F.var_samp(d), F.lit(0.0)) / F.nullif(F.count_if(c), F.lit(0))
    out = rows.groupBy(*by).agg(
        F.avg(F.when(pos, F.col("p_a"))).alias("auc_base"),
        F.avg(F.when(pos, F.col("p_b"))).alias("auc_new"),
        (part(d01, pos) + part(d10, neg)).alias("var"),
    )
    out = out.withColumn("delta", F.col("auc_new") - F.col("auc_base"))
    return out.withColumn("z", F.when(F.col("var") > 0, F.col("delta") / F.sqrt("var")))


def roc_points(df: DataFrame, score: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """A row per distinct score as threshold (>=): ``tp, fp, fn, tn, tpr, fpr, precision``."""
    t = score_table(df, score, truth, by)
    t = t.withColumn("tp", F.col("n_pos") - F.col("pos_le") + F.col("pos"))
    t = t.withColumn("fp", F.col("n_neg") - F.col("neg_le") + F.col("neg"))
    return t.select(
        *by,
        F.col("score").alias("threshold"),
        "tp",
        "fp",
        (F.col("n_pos") - F.col("tp")).alias("fn"),
        (F.col("n_neg") - F.col("fp")).alias("tn"),
        ratio(F.col("tp"), F.col("n_pos")).alias("tpr"),
        ratio(F.col("fp"), F.col("n_neg")).alias("fpr"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.col("pos"),
    )


def average_precision(df: DataFrame, score: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum over descending distinct scores of the recall gained times the precision there."""
    p = roc_points(df, score, truth, by)
    n = F.max(F.col("tp") + F.col("fn"))
    return p.groupBy(*by).agg((F.sum(F.col("pos") * F.col("precision")) / F.nullif(n, F.lit(0))).alias("ap"))


def youden_threshold(
    df: DataFrame, score: str, truth: str, by: Sequence[str] = (), ties: str = "lowest", undefined: float = 0.0, points: DataFrame | None = None
) -> DataFrame:
    """Threshold of the greatest sensitivity + specificity - 1: ``by, threshold, j``.

    Of equal ones the ``lowest`` (ascending scan, strictly greater) or the ``highest``.
    ``undefined`` stands for a rate without rows. ``points`` are the ROC points if they are at hand.
    """
    p = points if points is not None else roc_points(df, score, truth, by)
    j = F.coalesce("tpr", F.lit(undefined)) + F.coalesce(1 - F.col("fpr"), F.lit(undefined)) - 1
    # Equal up to rounding is equal: the rates are quotients of counts.
    p = p.withColumn("j", F.round(j, 12))
    t = F.col("threshold") if ties == "highest" else -F.col("threshold")
    best = p.groupBy(*by).agg(F.max(F.struct("j", t.alias("t"))).alias("best"))
    threshold = F.col("best.t") if ties == "highest" else -F.col("best.t")
    return best.select(*by, threshold.alias("threshold"), F.col("best.j").alias("j"))


def threshold_for_specificity(
    df: DataFrame, score: str, truth: str, target: float, by: Sequence[str] = (), ties: str = "first", points: DataFrame | None = None
) -> DataFrame:
    """Best sensitivity with at least the target specificity: ``by, threshold, sens, spec``.

    Thresholds are scanned from +inf down. ``first`` keeps the first (highest) threshold of the best
    sensitivity; ``lexicographic`` takes the greatest (sens, spec, threshold). Above all scores is +inf.
    """
    p = points if points is not None else roc_points(df, score, truth, by)
    p = p.select(*by, "threshold", F.col("tpr").alias("sens"), (1 - F.col("fpr")).alias("spec"))
    top = p.groupBy(*by).agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("sens"), F.lit(1.0).alias("spec"))
    p = p.unionByName(top).where(F.col("spec") >= target)
    key = F.struct("sens", "threshold", "spec") if ties == "first" else F.struct("sens", "spec", "threshold")
    best = p.groupBy(*by).agg(F.max(key).alias("b"))
    return best.select(*by, F.col("b.threshold").alias("threshold"), F.col("b.sens").alias("sens"), F.col("b.spec").alias("spec"))


def threshold_for_sensitivity(
    df: DataFrame, score: str, truth: str, target: float, by: Sequence[str] = (), points: DataFrame | None = None
) -> DataFrame:
    """Highest threshold whose sensitivity reaches the target, 0 if none."""
    p = points if points is not None else roc_points(df, score, truth, by)
    best = F.max(F.when(F.col("tpr") >= target, F.col("threshold")))
    return p.groupBy(*by).agg(F.coalesce(best, F.lit(0.0)).alias("threshold"))


def bh_fdr(df: DataFrame, p: str, by: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg ``q``: least p * m / rank over this and greater ranks, at most 1; null p has none."""
    own = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    each = own.groupBy(*by, F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    ranked = materialize(running_totals(each, [F.col("_p")], {"_rank": F.col("_n")}, by))
    if by:
        ranked = ranked.join(ranked.groupBy(*by).agg(F.max("_rank").alias("_m")), list(by))
    else:
        ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.max("_rank").alias("_m"))))
    ranked = ranked.withColumn("_q", F.col("_p") * F.col("_m") / F.col("_rank"))
    least = running_least(ranked, [F.col("_p").desc()], "_q", by)
    found = least.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_p"), F.least("_q", F.lit(1.0)).alias("q"))
    on = F.col(p) == F.col("_p")
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return df.join(found, on, "left").select(*df.columns, "q")
