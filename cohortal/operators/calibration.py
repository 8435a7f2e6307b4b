"""Calibration, decision curves and abstention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.operators.prefix import numbered
from cohortal.operators.ranking import quantiles
from cohortal.session import materialize


def brier(p: Sequence[Column], truth: Column) -> Column:
    """Sum over classes of (p - 1 if it is the truth)^2; average it."""
    terms = [(x - F.when(truth == k, 1.0).otherwise(0.0)) * (x - F.when(truth == k, 1.0).otherwise(0.0)) for k, x in enumerate(p)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def log_loss(p: Sequence[Column], truth: Column, eps: float = 1e-15) -> Column:
    """Minus the log of the true class's probability, clipped; average it."""
    own = F.element_at(F.array(*p), truth.cast("int") + 1)
    return -F.ln(F.least(F.greatest(own, F.lit(eps)), F.lit(1 - eps)))


def calibration_bins(df: DataFrame, confidence: Column, observed: Column, n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """``by, bin`` (from 0), ``n, mean_predicted, observed_frequency, absolute_gap``; only bins with rows."""
    b = F.least(F.floor(confidence * n_bins), F.lit(n_bins - 1)).cast("int")
    out = df.groupBy(*by, b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(confidence).alias("mean_predicted"), F.avg(observed.cast("double")).alias("observed_frequency")
    )
    return out.withColumn("absolute_gap", F.abs(F.col("mean_predicted") - F.col("observed_frequency")))


def calibration_table(df: DataFrame, confidence: Column, observed: Column, n_bins: int = 10) -> DataFrame:
    """All bins, empty ones with 0 rows and null values, with their bounds."""
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    full = bins.join(F.broadcast(calibration_bins(df, confidence, observed, n_bins)), "bin", "left").na.fill({"n": 0})
    return full.select(
        (F.col("bin") + 1).alias("bin"),
        (F.col("bin") / n_bins).alias("lower_inclusive"),
        ((F.col("bin") + 1) / n_bins).alias("upper_inclusive_for_last"),
        "n", "mean_predicted", "observed_frequency", "absolute_gap",
    )


def calibration_errors(df: DataFrame, confidence: Column, observed: Column, n_bins: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """``by, ece, mce``: weighted mean and greatest gap of the bins."""
    bins = calibration_bins(df, confidence, observed, n_bins, by)
    return bins.groupBy(*by).agg(
        (F.sum(F.col("n") * F.col("absolute_gap")) / F.sum("n")).alias("ece"), F.max("absolute_gap").alias("mce")
    )


def quantile_calibration(df: DataFrame, p: str, truth: str, n_bins: int = 10) -> DataFrame:
    """Bins between exact linear quantiles of the scores: ``bin, n, mean_predicted, observed_frequency``.

    A score lies in bin k if it exceeds k inner edges; equal edges leave bins empty, which are not returned.
    """
    names = {f"e{k}": k / n_bins for k in range(1, n_bins)}
    edges = quantiles(df, p, names).select(F.array(*names).alias("edges"))
    rows = df.crossJoin(F.broadcast(edges))  # one row
    b = F.size(F.filter("edges", lambda e: e < F.col(p)))
    return rows.groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(truth).cast("double")).alias("observed_frequency")
    )


def entropy(p: Column, eps: float = 1e-12) -> Column:
    """Shannon entropy of a probability array."""
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.ln(x + eps))


def decision_curve(df: DataFrame, p: str, truth: str, points: int = 99) -> DataFrame:
    """Net benefit at thresholds 1 / (points + 1) .. : ``k, threshold, net_benefit, treat_all``.

    Scores are reduced to the number of thresholds they reach, so that the thresholds meet a row per
    number instead of all rows.
    """
    grid = points + 1
    # Thresholds reached: the least k with k / grid > p, less one; checked against rounding.
    k = F.floor(F.col(p) * grid).cast("int")
    k = F.when(F.col(p) >= (k + 1) / F.lit(float(grid)), k + 1).when(F.col(p) < k / F.lit(float(grid)), k - 1).otherwise(k)
    each = df.groupBy(k.alias("reach")).agg(F.count("*").alias("n"), F.count_if(F.col(truth) == 1).alias("pos"))
    each = materialize(each)
    total = each.agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))
    steps = df.sparkSession.range(1, grid).select(F.col("id").cast("int").alias("k"))
    met = steps.join(F.broadcast(each), F.col("reach") >= F.col("k"), "left")  # at most points + 2 rows
    got = met.groupBy("k").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.col("n") - F.col("pos")), F.lit(0)).alias("fp"))
    t = F.col("k") / F.lit(float(grid))
    odds = t / (1 - t)
    return got.crossJoin(F.broadcast(total)).select(
        "k",
        t.alias("threshold"),
        (F.col("tp") / F.col("all_n") - F.col("fp") / F.col("all_n") * odds).alias("net_benefit"),
        (F.col("all_pos") / F.col("all_n") - (1 - F.col("all_pos") / F.col("all_n")) * odds).alias("treat_all"),
    )


def abstention(df: DataFrame, score: str, truth: str, coverage: str, threshold: float, cuts: Sequence[float] = (0.02, 0.05, 0.1, 0.2)) -> DataFrame:
    """Per cut of the coverage: counts without the rows below it, and with these as positive.

    ``cut, mode`` (drop or review), ``n_scored, n_abstain, pos_abstained, tp, fp, fn, tn``. Cut 0 drops nothing.
    """
    c = F.explode(F.array(*[F.lit(float(x)) for x in (0.0, *cuts)])).alias("cut")
    rows = df.select(F.col(score).alias("s"), (F.col(truth) == 1).alias("pos"), F.col(coverage).alias("cov"), c)
    keep, pred = F.col("cov") >= F.col("cut"), F.col("s") >= threshold
    pos = F.col("pos")

    def counts(mode: str, within: Column, positive: Column) -> DataFrame:
        return rows.groupBy("cut").agg(
            F.lit(mode).alias("mode"),
            F.count_if(within).alias("n_scored"),
            F.count_if(~keep).alias("n_abstain"),
            F.count_if(~keep & pos).alias("pos_abstained"),
            F.count_if(within & positive & pos).alias("tp"),
            F.count_if(within & positive & ~pos).alias("fp"),
            F.count_if(within & ~positive & pos).alias("fn"),
            F.count_if(within & ~positive & ~pos).alias("tn"),
        )

    review = counts("review", F.lit(True), pred | ~keep).where("cut > 0")
    return counts("drop", keep, pred).unionByName(review)


def risk_coverage(df: DataFrame, score: str, truth: str, threshold: float, id: str, shares: Sequence[float] = (0.0, 0.05, 0.1, 0.2, 0.3)) -> DataFrame:
    """Abstain on the rows nearest the threshold: ``share, n_kept, errors, risk``.

    The k = round(share * n) rows of least |score - threshold| (then least id) are left out; risk is the
    error rate of the rest.
    """
    rows = df.select(F.abs(F.col(score) - threshold).alias("d"), F.col(id).alias("i"), ((F.col(score) >= threshold) != (F.col(truth) == 1)).alias("wrong"))
    ranked = numbered(rows, [F.col("d"), F.col("i")], "k")
    total = F.broadcast(df.agg(F.count("*").alias("n")))  # one row
    at = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    each = ranked.crossJoin(total).select("k", "n", "wrong", at)
    left_out = F.bround(F.col("share") * F.col("n"), 0)
    kept = F.col("k") > left_out
    out = each.groupBy("share").agg(F.count_if(kept).alias("n_kept"), F.count_if(kept & F.col("wrong")).alias("errors"))
    return out.withColumn("risk", F.col("errors") / F.greatest(F.col("n_kept"), F.lit(1)))
