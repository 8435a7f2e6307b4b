"""Long tables of a classifier's metrics with scope, class, interval, method, denominator and note."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.operators import calibration as K
from cohortal.operators import confusion as M
from cohortal.operators import effects as E
from cohortal.operators import ranking as Q

RECORD = ("scope", "class", "metric", "estimate", "ci95_low", "ci95_high", "ci_method", "denominator_n", "note")
# Names of methods and notes.
NONE, WILSON, DELONG = "none", "Wilson 95%, image level", "DeLong 95%, image level"
ONE_REST = "One-vs-rest for AUC/AP/Brier and diagnostic rates."
NAIVE = "Naive image-level interval; clustering by patient/lesion unavailable."


def record(scope: str, metric: str, estimate: Column, denominator: Column, name: str | Column = "all", low=None, high=None, method: str = NONE, note: str = "") -> Column:
    number = lambda v: F.lit(v).cast("double")
    values = (F.lit(scope), F.lit(name) if isinstance(name, str) else name, F.lit(metric), number(estimate), number(low), number(high), F.lit(method), denominator.cast("long"), F.lit(note))
    return F.struct(*[v.alias(k) for k, v in zip(RECORD, values, strict=True)])


def shares(scope: str, names: dict[str, tuple[str, str]], **more) -> list[Column]:
    """Records of shares ``hit / of`` with Wilson intervals."""
    out = []
    for metric, (hit, of) in names.items():
        h, n = F.expr(hit), F.expr(of)
        low, high = M.wilson(h, n)
        out.append(record(scope, metric, Q.ratio(h, n), n, low=low, high=high, method=WILSON, **more))
    return out


RATES = {"sensitivity": ("tp", "tp + fn"), "specificity": ("tn", "tn + fp"), "precision_ppv": ("tp", "tp + fp"), "npv": ("tn", "tn + fn")}
CELLS = {"tp": "tp + fn", "fn": "tp + fn", "tn": "tn + fp", "fp": "tn + fp"}


def global_records(df: DataFrame, id: str, truth: str, pred: str, probabilities: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Counts, accuracy, and seven metrics with intervals from draws within each class; the sample itself is one more replicate."""
    known = E.known(df, truth, id, pred, *probabilities)
    drawn = E.stratified(known, id, truth, replicates, seed)
    both = drawn.unionByName(known.select("*", F.lit(-1).alias("_rep"), F.lit(1).alias("_w")))
    long = E.multiclass_values(both, truth, pred, probabilities).unpivot(["_rep"], list(E.SEVEN), "metric", "value")
    of_draws = lambda q: F.percentile(F.when(F.col("_rep") >= 0, F.col("value")), F.lit(q))
    own = F.max(F.when(F.col("_rep") < 0, F.col("value")))
    seven = long.groupBy("metric").agg(own.alias("v"), of_draws(0.025).alias("low"), of_draws(0.975).alias("high"))
    n = known.agg(F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(pred)).alias("hits"))
    method = f"stratified percentile bootstrap, {replicates} replicates, seed {seed}"
    named = seven.crossJoin(F.broadcast(n)).select(  # one row
        record("global_argmax", "", F.col("v"), F.col("n"), low=F.col("low"), high=F.col("high"), method=method, note=NAIVE).withField("metric", F.col("metric")).alias("r")
    )
    plain = [record("global_argmax", "n_images", F.col("n"), F.col("n")), record("global_argmax", "n_correct", F.col("hits"), F.col("n")), *shares("global_argmax", {"accuracy": ("hits", "n")})]
    return named.select("r.*").unionByName(n.select(F.inline(F.array(*plain))))


def class_records(df: DataFrame, truth: str, pred: str, probabilities: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Each class against the rest: counts, rates, F1, AUC, average precision, Brier score."""
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"), F.col(c).alias("s")) for k, (c, name) in enumerate(zip(probabilities, names, strict=True))]))
    long = df.where(F.col(truth).isNotNull()).select(F.col(truth).alias("t"), F.col(pred).alias("p"), one.alias("o"))
    long = long.select("o.name", "o.s", (F.col("t") == F.col("o.k")).cast("int").alias("y"), (F.col("p") == F.col("o.k")).alias("called"))
    y = F.col("y") == 1
    counts = long.groupBy("name").agg(
        F.count_if(y & F.col("called")).alias("tp"), F.count_if(~y & F.col("called")).alias("fp"), F.count_if(y & ~F.col("called")).alias("fn"), F.count_if(~y & ~F.col("called")).alias("tn"),
        F.avg((F.col("s") - F.col("y")) * (F.col("s") - F.col("y"))).alias("brier"), F.count("*").alias("n"),
    )
    auc = Q.roc_auc(long, "s", "y", ["name"]).select("name", "auc", "ci_low", "ci_high")
    # A row per class on each side.
    wide = counts.join(F.broadcast(auc), "name", "left").join(F.broadcast(Q.average_precision(long, "s", "y", ["name"])), "name", "left")
    scope, more = "per_class_argmax_ovr", {"name": F.col("name"), "note": ONE_REST}
    some = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    rows = [
        record(scope, "support", F.expr("tp + fn"), F.expr("tp + fn"), **more), *[record(scope, k, F.col(k), F.expr(n), **more) for k, n in CELLS.items()],
        *shares(scope, {"sensitivity_recall" if k == "sensitivity" else k: v for k, v in RATES.items()}, **more),
        record(scope, "f1_dice", F.coalesce(Q.ratio(F.expr("2 * tp"), F.expr("2 * tp + fp + fn")), F.lit(0.0)), F.col("n"), **more),
        record(scope, "auc_ovr", F.col("auc"), F.col("n"), low=F.col("ci_low"), high=F.col("ci_high"), method=DELONG, **more),
        record(scope, "average_precision_ovr", F.when(some, F.col("ap")), F.col("n"), **more), record(scope, "brier_ovr", F.col("brier"), F.col("n"), **more),
    ]
    return wide.select(F.inline(F.array(*rows)))


def threshold_records(df: DataFrame, truth: str, score: str, threshold: float, name: str, scope: str = "melanoma_fixed_threshold", note: str = "") -> DataFrame:
    """One class at a fixed threshold of its score."""
    c = M.confusion_counts(df.where(F.col(truth).isNotNull()), F.col(score), F.col(truth), threshold)
    c = c.withColumn("n", F.expr("tp + fp + fn + tn"))
    more = {"name": name, "note": note}
    sens, spec = Q.ratio(F.col("tp"), F.expr("tp + fn")), Q.ratio(F.col("tn"), F.expr("tn + fp"))
    rows = [
        record(scope, "threshold", F.lit(threshold), F.col("n"), **more), *[record(scope, k, F.col(k), F.expr(n), **more) for k, n in CELLS.items()], *shares(scope, RATES, **more),
        record(scope, "accuracy", Q.ratio(F.expr("tp + tn"), F.col("n")), F.col("n"), **more), record(scope, "balanced_accuracy", (sens + spec) / 2, F.col("n"), **more),
        record(scope, "f1_dice", F.coalesce(Q.ratio(F.expr("2 * tp"), F.expr("2 * tp + fp + fn")), F.lit(0.0)), F.col("n"), **more),
    ]
    return c.select(F.inline(F.array(*rows)))


def calibration_records(df: DataFrame, confidences: dict[str, tuple[Column, Column]], n_bins: int = 10) -> DataFrame:
    """Mean and greatest gap of equal-width bins, per named confidence and what it should foretell."""
    out = []
    for name, (confidence, observed) in confidences.items():
        n = F.broadcast(df.agg(F.count("*").alias("n")))  # one row
        e = K.calibration_errors(df, confidence, observed, n_bins).crossJoin(n)
        note = f"{n_bins} equal-width probability bins."
        out.append(e.select(F.inline(F.array(*[record("calibration", f"{k}_{name}", F.col(k), F.col("n"), note=note) for k in ("ece", "mce")]))))
    return reduce(DataFrame.unionByName, out)


def metric_rows(df: DataFrame, truth: str, score: str, threshold: float, by: Sequence[str]) -> DataFrame:
    """A wide row per group: sizes, AUC, average precision, rates at the threshold with Wilson intervals, and how low positives score.

    AUC and average precision are null where a class has no row, ``median_pos`` and ``frac_lt_0_01_pos`` without positives.
    """
    rows = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    pos = F.col(truth) == 1
    c = M.confusion_counts(rows, F.col(score), F.col(truth), threshold, by)
    low = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(pos, (F.col(score) < 0.01).cast("double"))).alias("frac_lt_0_01_pos"))
    auc = Q.roc_auc(rows, score, truth, by).select(*by, "n_pos", "n_neg", "auc")
    ap = Q.average_precision(rows, score, truth, by)
    median = Q.quantiles(rows.where(pos), score, {"median_pos": 0.5}, by)
    out = c
    for t in (low, auc, ap, median):
        out = out.join(t, list(by), "left")
    out = out.withColumns({k: F.expr(v) for k, v in {"n_pos": "tp + fn", "n_neg": "tn + fp"}.items()}).withColumn("threshold", F.lit(threshold))
    for name, (hit, of) in {"sens": ("tp", "n_pos"), "spec": ("tn", "n_neg")}.items():
        bounds = M.wilson(F.col(hit), F.col(of))
        out = out.withColumns({name: Q.ratio(F.col(hit), F.col(of)), f"{name}_ci_low": bounds[0], f"{name}_ci_high": bounds[1]})
    out = out.withColumn("ap", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("ap")))
    return out.select(*by, "n", "n_pos", "n_neg", "auc", "ap", "threshold", "sens", "sens_ci_low", "sens_ci_high", "spec", "spec_ci_low", "spec_ci_high", "tp", "fn", "tn", "fp", "median_pos", "frac_lt_0_01_pos")
