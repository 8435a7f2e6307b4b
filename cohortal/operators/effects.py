"""Factorial designs, exact tests and bootstrap."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortal.operators.prefix import numbered, running_totals
from cohortal.operators.ranking import ratio, roc_auc, roc_points
from cohortal.session import broadcast_if_small, materialize, shuffle_partitions

BLOCKS = ("A", "B", "C", "D")


def conditions(spark, blocks: Sequence[str] = BLOCKS) -> DataFrame:
    """All subsets of the blocks with and without the deep part: ``mask, deep, label``; no empty one without it."""
    n = 1 << len(blocks)
    bit = lambda k: F.shiftright("mask", k).bitwiseAND(1) == 1
    name = F.array_join(F.array_compact(F.array(*[F.when(bit(k), F.lit(b)) for k, b in enumerate(blocks)])), "")
    masks = spark.range(n).select(F.col("id").cast("int").alias("mask"))
    both = masks.select("mask", F.explode(F.array(F.lit(True), F.lit(False))).alias("deep")).where("deep or mask > 0")
    return both.select("mask", "deep", F.concat(name, F.when(F.col("deep"), "+deep").otherwise("")).alias("label"))


def auc_by_condition(df: DataFrame, base: Column, parts: Sequence[Column], truth: str) -> DataFrame:
    """``mask, auc`` of the sums of ``base`` and each subset of ``parts``."""
    n = 1 << len(parts)
    scores = []
    for m in range(n):
        s = base
        for k, p in enumerate(parts):
            if m >> k & 1:
                s = s + p
        scores.append(F.struct(F.lit(m).alias("mask"), s.alias("score")))
    long = df.select(truth, F.explode(F.array(*scores)).alias("c")).select(truth, "c.*")
    return roc_auc(long, "score", truth, ["mask"]).select("mask", "auc")


def main_effects(auc: DataFrame, n_blocks: int = 4) -> DataFrame:
    """``block, effect_type, delta``: add one to none, leave one out of all, mean over all subsets without it."""
    blocks = auc.sparkSession.range(n_blocks).select(F.col("id").cast("int").alias("block"))
    has = F.expr("shiftright(mask, block) & 1")
    bit = F.expr("shiftleft(1, block)")
    full = (1 << n_blocks) - 1
    a = auc.crossJoin(F.broadcast(blocks))  # subsets times blocks
    pairs = a.where(has == 0).select("block", "mask", F.col("auc").alias("without"), (F.col("mask") + bit).alias("other"))
    pairs = pairs.join(auc.select(F.col("mask").alias("other"), F.col("auc").alias("with")), "other")
    d = F.col("with") - F.col("without")
    wide = pairs.groupBy("block").agg(
        F.max(F.when(F.col("mask") == 0, d)).alias("add_one"),
        F.max(F.when(F.col("other") == full, d)).alias("leave_one_out"),
        F.avg(d).alias("main_effect_factorial"),
    )
    return wide.unpivot(["block"], ["add_one", "leave_one_out", "main_effect_factorial"], "effect_type", "delta")


def pair_interactions(auc: DataFrame, n_blocks: int = 4) -> DataFrame:
    """``b1, b2, delta``: mean over subsets without both of AUC(12) - AUC(1) - AUC(2) + AUC()."""
    pairs = [(i, j) for i in range(n_blocks) for j in range(i + 1, n_blocks)]
    grid = auc.sparkSession.createDataFrame(pairs, "b1 int, b2 int")
    a = auc.crossJoin(F.broadcast(grid))
    one, two = F.expr("shiftright(mask, b1) & 1"), F.expr("shiftright(mask, b2) & 1")
    rest = F.expr("mask - (shiftright(mask, b1) & 1) * shiftleft(1, b1) - (shiftright(mask, b2) & 1) * shiftleft(1, b2)")
    sign = F.when(one == two, 1.0).otherwise(-1.0)
    each = a.groupBy("b1", "b2", rest.alias("rest")).agg(F.sum(sign * F.col("auc")).alias("d"))
    return each.groupBy("b1", "b2").agg(F.avg("d").alias("delta"))


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a normal deviate; null stays null."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2))).astype("float64")


def _mcnemar(b: int, c: int) -> float:
    """Twice the lower tail of a fair binomial, by the continued fraction of the incomplete beta function."""
    n, k = b + c, min(b, c)
    if n == 0 or 2 * k == n:
        return 1.0
    # The tail up to k is I_1/2(n - k, k + 1); its fraction converges fast as 1/2 lies below its mean.
    p, q = n - k, k + 1
    front = math.exp(math.lgamma(n + 1) - math.lgamma(p) - math.lgamma(q) - (n + 1) * math.log(2)) / p
    tiny = 1e-300
    f, d = 1.0, 1.0 / (1 - (p + q) / (p + 1) / 2 or tiny)
    c_, f = 1.0, d
    for m in range(1, 10_000):
        for term in (m * (q - m) / ((p + 2 * m - 1) * (p + 2 * m)) / 2, -(p + m) * (p + q + m) / ((p + 2 * m) * (p + 2 * m + 1)) / 2):
            d = 1 / (1 + term * d or tiny)
            c_ = 1 + term / c_ or tiny
            f *= d * c_
        if abs(d * c_ - 1) < 1e-14:
            break
    return min(1.0, 2 * front * f)


@F.pandas_udf(T.DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided p of b against c discordant pairs; 1 if there are none."""
    return pd.Series([_mcnemar(int(x), int(y)) for x, y in zip(b, c, strict=True)], dtype="float64")


#: Distribution function of Poisson(1) at 0, 1, 2, ...: a uniform number's weight is how many of these it reaches.
POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(11))


def resampled(df: DataFrame, id: str, replicates: int, seed: int = 42) -> DataFrame:
    """Every row with its weight ``_w`` (positive) in every replicate ``_rep``: a Poisson bootstrap.

    A row's weight is Poisson(1), from the first 32 bits of the MD5 of seed, replicate and id, so that
    any engine draws the same. Nothing is collected; aggregates by replicate combine before
    they shuffle.
    """
    key = F.concat(F.lit(f"{seed}|"), F.col("_rep").cast("string"), F.lit("|"), F.col(id).cast("string"))
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    weight = sum((F.when(u >= x, 1).otherwise(0) for x in POISSON), F.lit(0))
    every = df.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return every.withColumn("_w", weight).where("_w > 0")


#: 32-bit arithmetic in 64-bit whole numbers, so that any engine draws the same.
MASK, MULTIPLIER, STEPS = (1 << 32) - 1, 0x45D9F3B, (0x9E3779B9, 0x85EBCA6B)


def stirred(df: DataFrame, x: str) -> DataFrame:
    """``x`` replaced by a 32-bit number whose bits all depend on all of its bits.

    Each step is a column of its own: it uses the one before twice, so that one expression would double with every step.
    """
    mixed = F.col(x).bitwiseXOR(F.shiftright(x, 16))
    for _ in range(2):
        df = df.withColumn(x, (mixed * F.lit(MULTIPLIER)).bitwiseAND(F.lit(MASK)))
    return df.withColumn(x, mixed)


def drawn_positions(df: DataFrame, name: str, k: Column, n: Column, rep: Column, stratum: Column, seed: int) -> DataFrame:
    """Adds ``name``: which of ``n`` positions (from 0, fewer than 2 ** 31) the ``k``-th draw of a stratum and replicate takes."""
    low = lambda x: x.bitwiseAND(F.lit(MASK))
    df = stirred(df.withColumn(name, low(k + F.lit(STEPS[0]) * (rep + 1))), name)
    df = stirred(df.withColumn(name, low(F.col(name) + F.lit(STEPS[1]) * (stratum + 1) + F.lit(seed))), name)
    return df.withColumn(name, F.shiftright(F.col(name) * n, 32))


def stratified(df: DataFrame, id: str, stratum: str, replicates: int, seed: int = 42, columns: Sequence[str] | None = None) -> DataFrame:
    """Resamples with replacement within each class: a row ``_rep``, ``_w`` (1) per draw, as many as the class has rows.

    Rows of a class are numbered along ``id`` (unique; ``stratum`` is a whole number, rows without one
    go). Each row makes one draw a replicate: a number that takes it to the row of that
    position by a join, in the task itself while the numbered rows are small (their bytes are
    measured), else by a shuffle of the draws, whose numbers are spread evenly. Draws have
    ``columns`` (all of ``df``) only, and what follows aggregates them by replicate before it shuffles.
    """
    columns = list(columns or df.columns)
    rows = df.where(F.col(stratum).isNotNull())
    placed = numbered(rows, [F.col(id)], "_k", [stratum])
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    placed = placed.join(F.broadcast(sizes), stratum)  # a row per class
    # Few bytes make many draws: adaptive execution would leave them to one task.
    placed = materialize(placed.repartition(shuffle_partitions(df.sparkSession)))
    # What is never null needs no filter before the join, which would repeat all steps of a draw.
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    draws = placed.select(*[whole(c).alias(c) for c in ("_k", "_n")], whole(stratum).alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_rep"))
    draws = drawn_positions(draws, "_at", F.col("_k") - 1, F.col("_n"), F.col("_rep").cast("long"), F.col("_s"), seed).select("_s", "_rep", "_at")
    found = placed.select(*columns, whole(stratum).alias("_s"), (whole("_k") - 1).alias("_at"))
    return draws.join(broadcast_if_small(found, otherwise="shuffle_hash"), ["_s", "_at"]).select(*columns, "_rep", F.lit(1).alias("_w"))


def known(df: DataFrame, truth: str, *used: str) -> DataFrame:
    """Rows with a truth and the columns in use: no other goes into checkpoints and shuffles, or is measured for a broadcast."""
    return df.where(F.col(truth).isNotNull()).select(*dict.fromkeys([*used, truth]))


def resamples(df: DataFrame, id: str, stratum: str | None, replicates: int, seed: int) -> DataFrame:
    """Resampled rows without their id, which only tells them apart before."""
    if stratum is None:
        return resampled(df, id, replicates, seed).drop(id)
    return stratified(df, id, stratum, replicates, seed, [c for c in df.columns if c != id])


def _weighted_auc(rows: DataFrame, score: str, positive: Column, by: Sequence[str]) -> DataFrame:
    """``by, auc, n_pos`` of weighted rows; null with one class only."""
    w = lambda c: F.sum(F.when(c, F.col("_w")).otherwise(0))
    each = rows.groupBy(*by, F.col(score).cast("double").alias("score")).agg(w(positive).alias("pos"), w(~positive).alias("neg"))
    ranked = running_totals(each, [F.col("score")], {"neg_le": F.col("neg")}, by)
    hits = F.sum(F.col("pos") * (F.col("neg_le") - F.col("neg") / 2))
    both = F.nullif((F.sum("pos") * F.sum("neg")).cast("double"), F.lit(0.0))
    return ranked.groupBy(*by).agg((hits / both).alias("auc"), F.sum("pos").alias("n_pos"))


def _both_scores(rows: DataFrame, truth: str, scores: Sequence[str]) -> DataFrame:
    """``_rep, _w, truth, which, score``: resampled rows once per score, from one pass over the resamples."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.col(c).cast("double").alias("score")) for k, c in enumerate(scores)]))
    return rows.select("_rep", "_w", F.col(truth).alias("truth"), each.alias("s")).select("_rep", "_w", "truth", "s.*")


def _of_scores(values: DataFrame, n: int, value: str) -> DataFrame:
    """``_rep, value``: of one score its value, of two the second's less the first's."""
    at = [F.max(F.when(F.col("which") == k, F.col(value))) for k in range(n)]
    return values.groupBy("_rep").agg((at[1] - at[0] if n == 2 else at[0]).alias("value"))


def intervals(values: DataFrame, names: Sequence[str]) -> DataFrame:
    """``metric, replicates, mean, median, ci_low, ci_high, n_undefined`` of a column per metric, a row per replicate."""
    long = values.unpivot([], list(names), "metric", "value")
    at = lambda q: F.percentile("value", F.lit(q))
    return long.groupBy("metric").agg(
        F.count("*").alias("replicates"),
        F.avg("value").alias("mean"),
        at(0.5).alias("median"),
        at(0.025).alias("ci_low"),
        at(0.975).alias("ci_high"),
        F.count_if(F.col("value").isNull()).alias("n_undefined"),
    )


def bootstrap_auc(
    df: DataFrame, id: str, truth: str, base: str, new: str | None = None, replicates: int = 1000, seed: int = 42, stratify: bool = False
) -> DataFrame:
    """Percentile interval of an AUC, or of the difference of two on the same resamples.

    Resamples are those of ``resampled``, with ``stratify`` those of ``stratified`` by the truth. One row:
    ``replicates, mean, median, ci_low, ci_high, n_undefined``. Replicates with one class
    only are undefined and left out of the rest.
    """
    scores = [base] if new is None else [base, new]
    rows = resamples(known(df, truth, id, *scores), id, truth if stratify else None, replicates, seed)
    auc = _weighted_auc(_both_scores(rows, truth, scores), "score", F.col("truth") == 1, ["_rep", "which"])
    return intervals(_of_scores(auc, len(scores), "auc"), ["value"]).drop("metric")


def bootstrap_ap_delta(df: DataFrame, id: str, truth: str, base: str, new: str, replicates: int = 1000, seed: int = 42, stratify: bool = False) -> DataFrame:
    """Like ``bootstrap_auc`` with two scores, for the difference of average precisions."""
    rows = resamples(known(df, truth, id, base, new), id, truth if stratify else None, replicates, seed)
    pos = F.sum(F.when(F.col("truth") == 1, F.col("_w")).otherwise(0)).alias("pos")
    each = _both_scores(rows, truth, [base, new]).groupBy("_rep", "which", "score").agg(pos, F.sum("_w").alias("all"))
    ranked = running_totals(each, [F.col("score").desc()], {"tp": F.col("pos"), "called": F.col("all")}, ["_rep", "which"])
    gained = F.sum(F.col("pos") * F.col("tp") / F.col("called")) / F.nullif(F.sum("pos"), F.lit(0))
    return intervals(_of_scores(ranked.groupBy("_rep", "which").agg(gained.alias("ap")), 2, "ap"), ["value"]).drop("metric")


SEVEN = ("balanced_accuracy", "macro_f1", "weighted_f1", "macro_auc_ovr", "weighted_auc_ovr", "log_loss", "brier")


def multiclass_values(rows: DataFrame, truth: str, pred: str, probabilities: Sequence[str]) -> DataFrame:
    """``_rep`` and the metrics of ``SEVEN`` of each resample; AUCs are null where a class has no row."""
    k = len(probabilities)
    own = F.element_at(F.array(*[F.col(c) for c in probabilities]), F.col(truth) + 1)
    loss = -F.ln(F.greatest(own, F.lit(2.220446049250313e-16)))
    brier = sum(((F.col(c) - (F.col(truth) == i).cast("double")) ** 2 for i, c in enumerate(probabilities)), F.lit(0.0))
    w, total = F.col("_w"), F.sum("_w").cast("double")
    when = lambda c: F.sum(F.when(c, w).otherwise(0)).cast("double")
    t, p = F.col(truth), F.col(pred)
    wide = rows.groupBy("_rep").agg(
        total.alias("n"), (F.sum(w * loss) / total).alias("log_loss"), (F.sum(w * brier) / total).alias("brier"),
        *[x.alias(f"{name}{i}") for i in range(k) for name, x in (("t", when(t == i)), ("p", when(p == i)), ("tp", when((t == i) & (p == i))))],
    )
    c = F.col
    recall = sum((c(f"tp{i}") / F.nullif(c(f"t{i}"), F.lit(0.0)) for i in range(k)), F.lit(0.0)) / k
    f1 = [F.coalesce(2 * c(f"tp{i}") / F.nullif(c(f"t{i}") + c(f"p{i}"), F.lit(0.0)), F.lit(0.0)) for i in range(k)]
    one = rows.select("_rep", "_w", F.explode(F.array(*[F.struct(F.lit(i).alias("class"), F.col(x).alias("s"), (t == i).alias("is")) for i, x in enumerate(probabilities)])).alias("o"))
    auc = _weighted_auc(one.select("_rep", "_w", "o.*"), "s", F.col("is"), ["_rep", "class"])
    auc = auc.groupBy("_rep").agg(F.avg("auc").alias("macro_auc_ovr"), (F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("weighted_auc_ovr"), F.count("auc").alias("_k"))
    defined = lambda x: F.when(F.col("_k") == k, x)
    return wide.join(auc, "_rep").select(
        "_rep", recall.alias("balanced_accuracy"), (sum(f1, F.lit(0.0)) / k).alias("macro_f1"),
        (sum((f1[i] * c(f"t{i}") for i in range(k)), F.lit(0.0)) / c("n")).alias("weighted_f1"),
        defined(c("macro_auc_ovr")).alias("macro_auc_ovr"), defined(c("weighted_auc_ovr")).alias("weighted_auc_ovr"), "log_loss", "brier",
    )


def bootstrap_multiclass(
    df: DataFrame, id: str, truth: str, pred: str, probabilities: Sequence[str], replicates: int = 1000, seed: int = 42, stratify: bool = False
) -> DataFrame:
    """Intervals of seven metrics of a classifier: balanced accuracy, macro and weighted F1, macro and
    weighted one-against-rest AUC, log loss and Brier score, each on the same resamples (see ``bootstrap_auc``)."""
    rows = resamples(known(df, truth, id, pred, *probabilities), id, truth if stratify else None, replicates, seed)
    return intervals(multiclass_values(rows, truth, pred, probabilities), SEVEN)


def bootstrap_youden(df: DataFrame, id: str, truth: str, score: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Intervals of the threshold of the greatest Youden index in resamples, and of the sensitivity and
    specificity that it has on the whole sample. Resamples of one class are undefined."""
    rows = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    w = lambda y: F.sum(F.when(F.col(truth) == y, F.col("_w")).otherwise(0))
    each = resampled(rows, id, replicates, seed).groupBy("_rep", F.col(score).cast("double").alias("score")).agg(w(1).alias("pos"), w(0).alias("neg"))
    ranked = running_totals(each, [F.col("score")], {"pos_le": F.col("pos"), "neg_le": F.col("neg")}, ["_rep"])
    total = ranked.groupBy("_rep").agg(F.max("pos_le").alias("n_pos"), F.max("neg_le").alias("n_neg"))
    points = ranked.join(total, "_rep")
    sens = ratio(F.col("n_pos") - F.col("pos_le") + F.col("pos"), F.col("n_pos"))
    spec = ratio(F.col("neg_le") - F.col("neg"), F.col("n_neg"))
    points = points.withColumn("j", F.round(sens + spec - 1, 12))
    best = points.groupBy("_rep").agg(F.max(F.struct("j", (-F.col("score")).alias("t"))).alias("best"))
    best = best.select("_rep", F.when(F.col("best.j").isNotNull(), -F.col("best.t")).alias("threshold"))
    whole = roc_points(rows, score, truth).select(F.col("threshold").alias("t"), F.col("tpr").alias("sens"), (1 - F.col("fpr")).alias("spec"))
    values = best.join(whole, F.col("threshold") == F.col("t"), "left").select("threshold", "sens", "spec")
    return intervals(values, ["threshold", "sens", "spec"])
