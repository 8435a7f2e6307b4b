"""Evaluation queries over the prediction table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.operators import calibration as K
from cohortal.operators import classify as C
from cohortal.operators import confusion as M
from cohortal.operators import ranking as Q
from cohortal.operators import relational as R
from cohortal.plans import views as V
from cohortal.plans.registry import query
from cohortal.plans.views import predictions, rounded

T = C.THRESHOLDS["melanoma"]
P = V.PRED + "\n"

WILSON = (
    "CASE WHEN {n} > 0 THEN greatest(0.0::DOUBLE, ({k}/{n}::DOUBLE + 3.8416/(2*{n}))/(1+3.8416/{n}) - 1.96*sqrt({k}/{n}::DOUBLE*(1-{k}/{n}::DOUBLE)/{n}+3.8416/(4*{n}::DOUBLE*{n}))/(1+3.8416/{n})) END",
    "CASE WHEN {n} > 0 THEN least(1.0::DOUBLE, ({k}/{n}::DOUBLE + 3.8416/(2*{n}))/(1+3.8416/{n}) + 1.96*sqrt({k}/{n}::DOUBLE*(1-{k}/{n}::DOUBLE)/{n}+3.8416/(4*{n}::DOUBLE*{n}))/(1+3.8416/{n})) END",
)


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    """Both bounds in SQL, rounded."""
    return tuple(f"round({w.format(k=f'({k})', n=f'({n})')}, 6)" for w in WILSON)


COUNTS = f"""c AS (SELECT source, count(*) FILTER (p_mel >= {T} AND y = 1) AS tp, count(*) FILTER (p_mel >= {T} AND y = 0) AS fp,
  count(*) FILTER (p_mel < {T} AND y = 1) AS fn, count(*) FILTER (p_mel < {T} AND y = 0) AS tn FROM pred GROUP BY source)"""


@query(
    f""", {COUNTS}
    SELECT source, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS sens, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS spec,
      round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS ppv, round(tn / nullif(tn + fn, 0)::DOUBLE, 6) AS npv,
      round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1,
      round((tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(tn + fp, 0)::DOUBLE) / 2, 6) AS balanced_accuracy,
      round(tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(tn + fp, 0)::DOUBLE - 1, 6) AS youden_j,
      {wilson_sql("tp", "tp + fn")[0]} AS sens_low, {wilson_sql("tp", "tp + fn")[1]} AS sens_high,
      {wilson_sql("tn", "tn + fp")[0]} AS spec_low, {wilson_sql("tn", "tn + fp")[1]} AS spec_high
    FROM c""",
    V.PRED,
)
def detector_rates(spark, sf_dir):
    c = M.rates(M.confusion_counts(predictions(spark, sf_dir), F.col("p_mel"), F.col("y"), T, ["source"]))
    for name, k, n in (("sens", F.col("tp"), F.col("tp") + F.col("fn")), ("spec", F.col("tn"), F.col("tn") + F.col("fp"))):
        low, high = M.wilson(k, n)
        c = c.withColumn(f"{name}_low", low).withColumn(f"{name}_high", high)
    return rounded(c)


GRID = """g AS (SELECT t.c AS true_class, p.c AS predicted_class FROM (SELECT unnest([0, 1, 2]) AS c) t, (SELECT unnest([0, 1, 2]) AS c) p),
m AS (SELECT g.true_class, g.predicted_class, count(pred.row_index) AS n FROM g LEFT JOIN pred ON pred.truth = g.true_class AND pred.pred = g.predicted_class GROUP BY ALL)"""


@query(
    f""", {GRID} SELECT true_class, predicted_class, n, round(100.0::DOUBLE * n / nullif(sum(n) OVER (PARTITION BY true_class), 0), 6) AS row_percentage FROM m""",
    V.PRED,
)
def confusion_matrix(spark, sf_dir):
    return rounded(M.confusion_matrix(predictions(spark, sf_dir), "truth", "pred"))


def summary_sql(undefined: bool) -> str:
    d = "coalesce({}, 0.0::DOUBLE)" if undefined else "{}"
    return f""", {GRID},
    k AS (SELECT c, sum(n) FILTER (true_class = c) AS nt, sum(n) FILTER (predicted_class = c) AS np,
        sum(n) FILTER (true_class = c AND predicted_class = c) AS h, (SELECT count(*) FROM pred)::DOUBLE AS n
      FROM m, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c),
    pr AS (SELECT *, h / nullif(nt, 0)::DOUBLE AS raw_r, {d.format("h / nullif(np, 0)::DOUBLE")} AS p, {d.format("h / nullif(nt, 0)::DOUBLE")} AS r FROM k),
    f AS (SELECT *, {d.format("2 * p * r / nullif(p + r, 0)")} AS f FROM pr),
    s AS (SELECT CAST(max(n) AS BIGINT) AS n, sum(h) / max(n) AS accuracy, avg(raw_r) AS balanced_accuracy, sum(nt * np::DOUBLE) / (max(n) * max(n)) AS pe,
      avg(p) AS macro_precision, avg(r) AS macro_recall, avg(f) AS macro_f1, sum(f * nt) / max(n) AS weighted_f1 FROM f)
    SELECT n, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_precision, 6) AS macro_precision,
      round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1,
      round((accuracy - pe) / nullif(1 - pe, 0), 6) AS kappa FROM s"""


@query(summary_sql(False), V.PRED)
def multiclass_summary_defined(spark, sf_dir):
    """Macro means over the classes that have a value."""
    return rounded(M.summary(M.confusion_matrix(predictions(spark, sf_dir), "truth", "pred")))


@query(summary_sql(True), V.PRED)
def multiclass_summary_zero(spark, sf_dir):
    """Macro means with 0 for a class without a value."""
    return rounded(M.summary(M.confusion_matrix(predictions(spark, sf_dir), "truth", "pred"), undefined=0.0))


@query(
    """, k AS (SELECT c, count(*) FILTER (truth = c) AS nt, count(*) FILTER (pred = c) AS np, count(*) FILTER (truth = c AND pred = c) AS h FROM pred, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c),
    d AS (SELECT CAST(c AS VARCHAR) AS class, coalesce(2 * h / nullif(nt + np, 0)::DOUBLE, 0) AS dice FROM k)
    SELECT class, round(dice, 6) AS dice FROM d UNION ALL SELECT 'macro', round(avg(dice), 6) FROM d""",
    V.PRED,
)
def dice_scores(spark, sf_dir):
    return rounded(M.dice(predictions(spark, sf_dir), "truth", "pred"))


@query(
    """SELECT source, round(avg((p_nevus - (truth = 0)::INT) ** 2 + (p_mel - (truth = 1)::INT) ** 2 + (p_atyp - (truth = 2)::INT) ** 2), 6) AS brier_multiclass,
      round(avg((p_mel - y) ** 2), 6) AS brier, round(avg(-ln(least(greatest([p_nevus, p_mel, p_atyp][truth + 1], 1e-15), 1 - 1e-15))), 6) AS log_loss,
      round(avg(-(p_nevus * ln(p_nevus + 1e-12) + p_mel * ln(p_mel + 1e-12) + p_atyp * ln(p_atyp + 1e-12))), 6) AS entropy
    FROM pred GROUP BY source""",
    P,
)
def proper_scores(spark, sf_dir):
    p = [F.col(c) for c in ("p_nevus", "p_mel", "p_atyp")]
    y = F.col("y")
    return rounded(
        predictions(spark, sf_dir)
        .groupBy("source")
        .agg(
            F.avg(K.brier(p, F.col("truth"))).alias("brier_multiclass"),
            F.avg((F.col("p_mel") - y) * (F.col("p_mel") - y)).alias("brier"),
            F.avg(K.log_loss(p, F.col("truth"))).alias("log_loss"),
            F.avg(K.entropy(F.array(*p))).alias("entropy"),
        )
    )


TOP = "greatest(p_nevus, p_mel, p_atyp)"


@query(
    f""", b AS (SELECT least(floor({TOP} * 15), 14) AS bin, count(*) AS n, avg({TOP}) AS conf, avg((pred = truth)::INT) AS acc FROM pred GROUP BY 1)
    SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece, round(max(abs(conf - acc)), 6) AS mce FROM b""",
    V.PRED,
)
def ece_15(spark, sf_dir):
    top = F.greatest("p_nevus", "p_mel", "p_atyp")
    return rounded(K.calibration_errors(predictions(spark, sf_dir), top, F.col("pred") == F.col("truth"), 15))


def bins_sql(name: str, conf: str, obs: str) -> str:
    return f"""SELECT '{name}' AS calibration_type, CAST(g.bin + 1 AS INT) AS bin, round(g.bin / 10.0::DOUBLE, 6) AS lower_inclusive, round((g.bin + 1) / 10.0::DOUBLE, 6) AS upper_inclusive_for_last,
      count(q.c) AS n, round(avg(q.c), 6) AS mean_predicted, round(avg(q.o), 6) AS observed_frequency, round(abs(avg(q.c) - avg(q.o)), 6) AS absolute_gap
    FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN (SELECT {conf} AS c, ({obs})::INT::DOUBLE AS o, least(floor({conf} * 10), 9) AS bin FROM pred) q ON q.bin = g.bin GROUP BY g.bin"""


@query(f" {bins_sql('top_label', TOP, 'pred = truth')} UNION ALL {bins_sql('melanoma_ovr', 'p_mel', 'y = 1')}", P)
def calibration_table(spark, sf_dir):
    df = predictions(spark, sf_dir)
    parts = {
        "top_label": K.calibration_table(df, F.greatest("p_nevus", "p_mel", "p_atyp"), F.col("pred") == F.col("truth")),
        "melanoma_ovr": K.calibration_table(df, F.col("p_mel"), F.col("y") == 1),
    }
    return rounded(reduce(DataFrame.unionByName, [t.withColumn("calibration_type", F.lit(k)) for k, t in parts.items()]))


@query(
    """, e AS (SELECT quantile_cont(p_mel, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM pred),
    b AS (SELECT len(list_filter(edges, lambda x: x < p_mel)) AS bin, p_mel, y FROM pred, e)
    SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(p_mel), 6) AS mean_predicted, round(avg(y), 6) AS observed_frequency FROM b GROUP BY 1""",
    V.PRED,
)
def quantile_calibration(spark, sf_dir):
    return rounded(K.quantile_calibration(predictions(spark, sf_dir), "p_mel", "y"))


@query(
    """, t AS (SELECT CAST(k AS INT) AS k, k / 100.0::DOUBLE AS threshold FROM (SELECT unnest(range(1, 100)) AS k)),
    n AS (SELECT k, threshold, count(*) FILTER (p_mel >= threshold AND y = 1) AS tp, count(*) FILTER (p_mel >= threshold AND y = 0) AS fp, count(*)::DOUBLE AS n, sum(y) AS pos FROM t, pred GROUP BY ALL)
    SELECT k, round(threshold, 6) AS threshold, round(tp / n - fp / n * threshold / (1 - threshold), 6) AS net_benefit,
      round(pos / n - (1 - pos / n) * threshold / (1 - threshold), 6) AS treat_all FROM n""",
    V.PRED,
)
def decision_curve(spark, sf_dir):
    return rounded(K.decision_curve(predictions(spark, sf_dir), "p_mel", "y"))


@query(
    f""", c AS (SELECT unnest([0.0, 0.02, 0.05, 0.1, 0.2])::DOUBLE AS cut),
    r AS (SELECT cut, coverage >= cut AS keep, p_mel >= {T} AS pred, y = 1 AS pos FROM c, pred)
    SELECT cut, 'drop' AS mode, count(*) FILTER (keep) AS n_scored, count(*) FILTER (NOT keep) AS n_abstain, count(*) FILTER (NOT keep AND pos) AS pos_abstained,
      count(*) FILTER (keep AND pred AND pos) AS tp, count(*) FILTER (keep AND pred AND NOT pos) AS fp, count(*) FILTER (keep AND NOT pred AND pos) AS fn, count(*) FILTER (keep AND NOT pred AND NOT pos) AS tn
    FROM r GROUP BY cut
    UNION ALL SELECT cut, 'review', count(*), count(*) FILTER (NOT keep), count(*) FILTER (NOT keep AND pos), count(*) FILTER ((pred OR NOT keep) AND pos), count(*) FILTER ((pred OR NOT keep) AND NOT pos),
      count(*) FILTER (NOT (pred OR NOT keep) AND pos), count(*) FILTER (NOT (pred OR NOT keep) AND NOT pos) FROM r WHERE cut > 0 GROUP BY cut""",
    V.PRED,
)
def abstention_table(spark, sf_dir):
    return K.abstention(predictions(spark, sf_dir), "p_mel", "y", "coverage", T)


@query(
    f""", r AS (SELECT row_number() OVER (ORDER BY abs(p_mel - {T}), row_index) AS k, count(*) OVER () AS n, (p_mel >= {T}) <> (y = 1) AS wrong FROM pred),
    s AS (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.3])::DOUBLE AS share)
    SELECT share, count(*) FILTER (k > round_even(share * n, 0)) AS n_kept, count(*) FILTER (k > round_even(share * n, 0) AND wrong) AS errors,
      round(count(*) FILTER (k > round_even(share * n, 0) AND wrong) / greatest(count(*) FILTER (k > round_even(share * n, 0)), 1)::DOUBLE, 6) AS risk
    FROM s, r GROUP BY share""",
    V.PRED,
)
def risk_coverage(spark, sf_dir):
    return rounded(K.risk_coverage(predictions(spark, sf_dir), "p_mel", "y", T, "row_index"))


@query(
    f"""SELECT source, truth, count(*) AS n, count(*) FILTER (p_mel >= {T}) AS flagged, count(*) FILTER (p_mel >= {T} OR p_atyp >= 0.412) AS not_benign,
      count(*) FILTER (coverage < 0.05) AS low_quality, round(median(coverage), 6) AS median_coverage, count(*) FILTER (coverage < 0.01) AS below_1pct, count(*) FILTER (coverage > 0.85) AS above_85pct
    FROM pred GROUP BY ALL""",
    P,
)
def flag_rates(spark, sf_dir):
    p = predictions(spark, sf_dir)
    counts = p.groupBy("source", "truth").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("p_mel") >= T).alias("flagged"),
        F.count_if(C.non_benign(F.col("p_mel"), F.col("p_atyp"), F.lit(T), F.lit(C.THRESHOLDS["atypical"]))).alias("not_benign"),
        F.count_if(C.low_quality(F.col("coverage"))).alias("low_quality"),
        F.count_if(F.col("coverage") < 0.01).alias("below_1pct"),
        F.count_if(F.col("coverage") > 0.85).alias("above_85pct"),
    )
    # Few groups hold all rows: their medians come from running counts.
    medians = Q.quantiles(p, "coverage", {"median_coverage": 0.5}, ["source", "truth"])
    return rounded(counts.join(medians, ["source", "truth"]))


@query(
    "SELECT row_index, rank() OVER (ORDER BY s_a) + (count(*) OVER (PARTITION BY s_a) - 1) / 2.0::DOUBLE AS midrank FROM pred",
    P,
)
def midrank(spark, sf_dir):
    return Q.midranks(predictions(spark, sf_dir).select("row_index", "s_a"), "s_a").select("row_index", F.col("midrank").cast("double").alias("midrank"))


AUC = """pl AS (SELECT *, ({s}) AS s FROM pred),
v AS (SELECT {by} y, (SELECT 1) AS one, (sum(1 - y) OVER (PARTITION BY {part} ORDER BY s) - sum(1 - y) OVER (PARTITION BY {part}, s) / 2.0::DOUBLE) / nullif(sum(1 - y) OVER (PARTITION BY {part}), 0) AS v01,
  1 - (sum(y) OVER (PARTITION BY {part} ORDER BY s) - sum(y) OVER (PARTITION BY {part}, s) / 2.0::DOUBLE) / nullif(sum(y) OVER (PARTITION BY {part}), 0) AS v10 FROM pl)"""


@query(
    ", "
    + AUC.format(s="s_a", by="source,", part="source")
    + """, a AS (SELECT source, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, avg(v01) FILTER (y = 1) AS auc,
      coalesce(var_samp(v01) FILTER (y = 1), 0) / count(*) FILTER (y = 1) + coalesce(var_samp(v10) FILTER (y = 0), 0) / count(*) FILTER (y = 0) AS var FROM v GROUP BY source)
    SELECT source, n_pos, n_neg, round(auc, 6) AS auc, round(var, 9) AS var, round(greatest(0, auc - 1.959963984540054 * sqrt(var)), 6) AS ci_low,
      round(least(1, auc + 1.959963984540054 * sqrt(var)), 6) AS ci_high FROM a""",
    V.PRED,
)
def delong_by_source(spark, sf_dir):
    a = Q.roc_auc(predictions(spark, sf_dir), "s_a", "y", ["source"])
    return rounded(a.drop("var")).join(a.select("source", F.round("var", 9).alias("var")), "source")


@query(
    """, pa AS (SELECT row_index, y, (sum(1 - y) OVER (ORDER BY s_a) - sum(1 - y) OVER (PARTITION BY s_a) / 2.0::DOUBLE) / sum(1 - y) OVER () AS p_a,
      1 - (sum(y) OVER (ORDER BY s_a) - sum(y) OVER (PARTITION BY s_a) / 2.0::DOUBLE) / sum(y) OVER () AS n_a,
      (sum(1 - y) OVER (ORDER BY s_b) - sum(1 - y) OVER (PARTITION BY s_b) / 2.0::DOUBLE) / sum(1 - y) OVER () AS p_b,
      1 - (sum(y) OVER (ORDER BY s_b) - sum(y) OVER (PARTITION BY s_b) / 2.0::DOUBLE) / sum(y) OVER () AS n_b FROM pred),
    q AS (SELECT avg(p_a) FILTER (y = 1) AS a, avg(p_b) FILTER (y = 1) AS b,
      var_samp(p_b - p_a) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(n_b - n_a) FILTER (y = 0) / count(*) FILTER (y = 0) AS var FROM pa)
    SELECT round(a, 6) AS auc_base, round(b, 6) AS auc_new, round(b - a, 6) AS delta, round(sqrt(var), 6) AS se, round((b - a) / sqrt(var), 6) AS z FROM q""",
    V.PRED,
)
def paired_delong(spark, sf_dir):
    d = Q.paired_delong(predictions(spark, sf_dir), "s_a", "s_b", "y")
    return rounded(d.select("auc_base", "auc_new", "delta", F.sqrt("var").alias("se"), "z"))


@query(
    """, l AS (SELECT c AS class, (truth = c)::INT AS y, CASE c WHEN 0 THEN p_nevus WHEN 1 THEN p_mel ELSE p_atyp END AS s FROM pred, (SELECT unnest([0, 1, 2]) AS c)),
    v AS (SELECT class, y, (sum(1 - y) OVER (PARTITION BY class ORDER BY s) - sum(1 - y) OVER (PARTITION BY class, s) / 2.0::DOUBLE) / sum(1 - y) OVER (PARTITION BY class) AS v FROM l),
    a AS (SELECT class, count(*) FILTER (y = 1) AS n_pos, avg(v) FILTER (y = 1) AS auc FROM v GROUP BY class)
    SELECT CAST(class AS VARCHAR) AS class, round(auc, 6) AS auc FROM a UNION ALL SELECT 'macro', round(avg(auc), 6) FROM a
    UNION ALL SELECT 'weighted', round(sum(auc * n_pos) / sum(n_pos), 6) FROM a""",
    V.PRED,
)
def ovr_auc(spark, sf_dir):
    """One-vs-rest AUC per class, their mean over classes that have one, and weighted by class size."""
    p = predictions(spark, sf_dir)
    c = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(n).alias("s")) for k, n in enumerate(("p_nevus", "p_mel", "p_atyp"))]))
    long = p.select("truth", c.alias("c")).select("c.*", (F.col("truth") == F.col("c.class")).cast("int").alias("y"))
    a = Q.roc_auc(long, "s", "y", ["class"])
    rows = a.select(F.col("class").cast("string").alias("class"), "auc")
    macro = a.agg(F.avg("auc").alias("auc")).select(F.lit("macro").alias("class"), "auc")
    weighted = a.agg((F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("auc")).select(F.lit("weighted").alias("class"), "auc")
    return rounded(rows.unionByName(macro).unionByName(weighted))


ROC = """r AS (SELECT s_a AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM pred GROUP BY 1),
roc AS (SELECT threshold, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM r WINDOW w AS (ORDER BY threshold DESC))"""


@query(
    f""", {ROC} SELECT round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(np - tp AS BIGINT) AS fn, CAST(nn - fp AS BIGINT) AS tn,
      round(tp / np::DOUBLE, 6) AS tpr, round(fp / nn::DOUBLE, 6) AS fpr, round(tp / (tp + fp)::DOUBLE, 6) AS precision FROM roc""",
    V.PRED,
)
def roc_points(spark, sf_dir):
    return rounded(Q.roc_points(predictions(spark, sf_dir), "s_a", "y").drop("pos"))


@query(f", {ROC} SELECT round(sum(pos * tp / (tp + fp)::DOUBLE) / max(np), 6) AS ap FROM roc", V.PRED)
def average_precision(spark, sf_dir):
    return rounded(Q.average_precision(predictions(spark, sf_dir), "s_a", "y"))


J = "round(tp / np::DOUBLE + 1 - fp / nn::DOUBLE - 1, 9)"


@query(
    f""", {ROC}, j AS (SELECT threshold, {J} AS j FROM roc)
    SELECT 'youden_lowest' AS rule, round(min(threshold), 6) AS threshold FROM j WHERE j = (SELECT max(j) FROM j)
    UNION ALL SELECT 'youden_highest', round(max(threshold), 6) FROM j WHERE j = (SELECT max(j) FROM j)
    UNION ALL SELECT 'spec_90_first', round(max(threshold), 6) FROM roc WHERE 1 - fp / nn::DOUBLE >= 0.9 AND tp = (SELECT max(tp) FROM roc WHERE 1 - fp / nn::DOUBLE >= 0.9)
    UNION ALL (SELECT 'spec_90_lexicographic', round(threshold, 6) FROM roc WHERE 1 - fp / nn::DOUBLE >= 0.9 ORDER BY tp DESC, fp, threshold DESC LIMIT 1)
    UNION ALL SELECT 'sens_80', round(coalesce(max(threshold), 0), 6) FROM roc WHERE tp / np::DOUBLE >= 0.8""",
    V.PRED,
)
def operating_points(spark, sf_dir):
    p = predictions(spark, sf_dir)
    at = {"points": Q.roc_points(p, "s_a", "y")}  # all rules look at the same points
    rules = {
        "youden_lowest": Q.youden_threshold(p, "s_a", "y", **at),
        "youden_highest": Q.youden_threshold(p, "s_a", "y", ties="highest", **at),
        "spec_90_first": Q.threshold_for_specificity(p, "s_a", "y", 0.9, **at),
        "spec_90_lexicographic": Q.threshold_for_specificity(p, "s_a", "y", 0.9, ties="lexicographic", **at),
        "sens_80": Q.threshold_for_sensitivity(p, "s_a", "y", 0.8, **at),
    }
    return rounded(reduce(DataFrame.unionByName, [t.select(F.lit(k).alias("rule"), "threshold") for k, t in rules.items()]))


#: Metrics of a cohort: what is counted, of which rows, and the method of the interval.
SHARES = {"sens": ("tp", "n_pos"), "spec": ("tn", "n_neg"), "nb_sens": ("nb_tp", "n_pos"), "nb_spec": ("nb_tn", "n_neg")}
NO_INTERVAL, WILSON_95, DELONG_95 = "none", "Wilson 95%", "DeLong 95%"


def block_ctes(unit: str, src: str) -> str:
    """Counts, AUC with its variance and average precision of one unit, a row each."""
    nb = "(p_mel >= 0.188 OR p_atyp >= 0.412)"
    return f"""k_{unit} AS (SELECT count(*) AS n, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, avg((p_mel - y) ** 2) AS brier,
      count(*) FILTER (y = 1 AND p_mel >= 0.188) AS tp, count(*) FILTER (y = 0 AND p_mel < 0.188) AS tn,
      count(*) FILTER (y = 1 AND {nb}) AS nb_tp, count(*) FILTER (y = 0 AND NOT {nb}) AS nb_tn FROM {src}),
    v_{unit} AS (SELECT y, (sum(1 - y) OVER (ORDER BY p_mel) - sum(1 - y) OVER (PARTITION BY p_mel) / 2.0::DOUBLE) / nullif(sum(1 - y) OVER (), 0) AS v01,
      1 - (sum(y) OVER (ORDER BY p_mel) - sum(y) OVER (PARTITION BY p_mel) / 2.0::DOUBLE) / nullif(sum(y) OVER (), 0) AS v10 FROM {src}),
    a_{unit} AS (SELECT avg(v01) FILTER (y = 1) AS auc, 1.959963984540054 * sqrt(coalesce(var_samp(v01) FILTER (y = 1), 0) / nullif(count(*) FILTER (y = 1), 0)
      + coalesce(var_samp(v10) FILTER (y = 0), 0) / nullif(count(*) FILTER (y = 0), 0)) AS h FROM v_{unit}),
    g_{unit} AS (SELECT p_mel, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY 1),
    r_{unit} AS (SELECT pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g_{unit} WINDOW w AS (ORDER BY p_mel DESC)),
    p_{unit} AS (SELECT sum(pos * tp / (tp + fp)::DOUBLE) / nullif(sum(pos), 0) AS ap FROM r_{unit})"""


def block_sql(unit: str) -> str:
    row = lambda metric, value, n, low="NULL::DOUBLE", high="NULL::DOUBLE", how=NO_INTERVAL: (
        f"SELECT '{unit}' AS unit, '{metric}' AS metric, round(({value})::DOUBLE, 6) AS estimate, {low} AS ci95_low, {high} AS ci95_high, "
        f"'{how}' AS ci_method, CAST({n} AS BIGINT) AS denominator_n FROM k_{unit}, a_{unit}, p_{unit}"
    )
    both = "n_pos > 0 AND n_neg > 0"
    out = [row(k, k, "n") for k in ("n", "n_pos", "n_neg", "brier")]
    out.append(row("auc", "auc", "n", "CASE WHEN auc IS NOT NULL THEN round(greatest(0, auc - h), 6) END", "CASE WHEN auc IS NOT NULL THEN round(least(1, auc + h), 6) END", DELONG_95))
    out.append(row("ap", f"CASE WHEN {both} THEN ap END", "n"))
    for miss, hit, n in (("fn", "tp", "n_pos"), ("fp", "tn", "n_neg"), ("nb_fn", "nb_tp", "n_pos"), ("nb_fp", "nb_tn", "n_neg")):
        out += [row(hit, hit, n), row(miss, f"{n} - {hit}", n)]
    for metric, (hit, n) in SHARES.items():
        out.append(row(metric, f"{hit} / nullif({n}, 0)::DOUBLE", n, *wilson_sql(hit, n), how=WILSON_95))
    return " UNION ALL ".join(out)


PATIENTS = "pt AS (SELECT patient_id, count(*) AS n_images, max(y) AS y, max(p_mel) AS p_mel, min(p_nevus) AS p_nevus, max(p_atyp) AS p_atyp, median(coverage) AS coverage FROM pred GROUP BY 1)"


@query(f", {PATIENTS} SELECT patient_id, n_images, y, round(p_mel, 6) AS p_mel, round(p_nevus, 6) AS p_nevus, round(p_atyp, 6) AS p_atyp, round(coverage, 6) AS coverage FROM pt", V.PRED)
def prediction_patients(spark, sf_dir):
    return rounded(per_patient(predictions(spark, sf_dir)))


def per_patient(p: DataFrame) -> DataFrame:
    """One row per patient: worst case of the scores, median coverage."""
    return p.groupBy("patient_id").agg(
        F.count("*").alias("n_images"), F.max("y").alias("y"), F.max("p_mel").alias("p_mel"), F.min("p_nevus").alias("p_nevus"),
        F.max("p_atyp").alias("p_atyp"), F.median("coverage").alias("coverage"),
    )


def metric_block(p: DataFrame, unit: str) -> DataFrame:
    """Long table of a cohort's metrics at the fixed thresholds, with intervals where they are defined.

    Columns are ``unit, metric, estimate, ci95_low, ci95_high, ci_method, denominator_n``. AUC and
    average precision are null where a class has no row, as are shares of no rows.
    """
    pos, neg, pred = F.col("y") == 1, F.col("y") == 0, F.col("p_mel") >= T
    nb = C.non_benign(F.col("p_mel"), F.col("p_atyp"), F.lit(T), F.lit(C.THRESHOLDS["atypical"]))
    wide = p.agg(
        F.count("*").alias("n"), F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg"),
        F.avg((F.col("p_mel") - F.col("y")) * (F.col("p_mel") - F.col("y"))).alias("brier"),
        F.count_if(pos & pred).alias("tp"), F.count_if(neg & ~pred).alias("tn"), F.count_if(pos & nb).alias("nb_tp"), F.count_if(neg & ~nb).alias("nb_tn"),
    )
    # Each side has one row.
    auc = Q.roc_auc(p, "p_mel", "y").select("auc", "ci_low", "ci_high")
    wide = wide.crossJoin(F.broadcast(auc)).crossJoin(F.broadcast(Q.average_precision(p, "p_mel", "y")))

    def row(metric, value, n, low=None, high=None, how=NO_INTERVAL):
        bounds = [F.lit(c).cast("double").alias(name) for c, name in ((low, "ci95_low"), (high, "ci95_high"))]
        estimate = value.cast("double").alias("estimate")
        return F.struct(F.lit(metric).alias("metric"), estimate, *bounds, F.lit(how).alias("ci_method"), F.col(n).alias("denominator_n"))

    rows = [row(k, F.col(k), "n") for k in ("n", "n_pos", "n_neg", "brier")]
    rows.append(row("auc", F.col("auc"), "n", F.col("ci_low"), F.col("ci_high"), DELONG_95))
    rows.append(row("ap", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("ap")), "n"))
    for miss, hit, n in (("fn", "tp", "n_pos"), ("fp", "tn", "n_neg"), ("nb_fn", "nb_tp", "n_pos"), ("nb_fp", "nb_tn", "n_neg")):
        rows += [row(hit, F.col(hit), n), row(miss, F.col(n) - F.col(hit), n)]
    for metric, (hit, n) in SHARES.items():
        rows.append(row(metric, Q.ratio(F.col(hit), F.col(n)), n, *M.wilson(F.col(hit), F.col(n)), WILSON_95))
    return wide.select(F.inline(F.array(*rows))).select(F.lit(unit).alias("unit"), "*")


@query(f", {PATIENTS}, {block_ctes('file', 'pred')}, {block_ctes('patient', 'pt')} {block_sql('file')} UNION ALL {block_sql('patient')}", V.PRED)
def metric_registry(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return rounded(metric_block(p, "file").unionByName(metric_block(per_patient(p), "patient")))


@query(
    """, f AS (SELECT feature, value, y FROM (SELECT y, p_nevus, p_atyp, coverage FROM pred) UNPIVOT (value FOR feature IN (p_nevus, p_atyp, coverage))),
    v AS (SELECT feature, y, (sum(1 - y) OVER (PARTITION BY feature ORDER BY value) - sum(1 - y) OVER (PARTITION BY feature, value) / 2.0::DOUBLE) / sum(1 - y) OVER (PARTITION BY feature) AS v FROM f),
    a AS (SELECT feature, avg(v) FILTER (y = 1) AS auc FROM v GROUP BY 1)
    SELECT feature, round(greatest(auc, 1 - auc), 6) AS oriented_auc, round(abs(auc - 0.5), 6) AS deviation FROM a""",
    V.PRED,
)
def oriented_auc(spark, sf_dir):
    f = predictions(spark, sf_dir).unpivot(["y"], ["p_nevus", "p_atyp", "coverage"], "feature", "value").where(~F.isnan("value"))
    a = Q.roc_auc(f, "value", "y", ["feature"])
    return rounded(a.select("feature", F.greatest("auc", 1 - F.col("auc")).alias("oriented_auc"), F.abs(F.col("auc") - 0.5).alias("deviation")))


@query(
    """, p AS (SELECT row_index, (row_index * 37 % 101) / 100.0::DOUBLE AS p, source FROM pred), r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY p) + count(*) OVER (PARTITION BY source, p) - 1 AS rk, count(*) OVER (PARTITION BY source) AS m FROM p)
    SELECT row_index, source, p, round(least(1, min(p * m / rk) OVER (PARTITION BY source ORDER BY p DESC)), 6) AS q FROM r""",
    V.PRED,
)
def bh_fdr(spark, sf_dir):
    p = predictions(spark, sf_dir).selectExpr("row_index", "source", "(row_index * 37 % 101) / 100D p")
    return rounded(Q.bh_fdr(p, "p", ["source"]))


@query(
    """SELECT source, count(*) FILTER (a AND NOT b) AS b_base_only, count(*) FILTER (b AND NOT a) AS c_new_only, count(*) FILTER (a AND b) AS both FROM (
      SELECT source, (s_a >= 0.5) = (y = 1) AS a, (s_b >= 0.5) = (y = 1) AS b FROM pred) GROUP BY source""",
    P,
)
def mcnemar_counts(spark, sf_dir):
    a, b = (((F.col(s) >= 0.5) == (F.col("y") == 1)) for s in ("s_a", "s_b"))
    return predictions(spark, sf_dir).groupBy("source").agg(
        F.count_if(a & ~b).alias("b_base_only"), F.count_if(b & ~a).alias("c_new_only"), F.count_if(a & b).alias("both")
    )


@query(
    """, j AS (SELECT a.row_index, a.truth, (a.p_nevus + b.p_nevus) / 2 AS e0, (a.p_mel + b.p_mel) / 2 AS e1, (a.p_atyp + b.p_atyp) / 2 AS e2
      FROM pred a JOIN pred b ON b.row_index = (a.row_index + 1) % (SELECT count(*) FROM pred))
    SELECT row_index, round(e0, 6) AS p_nevus, round(e1, 6) AS p_mel, round(e2, 6) AS p_atyp,
      CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END AS pred FROM j""",
    V.PRED,
)
def two_view_ensemble(spark, sf_dir):
    """Mean of the probability vectors of two views, joined by row index."""
    p = predictions(spark, sf_dir).select("row_index", F.array("p_nevus", "p_mel", "p_atyp").alias("p"))
    n = p.count()
    other = p.select(F.pmod(F.col("row_index") - 1, F.lit(n)).alias("row_index"), F.col("p").alias("q"))
    e = p.join(other, "row_index").select("row_index", C.mean_vectors(F.col("p"), F.col("q")).alias("e"))
    return rounded(e.select("row_index", *[F.get("e", F.lit(k)).alias(c) for k, c in enumerate(("p_nevus", "p_mel", "p_atyp"))], C.argmax(F.col("e")).alias("pred")))


@query(
    """SELECT row_index, CASE WHEN truth = pred THEN 'correct' ELSE CAST(truth AS VARCHAR) || ' -> ' || CAST(pred AS VARCHAR) END AS transition,
      CASE WHEN truth = 2 AND pred = 2 THEN 'atypical_well' WHEN truth = 2 AND p_nevus > 0.997 THEN 'nevus_ceiling' ELSE 'other' END AS bucket,
      CASE WHEN coverage < 0.05 THEN 'segmentation' WHEN p_mel >= 0.1 THEN 'threshold' ELSE 'model' END AS cause FROM pred""",
    P,
)
def case_labels(spark, sf_dir):
    return predictions(spark, sf_dir).select(
        "row_index",
        C.error_transition(F.col("truth"), F.col("pred")).alias("transition"),
        C.case_bucket(F.col("truth"), F.col("pred"), F.col("p_nevus")).alias("bucket"),
        C.miss_cause(F.col("coverage"), F.col("p_mel"), 0.1).alias("cause"),
    )


@query(
    """, f AS (SELECT fold, count(*) FILTER (truth = pred) / count(*)::DOUBLE AS acc FROM pred GROUP BY fold)
    SELECT count(*) AS folds, round(avg(acc), 6) AS mean_accuracy, round(stddev_pop(acc), 6) AS std_accuracy FROM f""",
    V.PRED,
)
def fold_summary(spark, sf_dir):
    f = predictions(spark, sf_dir).groupBy("fold").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("acc"))
    return rounded(f.agg(F.count("*").alias("folds"), F.avg("acc").alias("mean_accuracy"), F.stddev_pop("acc").alias("std_accuracy")))


@query(
    """SELECT max(abs(p_nevus + p_mel + p_atyp - 1)) <= 1.1e-5 AS sums_to_one, count(*) FILTER (isnan(p_mel) OR isinf(p_mel)) AS not_finite, count(*) - count(DISTINCT row_index) AS repeated_keys FROM pred""",
    P,
)
def prediction_audit(spark, sf_dir):
    p = predictions(spark, sf_dir)
    s = F.col("p_nevus") + F.col("p_mel") + F.col("p_atyp")
    return p.agg(
        (F.max(F.abs(s - 1)) <= 1.1e-5).alias("sums_to_one"),
        F.count_if(F.isnan("p_mel") | (F.abs("p_mel") == float("inf"))).alias("not_finite"),
        (F.count("*") - F.countDistinct("row_index")).alias("repeated_keys"),
    )


@query(
    """, z AS (SELECT avg(p_mel) FILTER (truth = 0) AS mu, stddev_pop(p_mel) FILTER (truth = 0) AS sd, avg(p_mel) FILTER (truth = 1) AS mm FROM pred)
    SELECT row_index, round((CASE WHEN mm >= mu THEN 1 ELSE -1 END) * (p_mel - mu) / CASE WHEN sd = 0 THEN 1e-6 ELSE sd END, 6) AS z,
      CASE WHEN (CASE WHEN mm >= mu THEN 1 ELSE -1 END) * (p_mel - mu) / CASE WHEN sd = 0 THEN 1e-6 ELSE sd END >= 2.5 THEN 'high'
        WHEN (CASE WHEN mm >= mu THEN 1 ELSE -1 END) * (p_mel - mu) / CASE WHEN sd = 0 THEN 1e-6 ELSE sd END >= 1 THEN 'moderate' ELSE 'normal' END AS level
    FROM pred, z""",
    V.PRED,
)
def oriented_z_scores(spark, sf_dir):
    p = predictions(spark, sf_dir)
    base = benign_baseline(p, ["p_mel"])
    b = F.broadcast(base)  # a row per feature
    z = C.oriented_z(F.col("p_mel"), F.col("mean"), F.col("std"), F.col("sign"))
    return rounded(p.crossJoin(b).select("row_index", z.alias("z"), C.level(z).alias("level")))


def benign_baseline(p: DataFrame, features: list[str]) -> DataFrame:
    """Mean and deviation over the benign class, and the side on which the other class lies: a row per feature."""
    long = p.unpivot(["truth"], features, "feature", "value")
    v = lambda k: F.when(F.col("truth") == k, F.col("value"))
    g = long.groupBy("feature").agg(F.avg(v(0)).alias("mean"), F.stddev_pop(v(0)).alias("raw"), F.avg(v(1)).alias("other"))
    return g.select("feature", "mean", F.when(F.col("raw") == 0, 1e-6).otherwise(F.col("raw")).alias("std"), F.when(F.col("other") >= F.col("mean"), 1).otherwise(-1).alias("sign"))


@query(
    "SELECT feature, round(avg(value) FILTER (truth = 0), 6) AS mean, round(stddev_pop(value) FILTER (truth = 0), 6) AS std, CASE WHEN avg(value) FILTER (truth = 1) >= avg(value) FILTER (truth = 0) THEN 1 ELSE -1 END AS sign FROM (SELECT truth, p_nevus, p_mel, p_atyp, coverage FROM pred) UNPIVOT (value FOR feature IN (p_nevus, p_mel, p_atyp, coverage)) GROUP BY feature",
    P,
)
def benign_baseline_table(spark, sf_dir):
    return rounded(benign_baseline(predictions(spark, sf_dir), ["p_nevus", "p_mel", "p_atyp", "coverage"]))


@query(
    """, h AS (SELECT row_index, p_nevus AS a0, p_mel AS a1, p_atyp AS a2, s_a AS b1, (1 - s_a) / 2 AS b0 FROM pred),
    w AS (SELECT *, 1 / (-(a0 * ln(a0 + 1e-12) + a1 * ln(a1 + 1e-12) + a2 * ln(a2 + 1e-12)) + 1e-12) AS wa, 1 / (-(b0 * ln(b0 + 1e-12) + b1 * ln(b1 + 1e-12) + b0 * ln(b0 + 1e-12)) + 1e-12) AS wb FROM h)
    SELECT row_index, round((wa * a0 + wb * b0) / (wa + wb), 5) AS f0, round((wa * a1 + wb * b1) / (wa + wb), 5) AS f1 FROM w""",
    V.PRED,
)
def entropy_fusion(spark, sf_dir):
    b0 = (1 - F.col("s_a")) / 2
    e = C.entropy_fused(F.array("p_nevus", "p_mel", "p_atyp"), F.array(b0, F.col("s_a"), b0))
    return rounded(predictions(spark, sf_dir).select("row_index", e.alias("e")).select("row_index", F.get("e", F.lit(0)).alias("f0"), F.get("e", F.lit(1)).alias("f1")), 5)


@query(
    """, n AS (SELECT avg(p_mel) AS m, stddev_pop(p_mel) AS s FROM pred)
    SELECT row_index, round((p_mel - m) / nullif(s, 0), 6) AS z FROM pred, n""",
    V.PRED,
)
def standard_scores(spark, sf_dir):
    p = predictions(spark, sf_dir)
    n = F.broadcast(p.agg(F.avg("p_mel").alias("m"), F.stddev_pop("p_mel").alias("s")))  # one row
    return rounded(p.crossJoin(n).select("row_index", ((F.col("p_mel") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).alias("z")))


@query(
    """, s AS (SELECT source, row_index, rank() OVER (PARTITION BY source ORDER BY row_index) AS k FROM pred WHERE y = 1) SELECT source, row_index FROM s WHERE k <= 5""",
    V.PRED,
)
def first_per_class(spark, sf_dir):
    p = predictions(spark, sf_dir).where("y = 1").select("source", "row_index")
    return R.sample_per_class(p, "source", F.col("row_index"), n=5)
