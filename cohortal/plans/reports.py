"""Long and wide tables of a classifier's metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortal.operators import registry as G
from cohortal.operators.classify import THRESHOLDS
from cohortal.plans import cohorts as H
from cohortal.plans import views as V
from cohortal.plans.evaluation import wilson_sql
from cohortal.plans.registry import query
from cohortal.plans.views import predictions, rounded

T = THRESHOLDS["melanoma"]
NAMES = ("nevus", "melanoma", "atypical")
COLUMNS = ("p_nevus", "p_mel", "p_atyp")
SEED, METHOD = 42, f"stratified percentile bootstrap, {H.REPLICATES} replicates, seed 42"


def record_sql(scope: str, metric: str, estimate: str, n: str, source: str, name: str = "'all'", low: str = "NULL::DOUBLE", high: str = "NULL::DOUBLE", how: str = G.NONE, note: str = "") -> str:
    return (
        f"SELECT '{scope}' AS scope, {name} AS class, {metric} AS metric, round(({estimate})::DOUBLE, 6) AS estimate, {low} AS ci95_low, {high} AS ci95_high, "
        f"'{how}' AS ci_method, CAST({n} AS BIGINT) AS denominator_n, '{note}' AS note FROM {source}"
    )


def share_sql(scope: str, metric: str, hit: str, n: str, source: str, **more) -> str:
    low, high = wilson_sql(hit, n)
    return record_sql(scope, f"'{metric}'", f"({hit}) / nullif({n}, 0)::DOUBLE", n, source, low=low, high=high, how=G.WILSON, **more)


def rates_sql(scope: str, source: str, recall: str = "sensitivity", **more) -> list[str]:
    return [share_sql(scope, recall if k == "sensitivity" else k, h, n, source, **more) for k, (h, n) in G.RATES.items()]


def cells_sql(scope: str, source: str, **more) -> list[str]:
    return [record_sql(scope, f"'{k}'", k, n, source, **more) for k, n in G.CELLS.items()]


BINS = """SELECT '{name}' AS name, sum(n * abs(c - o)) / sum(n) AS ece, max(abs(c - o)) AS mce, sum(n) AS n FROM (
  SELECT least(floor({conf} * 10), 9) AS bin, count(*) AS n, avg({conf}) AS c, avg(({obs})::INT) AS o FROM pred GROUP BY 1)"""
F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)"
OVR, FIXED = {"name": "class", "note": G.ONE_REST}, {"name": "'melanoma'", "note": "Descriptive operating point."}
PARTS = [
    record_sql("global_argmax", "'n_images'", "n", "n", "tot"), record_sql("global_argmax", "'n_correct'", "hits", "n", "tot"), share_sql("global_argmax", "accuracy", "hits", "n", "tot"),
    record_sql("global_argmax", "metric", "own", "n", "seven, tot", low="round(low, 6)", high="round(high, 6)", how=METHOD, note=G.NAIVE),
    *[record_sql("calibration", f"'{k}_' || name", k, "n", "bins", note="10 equal-width probability bins.") for k in ("ece", "mce")],
    record_sql("per_class_argmax_ovr", "'support'", "tp + fn", "tp + fn", "ovr1", **OVR), *cells_sql("per_class_argmax_ovr", "ovr1", **OVR), *rates_sql("per_class_argmax_ovr", "ovr1", "sensitivity_recall", **OVR),
    record_sql("per_class_argmax_ovr", "'f1_dice'", F1, "n", "ovr1", **OVR),
    record_sql("per_class_argmax_ovr", "'auc_ovr'", "auc", "n", "ovr1", low="CASE WHEN auc IS NOT NULL THEN round(greatest(0, auc - h), 6) END", high="CASE WHEN auc IS NOT NULL THEN round(least(1, auc + h), 6) END", how=G.DELONG, **OVR),
    record_sql("per_class_argmax_ovr", "'average_precision_ovr'", "ap", "n", "ovr1", **OVR), record_sql("per_class_argmax_ovr", "'brier_ovr'", "brier", "n", "ovr1", **OVR),
    record_sql("melanoma_fixed_threshold", "'threshold'", f"{T}", "n", "fix", **FIXED), *cells_sql("melanoma_fixed_threshold", "fix", **FIXED), *rates_sql("melanoma_fixed_threshold", "fix", **FIXED),
    record_sql("melanoma_fixed_threshold", "'accuracy'", "(tp + tn) / nullif(n, 0)::DOUBLE", "n", "fix", **FIXED),
    record_sql("melanoma_fixed_threshold", "'balanced_accuracy'", "(tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(tn + fp, 0)::DOUBLE) / 2", "n", "fix", **FIXED), record_sql("melanoma_fixed_threshold", "'f1_dice'", F1, "n", "fix", **FIXED),
]
#: One class against the rest, with AUC by placements and average precision by thresholds.
REST = f"""lo AS (SELECT ['nevus', 'melanoma', 'atypical'][c + 1] AS class, (truth = c)::INT AS y, pred = c AS called, [p_nevus, p_mel, p_atyp][c + 1] AS s FROM pred, (SELECT unnest([0, 1, 2]) AS c)),
cnt AS (SELECT class, count(*) FILTER (y = 1 AND called) AS tp, count(*) FILTER (y = 0 AND called) AS fp, count(*) FILTER (y = 1 AND NOT called) AS fn, count(*) FILTER (y = 0 AND NOT called) AS tn, avg((s - y) ** 2) AS brier, count(*) AS n FROM lo GROUP BY 1),
pl AS (SELECT class, y, (sum(1 - y) OVER (PARTITION BY class ORDER BY s) - sum(1 - y) OVER (PARTITION BY class, s) / 2.0::DOUBLE) / nullif(sum(1 - y) OVER (PARTITION BY class), 0) AS v01,
  1 - (sum(y) OVER (PARTITION BY class ORDER BY s) - sum(y) OVER (PARTITION BY class, s) / 2.0::DOUBLE) / nullif(sum(y) OVER (PARTITION BY class), 0) AS v10 FROM lo),
au AS (SELECT class, avg(v01) FILTER (y = 1) AS auc, 1.959963984540054 * sqrt(coalesce(var_samp(v01) FILTER (y = 1), 0) / nullif(count(*) FILTER (y = 1), 0) + coalesce(var_samp(v10) FILTER (y = 0), 0) / nullif(count(*) FILTER (y = 0), 0)) AS h FROM pl GROUP BY 1),
th AS (SELECT class, s, sum(y) AS pos, count(*) AS every FROM lo GROUP BY ALL),
cu AS (SELECT class, pos, sum(pos) OVER w AS tp, sum(every) OVER w AS called FROM th WINDOW w AS (PARTITION BY class ORDER BY s DESC)),
ap AS (SELECT class, sum(pos * tp / called::DOUBLE) / nullif(sum(pos), 0) AS ap FROM cu GROUP BY 1),
ovr1 AS (SELECT * FROM cnt JOIN au USING (class) JOIN ap USING (class))"""


@query(
    H.stratified_sql("truth").replace("\n    boot AS (", "\n    drawn_ AS (") + ", boot AS (SELECT * FROM drawn_ UNION ALL SELECT placed.*, -1 AS rep, 1 AS w FROM placed)" + H.SEVEN.split("\n    SELECT metric")[0]
    + f""", tall AS (SELECT rep, metric, value FROM v UNPIVOT INCLUDE NULLS (value FOR metric IN (balanced_accuracy, macro_f1, weighted_f1, macro_auc_ovr, weighted_auc_ovr, log_loss, brier))),
    seven AS (SELECT metric, max(value) FILTER (rep < 0) AS own, quantile_cont(value, 0.025) FILTER (rep >= 0) AS low, quantile_cont(value, 0.975) FILTER (rep >= 0) AS high FROM tall GROUP BY metric),
    tot AS (SELECT count(*) AS n, count(*) FILTER (truth = pred) AS hits FROM pred), {REST},
    bins AS ({BINS.format(name="top_label", conf="greatest(p_nevus, p_mel, p_atyp)", obs="pred = truth")} UNION ALL {BINS.format(name="melanoma", conf="p_mel", obs="y = 1")}),
    fix AS (SELECT *, tp + fp + fn + tn AS n FROM (SELECT count(*) FILTER (p_mel >= {T} AND y = 1) AS tp, count(*) FILTER (p_mel >= {T} AND y = 0) AS fp, count(*) FILTER (p_mel < {T} AND y = 1) AS fn, count(*) FILTER (p_mel < {T} AND y = 0) AS tn FROM pred))
    """
    + " UNION ALL ".join(PARTS),
    V.PRED,
)
def class_registry(spark, sf_dir):
    """Metrics of a classifier of three classes by scope and class, with their intervals and what they are of."""
    p = predictions(spark, sf_dir)
    out = G.global_records(p, "row_index", "truth", "pred", COLUMNS, H.REPLICATES, SEED)
    out = out.unionByName(G.class_records(p, "truth", "pred", COLUMNS, NAMES)).unionByName(G.threshold_records(p, "y", "p_mel", T, "melanoma", note="Descriptive operating point."))
    confidences = {"top_label": (F.greatest(*COLUMNS), F.col("pred") == F.col("truth")), "melanoma": (F.col("p_mel"), F.col("y") == 1)}
    return rounded(out.unionByName(G.calibration_records(p, confidences)))


@query(
    f""", c AS (SELECT source, split, count(*) AS n, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, count(*) FILTER (p_mel >= {T} AND y = 1) AS tp, count(*) FILTER (p_mel >= {T} AND y = 0) AS fp,
      count(*) FILTER (p_mel < {T} AND y = 1) AS fn, count(*) FILTER (p_mel < {T} AND y = 0) AS tn, median(p_mel) FILTER (y = 1) AS med, avg((p_mel < 0.01)::INT) FILTER (y = 1) AS frac FROM pred GROUP BY ALL),
    v AS (SELECT source, split, y, (sum(1 - y) OVER (PARTITION BY source, split ORDER BY p_mel) - sum(1 - y) OVER (PARTITION BY source, split, p_mel) / 2.0::DOUBLE) / nullif(sum(1 - y) OVER (PARTITION BY source, split), 0) AS v FROM pred),
    a AS (SELECT source, split, avg(v) FILTER (y = 1) AS auc FROM v GROUP BY ALL),
    th AS (SELECT source, split, p_mel, sum(y) AS pos, count(*) AS every FROM pred GROUP BY ALL),
    cu AS (SELECT source, split, pos, sum(pos) OVER w AS tp, sum(every) OVER w AS called FROM th WINDOW w AS (PARTITION BY source, split ORDER BY p_mel DESC)),
    p AS (SELECT source, split, sum(pos * tp / called::DOUBLE) / nullif(sum(pos), 0) AS ap FROM cu GROUP BY ALL)
    SELECT source, split, n, n_pos, n_neg, round(auc, 6) AS auc, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round(ap, 6) END AS ap, {T}::DOUBLE AS threshold,
      round(tp / nullif(n_pos, 0)::DOUBLE, 6) AS sens, {wilson_sql("tp", "n_pos")[0]} AS sens_ci_low, {wilson_sql("tp", "n_pos")[1]} AS sens_ci_high,
      round(tn / nullif(n_neg, 0)::DOUBLE, 6) AS spec, {wilson_sql("tn", "n_neg")[0]} AS spec_ci_low, {wilson_sql("tn", "n_neg")[1]} AS spec_ci_high, tp, fn, tn, fp,
      round(med, 6) AS median_pos, round(frac, 6) AS frac_lt_0_01_pos
    FROM c JOIN a USING (source, split) JOIN p USING (source, split)""",
    V.PRED,
)
def metric_rows(spark, sf_dir):
    """A wide row of metrics per source and split."""
    return rounded(G.metric_rows(predictions(spark, sf_dir), "y", "p_mel", T, ["source", "split"]))
