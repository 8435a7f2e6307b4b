"""Queries of feature columns and of two variants of a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortal.operators import demo as D
from cohortal.operators import features as X
from cohortal.plans import views as V
from cohortal.plans.registry import query
from cohortal.plans.views import predictions, rounded
from cohortal.session import table


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_discount FROM lineitem")
def prefix_columns(spark, sf_dir):
    """Columns by prefix and pattern, in the table's order within each."""
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", *X.columns_like(t, "l_ship*", r"l_(extended|disc).*"))


@query("SELECT row_index, truth, s_b AS s_a, 1 - coverage AS coverage, p_mel FROM (SELECT row_index, truth, round(s_b, 6) AS s_b, round(coverage, 6) AS coverage, round(p_mel, 6) AS p_mel FROM pred)", V.PRED + "\n")
def overwritten_columns(spark, sf_dir):
    """A block of columns replaced by that of another extraction at the same positions."""
    p = rounded(predictions(spark, sf_dir))
    other = p.select("row_index", F.col("s_b").alias("otsu_s_a"), (1 - F.col("coverage")).alias("otsu_coverage"))
    return X.overwritten(p.select("row_index", "truth", "s_a", "coverage", "p_mel"), other, ["s_a", "coverage"], prefix="otsu_")


@query(
    """SELECT l_returnflag, l_linenumber, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS std,
      round(CASE WHEN stddev_pop(q) = 0 THEN 0 ELSE avg((q - mu) ** 3) / stddev_pop(q) ** 3 END, 6) AS skew, round(CASE WHEN stddev_pop(q) = 0 THEN 0 ELSE avg((q - mu) ** 4) / stddev_pop(q) ** 4 - 3 END, 6) AS kurtosis,
      round(CASE WHEN stddev_pop(q) = 0 OR stddev_pop(d) = 0 THEN 1 ELSE corr(q, d) END, 6) AS pearson, round(CASE WHEN stddev_pop(q) = 0 THEN 0 ELSE regr_slope(d, q) END, 6) AS slope
    FROM (SELECT l_returnflag, l_linenumber, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d, avg(l_quantity::DOUBLE) OVER (PARTITION BY l_returnflag, l_linenumber) AS mu FROM lineitem) GROUP BY ALL"""
)
def group_statistics(spark, sf_dir):
    """Moments, correlation and slope per group, with values for constants."""
    s = X.statistics(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"))
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(*[c.alias(k) for k, c in s.items()]))


@query(
    """, v AS (SELECT split, y, """
    + ", ".join(
        f"(sum(1 - y) OVER (PARTITION BY split ORDER BY {k}) - sum(1 - y) OVER (PARTITION BY split, {k}) / 2.0::DOUBLE) / sum(1 - y) OVER (PARTITION BY split) AS p_{k}, "
        f"1 - (sum(y) OVER (PARTITION BY split ORDER BY {k}) - sum(y) OVER (PARTITION BY split, {k}) / 2.0::DOUBLE) / sum(y) OVER (PARTITION BY split) AS n_{k}"
        for k in ("s_a", "s_b")
    )
    + """, (s_a >= 0.3) = (y = 1) AS ra, (s_b >= 0.3) = (y = 1) AS rb FROM pred),
    d AS (SELECT split, avg(p_s_a) FILTER (y = 1) AS a, avg(p_s_b) FILTER (y = 1) AS b, var_samp(p_s_b - p_s_a) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(n_s_b - n_s_a) FILTER (y = 0) / count(*) FILTER (y = 0) AS var,
      count(*) FILTER (ra AND NOT rb) AS nb, count(*) FILTER (rb AND NOT ra) AS nc FROM v GROUP BY split),
    z AS (SELECT *, abs(b - a) / sqrt(2 * var) AS x FROM d)
    SELECT split, round(a, 6) AS auc_base, round(b, 6) AS auc_new, round(b - a, 6) AS delta_auc, round(b - a - 1.959963984540054 * sqrt(var), 6) AS ci95_low, round(b - a + 1.959963984540054 * sqrt(var), 6) AS ci95_high,
      round(1 - CASE WHEN x > 0 THEN exp(-x * x) * list_sum(list_transform(range(0, 300), lambda n: exp((2 * n + 1) * ln(x) - lgamma(n + 1.5)))) ELSE 0 END, 6) AS p_delong, nb AS b, nc AS c,
      round(least(1, 2 * list_sum(list_transform(range(0, least(nb, nc) + 1), lambda i: exp(lgamma(nb + nc + 1) - lgamma(i + 1) - lgamma(nb + nc - i + 1) - (nb + nc) * ln(2))))), 6) AS p_mcnemar FROM z""",
    V.PRED,
)
def confound_comparison(spark, sf_dir):
    """One score from two kinds of masks, per split: what the change of masks does."""
    return rounded(X.variant_comparison(predictions(spark, sf_dir), "y", "s_a", "s_b", 0.3, ["split"]))


NOW = 1_780_000_000_000
_U = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"


@query(
    f""", sh AS (SELECT *, row_number() OVER (ORDER BY {_U.format("'42|order|' || row_index")}, row_index) AS place FROM pred),
    n AS (SELECT count(*) AS n FROM sh), sz AS (SELECT p, [1, 2, 2, 3, 3, 4, 5][{_U.format("'42|size|' || p")} % 7 + 1] AS k FROM (SELECT unnest(range((SELECT n FROM n))) AS p)),
    sp AS (SELECT p, k, CAST(sum(k) OVER (ORDER BY p) AS BIGINT) AS stop FROM sz), ok AS (SELECT p, stop - k AS first, least(stop, n) - stop + k AS k, 45 + {_U.format("'42|window|' || p")} % 606 AS win FROM sp, n WHERE stop - k < n),
    d AS (SELECT p, first, win, unnest(range(1, CAST(k + 1 AS BIGINT))) AS i FROM ok), dd AS (SELECT p, first, win, {_U.format("'42|day|' || p || '|' || i")} % (win + 1) AS day FROM d),
    pl AS (SELECT p, first + row_number() OVER (PARTITION BY p ORDER BY day) AS place, {NOW} - win * 86400000 + day * 86400000 AS ts, win FROM dd)
    SELECT 'a_demo' || lpad(CAST(place AS VARCHAR), 12, '0') AS id, CAST(ts AS BIGINT) AS ts, 'p_demo' || lpad(CAST(p AS VARCHAR), 9, '0') AS patient_id, 'Patient ' || p AS name, CAST({_U.format("'42|sex|' || p")} % 2 AS INT) AS sex,
      CAST({_U.format("'42|sun|' || p")} % 4 AS INT) AS sun_exposure, [NULL, NULL, 'family history', 'many nevi', 'sun damage', 'earlier excision', 'fair skin'][{_U.format("'42|antecedents|' || p")} % 7 + 1] AS antecedents,
      CAST({NOW} - win * 86400000 AS BIGINT) AS created_ts, row_index AS image_id, pred AS pred_class, CASE WHEN p_mel >= 0.188 THEN 2 WHEN p_atyp >= 0.412 THEN 1 ELSE 0 END AS verdict,
      CASE WHEN coverage < 0.05 THEN 1 ELSE 0 END AS quality_flag, CASE WHEN place % 13 <> 0 THEN y END AS verified_class
    FROM pl JOIN sh USING (place)""",
    V.PRED,
)
def demo_store(spark, sf_dir):
    """A demonstration store: analyses with their patient and label."""
    s = D.demo_store(predictions(spark, sf_dir), "row_index", ["p_nevus", "p_mel", "p_atyp"], "truth", "coverage", NOW)
    people = s["patient"].select(F.col("id").alias("patient_id"), "name", "sex", "sun_exposure", "antecedents", "created_ts")
    labels = s["verified_label"].select(F.col("analysis_id").alias("id"), "verified_class")
    out = s["analysis"].join(people, "patient_id").join(labels, "id", "left")
    return out.select("id", "ts", "patient_id", "name", "sex", "sun_exposure", "antecedents", "created_ts", "image_id", "pred_class", "verdict", "quality_flag", "verified_class")
