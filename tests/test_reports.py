"""Feature columns, statistics, comparisons and metric tables at their edges."""

import pytest
from pyspark.sql import functions as F

from cohortal.operators import features as X
from cohortal.operators import registry as G


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "cnn_1 int, x int, cnnL_1 int, cnn_0 int")
    assert X.columns_like(df, "cnn_*") == ["cnn_1", "cnn_0"] and X.columns_like(df, r"cnn[L_].*", "x") == ["cnn_1", "cnnL_1", "cnn_0", "x"]
    with pytest.raises(ValueError, match="no column fits hc_"):
        X.columns_like(df, "hc_*")
    assert X.block_columns(["D", "A"]) == ["D", "A4"] and len(X.block_columns("ABCD")) == 18
    with pytest.raises(ValueError, match="unknown blocks: Z"):
        X.block_columns(["A", "Z"])


def test_overwritten_needs_the_same_positions(spark):
    df = spark.createDataFrame([(k, float(k), "a") for k in range(4)], "row_index long, B double, s string")
    other = df.select("row_index", (-F.col("B")).alias("otsu_B"))
    assert sorted((r.row_index, r.B, r.s) for r in X.overwritten(df, other, ["B"], prefix="otsu_").collect()) == [(k, -float(k), "a") for k in range(4)]
    with pytest.raises(ValueError, match="other: rows 1"):
        X.overwritten(df, other.where("row_index < 3"), ["B"], prefix="otsu_")
    with pytest.raises(ValueError, match="missing columns: B"):
        X.overwritten(df, other, ["B"])


def test_statistics_of_constants_and_single_rows(spark):
    rows = [("c", 2.0, 1.0), ("c", 2.0, 5.0), ("one", 3.0, 4.0), ("n", None, 1.0), ("v", 1.0, 2.0), ("v", 3.0, 1.0), ("v", 5.0, 0.0), ("v", None, 9.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in df.groupBy("g").agg(*[c.alias(k) for k, c in X.statistics(F.col("x"), F.col("y")).items()]).collect()}
    for g in ("c", "one"):
        assert (got[g]["skew"], got[g].kurtosis, got[g].pearson, got[g].slope) == (0.0, 0.0, 1.0, 0.0)
    assert got["v"].pearson == pytest.approx(-1) and got["v"].slope == pytest.approx(-0.5) and got["v"]["mean"] == 3
    assert got["n"]["mean"] is None and got["n"]["skew"] == 0.0


def test_variant_against_itself(spark):
    df = spark.createDataFrame([(k % 2, k / 20, k / 20) for k in range(20)] + [(None, 0.5, 0.5)], "y int, a double, b double")
    r = X.variant_comparison(df, "y", "a", "b", 0.5).first()
    assert (r.delta_auc, r.p_delong, r.b, r.c, r.p_mcnemar) == (0, None, 0, 0, 1.0)


def test_metric_rows_of_one_class(spark):
    df = spark.createDataFrame([("pos", 1, 0.005), ("pos", 1, 0.9), ("neg", 0, 0.2), ("both", 1, 0.3), ("both", 0, 0.1), ("both", None, 0.1)], "g string, y int, s double")
    got = {r.g: r for r in G.metric_rows(df, "y", "s", 0.188, ["g"]).collect()}
    assert (got["pos"].auc, got["pos"].ap, got["pos"].sens, got["pos"].spec, got["pos"].n_neg) == (None, None, 0.5, None, 0)
    assert (got["pos"].median_pos, got["pos"].frac_lt_0_01_pos) == (pytest.approx(0.4525), 0.5)
    assert (got["neg"].median_pos, got["neg"].frac_lt_0_01_pos, got["neg"].fp) == (None, None, 1)
    assert (got["both"].auc, got["both"].ap, got["both"].n) == (1.0, 1.0, 2)


def test_registry_of_a_class_without_rows(spark):
    rows = [(k, k % 2, (k // 2) % 2, 0.5 - k / 100, 0.4 + k / 100, 0.1) for k in range(30)] + [(99, None, 1, 0.2, 0.3, 0.5)]
    df = spark.createDataFrame(rows, "id long, t int, p int, a double, b double, c double")
    out = G.global_records(df, "id", "t", "p", ["a", "b", "c"], 20, 1).collect()
    got = {r.metric: r for r in out}
    assert got["n_images"].estimate == 30 and got["n_images"].denominator_n == 30
    assert got["macro_auc_ovr"].estimate is None and got["macro_auc_ovr"].ci95_low is None  # class 2 has no row
    assert got["log_loss"].ci95_low <= got["log_loss"].estimate <= got["log_loss"].ci95_high
    each = {(r["class"], r.metric): r for r in G.class_records(df, "t", "p", ["a", "b", "c"], ["n", "m", "x"]).collect()}
    assert len(each) == 39 and each["x", "support"].estimate == 0 and each["x", "auc_ovr"].estimate is None and each["x", "sensitivity_recall"].ci95_low is None
    assert each["n", "support"].estimate == 15 and each["x", "f1_dice"].estimate == 0
