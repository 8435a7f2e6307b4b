import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortal.operators import classify as C
from cohortal.operators import models as M


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3)) * [1, 5, 0.1]
    y = x @ [1.0, -0.5, 3.0] + rng.normal(size=60) + 4
    rows = [(k, *map(float, x[k]), float(y[k]), k % 4) for k in range(60)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, y double, fold int")
    got = {r.i: r.prediction for r in M.ridge_out_of_fold(df, ["a", "b", "c"], "y", "fold", 2.0).collect()}
    for k in range(4):
        tr, te = np.arange(60) % 4 != k, np.arange(60) % 4 == k
        mu, sd = x[tr].mean(0), x[tr].std(0)
        z, zt = (x[tr] - mu) / sd, (x[te] - mu) / sd
        w = np.linalg.solve(z.T @ z + 2.0 * np.eye(3), z.T @ (y[tr] - y[tr].mean()))
        for i, p in zip(np.flatnonzero(te), zt @ w + y[tr].mean(), strict=True):
            assert got[int(i)] == pytest.approx(p, rel=1e-3, abs=1e-3)
    r2 = M.r_squared(M.ridge_out_of_fold(df, ["a", "b", "c"], "y", "fold"), "y").first().r2
    assert 0.5 < r2 < 1
    assert M.r_squared(df.withColumn("prediction", F.lit(1.0)).withColumn("y", F.lit(2.0)), "y").first().r2 is None


def test_tree_heads_cover_every_row_once(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(k % 3 + rng.normal() / 5), 1.0], [float(-(k % 3) + rng.normal() / 5)], k % 3, k % 2) for k in range(90)]
    df = spark.createDataFrame(rows, "i int, v array<double>, w array<double>, y int, fold int")
    got = M.tree_head_out_of_fold(df, ["v", "w"], "y", "fold", trees=10, depth=4).collect()
    assert sorted(r.i for r in got) == list(range(90))
    assert all(sum(r.proba) == pytest.approx(1) and len(r.proba) == 3 for r in got)
    assert np.mean([int(np.argmax(r.proba)) == r.y for r in got]) > 0.9


def test_nested_folds_and_manifest(spark):
    df = spark.createDataFrame([(0, "a")] * 9 + [(1, "a")] * 9 + [(0, "b"), (1, "b"), (1, "b")], "fold int, y string")
    assert {r.fold: r.k for r in M.nested_folds(df, "fold", "y", "k").collect()} == {0: 2, 1: 1}
    old = {"bundle_id": "b1", "created": "2024-01-01", "components": [{"name": "u", "sha256": "x"}]}
    assert M.refreshed_manifest(old, {"u": "y"}, "b2", "2024-02-01")["components"][0]["sha256"] == "y"
    assert M.refreshed_manifest(old, {"u": "x"}, "b1", "2024-02-01")["bundle_id"] == "b1"
    for digests, name, day in (({"u": "y"}, "b1", "2024-02-01"), ({"q": "y"}, "b2", "2024-02-01"), ({}, "b1", "01.02.2024")):
        with pytest.raises(ValueError):
            M.refreshed_manifest(old, digests, name, day)


def test_bands_and_blocks(spark):
    df = spark.createDataFrame([("A4", 0.6, 0.5), ("D", 0.3, 0.5), ("Lab_a_std", 0.1, 0.7), ("B", 0.0, 0.5), ("fractal_D", None, None)], "n string, r double, a double")
    got = [tuple(r) for r in df.select(C.descriptor_block(F.col("n")), C.probing_verdict(F.col("r"), F.col("a"))).collect()]
    assert got == [("A", "encoded"), ("D", "partly encoded"), ("C", "independent signal"), ("B", "weak"), ("B", "weak")]
