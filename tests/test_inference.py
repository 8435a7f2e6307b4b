"""Networks from the library's own ONNX files, opened and run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortal.operators import inference as N
from cohortal.operators import picture as P
from cohortal.sources import binary, graphs

pytest.importorskip("onnxruntime")


def test_results_and_failures(spark):
    net = graphs.mean_over([1], ["n", 4], ["n"], False)
    rows = [(k, [float(k), 1.0, 2.0, 3.0]) for k in range(40)] + [(50, None), (51, [1.0]), (52, [float("nan")] * 4), (53, [1.0, None, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(2)
    got = {r.id: r.r for r in df.select("id", N.run_model(spark, net, F.col("v"), (4,), batch=8).alias("r")).collect()}
    assert all(got[k].error is None and got[k]["values"] == pytest.approx([(k + 6) / 4]) for k in range(40))
    assert got[50].error == "missing" and got[51].error == "ValueError: 1 values, not 4"
    assert "not finite" in got[52].error and got[53]["values"] is None and got[53].error
    broken = df.where("id < 3").select(N.run_model(spark, b"no model", F.col("v"), (4,)).alias("r")).collect()
    assert all(r.r["values"] is None and r.r.error for r in broken)


def test_trees_of_a_file_are_run_and_scanned(spark, tmp_path):
    """One tree file through the runtime and through the scan of its nodes."""
    tree = {"feature": [1, 0, 0], "mode": ["BRANCH_LEQ", "LEAF", "LEAF"], "value": [0.5, 0, 0], "true": [1, 0, 0], "false": [2, 0, 0], "leaf": [(1, 0, 0.75), (1, 1, 0.25), (2, 1, 1.0)]}
    head = graphs.tree_head([tree], 2, 2)
    (tmp_path / "a.onnx").write_bytes(head)
    assert N.read_model(spark, str(tmp_path / "a.onnx")) == head
    with pytest.raises(Exception, match="."):
        N.read_model(spark, str(tmp_path / "none.onnx"))
    nodes = binary.read_tree_nodes(spark, str(tmp_path)).orderBy("node_id").collect()
    assert [(r.feature_id, r.mode, r.value) for r in nodes] == [(1, "BRANCH_LEQ", 0.5), (0, "LEAF", 0.0), (0, "LEAF", 0.0)]
    df = spark.createDataFrame([(1, [9.0, 0.5]), (2, [9.0, 0.6])], "id long, v array<double>")
    got = {r.id: r.r["values"] for r in df.select("id", N.run_model(spark, head, F.col("v"), None, 1).alias("r")).collect()}
    assert got[1] == pytest.approx([0.75, 0.25]) and got[2] == pytest.approx([0.0, 1.0])


def chain(spark, n_hand=0):
    n = 3 + n_hand
    w = [[0.5 * (i + 1), -0.25 * i, 0.1] for i in range(n)]
    models = {
        "mask": graphs.mean_over([1], ["n", 3, 6, 6], ["n", 1, 6, 6], True), "lesion": graphs.mean_over([2, 3], ["n", 3, 4, 4], ["n", 3], False),
        "dehair": graphs.mean_over([2, 3], ["n", 3, 4, 4], ["n", 3], False), "trees_a": graphs.linear_head(w, [0.1, 0.2, 0.3]), "trees_c": graphs.linear_head([[-v for v in r] for r in w], [0.0, 0.4, 0.0]),
    }
    return models, np.array(w)


@pytest.mark.parametrize("hand", [False, True])
def test_the_whole_chain(spark, hand):
    rng = np.random.default_rng(2)
    models, w = chain(spark, 2 if hand else 0)
    rows, want = [], {}
    from tests.test_picture import bilinear

    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for k in range(20):
        h, wd = int(rng.integers(5, 9)), int(rng.integers(5, 9))
        a = rng.integers(0, 256, (3, h, wd)).astype(float)
        extra = [float(k) / 10, -1.0]
        rows.append((k, wd, *[c.ravel().tolist() for c in a], extra))
        planes = lambda x, size: np.stack([(bilinear(x[c], size, size) / 255 - m) / s for c, m, s in zip((2, 1, 0), P.CHANNEL_MEAN, P.CHANNEL_STD, strict=True)])
        small = planes(a, 6).mean(0) > 0
        mask = small[np.ix_([i * 6 // h for i in range(h)], [j * 6 // wd for j in range(wd)])]
        views = [planes(np.where(mask, a, 0), 4).mean((1, 2)), planes(a, 4).mean((1, 2))]
        xs = [np.concatenate([extra, v]) if hand else v for v in views]
        probs = (soft(xs[0] @ w + [0.1, 0.2, 0.3]) + soft(-xs[1] @ w + [0.0, 0.4, 0.0])) / 2
        want[k] = (mask.mean(), probs)
    rows += [(90, 5, None, None, None, [0.0, 0.0]), (91, 5, [300.0] * 24, [1.0] * 24, [float("nan")] * 24, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, w int, b array<double>, g array<double>, r array<double>, extra array<double>")
    out = N.classify_pictures(df, models, F.col("w"), {"mask": 6, "view": 4}, F.col("extra") if hand else None)
    assert out.columns == [*df.columns, "coverage", "probs", "pred_class", "score_nevus", "score_mel", "score_atyp", "verdict", "non_benign", "error"]
    got = {r.id: r for r in out.collect()}
    for k, (coverage, probs) in want.items():
        r = got[k]
        assert r.error is None and r.coverage == pytest.approx(coverage) and r.probs == pytest.approx(probs, abs=1e-5) and r.pred_class == int(np.argmax(probs))
        assert r.score_mel == r.probs[1] and r.verdict is not None
    assert got[90].error == "missing" and got[90].probs is None and got[90].verdict is None
    assert got[91].probs is None and got[91].error


def test_networks_of_one_step(spark):
    """As each one alone says; one after another sees its own values first, and is missing where the other one failed."""
    net, (w, bias) = graphs.mean_over([1], ["n", 2, 2], ["n", 2], False), ([[1.0, -1.0], [0.5, 2.0], [-1.0, 0.3]], [0.1, 0.2])
    head = graphs.linear_head(w, bias)
    rows = [(k, [float(k), 1.0, 2.0, 3.0], [0.25 * k]) for k in range(40)] + [(50, None, [1.0]), (51, [1.0], [1.0]), (52, [float("nan")] * 4, [1.0]), (53, [1.0] * 4, None), (54, [1.0] * 4, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>, own array<double>").repartition(3)
    out = N.stage(df, {"a": N.Net(net, F.col("v"), (2, 2)), "b": N.Net(head, F.col("own"), None, 1, "a")}, batch=8)
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(rows) and out.columns == ["id", "v", "own", "error", "a", "b"]
    for k in range(40):
        z = np.exp(np.array([0.25 * k, (k + 2) / 2, 2.0]) @ np.array(w) + bias)
        assert got[k].error is None and got[k].a == pytest.approx([(k + 2) / 2, 2.0]) and got[k].b == pytest.approx((z / z.sum()).tolist(), abs=1e-5)
    assert [got[k].error and got[k].error.split(":")[0] for k in (50, 51, 52, 53)] == ["missing", "ValueError", "ValueError", "missing"]
    assert got[53].a == [1.0, 1.0] and got[54].a == [1.0, 1.0] and got[54].error and all(got[k].b is None for k in (50, 51, 52, 53, 54))


def test_the_chain_is_two_python_steps(spark):
    """An executor holds a worker for each step and task: five of them came near its limit."""
    df = spark.createDataFrame([(1, *[[float(v) for v in range(36)]] * 3)], "id long, b array<double>, g array<double>, r array<double>")
    out = N.classify_pictures(df, chain(spark)[0], 6, {"mask": 6, "view": 4})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 2
