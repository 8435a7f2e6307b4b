"""Draws within classes, greedy group folds and boosted trees against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortal.operators import boosting as B
from cohortal.operators import effects as E
from cohortal.operators import relational as R


def stirred(x):
    for _ in range(2):
        x = ((x ^ x >> 16) * E.MULTIPLIER) & E.MASK
    return x ^ x >> 16


def drawn(k, n, rep, stratum, seed):
    h = stirred((k + E.STEPS[0] * (rep + 1)) & E.MASK)
    return stirred((h + E.STEPS[1] * (stratum + 1) + seed) & E.MASK) * n >> 32


def scored(n=90, seed=4):
    rng = random.Random(seed)
    return [(k * 3 + 1, int(rng.random() < 0.3), round(rng.random(), 1), round(rng.random(), 2)) for k in range(n)]


def auc(rows, score):
    pos, neg = ([r[score] for r in rows if r[1] == y] for y in (1, 0))
    return np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])


def test_draws_keep_class_totals_and_equal_the_plain_ones(spark):
    rows = scored()
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    got = E.stratified(df.union(spark.createDataFrame([(9_999, None, 1.0, 1.0)], df.schema)), "id", "y", 12, seed=5).collect()
    by = {y: sorted(r[0] for r in rows if r[1] == y) for y in (0, 1)}
    want = Counter((rep, ids[drawn(k, len(ids), rep, y, 5)]) for rep in range(12) for y, ids in by.items() for k in range(len(ids)))
    assert Counter((r["_rep"], r.id) for r in got) == want
    assert Counter((r["_rep"], r.y) for r in got) == {(rep, y): len(ids) for rep in range(12) for y, ids in by.items()}
    assert max(want.values()) > 1 and len({i for _, i in want}) > 60
    assert E.stratified(df.limit(0), "id", "y", 3).count() == 0


def test_draws_are_uniform():
    n = 50
    hits = Counter(drawn(k, n, rep, 1, 42) for rep in range(400) for k in range(n))
    spread = sum((hits[j] - 400) ** 2 / 400 for j in range(n))
    assert 20 < spread < 90  # chi square of 49 degrees of freedom
    same = np.mean([drawn(k, n, rep, 0, 42) == drawn(k, n, rep + 1, 0, 42) for rep in range(100) for k in range(n)])
    assert abs(same - 1 / n) < 0.01


@pytest.mark.parametrize("new", [None, "b"])
def test_stratified_interval(spark, new):
    rows = scored()
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    got = E.bootstrap_auc(df, "id", "y", "a", new, replicates=40, seed=42, stratify=True).first()
    at = {r[0]: r for r in rows}
    by = {y: sorted(i for i, r in at.items() if r[1] == y) for y in (0, 1)}
    values = []
    for rep in range(40):
        sample = [at[ids[drawn(k, len(ids), rep, y, 42)]] for y, ids in by.items() for k in range(len(ids))]
        values.append(auc(sample, 2) if new is None else auc(sample, 3) - auc(sample, 2))
    assert (got.replicates, got.n_undefined) == (40, 0)
    assert [got["mean"], got["median"], got.ci_low, got.ci_high] == pytest.approx([np.mean(values), *np.quantile(values, [0.5, 0.025, 0.975])], abs=1e-9)


def plain_greedy(groups, folds, seed):
    """One group at a time, in the order of the rule."""
    classes = sorted({y for ys in groups.values() for y in ys})
    counts = {g: tuple(ys.count(c) for c in classes) for g, ys in groups.items()}
    totals = [sum(c[k] for c in counts.values()) for k in range(len(classes))]
    order = sorted(counts, key=lambda g: (-R.spread_of(counts[g]), [-c for c in counts[g]], hashlib.md5(f"{seed}|{g}".encode()).hexdigest(), g))
    state, out = [[0] * len(classes) for _ in range(folds)], {}
    for g in order:
        out[g] = R.next_fold(state, counts[g], totals)
        state[out[g]] = [s + c for s, c in zip(state[out[g]], counts[g], strict=True)]
    return out, state


@pytest.mark.parametrize(("n", "folds", "classes", "seed"), [(300, 5, 2, 0), (150, 3, 3, 1), (40, 7, 2, 2), (3, 5, 2, 3), (400, 4, 1, 4)])
def test_greedy_folds_equal_the_plain_rule(spark, n, folds, classes, seed):
    rng = random.Random(seed)
    groups = {f"g{k}": [rng.randrange(classes) for _ in range(min(rng.randrange(1, 12), rng.randrange(1, 40)))] for k in range(n)}
    df = spark.createDataFrame([(g, y) for g, ys in groups.items() for y in ys], "g string, y int")
    got = {r.g: r.fold for r in R.greedy_group_folds(df, "g", "y", folds, seed).collect()}
    want, state = plain_greedy(groups, folds, seed)
    assert got == want
    if n > 100:
        assert max(map(sum, state)) - min(map(sum, state)) <= 12


def test_greedy_folds_of_many_like_groups_take_few_steps(monkeypatch):
    steps = []
    plain = R.next_fold
    monkeypatch.setattr(R, "next_fold", lambda *a: steps.append(1) or plain(*a))
    state = [[5, 0], [0, 3], [0, 0]]
    first, cycle = R.dealt_alike(state, (1, 1), [1_000_005, 1_000_003], 1_000_000)
    assert len(steps) < 100 and sorted(cycle) == [0, 1, 2]
    assert [sum(c) for c in zip(*state, strict=True)] == [1_000_005, 1_000_003]


def test_greedy_folds_with_nulls_and_without_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 0), (None, 1), ("b", 0)], "g string, y int")
    got = R.greedy_group_folds(df, "g", "y", 2).collect()
    assert {r.g for r in got} == {"a", "b", None} and all(r.fold in (0, 1) for r in got)
    assert R.greedy_group_folds(df.limit(0), "g", "y", 2).collect() == []


def rings(n, seed):
    """Three classes by the distance from the middle, with a useless feature, a constant one and gaps."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    r = np.hypot(x[:, 0], x[:, 1])
    y = (r > 0.8).astype(int) + (r > 1.5)
    x[:, 3] = 7.0
    x[::50, 2] = np.nan
    return [(int(k), [float(v) for v in x[k]], int(y[k]), int(k % 4), float(r[k])) for k in range(n)]


def test_boosted_heads_learn_and_repeat(spark):
    rows = rings(600, 3)
    df = spark.createDataFrame(rows, "id long, x array<double>, y int, fold int, r double")
    run = lambda d: {r.id: tuple(round(v, 9) for v in r.proba) for r in B.boosted_heads(d, ["x"], "y", "fold", rounds=10, depth=3).collect()}
    got = run(df.repartition(3))
    assert all(abs(sum(p) - 1) < 1e-6 for p in got.values()) and len(got) == 600
    hit = np.mean([np.argmax(got[i]) == y for i, _, y, _, _ in rows])
    from cohortal.operators.models import tree_head_out_of_fold

    forest = {r.id: r.proba for r in tree_head_out_of_fold(df.withColumn("x", F.transform("x", lambda v: F.nanvl(v, F.lit(0.0)))), ["x"], "y", "fold", trees=20, depth=4).collect()}
    assert hit > 0.88 and hit >= np.mean([np.argmax(forest[i]) == y for i, _, y, _, _ in rows])
    assert run(df.repartition(7)) == got  # the order of tasks leaves no trace


def test_boosted_heads_never_see_their_fold(spark):
    rows = [(k, [float(k % 2)], k % 2 if k % 3 else 1 - k % 2, k % 3, 0.0) for k in range(240)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int, fold int, r double")
    got = B.boosted_heads(df, ["x"], "y", "fold", 2, rounds=4, depth=1).collect()
    # Labels of fold 0 are turned round: the model of folds 1 and 2 says the opposite of them.
    assert np.mean([np.argmax(r.proba) == r.y for r in got if r.fold == 0]) == 0


def test_boosted_binary_head_without_a_class(spark):
    rows = rings(300, 5)
    df = spark.createDataFrame(rows, "id long, x array<double>, y int, fold int, r double")
    odd = df.withColumn("y", F.when(F.col("id") == 5, None).otherwise(F.col("y")))
    got = B.boosted_heads(odd, ["x"], "y", "fold", exclude=[2], rounds=5, depth=2).collect()
    assert len(got) == 300 and max(r.proba[2] for r in got) < 0.01
    assert np.mean([np.argmax(r.proba) == r.y for r in got if r.y in (0, 1)]) > 0.75


def test_one_boosted_tree_by_hand(spark):
    """One round of depth one on squared loss: a stump with the means of both sides, shrunk by the ridge."""
    rows = [(k, [float(k), 0.0], 10.0 if k >= 8 else 2.0, k % 2) for k in range(16)]
    df = spark.createDataFrame(rows, "id long, x array<double>, t double, fold int")
    got = {r.id: r.prediction for r in B.boosted_regression(df, "x", "t", "fold", rounds=1, depth=1, rate=1.0, n_bins=16, ridge=0.0, min_rows=1).collect()}
    # Of equal cuts the lowest counts: row 7 is no training row of its model and falls to the right.
    assert got == pytest.approx({k: t for k, _, t, _ in rows} | {7: 10.0}, abs=1e-4)
    half = B.boosted_regression(df, "x", "t", "fold", rounds=1, depth=1, rate=0.5, n_bins=16, ridge=0.0, min_rows=1).where("id = 0").first()
    assert half.prediction == pytest.approx(6 + 0.5 * (2 - 6), abs=1e-4)


def test_boosted_regression_beats_the_line(spark):
    df = spark.createDataFrame(rings(500, 9), "id long, x array<double>, y int, fold int, r double")
    from cohortal.operators.models import r_squared, ridge_out_of_fold

    boosted = r_squared(B.boosted_regression(df, "x", "r", "fold", rounds=12), "r").first().r2
    flat = df.select("*", *[F.nanvl(F.get("x", F.lit(k)), F.lit(0.0)).alias(f"f{k}") for k in range(3)])
    line = r_squared(ridge_out_of_fold(flat, ["f0", "f1", "f2"], "r", "fold"), "r").first().r2
    assert boosted > 0.8 > line


def test_only_columns_in_use_are_resampled(spark):
    df = spark.createDataFrame([(1, 0, 0.5, "x"), (2, None, 0.5, "y")], "id long, y int, a double, other string")
    got = E.known(df, "y", "id", "a", "a")
    assert got.columns == ["id", "a", "y"] and [tuple(r) for r in got.collect()] == [(1, 0.5, 0)]


def test_steps_of_a_draw_are_computed_once(spark, capsys):
    df = spark.createDataFrame(scored(), "id long, y int, a double, b double")
    draws = E.stratified(df, "id", "y", 12, seed=5)
    capsys.readouterr()
    draws.explain()
    assert capsys.readouterr().out.count(str(E.MULTIPLIER)) == 4  # an expression that uses each step twice has hundreds


def test_draws_are_spread_over_tasks_and_equal_without_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(scored(400), "id long, y int, a double, b double")
    draws = E.stratified(df, "id", "y", 12, seed=5)
    per_task = [r.n for r in draws.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(per_task) == 4 and sum(per_task) == 4_800 and max(per_task) < 2_000
    want = Counter(map(tuple, draws.collect()))
    monkeypatch.setattr(E, "broadcast_if_small", lambda d, otherwise=None: d.hint(otherwise))
    assert Counter(map(tuple, E.stratified(df, "id", "y", 12, seed=5).collect())) == want
