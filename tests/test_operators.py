import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortal.operators import audit as A
from cohortal.operators import calibration as K
from cohortal.operators import classify as C
from cohortal.operators import confusion as M
from cohortal.operators import effects as E
from cohortal.operators import prefix as P
from cohortal.operators import ranking as Q
from cohortal.operators import relational as R
from cohortal.operators import store as S
from cohortal.operators.graph import connected_components
from cohortal.operators.prefix import numbered, running_totals


def scored(spark, seed=0, n=80, extra=()):
    rng = random.Random(seed)
    rows = [(k, rng.randrange(2), rng.randrange(12) / 10, rng.randrange(12) / 10) for k in range(n)] + list(extra)
    return rows, spark.createDataFrame(rows, "i int, y int, a double, b double")


def placement(pos, neg):
    v01 = [sum((p > q) + 0.5 * (p == q) for q in neg) / len(neg) for p in pos]
    v10 = [sum((p > q) + 0.5 * (p == q) for p in pos) / len(pos) for q in neg]
    return np.array(v01), np.array(v10)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_delong_equals_pairwise_comparison(spark, seed):
    rows, df = scored(spark, seed)
    pos, neg = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    a01, a10 = placement([r[2] for r in pos], [r[2] for r in neg])
    b01, b10 = placement([r[3] for r in pos], [r[3] for r in neg])
    got = Q.roc_auc(df, "a", "y").first()
    var = a01.var(ddof=1) / len(pos) + a10.var(ddof=1) / len(neg)
    assert got.auc == pytest.approx(a01.mean()) and got.var == pytest.approx(var)
    assert got.ci_low == pytest.approx(max(0, a01.mean() - Q.Z95 * math.sqrt(var)))
    two = Q.paired_delong(df, "a", "b", "y").first()
    dvar = (b01 - a01).var(ddof=1) / len(pos) + (b10 - a10).var(ddof=1) / len(neg)
    assert two.delta == pytest.approx(b01.mean() - a01.mean()) and two["var"] == pytest.approx(dvar)
    flipped = Q.roc_auc(df.withColumn("a", -F.col("a")), "a", "y").first()
    assert flipped.auc == pytest.approx(1 - got.auc)


def test_auc_of_one_class_and_nulls(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.2), (None, 0.3), (1, None)], "y int, a double")
    got = Q.roc_auc(df, "a", "y").first()
    assert (got.n_pos, got.n_neg, got.auc, got.ci_high) == (2, 0, None, None)


def test_thresholds_by_scan(spark):
    rows, df = scored(spark, 5)
    y, s = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    j = {t: ((s >= t) & (y == 1)).sum() / (y == 1).sum() + ((s < t) & (y == 0)).sum() / (y == 0).sum() - 1 for t in np.unique(s)}
    best = max(j.values())
    tied = [t for t, v in j.items() if abs(v - best) < 1e-12]
    assert Q.youden_threshold(df, "a", "y").first().threshold == min(tied)
    assert Q.youden_threshold(df, "a", "y", ties="highest").first().threshold == max(tied)
    ok = [t for t in np.unique(s) if ((s >= t) & (y == 1)).sum() / (y == 1).sum() >= 0.7]
    assert Q.threshold_for_sensitivity(df, "a", "y", 0.7).first().threshold == max(ok)
    assert Q.threshold_for_sensitivity(df, "a", "y", 1.1).first().threshold == 0.0
    assert Q.threshold_for_specificity(df, "a", "y", 1.0).first().spec == 1.0


def test_average_precision(spark):
    rows, df = scored(spark, 6)
    y, s = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp, n = ((s >= t) & (y == 1)).sum(), (s >= t).sum()
        recall = tp / y.sum()
        ap, last = ap + (recall - last) * tp / n, recall
    assert Q.average_precision(df, "a", "y").first().ap == pytest.approx(ap)


def test_quantiles_equal_linear_interpolation(spark):
    rng = random.Random(7)
    rows = [(k % 3, rng.randrange(40) / 4) for k in range(200)] + [(3, 5.0), (3, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r for r in Q.quantiles(df, "v", {"a": 0.0, "b": 0.31, "c": 1.0}, ["g"]).collect()}
    for g in range(4):
        own = [v for k, v in rows if k == g and v is not None]
        assert [got[g].a, got[g].b, got[g].c] == pytest.approx(np.quantile(own, [0, 0.31, 1]))
    assert Q.quantiles(df, "v", {"m": 0.5}).first().m == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_fdr_is_monotone_and_skips_null(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, None, 0.03]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(p)], "i int, p double")
    q = {r.i: r.q for r in Q.bh_fdr(df, "p").collect()}
    known = sorted((v, k) for k, v in enumerate(p) if v is not None)
    want, run = {}, 1.0
    for rank in range(len(known), 0, -1):
        run = min(run, known[rank - 1][0] * len(known) / rank)
        want[known[rank - 1][1]] = run
    assert q[5] is None and all(q[k] == pytest.approx(min(1, v)) for k, v in want.items())


def test_running_totals_over_many_parts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.pmod(F.col("id") * 37, F.lit(1000)).alias("k"))
    got = running_totals(df, [F.col("k")], {"s": F.col("k")}, ["g"]).collect()
    for g in range(3):
        own = sorted(r.k for r in got if r.g == g)
        assert {r.k: r.s for r in got if r.g == g} == dict(zip(own, np.cumsum(own).tolist(), strict=True))
    assert sorted(r.n for r in numbered(df, [F.col("k").desc()]).collect()) == list(range(1, 1001))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_wilson_brackets_and_is_null_for_nothing(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (5, 5), (3, 10)], "k int, n int")
    low, high = M.wilson(F.col("k"), F.col("n"))
    got = df.select("k", "n", low.alias("l"), high.alias("h")).collect()
    assert got[0].l is None and got[0].h is None
    assert all(r.l <= r.k / r.n <= r.h and 0 <= r.l and r.h <= 1 for r in got[1:])
    assert got[3].l == pytest.approx(0.1078, abs=1e-3) and got[3].h == pytest.approx(0.6032, abs=1e-3)


def test_undefined_rates(spark):
    c = M.confusion_counts(spark.createDataFrame([(0.9, 1)], "s double, y int"), F.col("s"), F.col("y"), 0.9)
    assert M.rates(c).first().spec is None and M.rates(c).first().sens == 1.0
    assert M.rates(c, undefined=0.0).first().spec == 0.0


def test_summary_leaves_out_or_counts_undefined_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "t int, p int")
    m = M.confusion_matrix(df, "t", "p")
    assert M.summary(m).first().macro_precision == pytest.approx(2 / 3)
    assert M.summary(m, undefined=0.0).first().macro_precision == pytest.approx(2 / 9)
    assert M.summary(m).first().kappa == 0
    empty = M.summary(M.confusion_matrix(df.limit(0), "t", "p")).first()
    assert empty.accuracy is None and empty.macro_f1 is None


def test_argmax_takes_the_first_and_verdict_is_inclusive(spark):
    r = spark.range(1).select(
        C.argmax(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))).alias("i"),
        C.verdict(F.lit(0.188), F.lit(0.0), F.lit(0.188), F.lit(0.412)).alias("v"),
        C.two_class_readout(F.lit(0.0), F.lit(0.0)).alias("z"),
        C.normalised(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("n"),
    ).first()
    assert (r.i, r.v, r.z) == (0, 2, 0.0) and r.n == pytest.approx([1 / 3] * 3)


def test_decision_curve_counts_scores_at_thresholds(spark):
    rows = [(k / 100, k % 2) for k in range(101)]
    got = {r.k: r for r in K.decision_curve(spark.createDataFrame(rows, "p double, y int"), "p", "y").collect()}
    for k in range(1, 100):
        t = k / 100
        tp, fp = sum(p >= t and y for p, y in rows), sum(p >= t and not y for p, y in rows)
        assert got[k].net_benefit == pytest.approx(tp / 101 - fp / 101 * t / (1 - t))


def store(spark):
    analysis = spark.createDataFrame(
        [("a", 5, "p1", None, 1, None, None, 0.9), ("b", 6, None, 7, 0, 1, 0, 0.1), ("c", 7, "gone", 3, None, 1, 1, 0.2), ("d", 7, "p1", 3, 2, 1, 0, 0.2)],
        "id string, ts long, patient_id string, capture_date long, pred_class int, non_benign int, archived int, score_mel double",
    )
    for c in "verdict quality_flag".split():
        analysis = analysis.withColumn(c, F.lit(None).cast("int"))
    patient = spark.createDataFrame([("p1", 'O"Neil, A%', 1, 2, None)], "id string, name string, sex int, sun_exposure int, antecedents string")
    labels = spark.createDataFrame(
        [(1, "a", 10, 0, "x"), (2, "a", 10, 1, "y"), (3, "a", None, 2, "z"), (4, "b", None, 2, "n"), (5, "c", 1, 1, "q")],
        "id long, analysis_id string, ts long, verified_class int, source string",
    )
    return analysis, patient, labels


def test_view_takes_the_newest_label(spark):
    v = {r.id: r for r in S.analysis_view(*store(spark)).collect()}
    assert set(v) == {"a", "b", "d"}
    assert v["a"].verified_class == 1 and v["a"].capture_date == 5 and v["a"].verdict == 0 and v["a"].non_benign is False
    assert v["b"].verified_class == 2 and v["b"].patient_name is None and v["d"].verified_class is None
    assert tuple(S.store_counts(*store(spark)).first()) == (1, 3, 3)


def test_csv_export_bytes(spark, tmp_path):
    a, p, lab = store(spark)
    for name, kind in {"image_path": "string", "model_version": "string", "model_bundle_sha256": "string", "preprocessing_version": "string", "decision_policy_version": "string",
                       "probs": "string", "score_atyp": "double", "score_nevus": "double", "thr_mel": "double", "thr_atyp": "double", "thr_nevus": "double"}.items():
        a = a.withColumn(name, F.lit(None).cast(kind))
    t = S.export_table(a, p, lab)
    S.write_export(t, str(tmp_path))
    lines = [r.value for r in spark.read.text(f"{tmp_path}/rows").collect()]
    assert spark.read.text(f"{tmp_path}/header").first().value.split(",") == [n for n, _ in S.EXPORT]
    assert len(lines) == 4
    first = next(x for x in lines if x.startswith('"a"'))
    assert first.startswith('"a","","","O""Neil, A%","1","2","","') and first.endswith('"","1","y"')


def test_search_wildcards_are_live_and_case_is_ignored(spark):
    p = spark.createDataFrame([("1", "Abc", 1), ("2", "aXc", None), ("3", "zzz", 9)], "id string, name string, updated_ts long")
    assert [r.id for r in S.search_patients(p, "A_C").collect()] == ["1", "2"]
    assert S.search_patients(p, "").count() == 3 and S.search_patients(p, "", limit=1).first().id == "3"


def test_merge_archive_and_settings(spark):
    base = spark.createDataFrame([("1", "a", 5), ("2", "b", 6)], "id string, name string, created long")
    ch = spark.createDataFrame([("1", "x", 9), ("3", "n", 9)], "id string, name string, created long")
    assert sorted(map(tuple, S.merge_by_key(base, ch, "id", insert=False, keep=["created"]).collect())) == [("1", "x", 5), ("2", "b", 6)]
    assert S.merge_by_key(base, ch, "id").count() == 3
    a, p, lab = store(spark)
    out, log = S.archive(a, a.where("id = 'a'"), 1, "r")
    assert {r.id: r.archived for r in out.collect()} == {"a": 1, "b": 0, "c": 1, "d": 0} and log.first().analysis_id == "a"
    s = spark.createDataFrame([("thresholds:v1", '{"mel":0.3,"atyp":0.4,"nevus":0.5}'), ("thresholds:v2", "broken")], "key string, value string")
    v = spark.createDataFrame([("v1",), ("v2",), ("v3",)], "version string")
    assert {r.version: r.thr_mel for r in S.thresholds_for(s, v).collect()} == {"v1": 0.3, "v2": 0.188, "v3": 0.188}


def test_checked_join_raises_on_repeated_keys(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    assert R.checked_join(a, b, ["k"], validate="many_to_one").count() == 2
    with pytest.raises(ValueError, match="left"):
        R.checked_join(a, b, ["k"], validate="one_to_one")
    with pytest.raises(ValueError, match="missing"):
        R.ordered_subset(b, "k", [1, 7])


def test_components_of_chains_and_loops(spark):
    n = 300
    rng = random.Random(0)
    edges = [(k, k + 1) for k in range(0, 100)] + [(rng.randrange(101, n), rng.randrange(101, n)) for _ in range(150)] + [(n, n), (None, 3), (4, 4)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {k: find(k) for k in root}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_links_connect_what_the_pairs_connect(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, rng.choice(["x", "y", None]), rng.choice([1, 2]), round(rng.uniform(0, 900), 1)) for k in range(-40, 120)]
    rows += [(500 + k, "z", 1, 7.0) for k in range(9)] + [(600, "z", 1, 40.0), (600, "x", 1, 9_000.0), (600, "x", 1, 9_001.0), (None, "z", 1, 7.0)]
    rows += [(700 + k, "z", 1, v) for k, v in enumerate([float("inf"), float("inf"), float("-inf"), float("nan"), float("nan"), None, 12.0, 37.0, 62.0, 87.1])]
    df = spark.createDataFrame(rows, "id int, k string, m int, v double")
    pairs = R.near_duplicate_pairs(df, "id", ["k", "m"], F.abs(F.col("a.v") - F.col("b.v")), 25)
    links = R.near_duplicate_links(df, "id", ["k", "m"], "v", 25)
    want = {(a[0], b[0]) for a in rows for b in rows if None not in (*a, *b) and a[1:3] == b[1:3] and a[0] < b[0] and abs(a[3] - b[3]) <= 25}
    assert {tuple(r) for r in pairs.collect()} == want
    of = lambda e: {tuple(r) for r in connected_components(e, "member_1", "member_2").collect()}
    assert of(links) == of(pairs)
    # Copies: as many links as rows, where pairs grow with the square.
    many = spark.range(3_000).selectExpr("id", "id % 1 as k", "id % 1 as m", "cast(id % 3 as double) as v")
    assert R.near_duplicate_links(many, "id", ["k", "m"], "v", 25).count() == 2_999
    monkeypatch.setattr(R, "PAIR_ROWS", 256)
    every = R.near_duplicate_pairs(many, "id", ["k", "m"], F.abs(F.col("a.v") - F.col("b.v")), 0.5)
    assert every.count() == every.distinct().count() == 3 * 1_000 * 999 // 2
    assert max(every.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) < 3 * 1_000 * 999 // 2  # no task makes them all


def test_shorter_of_a_pair_is_kept(spark):
    rows = [("b", "a"), ("aa", "b"), ("-5", "3"), (None, "x"), ("x", None), ("q", "q"), (None, None)]
    got = {tuple(r) for r in R.keep_shorter(spark.createDataFrame(rows, "member_1 string, member_2 string")).collect()}
    kept = [("a", "b"), ("b", "aa"), ("3", "-5"), (None, "x"), (None, "x"), ("q", "q"), (None, None)]
    assert got == {(*r, *k) for r, k in zip(rows, kept, strict=True)}


def test_group_folds_keep_groups_whole(spark):
    rows = [(f"g{k % 41}", k % 7 == 0) for k in range(500)]
    f = R.group_folds(spark.createDataFrame(rows, "g string, y boolean"), "g", "y", 5).collect()
    assert len(f) == 41 and {r.fold for r in f} == set(range(5))
    fold = {r.g: r.fold for r in f}
    sizes = [sum(fold[g] == k for g, _ in rows) for k in range(5)]
    assert max(sizes) - min(sizes) <= 30


def test_last_writer_and_cascade(spark):
    a = spark.createDataFrame([("k", "old", 1), ("k", "new", 2), ("m", "nan", 3)], "key string, value string, o int")
    b = spark.createDataFrame([("k", " ", 1), ("z", " v ", 1)], "key string, value string, o int")
    assert {r.key: r.value for r in R.last_writer_wins([a, b], "key", "value", "o").collect()} == {"k": "new", "z": "v"}
    r = spark.range(1).select(R.first_reason([("x", F.lit(False)), ("y", F.lit(True)), ("z", F.lit(True))]).alias("r")).first()
    assert r.r == "y"


def test_mcnemar_normal_and_bootstrap(spark):
    df = spark.createDataFrame([(0, 0), (1, 5), (10, 10)], "b int, c int")
    p = [r.p for r in df.select(E.mcnemar_p("b", "c").alias("p")).collect()]
    assert p[0] == 1 and p[1] == pytest.approx(2 * 7 / 64) and p[2] == 1
    for b, c in ((0, 1), (3, 9), (40, 61), (499, 500), (1, 300), (7, 8)):
        tail = sum(math.comb(b + c, i) for i in range(b + 1)) / 2 ** (b + c)
        assert E._mcnemar(b, c) == E._mcnemar(c, b) == pytest.approx(min(1, 2 * tail), rel=1e-9)
    assert 0 < E._mcnemar(10**9, 10**9 + 60_000) < 1
    z = spark.createDataFrame([(1.959963984540054,), (None,)], "z double").select(E.normal_p("z").alias("p")).collect()
    assert z[0].p == pytest.approx(0.05) and z[1].p is None
    rows, s = scored(spark, 3, 200)
    auc = Q.roc_auc(s, "a", "y").first().auc
    one = E.bootstrap_auc(s, "i", "y", "a", replicates=400).first()
    assert one == E.bootstrap_auc(s.repartition(3), "i", "y", "a", replicates=400).first()
    assert one.ci_low < auc < one.ci_high and abs(one["mean"] - auc) < 0.02
    same = E.bootstrap_auc(s, "i", "y", "a", "a", replicates=50).first()
    assert same["mean"] == 0


def test_audit(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None)], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.5, "x"), (3, 2.0, None)], "k int, v double, s string")
    got = {r.column: r for r in A.parity(a, b, ["k"]).collect()}
    assert got["v"].mismatches == 1 and got["v"].max_abs_diff == 0.5 and got["s"].mismatches == 0 and got["v"].unmatched == 2
    good = {"classes": ["n", "m"], "thresholds": {"m": 0.2}, "components": [{"name": "u", "sha256": "0" * 64}]}
    assert A.manifest_faults(spark, good, ["u"], ["n", "m"]).count() == 0
    for bad in (-0.1, 1.1, float("nan"), True, "0.2", None):
        assert A.manifest_faults(spark, good | {"thresholds": {"m": bad}}, ["u"], ["n", "m"]).count() == 1
    assert A.manifest_faults(spark, good | {"classes": ["m", "n"]}, ["u"], ["n", "m"]).first().check == "classes"
    assert A.manifest_faults(spark, good | {"components": ["u"]}, ["u"], ["n", "m"]).count() == 1
    import hashlib

    names, digests = ["a", "b"], [hashlib.sha256(x).hexdigest() for x in (b"1", b"2")]
    want = hashlib.sha256(b"".join(n.encode() + b"\0" + bytes.fromhex(d) for n, d in zip(names, digests, strict=True))).hexdigest()
    row = spark.createDataFrame([(names, digests)], "n array<string>, d array<string>")
    assert row.select(A.bundle_sha256(F.col("n"), F.col("d")).alias("h")).first().h == want
    files = spark.createDataFrame([("b", 1, digests[1]), ("a", 1, digests[0])], "path string, bytes long, sha256 string")
    want = hashlib.sha256(b"".join(n.encode() + b"\0" + b"1" + b"\0" + bytes.fromhex(d) for n, d in zip(names, digests, strict=True))).hexdigest()
    assert A.aggregate_fingerprint(files).first().fingerprint == want


def test_factorial_effects_of_additive_aucs(spark):
    w = [0.01, 0.02, 0.03, 0.04]
    auc = spark.createDataFrame([(m, 0.5 + sum(w[k] for k in range(4) if m >> k & 1) + (0.005 if m & 3 == 3 else 0)) for m in range(16)], "mask int, auc double")
    e = {(r.block, r.effect_type): r.delta for r in E.main_effects(auc).collect()}
    assert e[2, "add_one"] == pytest.approx(0.03) and e[2, "main_effect_factorial"] == pytest.approx(0.03)
    assert e[0, "leave_one_out"] == pytest.approx(0.015) and e[0, "main_effect_factorial"] == pytest.approx(0.0125)
    i = {(r.b1, r.b2): r.delta for r in E.pair_interactions(auc).collect()}
    assert i[0, 1] == pytest.approx(0.005) and i[2, 3] == pytest.approx(0)
    c = E.conditions(spark)
    assert c.count() == 31 and c.where("not deep and mask = 0").count() == 0


def test_resamples_are_poisson(spark):
    w = E.resampled(spark.range(500).withColumnRenamed("id", "i"), "i", 40).groupBy("_rep").agg({"_w": "sum"}).collect()
    sums = [r["sum(_w)"] for r in w]
    assert len(sums) == 40 and abs(sum(sums) / 40 - 500) < 15 and 10 < (sum((x - 500) ** 2 for x in sums) / 40) ** 0.5 < 35


def test_running_least(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.random()) for g in range(3) for i in range(200)]
    got = P.running_least(spark.createDataFrame(rows, "g int, i int, v double"), [F.col("i").desc()], "v", ["g"]).collect()
    want = {(g, i): min(v for h, k, v in rows if h == g and k >= i) for g, i, _ in rows}
    assert {(r.g, r.i): r.v for r in got} == want


def test_constant_features_have_no_z(spark):
    r = spark.range(1).select(C.oriented_z(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(1)).alias("z")).first()
    assert r.z is None


def test_appends_and_their_log(spark):
    a = spark.createDataFrame([("x", 1, 0)], "id string, ts long, verdict int")
    out, log = S.log_analysis(a, spark.createDataFrame([("y", 2)], "id string, ts long"), 9)
    assert {tuple(r) for r in out.collect()} == {("x", 1, 0), ("y", 2, None)} and log.first().asDict() == {"ts": 9, "event": "analysis", "analysis_id": "y", "detail": None}
    labels = spark.createDataFrame([], "analysis_id string, ts long, verified_class int, source string")
    out, log = S.add_verified_label(labels, spark.createDataFrame([("y", 2, "biopsy")], "analysis_id string, verified_class int, source string"), 10)
    assert out.first().asDict() == {"analysis_id": "y", "ts": 10, "verified_class": 2, "source": "biopsy"} and log.first().detail == "2"
    v = spark.createDataFrame([], "analysis_id string, ts long, md_agree int, md_class int")
    out, log = S.add_validation(v, spark.createDataFrame([("y", 1, None), ("x", 0, 2)], "analysis_id string, md_agree int, md_class int"), 11)
    assert out.count() == 2 and {r.detail for r in log.collect()} == {"agree", "class 2"}


def test_fold_leaks(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 1), (None, 0), (None, 1)], "g string, fold int")
    assert [tuple(r) for r in R.fold_leaks(df, "g").collect()] == [("a", 2)]


def test_metric_block_of_one_class_and_of_none(spark):
    from cohortal.plans.evaluation import metric_block

    rows = spark.createDataFrame([(1, 0.9, 0.1), (1, 0.1, 0.5)], "y int, p_mel double, p_atyp double")
    got = {r.metric: r for r in metric_block(rows, "file").collect()}
    assert got["sens"].estimate == 0.5 and got["nb_sens"].estimate == 1.0 and got["fn"].estimate == 1.0
    assert 0 < got["sens"].ci95_low < 0.5 < got["sens"].ci95_high < 1 and got["sens"].denominator_n == 2
    assert got["auc"].estimate is None and got["auc"].ci95_low is None and got["ap"].estimate is None
    assert got["spec"].estimate is None and got["spec"].ci95_low is None and got["spec"].denominator_n == 0
    none = {r.metric: r.estimate for r in metric_block(rows.where("y = 5"), "file").collect()}
    assert none["n"] == 0 and none["brier"] is None and none["ap"] is None
