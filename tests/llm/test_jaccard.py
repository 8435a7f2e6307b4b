import random

import numpy as np
import pytest

from cohortal.llm import jaccard as J
from tests.llm.helpers import documents, near_classes, prose


def edited(rng, text, share):
    w = text.split()
    for _ in range(int(share * len(w))):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=0):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(1, 120))) for i in range(60)]
    i = 100
    for _ in range(12):
        base = prose(rng, rng.randrange(30, 200))
        for _ in range(rng.randrange(2, 25)):
            rows.append((i, edited(rng, base, rng.choice([0, 0, 0.005, 0.01, 0.02, 0.05]))))
            i += 1
    rows += [(900, ""), (901, None), (902, ""), (903, "one"), (904, "one"), (905, "two words"), (906, "  \n ")]
    return rows


def test_links_equal_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.class_id, r.rep_id, r.n_copies, r.n_links) for r in J.jaccard_links(documents(spark, rows)).collect()}
    want = near_classes([r for r in rows])
    for i, t in rows:
        assert got[i] == want.get(i, (i, i, 1, 0)) or (t is None and got[i][2:] == (1, 0)), i
    assert len(got) == len(rows)


def test_large_group_is_split_over_blocks(spark):
    rng = random.Random(3)
    base = prose(rng, 150)
    rows = [(i, edited(rng, base, 0.012)) for i in range(300)]
    got = {r.doc_id: (r.class_id, r.rep_id, r.n_copies, r.n_links) for r in J.jaccard_links(documents(spark, rows)).collect()}
    assert got == near_classes(rows)


def test_pairs_are_the_exact_index(spark):
    rows = corpus(5)
    docs = documents(spark, rows)
    pairs = J.jaccard_pairs(docs).collect()
    links = sum(v[3] for v in {r[1]: r for r in near_classes(rows).values()}.values())
    assert 2 * len(pairs) == links
    assert all(p.a_id != p.b_id and p.jaccard >= 0.8 - 1e-9 for p in pairs)


def test_repeated_ids_null_ids_and_extra_columns(spark):
    text = "a b c d e f g h i j"
    rows = [(5, text), (5, text), (5, "something quite different from it all here"), (None, text), (None, text), (7, text + " k")]
    docs = documents(spark, rows).withColumnsRenamed({"lang": "node"}).selectExpr("*", "1 as root", "2 as digest", "3 as bucket")
    got = J.jaccard_links(docs)
    assert got.count() == 6
    first = got.where("doc_id = 7").first()
    assert first.n_links == 1
    kept = J.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == sorted([min((text, text + " k"), key=len), rows[2][1]]) or kept.count() == 2


def test_drop_keeps_one_of_each_class(spark):
    rows = corpus(8)
    kept = {r.doc_id for r in J.drop_near_duplicates(documents(spark, rows)).collect()}
    want = near_classes(rows)
    assert {want[i][0] for i in kept if i in want} == {v[0] for v in want.values()}
    assert all(want[i][0] == i for i in kept if i in want)
    assert {900, 902, 906} <= kept


def test_empty_table(spark):
    docs = documents(spark, []).limit(0)
    assert J.jaccard_links(docs).count() == 0
    assert J.drop_near_duplicates(docs).count() == 0


def test_posterior_bound_loses_almost_nothing():
    least = J.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(0)
    draws = rng.random((50_000, J.N_HASHES)) < 0.8
    matches = np.cumsum(draws, 1)[:, J.STEP - 1 :: J.STEP]
    assert (matches < least).any(1).mean() < 1e-4
    low = np.cumsum(rng.random((2_000, J.N_HASHES)) < 0.3, 1)[:, J.STEP - 1 :: J.STEP]
    assert (low < least).any(1).mean() > 0.999


def test_minhash_estimates_the_index():
    memo = {}
    rng = random.Random(1)
    a = prose(rng, 300, 10**6)
    b = " ".join(a.split()[:240]) + " " + prose(rng, 60, 10**6)
    x, y = J.shingles(a, 5, memo), J.shingles(b, 5, memo)
    exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    estimate = (J.signature(x) == J.signature(y)).mean()
    assert abs(exact - estimate) < 0.15


@pytest.mark.parametrize(("m", "values"), [(2, 500), (3, 500), (40, 500), (60, 10**9), (300, 400)])
def test_shared(m, values):
    rng = np.random.default_rng(m)
    sets = [np.unique(rng.integers(0, values, rng.integers(1, 200)).astype(np.uint64)) for _ in range(m)]
    i, j = np.triu_indices(m, 1)
    got = J.shared(sets, i, j)
    some = rng.permutation(len(i))[:500]
    assert got[some].tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i[some], j[some], strict=True)]


def test_forest():
    rng = np.random.default_rng(3)
    for n, k in ((1, 0), (50, 20), (400, 300), (400, 399)):
        i, j = rng.integers(0, n, k), rng.integers(0, n, k)
        if k == n - 1:
            i, j = np.arange(1, n), np.arange(n - 1)  # a long chain
        one, all_at_once = J.Forest(n), J.Forest(n)
        for a, b in zip(i, j, strict=True):
            one.join(np.array([a, b]))
        all_at_once.join_pairs(i, j)
        same = lambda f: len(set(zip(one.label.tolist(), f.label.tolist(), strict=True)))
        assert same(all_at_once) == len(set(one.label.tolist())) == len(set(all_at_once.label.tolist()))


@pytest.mark.parametrize(("prune", "verify"), [(50, 40), (8192, 30), (20, 1024)])
def test_chunks_change_nothing(spark, prune, verify):
    rows = corpus(2) + [(2000 + i, edited(random.Random(i), prose(random.Random(5), 90), 0.01)) for i in range(150)]
    docs = documents(spark, rows)
    got = {r.doc_id: (r.class_id, r.rep_id, r.n_copies, r.n_links) for r in J.jaccard_links(docs, prune_chunk=prune, verify_chunk=verify).collect()}
    want = near_classes(rows)
    assert all(got[i] == want[i] for i in want)


def test_only_pairs_that_stay_are_verified(spark):
    rng = random.Random(11)
    base = prose(rng, 200, 10**6)
    rows = [(i, edited(rng, base, 0.01)) for i in range(80)]
    docs = documents(spark, rows)
    strict = {tuple(sorted((p.a_id, p.b_id))) for p in J.jaccard_pairs(docs, tolerance=0.4).collect()}
    every = {tuple(sorted((p.a_id, p.b_id))) for p in J.jaccard_pairs(docs).collect()}
    sig = np.stack([J.signature(J.shingles(t, 5, {})) for _, t in rows]).astype(np.uint8)
    i, j = np.triu_indices(80, 1)
    stay = set(zip(*(x.tolist() for x in J.surviving(sig, i, j, J.least_matches(0.8, 0.4))), strict=True))
    assert strict < every and strict == every & stay
    assert len(every) == sum(v[3] for v in near_classes(rows).values()) // 2


def test_narrow_ids_with_nulls(spark):
    text = "a b c d e f g h i j"
    rows = [(5, text), (None, text), (None, "other words than these are here now"), (7, text + " k"), (None, None)]
    for kind in ("int", "smallint", "string", "long"):
        docs = documents(spark, rows).selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
        got = J.jaccard_links(docs)
        assert got.count() == 5 and dict(got.dtypes)["class_id"] == dict(docs.dtypes)["doc_id"]
        assert sorted(str(r.class_id) for r in got.where("text like 'a b%'" if "text" in got.columns else "n_links = 1").collect()) == ["5"] * 3
        assert J.drop_near_duplicates(docs).count() == 3


def test_one_id_for_many_texts(spark):
    rng = random.Random(12)
    rows = [(1, prose(rng, 30)) for _ in range(120)] + [(1, prose(random.Random(k), 60, 10**5) + f" {x}") for k in range(3) for x in range(40)]
    got = J.jaccard_links(documents(spark, rows)).collect()
    assert len(got) == 240 and sorted(r.n_links for r in got) == [0] * 120 + [39] * 120
    assert J.drop_near_duplicates(documents(spark, rows)).count() == 123


def test_hot_keys_are_bounded(spark):
    rows = spark.range(3_000).selectExpr("if(id < 1000, 0, id) k")
    sizes = rows.groupBy("k").count()
    assert J.join_sized(rows, sizes, "k", "count", 3_000).groupBy().sum("count").first()[0] == 1000 * 1000 + 2000
