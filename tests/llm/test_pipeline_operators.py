import math
import random
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortal.llm import fingerprint as FP
from cohortal.llm import mixing as MX
from cohortal.llm import packing as PK
from cohortal.llm import toxicity as TX
from cohortal.llm import urls
from tests.llm.helpers import documents, prose, words


def highest_quotients(votes, seats, caps=None):
    given = [0] * len(votes)
    for _ in range(seats):
        best = max(
            (i for i in range(len(votes)) if votes[i] > 0 and (caps is None or given[i] < caps[i])),
            key=lambda i: (votes[i] / (2 * given[i] + 1), -i),
            default=None,
        )
        if best is None:
            break
        given[best] += 1
    return given


@pytest.mark.parametrize("seed", range(30))
def test_sainte_lague(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 12)
    votes = [rng.choice([0, 1, 3, 3, 10, 97.5, 1000]) * rng.random() for _ in range(n)]
    seats = rng.randrange(0, 200)
    caps = [rng.randrange(0, 60) for _ in range(n)] if seed % 2 else None
    assert MX.sainte_lague(votes, seats, caps).tolist() == highest_quotients(votes, seats, caps)


def test_sainte_lague_edges():
    assert MX.sainte_lague([], 5).tolist() == []
    assert MX.sainte_lague([0, 0], 5).tolist() == [0, 0]
    assert MX.sainte_lague([1, 1, 1], 2).tolist() == [1, 1, 0]
    assert MX.sainte_lague([1e9, 1], 10**9).sum() == 10**9


def test_water_fill():
    t = MX.water_fill([10, 1000, 1000], [5, 2, 1], 2010, 3)
    assert t[0] == 30 and abs(t.sum() - 2010) < 1e-9 and t[1] == pytest.approx(1320) and t[2] == pytest.approx(660)
    assert MX.water_fill([0, 5], [5, 2], 5, 3).tolist() == [0, 5]


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(0, 200)), f"s{min(rng.randrange(12), 5)}") for i in range(600)]
    rows += [(1000, None, "s0"), (1001, "", None), (1002, "a b c", None), (None, "x y", "s1"), (7, rows[7][1], rows[7][2])]
    docs = documents(spark, rows)
    got = MX.mix_documents(docs).collect()
    again = {(r.doc_id, r.size, r.taken) for r in MX.mix_documents(docs.repartition(7)).collect()}
    assert {(r.doc_id, r.size, r.taken) for r in got} == again
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = MX.water_fill([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], sum(sizes.values()), 3)
    for s, w in zip(order, want, strict=True):
        assert target[s] == pytest.approx(w)
        assert abs(taken[s] - w) <= 48, s
    assert all(r.source_size == sizes[r.source] for r in got)
    assert MX.mix_documents(docs.limit(0)).count() == 0


def padded(histogram, bounds):
    return sum(n * min(b for b in bounds if b >= k) for k, n in histogram.items())


@pytest.mark.parametrize("seed", range(20))
def test_optimal_buckets(seed):
    rng = random.Random(seed)
    h = {rng.randrange(1, 40): rng.randrange(1, 50) for _ in range(rng.randrange(1, 9))}
    k = rng.randrange(1, 5)
    bounds = PK.optimal_buckets(h, k)
    best = min(padded(h, set(c) | {max(h)}) for c in combinations_with_replacement(sorted(h), k - 1)) if k > 1 else padded(h, [max(h)])
    assert padded(h, bounds) == best and len(bounds) <= k and bounds == sorted(bounds)


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 40, 300, 2500]))) for i in range(400)] + [(None, "a b"), (3, rows[3][1]) if False else (3, "z z"), (500, None)]
    docs = documents(spark, rows)
    got = PK.pack_documents(docs, max_length=256, n_buckets=4, budget=1024, rows_per_shard=50).collect()
    pieces, batches = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        if r.n_tokens:
            batches[r.bucket, r.batch].append(r)
        else:
            assert (r.bucket, r.batch, r.slot) == (0, None, None)
    want = Counter()
    for i, t in rows:
        n = len(words(t))
        for s in range(0, max(n, 1), 256):
            want[i, s, min(256, n - s)] += 1
    assert Counter((r.doc_id, r.start, r.n_tokens) for r in got) == want
    for (bucket, _), rs in batches.items():
        assert max(r.n_tokens for r in rs) <= bucket and len(rs) * bucket <= max(1024, bucket)
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    for bucket in {b for b, _ in batches}:
        own = [len(v) for (b, _), v in batches.items() if b == bucket]
        assert sum(n < max(1024 // bucket, 1) for n in own) <= 1
    assert PK.pack_documents(docs.limit(0)).count() == 0


def test_urls(spark):
    rows = [
        (1, "http://A.Example.NET/en/1?x#y"), (2, "https://example.com/de"), (3, "https://x.example.com/de/a"), (4, "ftp://foo.org/fr/z"), (5, None), (6, "no scheme/net/"),
        (7, "http://net/"), (8, "http://net"), (9, "http://internet/"), (10, "http://example.net/de/"), (1, "http://A.Example.NET/en/1?x#y"), (None, ""), (11, "http://a.b.org://net/x"),
        (12, "http://host\n.net/a\nb"),
    ]
    rules = spark.createDataFrame(
        [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("b.org", "/", "allow"), (None, "/", "block")],
        "host string, path string, verdict string",
    )
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("short", F.lit(1)).withColumn("rule", F.lit("q"))
    got = urls.filter_urls(pages, rules, keep=("page_id",))
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert got.count() == len(rows)
    assert by[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert by[2] == ("example.com", "/de", None, "allow") and by[3][2:] == ("example.com/de/", "block")
    assert by[4][2:] == ("org/fr/", "allow") and by[5] == ("", "", None, "allow") and by[6] == ("", "", None, "allow")
    assert by[7][2:] == ("net/", "block") and by[8] == ("net", "", None, "allow") and by[9][2] is None
    assert by[10][2:] == ("net/", "block") and by[None][0] == "" and by[11][:2] == ("a.b.org:", "//net/x")
    assert by[12][:2] == ("host\n.net", "/a\nb") and by[12][2:] == ("net/", "block")
    assert urls.filter_urls(pages, rules.limit(0), keep=("page_id",)).where("verdict = 'allow'").count() == len(rows)


def test_very_long_hosts(spark):
    start = time.perf_counter()
    rows = [(1, "http://" + "a." * 500_000 + "net/x"), (2, "http://" + "b" * 1_000_000 + "/net/"), (3, "http://x/" + "p/" * 300_000)]
    rules = spark.createDataFrame([("net", "/", "block"), ("a.a.net", "/x", "allow"), ("a.b.net", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    by = {r.page_id: r.rule for r in urls.filter_urls(pages, rules, keep=("page_id",)).collect()}
    assert by == {1: "a.a.net/x", 2: None, 3: None} and time.perf_counter() - start < 15


def test_rows_of_one_id_are_dealt_to_many_shards(spark):
    rng = random.Random(6)
    docs = documents(spark, [(7, prose(rng, 20)) for _ in range(400)])
    packed = PK.pack_documents(docs, rows_per_shard=20, n_buckets=1, max_length=64, budget=64)
    assert packed.count() == 400 and packed.select("batch", "slot").distinct().count() == 400
    mixed = MX.mix_documents(docs, docs_per_shard=20)
    assert mixed.agg(F.sum("taken")).first()[0] == 400 * 20
    shards = lambda df: df.groupBy(F.spark_partition_id()).count().count()
    spread = FP.edited_fingerprints(docs, partitions=8)
    assert spread.count() == 400 and shards(docs.withColumn("h", F.xxhash64("text")).repartitionByRange(8, F.col("doc_id"), F.col("h"))) > 4


def toxic_corpus(spark, n=700):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.15
        w = prose(rng, rng.randrange(5, 80)).split()
        if bad:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["moron", "Idiot,", f"zqxv{rng.choice('abcdefgh')}l{rng.randrange(30)}"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_words_and_beginnings(spark):
    rows, labels = toxic_corpus(spark)
    extra = [(5000, None), (5001, ""), (None, "a moron"), (3, rows[3][1])]
    lab = spark.createDataFrame([*labels, (None, 1, 1), (9999, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    got = TX.toxicity(documents(spark, rows + extra), lab).collect()
    assert len(got) == len(rows) + 4
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score < 0.5


def test_copies_of_a_toxic_text_do_not_crowd_out_other_words(spark):
    rng = random.Random(12)
    name = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    copied = " ".join(name(9) for _ in range(400))
    rows = [(i, prose(rng, 30)) for i in range(600)]
    rows += [(1000 + i, copied) for i in range(200)]
    rows += [(2000 + i, f"{prose(rng, 20)} grobnik") for i in range(60)]
    labels = [(i, 1, int(i >= 1000)) for i, _ in rows]
    labels += [(3000, 1, 1)]
    rows += [(3000, f"{copied} {k}") for k in range(50)]  # an id that repeats
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = TX.toxicity(documents(spark, rows + [(5000, f"{prose(rng, 20)} grobnik")]), lab)
    by = {r.doc_id: r.predicted for r in got.collect()}
    assert by[5000] == 1 and all(by[2000 + i] for i in range(60)) and not any(by[i] for i in range(600))


def test_all_precise_features_are_mined(spark):
    rng = random.Random(13)
    bad = [chr(97 + k // 26) + chr(97 + k % 26) + "q" for k in range(400)]  # no common beginnings
    rows = [(" ".join([*prose(rng, 5).split(), w]), 1) for w in bad for _ in range(7)] + [(prose(rng, 8), 0) for _ in range(500)]
    sample = spark.createDataFrame(rows, "text string, toxic int").dropDuplicates(["text"])
    assert set(bad) <= set(TX.mine_features(sample))


def test_held_out_labels_are_never_read(spark):
    rows, labels = toxic_corpus(spark, 400)
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    s = "doc_id long, quality int, toxic int"
    docs = documents(spark, rows)
    a = {r.doc_id: r.score for r in TX.toxicity(docs, spark.createDataFrame(labels, s)).collect()}
    b = {r.doc_id: r.score for r in TX.toxicity(docs, spark.createDataFrame(flip, s)).collect()}
    assert a == b


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "you stupid idiot"), (2, "good day"), (3, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in TX.toxicity(docs, none).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
    assert TX.toxicity(docs.limit(0), none).count() == 0


@pytest.mark.parametrize(
    "text",
    ["You are such an idiot!! Go to hell", "they hate you and KILL them", "a sh**ty f@#k word", "Du bist ein Trottel, halt die Klappe", "espèce d'imbécile, ta gueule", "Eres un payaso. Cállate", "nothing here", "", None,
     "(stupid)loser and trash", "what a \n clown", "You,fool", "son basura\tvete a la calle"],
)
def test_anchors_lose_no_pattern(text):
    want = [k for k, p in enumerate(TX.COMPILED) if p.search(text or "")]
    assert TX.fired_of(text, {}, {}, 0) == want == TX.fired_of(text, {}, {}, 0, TX.heads_of({}))


def test_heads_lose_no_feature():
    rng = random.Random(2)
    wanted, n = TX.voter_numbers(["zqx*", "ab", "moron", "é*", "w12x"])
    for _ in range(200):
        text = " ".join(rng.choice(["zqxa", "Moron!", "ab", "abc", "idiot's", "x-idiot", "w12x", "w13x", "éa", "é", "f*@k", "you", "trash"]) for _ in range(6))
        assert TX.fired_of(text, {}, wanted, n) == TX.fired_of(text, {}, wanted, n, TX.heads_of(wanted))


def table(votes):
    return TX.Rows.of([list(np.flatnonzero(v)) for v in votes], votes.shape[1])


def abusive_votes(rng, n=4000):
    y = rng.random(n) < 0.3
    rates = np.array([[0.05, 0.1, 0.02, 0.02, 0.3], [0.7, 0.4, 0.6, 0.6, 0.3]])
    votes = rng.random((n, 5)) < rates[y.astype(int)]
    votes[:, 3] = np.where(rng.random(n) < 0.95, votes[:, 2], votes[:, 3])  # a voter that repeats another
    return y, rates, np.hstack([votes, ~votes.any(1, keepdims=True)])


def test_label_model_recovers_accuracies():
    y, rates, votes = abusive_votes(np.random.default_rng(0))
    m = TX.LabelModel(prior=0.3)
    post = m.fit(table(votes), np.full(len(y), -1))
    assert ((post > 0.5) == y).mean() > 0.85
    known = np.where(np.arange(len(y)) % 10 == 0, y.astype(int), -1)
    post = m.fit(table(votes), known)
    assert ((post > 0.5) == y).mean() > 0.88
    assert np.abs(m.rates[:, :3] - rates[:, :3]).max() < 0.1
    assert m.parent[3] == 2 or m.parent[2] == 3


def test_two_that_repeat_each_other_count_once():
    y, _, votes = abusive_votes(np.random.default_rng(0))
    rows, w = table(votes), np.stack([~y, y]).astype(float)
    m = TX.LabelModel(prior=0.3)
    m.parent = m.forest(rows, w)
    assert m.parent[3] == 2 and m.parent[0] == m.parent[1] == -1
    total, fires = w.sum(1), np.stack([rows.sums(x) for x in w])
    m.rates = fires / total[:, None]
    pairs = m._pairs(rows)
    m._set(np.stack([np.bincount(rows.at[pairs], x[rows.row[pairs]], 6) for x in w]), fires, total, np.zeros(2))
    logit = lambda *fired: float(np.log((p := m.posterior(TX.Rows.of([fired], 6))[0]) / (1 - p)))
    base, alone = math.log(0.3 / 0.7), np.log(m.rates[1] / m.rates[0])
    assert logit(2) - base == pytest.approx(alone[2])
    assert logit(2, 3) - base < alone[2] + 0.4 and logit(0, 1) - base == pytest.approx(alone[0] + alone[1])


def test_a_label_is_no_vote_on_its_own_row():
    y, _, votes = abusive_votes(np.random.default_rng(4))
    known = np.where(np.arange(len(y)) % 4 == 0, y.astype(int), -1)
    a = TX.LabelModel().fit(table(votes), known)
    for row in (0, 4, 8, 12):
        wrong = known.copy()
        wrong[row] = 1 - wrong[row]
        # The label moves the row no more than any other row with the same votes.
        b = TX.LabelModel().fit(table(votes), wrong)
        same = (votes == votes[row]).all(1)
        assert np.ptp(b[same]) < 1e-12 and abs(b[row] - a[row]) < 0.5


def plain_label_model(votes, labels, calibration=1000.0, edge_gain=12.0, rounds=60):
    """The same estimation in loops over a dense table."""
    n, k = len(votes), len(votes[0])
    known = [[float(x == c) for x in labels] for c in (0, 1)]
    size = [sum(w) for w in known]
    base = [[(sum(w[i] * votes[i][j] for i in range(n)) + c) / (size[y] + 1) for j in range(k)] for y, (w, c) in enumerate(zip(known, (0.05, 0.5), strict=True))]
    weight = [min(calibration, s) for s in size]
    odds = math.log(size[1] / size[0])
    parent, rates, both, fires, total, shift = [-1] * k, base, None, None, None, 0.0

    def posterior():
        out = []
        for v in votes:
            z = odds + shift
            for y, sign in ((1, 1), (0, -1)):
                for j in range(k):
                    if not v[j]:
                        continue
                    p, r = parent[j], rates[y][j]
                    if p >= 0 and v[p]:
                        m = weight[y] * rates[y][p] + 2
                        r = (both[y][j] + m * r) / (fires[y][p] + m)
                    elif p >= 0:
                        m = weight[y] * (1 - rates[y][p]) + 2
                        r = (fires[y][j] - both[y][j] + m * r) / (total[y] - fires[y][p] + m)
                    z += sign * math.log(min(max(r, 1e-6), 1 - 1e-6))
            out.append(1 / (1 + math.exp(-min(max(z, -50), 50))))
        return out

    def gain(i, j, w):
        g = 0.0
        for y in (0, 1):
            cells = Counter()
            for v, x in zip(votes, w[y], strict=True):
                cells[bool(v[i]), bool(v[j])] += x
            a, b, t = cells[True, True] + cells[True, False], cells[True, True] + cells[False, True], sum(cells.values())
            for (s, u), c in cells.items():
                e = (a if s else t - a) * (b if u else t - b) / t
                if c > 1e-9 and e > 1e-9:
                    g += 2 * c * math.log(c / e)
        return g

    post = posterior()
    for r in range(rounds):
        w = [[1 - p for p in post], post]
        if r == 2:
            edges = sorted((-gain(i, j, w), i, j) for i in range(k) for j in range(i) if any(v[i] and v[j] for v in votes))
            group = list(range(k))
            near = defaultdict(list)
            for g, i, j in edges:
                if -g > edge_gain and group[i] != group[j]:
                    group = [min(group[i], group[j]) if x in (group[i], group[j]) else x for x in group]
                    near[i].append(j), near[j].append(i)
            for root in range(k):
                if parent[root] < 0 and group[root] == root:
                    line = [root]
                    for x in line:
                        for z in near[x]:
                            if z not in line:
                                parent[z] = x
                                line.append(z)
        total = [sum(x) for x in w]
        fires = [[sum(x * v[j] for x, v in zip(w[y], votes, strict=True)) for j in range(k)] for y in (0, 1)]
        both = [[sum(x for x, v in zip(w[y], votes, strict=True) if v[j] and parent[j] >= 0 and v[parent[j]]) for j in range(k)] for y in (0, 1)]
        rates = [[(fires[y][j] + weight[y] * base[y][j]) / (total[y] + weight[y]) for j in range(k)] for y in (0, 1)]
        low, high = -60.0, 60.0
        for _ in range(60):
            shift = (low + high) / 2
            sure = [p for p, x in zip(posterior(), labels, strict=True) if x >= 0]
            low, high = (low, shift) if sum(sure) / len(sure) > size[1] / sum(size) else (shift, high)
        new = posterior()
        done = r > 3 and max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-6
        post = new
        if done:
            break
    return post, parent


def test_a_plain_second_label_model_agrees():
    y, _, votes = abusive_votes(np.random.default_rng(7), 600)
    known = np.where(np.arange(len(y)) % 3 == 0, y.astype(int), -1)
    m = TX.LabelModel()
    post = m.fit(table(votes), known)
    want, parent = plain_label_model(votes.tolist(), known.tolist())
    assert np.abs(post - want).max() < 1e-6 and (m.parent >= 0).sum() == sum(p >= 0 for p in parent) > 0


def test_linear_model_is_at_its_optimum():
    rng = np.random.default_rng(1)
    x = rng.random((300, 8)) < 0.3
    y = rng.random(300)
    w = TX.fit_linear(table(x), y)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (y - p) - 0.1 * w[:-1]).max() < 1e-5 and abs((y - p).sum() - 1e-3 * w[-1]) < 1e-5


def test_families_of_near_copies_teach_no_words(spark):
    rng = random.Random(21)
    base = prose(rng, 120, 10**6)
    rows = [(i, f"{base} {prose(rng, 3, 50)}") for i in range(30)] + [(100 + i, prose(rng, 40)) for i in range(300)]
    rows += [(500 + i, f"{prose(rng, 25)} grobnik {prose(rng, 5)}") for i in range(40)]
    labels = [(i, 1, int(i < 100 or i >= 500)) for i, _ in rows]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = TX.fit_toxicity(documents(spark, rows), lab)
    assert any(f.startswith("gro") for f in m.columns) and not set(base.split()) & set(m.columns)


def test_pipeline_stages(spark, tmp_path):
    rows, labels = toxic_corpus(spark, 300)
    rows += [(1000 + k, rows[k][1]) for k in range(40)] + [(2000, "token = 1c383cd30b7c298ab50293adfecb7b18bb and nine other words to fill the text up"), (2001, None)]
    docs = documents(spark, [(i, t, f"s{i % 3}") for i, t in rows])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, columns = docs, docs.columns
    truth = {i for i, _, t in labels if t}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        out = f"{tmp_path}/out-{name}"
        now.write.parquet(out)
        now = spark.read.parquet(out)
        seen.append(now)
        if name != "packing":
            assert now.columns == columns
    kept = {r.doc_id for r in seen[0].collect()}
    assert len(truth & kept) <= 0.05 * len(truth) and {i for i, _ in rows if i < 300} - truth <= kept
    one = [r.doc_id for r in seen[1].collect()]
    assert len(one) == len(set(one)) and not [i for i in one if 1000 <= i < 1040 and i - 1000 in one]
    assert seen[2].where("doc_id = 2000").first().text.startswith("<assign> and")
    assert seen[2].count() == seen[1].count()
    times = Counter(r.doc_id for r in seen[3].collect())
    assert max(times.values()) <= 3
    packed = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: Counter((r.doc_id, r.start, r.n_tokens) for r in df.collect())
    assert key(packed) == key(seen[4])
