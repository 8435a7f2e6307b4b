import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortal.llm import bytenet, negatives, spelling
from tests.llm.helpers import documents

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_negatives(rows, positives=5, negatives=5, floor=80):
    """Hard negatives by looking at all pairs."""
    ok = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ok[i] = ([int(np.floor(256 * x)) for x in v], (y + 1) % 10 if i % 7 == 0 else y)
    score = lambda a, b: sum(x * y for x, y in zip(ok[a][0], ok[b][0], strict=False))
    out = []
    for a in (i for i in ok if i % 100 == 0):
        ranked = sorted((-score(a, b), b) for b in ok if b != a)
        same = [(-s, b) for s, b in ranked if ok[b][1] == ok[a][1]][:positives]
        for ps, p in same:
            hard = [(-s, b) for s, b in ranked if ok[b][1] != ok[a][1] and floor * ps <= -100 * s <= 100 * ps][:negatives]
            out += [(a, p, k + 1, b, ps, s) for k, (s, b) in enumerate(hard)]
    return sorted(out)


def vectors(n, dims, seed, labels=4, grid=8, step=10):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dims)) * grid) / grid
    x[::3] += 1.0
    return [(int(i) * step, [float(c) for c in v], int(rng.integers(labels))) for i, v in enumerate(x)]


def mined(df, **options):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **options).collect())


@pytest.mark.parametrize(("n", "dims", "labels", "grid"), [(300, 6, 3, 8), (700, 3, 2, 2), (200, 16, 10, 64), (120, 4, 1, 4)])
def test_negatives_equal_all_pairs(spark, n, dims, labels, grid):
    rows = vectors(n, dims, n, labels, grid)
    got = mined(spark.createDataFrame(rows, VECTORS))
    assert got == plain_negatives(rows)
    assert labels == 1 or len(got) > 30


def test_negatives_nulls_ties_and_clashes(spark):
    base = vectors(40, 3, 5, 2, 2)
    odd = [(None, [1.0, 1.0, 1.0], 1), (100, None, 1), (200, [1.0, None, 1.0], 1), (300, [float("nan"), 0.0, 1.0], 1), (15, [float("inf"), 0.0, 1.0], 0), (16, [1.0, 1.0, 1.0], None), (17, [2.0], 1), (18, [], 0), (19, [1.0, 1.0, 1.0, 9.0], 1)]
    rows = [r for r in base if r[0] not in (100, 200, 300)] + odd + [(1000 + k, [1.0, 1.0, 1.0], k % 2) for k in range(30)]
    df = spark.createDataFrame(rows, VECTORS)
    want = plain_negatives(rows)
    assert mined(df) == want
    assert mined(df.union(df)) == want  # repeated ids count once
    wide = df.select("*", *[F.lit("z").alias(c) for c in ("vec", "block", "kind", "wanted", "score", "rank", "x", "r", "anchor_id", "positive_id")])
    assert mined(wide) == want
    assert mined(df.limit(0)) == []


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 5)) * 40
    x = np.floor(centres[rng.integers(8, size=4_000)] + rng.normal(size=(4_000, 5)) * 2)
    ids, labels = rng.permutation(4_000).astype(np.int64), rng.integers(3, size=4_000).astype(np.int64)
    tree = negatives.BallTree(ids, labels, x)
    assert sorted(tree.ids) == list(range(4_000)) and len(tree.nodes) > 60
    for (lo, hi, _, _), c, r in zip(tree.nodes, tree.centres, tree.radii, strict=True):
        assert np.sqrt(((tree.rows[lo:hi] - c) ** 2).sum(1)).max() <= r + 1e-9
    q, own = x[:20], np.arange(20)
    low, high = np.full(20, -50.0), np.full(20, 900.0)
    i, found, score = tree.search(q, own, ids[:20], labels[:20], False, low, high, 4)
    for k in range(20):
        s = x @ q[k]
        ok = (labels != labels[k]) & (s >= -50) & (s <= 900) & (ids != ids[k])
        assert list(zip(score[i == k], found[i == k], strict=True)) == [(t, j) for t, j in sorted(zip(s[ok].astype(int), ids[ok], strict=True), key=lambda p: (-p[0], p[1]))[:4]]


def plain_variants(rows, min_length=6, min_n=5, ratio=5):
    """Spelling variants by looking at all pairs of words."""
    import re

    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_n}
    near = {w: [v for v in n if spelling.one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def variants(docs):
    return {r.word: (r.form, r.root, r.n, r.near_n, r.form_n) for r in spelling.spelling_variants(docs).collect()}


@pytest.mark.parametrize(("a", "b", "near"), [("abc", "abd", True), ("abc", "ab", True), ("abc", "xabc", True), ("abc", "abc", False), ("abc", "acb", False), ("aab", "ab", True), ("", "a", True), ("ab", "abcd", False), ("abcd", "bcda", False)])
def test_one_apart(a, b, near):
    assert spelling.one_apart(a, b) is near and spelling.one_apart(b, a) is near


def test_variants_equal_all_pairs(spark):
    rng = random.Random(8)
    letters = "abcéÀ÷"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "aaaaaab", "bbbbbbbb", "Banana", "banana"]
    words = []
    for stem in stems:
        w, n = stem, 150
        while n >= 6:  # a chain of variants, each five times as rare
            words += [w] * n
            k, n = rng.randrange(len(w)), n // 5
            w = w[:k] + rng.choice(["", rng.choice(letters), w[k] * 2]) + w[k + 1 :]
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", ", ", "1", "\n", "日"]).join(words[i::60])) for i in range(60)]
    rows += [(None, "banana banana"), (3, None), (4, ""), (5, "x1y2"), (7, rows[7][1]), (7, rows[7][1])]
    want = plain_variants(rows)
    docs = documents(spark, rows)
    assert variants(docs) == want
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[1] not in (w, v[0]) for w, v in want.items())
    assert variants(docs.select("*", *[F.lit("z").alias(c) for c in ("word", "n", "key", "at", "part", "form", "root", "best", "near_n")])) == want
    assert variants(docs.limit(0)) == {}


def test_variants_of_long_words_and_hot_words(spark):
    long = "ab" * 40
    rows = [(1, f"{long} " * 6), (2, f"{long}c " * 40), (3, f"{long[:-1]}x " * 7), (4, f"{long[:64]} " * 5), (5, f"{long[:63]} " * 30), (6, f"{long[:65]} " * 9), (7, "q" * 50_000 + (" " + "q" * 49_999) * 3), *[(8 + k, "q" * 50_000) for k in range(5)], (20, "hotword " * 50_000)]
    assert variants(documents(spark, rows)) == plain_variants(rows)


def test_equal_keys_of_other_strings_do_not_join():
    import pandas as pd

    b = pd.DataFrame({"part": 0, "key": [7, 7, 7, 7], "at": [1, 1, -1, 0], "first": True, "word": ["kitten", "xyzabc", "unlike", "akitte"], "n": [5, 6, 7, 8]})
    assert spelling.near_in_bucket(b).empty


def clean_and_junk(n, seed):
    """(id, text, quality): prose, and prose whose words carry symbols, shout or repeat."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = ["".join(rng.choice("aeionrstdlmé") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(30, 400))]
        kind = k % 4
        if kind == 0:
            words = [[f"{w}{rng.choice(['###', '%%%', '$$$'])}" for w in words], [f"{w.upper()}!!" for w in words], [w for w in words[:9] for _ in range(30)]][k // 4 % 3]
        out.append((k, " ".join(words), int(kind != 0)))
    return out


def test_network_learns_and_covers_whole_texts(spark):
    rows = clean_and_junk(600, 5)
    docs = documents(spark, [(i, t) for i, t, _ in rows] + [(None, "x"), (9_000, None), (9_001, ""), (9_002, "é" * 700_000), (3, rows[3][1])])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1), (77_777, 0)], "doc_id long, quality int")
    got = bytenet.byte_quality(docs, labels, epochs=25).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    quality = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in quality]
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == quality[r.doc_id] for r in held]) > 0.97
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[3][0] == pytest.approx(by[3][1], abs=1e-5) and by[9_000] == pytest.approx(by[9_001])
    again = bytenet.byte_quality(docs, labels, epochs=25).collect()
    assert sorted((str(r.doc_id), r.predicted) for r in got) == sorted((str(r.doc_id), r.predicted) for r in again)


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(0, 0)]])
def test_network_without_both_labels(spark, labels):
    docs = documents(spark, [(k, f"text {k}") for k in range(5)])
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    scores = {round(r.score, 6) for r in bytenet.byte_quality(docs, known).collect()}
    share = [y for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    assert scores == {round(min(max(np.mean(share), 1e-3), 1 - 1e-3), 6) if share else 0.5}
    assert bytenet.byte_quality(docs.limit(0), known).collect() == []


def plain_score(net, text):
    """The network as its definition says: every window of every chunk, one at a time."""
    x = bytenet.padded(text)
    blocks = len(x) // bytenet.BLOCK
    ahead = np.r_[x, np.zeros(bytenet.STRIDE, np.uint8)]
    hidden = []
    for b in range(blocks - 1):
        parts = []
        for part in range(b * bytenet.BLOCK, (b + 2) * bytenet.BLOCK, bytenet.BLOCK // bytenet.PARTS):
            starts = range(part, part + bytenet.BLOCK // bytenet.PARTS, bytenet.STRIDE)
            parts.append(np.max([net.codes[ahead[s : s + 8]].ravel() @ net.filters for s in starts], axis=0))
        pooled = np.r_[np.max(parts, axis=0), -np.min(parts, axis=0)]
        hidden.append(np.maximum(np.maximum(pooled + net.bias, 0) @ net.hidden + net.hidden_bias, 0))
    return 1 / (1 + np.exp(-(np.mean(hidden, axis=0) @ net.out + net.out_bias[0])))


def test_scores_equal_the_definition(monkeypatch):
    net = bytenet.ByteNet.start(3, 0.4)
    net.out *= 30
    net.bias += 0.1
    texts = [None, "", "a", "x" * 251, "x" * 252, "x" * 253, "y" * 508, "äöü😀" * 400, " ".join(map(str, range(4_000)))]
    want = [plain_score(net, t) for t in texts]
    for size in (1, 3, 512):
        monkeypatch.setattr(bytenet, "SLICE_BLOCKS", size)
        assert net.scores([bytenet.padded(t) for t in texts]) == pytest.approx(want, abs=1e-4)
    assert max(want) - min(want) > 0.01


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(4)
    net = bytenet.ByteNet.start(5, 0.5)
    for name in ("codes", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.bias += 0.3
    net.hidden_bias += 0.2
    chunks = [bytenet.spread_chunks("".join(map(chr, rng.integers(32, 127, n))), 4) for n in (900, 200, 3_000)]
    x, doc, y = np.concatenate(chunks), np.repeat([0, 1, 2], [len(c) for c in chunks]), np.array([0.0, 1.0, 1.0])
    _, slopes = net.gradients(x, doc, y)
    for name, slope in zip(("codes", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias"), slopes, strict=True):
        w = getattr(net, name)
        for at in np.argsort(-np.abs(slope).ravel())[:3]:
            k, keep, h = np.unravel_index(at, w.shape), w.flat[at], 1e-5
            w[k] = keep + h
            up = net.gradients(x, doc, y)[0]
            w[k] = keep - h
            down = net.gradients(x, doc, y)[0]
            w[k] = keep
            assert slope[k] == pytest.approx((up - down) / (2 * h), rel=2e-2, abs=1e-6), name


def test_chunks_for_training_are_spread_over_the_whole_text():
    text = "".join(chr(97 + k // 4_000) for k in range(80_000))
    chunks = bytenet.spread_chunks(text, 8)
    assert chunks.shape == (8, 516) and chunks[0][0] == 97 and 97 + 19 in chunks[-1]
    assert bytenet.spread_chunks("", 8).shape == (1, 516) and bytenet.spread_chunks("z" * 900, 8).shape == (3, 516)


def test_network_clashing_names(spark):
    docs = documents(spark, [(i, t) for i, t, _ in clean_and_junk(40, 2)])
    labels = spark.createDataFrame([(i, y) for i, _, y in clean_and_junk(40, 2)], "doc_id long, quality int")
    wide = docs.select("*", *[F.lit("z").alias(c) for c in ("key", "y", "size", "chunks", "row", "score", "predicted", "held_out", "quality")])
    one, two = (sorted(map(str, bytenet.byte_quality(d, labels, epochs=2).collect())) for d in (docs, wide))
    assert one == two


def test_runs_of_long_texts_are_the_same(monkeypatch):
    text = " ".join(random.Random(1).choice(["abc", "É", "x1y", "日本", "÷×", "Zebra-crossing"]) for _ in range(500)).encode().lower()
    short = list(spelling.runs_of(text))
    monkeypatch.setattr(spelling, "LONG_TEXT", 10)
    assert list(spelling.runs_of(text)) == short and len(short) > 400


def test_partitions_without_rows(spark):
    """Few rows in many partitions, and rows that say nothing."""
    rows = [(k, t) for k, t in enumerate(["banana " * 6, None, "", "x y z", "12 34"])]
    spread = spark.createDataFrame(spark.sparkContext.parallelize([(k, t, "en", "s", None) for k, t in rows], 24), "doc_id long, text string, lang string, source string, n_chars long")
    assert variants(spread) == plain_variants(rows)
    nothing = spread.where("doc_id > 2").union(spread.where("doc_id < 0"))
    assert variants(nothing) == {}
    labels = spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, quality int")
    assert len(bytenet.byte_quality(spread, labels, epochs=1).collect()) == 5
    given = vectors(60, 4, 1)
    few = spark.createDataFrame(spark.sparkContext.parallelize(given, 100), VECTORS)
    assert mined(few) == plain_negatives(given)


def test_toxicity_of_texts_without_words(spark):
    from cohortal.llm import toxicity

    docs = documents(spark, [(k, ["", " ", None, "!?"][k % 4]) for k in range(40)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 40
