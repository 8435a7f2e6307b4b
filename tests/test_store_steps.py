"""Positions, alignment, schema steps, views with a fallback, digests and completeness."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cohortal.operators import alignment as L
from cohortal.operators import audit as A
from cohortal.operators import image as I
from cohortal.operators import migration as G


def files_of(root):
    return sorted((os.path.join(d, f), os.path.getmtime(os.path.join(d, f))) for d, _, fs in os.walk(root) for f in fs)


def test_positions_follow_files_and_rows(spark, tmp_path):
    rows = list(range(50))
    for k, part in enumerate((rows[:20], rows[20:21], rows[21:])):
        spark.createDataFrame([(v,) for v in part], "v long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t{k}")
    paths = [f"{tmp_path}/t{k}" for k in range(3)]
    got = L.file_positions(spark.read.parquet(*reversed(paths))).orderBy("row_index").collect()
    assert [(r.row_index, r.v) for r in got] == [(k, k) for k in rows]
    assert L.file_positions(spark.read.parquet(paths[0]).where("v >= 5"), "at").agg(F.min("at")).first()[0] == 5


def features(spark, rows):
    return spark.createDataFrame(rows, "row_index long, file string, label int, x double")


GOOD = [(k, f"f{k}.jpg", k % 3, float(k)) for k in range(12)]


def bad(spark, rows):
    tables = {"hc": features(spark, GOOD), "deep": features(spark, rows)}
    return {(r.table, r.check): r.observed for r in L.alignment_checks(tables, ["file", "label"]).where("status = 'FAIL'").collect()}


def test_alignment_checks(spark):
    assert bad(spark, random.Random(1).sample(GOOD, 12)) == {}
    assert bad(spark, GOOD[:-1]) == {("deep", "rows"): 1, ("deep", "unmatched"): 1}
    assert bad(spark, GOOD[:5] + GOOD[6:]) == {("deep", "rows"): 1, ("deep", "gaps"): 1, ("deep", "unmatched"): 1}
    assert bad(spark, GOOD + [GOOD[3]]) == {("deep", "rows"): 1, ("deep", "repeated"): 1, ("deep", "gaps"): 1}
    assert bad(spark, [(11 - k, *r) for k, *r in GOOD])[("deep", "column file")] == 12
    assert bad(spark, [(k, f, None if k == 4 else y, x) for k, f, y, x in GOOD]) == {("deep", "column label"): 1}
    assert bad(spark, [(None if k == 4 else k, f, y, x) for k, f, y, x in GOOD]) == {("deep", "null"): 1, ("deep", "gaps"): 1, ("deep", "unmatched"): 1}
    assert bad(spark, []) == {("deep", "rows"): 12, ("deep", "unmatched"): 12}


def test_aligned_joins_or_raises(spark):
    tables = {"hc": features(spark, GOOD), "a": features(spark, GOOD).withColumn("y", F.col("x") * 2), "c": features(spark, list(reversed(GOOD)))}
    out = L.aligned(tables, ["file", "label"])
    assert out.columns == ["row_index", "file", "label", "hc_x", "a_x", "y", "c_x"]
    assert [(r.hc_x, r.y, r.c_x) for r in out.orderBy("row_index").collect()] == [(k, 2 * k, k) for k in range(12)]
    with pytest.raises(ValueError, match="c: column label 12"):
        L.aligned(tables | {"c": features(spark, GOOD).withColumn("label", F.lit(9))}, ["file", "label"])
    with pytest.raises(ValueError, match="hc: repeated 1"):
        L.aligned({"hc": features(spark, [*GOOD, GOOD[0]]), "a": features(spark, [*GOOD, GOOD[0]])}, ["file"])


@pytest.mark.parametrize("start", [0, 1, 2, 3, 4])
def test_every_version_upgrades(spark, tmp_path, start):
    root = str(tmp_path / "store")
    assert G.migrate(spark, root, 1, to=start) == list(range(1, start + 1)) if start else G.store_version(spark, root) == 0
    if start:
        a = G.open_store(spark, root)["analysis"]
        one = spark.createDataFrame([("x", 5)], "id string, ts long")
        G.replace_tables(spark, root, {"analysis": a.unionByName(one, allowMissingColumns=True)}, 2)
    assert G.migrate(spark, root, 3) == list(range(start + 1, 6)) and G.store_version(spark, root) == 5
    tables = G.open_store(spark, root)
    assert set(tables) == {"patient", "analysis", "validation", "verified_label", "audit_log", "settings"}
    assert {"archived", "model_bundle_sha256", "thr_atyp", "lesion_id", "capture_date"} <= set(tables["analysis"].columns)
    assert len(set(tables["analysis"].columns)) == len(tables["analysis"].columns)
    if start:
        row = tables["analysis"].first()
        assert (row.id, row.ts, row.score_mel, row.archived) == ("x", 5, None, None if start >= 3 else 0)
    before = files_of(root)
    assert G.migrate(spark, root, 4) == [] and files_of(root) == before


def test_a_failed_step_is_taken_up_again(spark, tmp_path):
    root, calls = str(tmp_path), []

    def twice(tables):
        calls.append(sorted(tables))
        if len(calls) == 1:
            # One table is written before the other fails on its executor.
            boom = F.udf(lambda v: 1 // 0, "int")
            return {"a": tables["a"].withColumn("w", F.lit(1)), "b": tables["b"].withColumn("w", boom("v"))}
        return {"a": tables["a"].withColumn("w", F.lit(2)), "b": tables["b"].withColumn("w", F.lit(2))}

    steps = [G.Step(1, "start", create={"a": "v int", "b": "v int"}), G.Step(2, "both", also=twice), G.Step(5, "last", add={"b": {"z": ("string", "new")}})]
    assert G.migrate(spark, root, 0, steps[:1]) == [1]
    rows = spark.createDataFrame([(1,), (2,)], "v int")
    G.replace_tables(spark, root, {"a": rows, "b": rows}, 0)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        G.migrate(spark, root, 1, steps)
    assert G.store_version(spark, root) == 1 and G.open_store(spark, root)["a"].columns == ["v"]
    assert G.migrate(spark, root, 2, steps) == [2, 5] and calls == [["a", "b"]] * 2
    got = G.open_store(spark, root)
    assert sorted(map(tuple, got["a"].collect())) == [(1, 2), (2, 2)] and sorted(map(tuple, got["b"].collect())) == [(1, 2, "new"), (2, 2, "new")]
    assert [r.version for r in G.versions(spark, root).orderBy("seq").collect()] == [1, 1, 2, 5]


def test_steps_that_cannot_run(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="have to rise"):
        G.migrate(spark, root, 0, [G.Step(2, "b"), G.Step(1, "a")])
    with pytest.raises(ValueError, match="no table c"):
        G.migrate(spark, root, 0, [G.Step(1, "a", add={"c": {"x": ("int", 0)}})])
    assert G.store_version(spark, root) == 0
    G.migrate(spark, root, 0, [G.Step(7, "a", create={"c": "x int"})])
    with pytest.raises(ValueError, match="newer than step 5"):
        G.migrate(spark, root, 0)


def fnv1a(data, signed=False):
    h = 0xCBF29CE484222325
    for x in data:
        h = (h ^ x) * 0x100000001B3 % (1 << 64)
    return f"-{(1 << 64) - h:x}".rjust(16, "0") if signed and h >> 63 else f"{h:016x}"


def test_fnv_equals_the_loop(spark):
    rng = random.Random(3)
    values = [b"", b"a", b"foobar", b"\x00", b"\xff" * 9, *[rng.randbytes(rng.randrange(1, 60)) for _ in range(200)], rng.randbytes(20_000), None]
    assert fnv1a(b"") == "cbf29ce484222325" and fnv1a(b"a") == "af63dc4c8601ec8c"
    df = spark.createDataFrame([(v,) for v in values], "b binary")
    for signed in (False, True):
        out = df.select("b", A.fnv1a_64("b", signed).alias("h"))
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
        assert [r.h for r in out.collect()] == [None if v is None else fnv1a(v, signed) for v in values]


def manifest(**changed):
    import hashlib

    digests = [hashlib.sha256(n.encode()).hexdigest() for n in ("u", "c")]
    whole = hashlib.sha256(b"".join(n.encode() + b"\0" + bytes.fromhex(d) for n, d in zip("uc", digests, strict=True))).hexdigest()
    base = {"components": list(zip("uc", digests, strict=True)), "classes": ["n", "m"], "thresholds": {"a": 0.0, "b": 1.0}, "bundle_sha256": whole, "files": digests}
    return base | changed


def test_manifest_checks(spark):
    good = manifest()
    one, two = (d for _, d in good["components"])
    cases = {
        "good": (good, []),
        "order": (manifest(components=good["components"][::-1]), [("components", "c,u")]),
        "missing": (manifest(components=good["components"][:1]), [("components", "u")]),
        "none": (manifest(components=None, classes=None), [("classes", ""), ("components", "")]),
        "upper": (manifest(components=[("u", one.upper()), ("c", two)]), [("sha256", "u")]),
        "classes": (manifest(classes=["m", "n"]), [("classes", "m,n")]),
        "high": (manifest(thresholds={"a": 1.1, "b": float("nan")}), [("thresholds", "a"), ("thresholds", "b")]),
        "low": (manifest(thresholds={"a": -0.1}), [("thresholds", "a"), ("thresholds", "b")]),
        "bundle": (manifest(bundle_sha256="0" * 64), [("bundle_sha256", "not that of the components")]),
        "no bundle": (manifest(bundle_sha256=None), [("bundle_sha256", "no digest")]),
        "file": (manifest(files=[one, one]), [("file", "c")]),
    }
    schema = "id string, components array<struct<name: string, sha256: string>>, classes array<string>, thresholds map<string, double>, bundle_sha256 string, files array<string>"
    df = spark.createDataFrame([(k, m["components"], m["classes"], m["thresholds"], m["bundle_sha256"], m["files"]) for k, (m, _) in cases.items()], schema)
    out = A.manifest_checks(df, "id", ["u", "c"], ["n", "m"], ["a", "b"], "files")
    got = {k: [] for k in cases}
    for r in out.collect():
        got[r.id].append((r.check, r.detail))
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, (_, w) in cases.items()}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_completeness(spark):
    t = lambda rows: spark.createDataFrame(rows, "k long, v double, s string")
    source = t([(k, k / 3, "x") for k in range(9)] + [(None, None, "y")])
    whole = {"same": source, "short": source.where("k > 0 or k is null"), "more": source.union(t([(99, 0.0, "z")])), "twice": source.where("k < 8").union(source.where("k = 2")).union(source.where("k is null")), "off": source.withColumn("v", F.col("v") + F.when(F.col("k") == 5, 1e-5).otherwise(1e-8)), "null": source.withColumn("v", F.when(F.col("k") != 3, F.col("v")))}
    names = [*whole, "lost"]
    out = A.completeness(dict.fromkeys(names, source), whole, dict.fromkeys(names, ["k"]), {n: ["v"] for n in names if n != "lost"})
    got = {r.table: (r.expected_rows, r.rows, r.missing_keys, r.extra_keys, r.repeated_keys, r.off_values, r.status) for r in out.collect()}
    assert got == {
        "same": (10, 10, 0, 0, 0, 0, "PASS"), "short": (10, 9, 1, 0, 0, 0, "FAIL"), "more": (10, 11, 0, 1, 0, 0, "FAIL"), "twice": (10, 10, 1, 0, 1, 0, "FAIL"),
        "off": (10, 10, 0, 0, 0, 1, "FAIL"), "null": (10, 10, 0, 0, 0, 1, "FAIL"), "lost": (10, 0, 10, 0, 0, 0, "FAIL"),
    }


def test_views_with_fallback(spark):
    rows = spark.createDataFrame([(k, "x") for k in range(8)], "k long, note string")
    side = lambda at, v: spark.createDataFrame([(k, bytes([v, k]) if k != 6 else None) for k in at], "k long, b binary")
    prepared, raw = side([0, 1, 2, 6], 1), side([1, 2, 3, 4, 6], 2)

    def model():
        def run(batch):
            if any(b[1] == 4 for (b,) in batch):
                raise ValueError("four")
            return [(b[0] * 10 + b[1],) for (b,) in batch]

        return run

    doubled = lambda d: d.withColumn("b", F.concat(F.unhex(F.lit("05")), F.substring("b", 2, 1)))
    out = I.embedded_views(rows.repartition(1), prepared, raw, ["k"], ["b"], model, "v int", prepare=doubled)
    got = {r.k: (r.note, r.view_source, r.v, r.error) for r in out.collect()}
    tags = ("dehair_file", "dehair_fallback_raw")
    assert got == {
        0: ("x", tags[0], 10, None), 1: ("x", tags[0], 11, None), 2: ("x", tags[0], 12, None), 3: ("x", tags[1], 53, None), 4: ("x", tags[1], None, "ValueError: four"),
        5: ("x", None, None, "missing"), 6: ("x", None, None, "missing"), 7: ("x", None, None, "missing"),
    }
    read = I.with_fallback(rows, prepared, raw, ["k"], ["b"], readable=F.length("b") > 5)
    assert read.where("view_source is not null").count() == 0


def glcm(picture, width):
    """Descriptors of a matrix of levels (None: outside the mask), pair by pair."""
    n = {}
    for i, v in enumerate(picture):
        for j in ([i + 1] if (i + 1) % width else []) + [i + width]:
            if j < len(picture) and v is not None and picture[j] is not None:
                for p in ((v, picture[j]), (picture[j], v)):
                    n[p] = n.get(p, 0) + 1
    t = sum(n.values())
    if not t:
        return None
    mean = lambda f: sum(c * f(*p) for p, c in n.items()) / t
    mu = mean(lambda a, b: a)
    var = mean(lambda a, b: (a - mu) ** 2)
    return (
        mean(lambda a, b: (a - b) ** 2), mean(lambda a, b: abs(a - b)), mean(lambda a, b: 1 / (1 + (a - b) ** 2)), sum(c * c for c in n.values()) ** 0.5 / t,
        mean(lambda a, b: (a - mu) * (b - mu)) / var if var > 1e-12 else 1.0,
    )


def test_picture_descriptors_stay_in_their_row(spark):
    rng = random.Random(6)
    pictures = {k: [rng.choice([-1.0, 0.0, *range(1, 5)]) * 1.0 for _ in range(rng.randrange(1, 31))] for k in range(40)} | {50: [], 51: None, 52: [2.0] * 12, 53: [-1.0] * 12, 54: [None, float("nan"), 3.0, 3.0, 1.0]}
    df = spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in pictures.items()], "id long, v array<double>")
    out = I.cooccurrence_table(df, "id", "v", 5, lambda v: v, 6)
    got = {r.id: (r.contrast, r.dissimilarity, r.homogeneity, r.energy, r.correlation) for r in out.collect()}
    on = lambda x: int(x) if x is not None and x > 0 else None
    want = {k: w for k, v in pictures.items() if v and (w := glcm([on(x) for x in v], 5))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    tables = [out, I.asymmetry_table(df, "id", "v", 5), I.box_counts(df, "id", "v", 5, [1, 2, 3]), I.moments_table(df, "id", "v")]
    for t in tables:
        plan = t._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan
    boxes = {r.id: r.boxes for r in tables[2].collect()}
    for k, v in pictures.items():
        cells = {(s, i // 5 // s, i % 5 // s) for s in (1, 2, 3) for i, x in enumerate(v or []) if on(x)}
        assert boxes.get(k, 0) == len(cells)
    assert {r.id: r.a4 for r in tables[1].collect()}[52] == 1.0
    assert {r.id: (r.n, r["std"]) for r in tables[3].collect()}[54] == (3, pytest.approx((8 / 9) ** 0.5))


def test_copies_of_an_image_make_a_star(spark):
    rng = random.Random(1)
    a, mask = rng.randbytes(32 * 40 * 3), bytes(32 * 40)
    b = bytes([a[0] ^ 1]) + a[1:]
    df = spark.createDataFrame([(k, 32, 40, a, mask) for k in range(60)] + [(k, 32, 40, b, mask) for k in range(60, 65)], "id long, height int, width int, bgr binary, mask binary")
    got = sorted((r.member_1, r.member_2, r.pixel_max_abs_difference) for r in I.near_duplicate_images(df).collect())
    assert got == sorted([(0, k, 0) for k in range(1, 60)] + [(60, k, 0) for k in range(61, 65)] + [(0, 60, 1)])
