import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortal.functions import pixels as X
from cohortal.functions import text as TF
from cohortal.operators import image as I
from cohortal.sources import files, sinks
from cohortal.streaming import recent


def tree(root, spec):
    for path, data in spec.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(root)


def test_csv_scans(spark, tmp_path):
    root = tree(tmp_path, {"a.csv": b"Image_ID,value,extra\nham_1.jpg,1.5,x\n,bad,\n"})
    df = files.read_csv(spark, f"{root}/a.csv", "image_id string, value double, extra string")
    assert [(r.image_id, r.value) for r in df.select("image_id", "value").collect()] == [("ham_1.jpg", 1.5), (None, None)]
    assert files.read_strings(spark, f"{root}/missing.csv") is None
    got = files.read_columns(spark, f"{root}/a.csv", {"id": ["isic_id", "image_id"], "v": ["VALUE"]})
    assert got.columns == ["id", "v"] and files.read_columns(spark, f"{root}/a.csv", {"id": ["nope"]}) is None


def test_trees_and_manifests(spark, tmp_path):
    root = tree(
        tmp_path / "data",
        {"valid/melanoma/b.JPG": b"1", "train/nevus/z.jpg": b"22", "train/melanoma/a.png": b"333", "other/x/y.jpg": b"4", "train/nevus/readme.txt": b"n"},
    )
    t = {r.row_index: (r.path, r.split_original, r.class_name) for r in files.split_tree(spark, root).collect()}
    assert t == {0: ("train/melanoma/a.png", "train", "melanoma"), 1: ("train/nevus/z.jpg", "train", "nevus"), 2: ("valid/melanoma/b.JPG", "valid", "melanoma")}
    assert {r.file: r.true for r in files.class_tree(spark, root, {"nevus": 0, "melanoma": 1}).collect()} == {"a.png": 1, "z.jpg": 0, "b.JPG": 1}
    m = {r.path: (r.bytes, len(r.sha256)) for r in files.raw_manifest(spark, root, 5).collect()}
    assert m["train/nevus/z.jpg"] == (2, 64)
    with pytest.raises(ValueError, match="expected 9"):
        files.raw_manifest(spark, root, 9)
    assert {r.stem for r in files.stem_index(spark, root).collect()} == {"z", "b", "y"}
    found = files.metadata_files(spark, [root, f"{root}/none"], ["*.txt", "*.jpg"], exclude=["/other/"])
    assert sorted((r.path.rsplit("/", 1)[1], r.bytes) for r in found.collect()) == [("readme.txt", 1), ("z.jpg", 2)]
    assert files.metadata_files(spark, [f"{root}/none"], ["*.txt"]).count() == 0


def test_logs_manifest_backups(spark, tmp_path):
    root = tree(tmp_path / "l", {"cv.log": b"metric a 0.1 0.2 0.3 0.4 0.5 0.6 0.7 0.8\nmetric b 0.1\nnone 0.1 0.2 0.3 0.4 0.5 0.6 0.7 0.8\n"})
    assert [(r.low, r.high) for r in files.log_metrics(spark, f"{root}/cv.log").collect()] == [(0.5, 0.6)]
    good = {"bundle_id": "b", "created": "2024-01-01", "classes": ["n"], "thresholds": {"melanoma": 0.1, "atypical": 0.2, "nevus": 0.3}, "components": [{"name": "u", "path": "p", "sha256": "s"}]}
    tree(tmp_path / "m", {"good.json": json.dumps(good, indent=1).encode(), "bad.json": json.dumps({k: v for k, v in good.items() if k != "classes"}).encode()})
    assert files.read_manifest(spark, f"{tmp_path}/m/good.json").first().components[0].name == "u"
    with pytest.raises(ValueError, match="classes"):
        files.read_manifest(spark, f"{tmp_path}/m/bad.json")
    tree(tmp_path / "b", {"backup_5/audit/x": b"12", "backup_17/audit/x": b"1", "backup_old/y": b"123", "misc/z": b"1"})
    got = [(r.name, r.ts, r.bytes) for r in files.list_backups(spark, f"{tmp_path}/b").collect()]
    assert got == [("backup_17", 17, 1), ("backup_5", 5, 2), ("backup_old", 0, 3)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "condition int, v double").withColumn("row_index", F.lit(0))
    sinks.write_csv(df, f"{tmp_path}/c", "%.6f")
    assert sorted(r.v or "" for r in spark.read.csv(f"{tmp_path}/c", header=True).collect()) == ["", "0.500000"]
    with pytest.raises(ValueError, match="nothing"):
        sinks.write_csv(df.limit(0), f"{tmp_path}/d", allow_empty=False)
    with pytest.raises(ValueError, match="repeated"):
        sinks.write_observations([df, df], f"{tmp_path}/e")
    sinks.write_observations([df, df.withColumn("condition", F.lit(9)).limit(1)], f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e").count() == 3
    r = sinks.ragged(spark, [{"a": 1}, {"b": 2.5, "a": None}])
    assert r.columns == ["a", "b"] and [tuple(x) for x in r.collect()] == [("1", None), (None, "2.5")]
    calls = []
    make = lambda: calls.append(1) or df
    assert sinks.cached(spark, f"{tmp_path}/k", make).count() == sinks.cached(spark, f"{tmp_path}/k", make).count() == 2 and len(calls) == 1
    assert sinks.resume(df, df.where("condition = 1"), "condition").count() == 1
    path = sinks.snapshot({"t": df}, str(tmp_path), 7)
    assert sinks.restore(spark, path, ["t"])["t"].count() == 2
    with pytest.raises(ValueError, match="missing"):
        sinks.restore(spark, path, ["t", "u"])
    assert sinks.markdown(df.limit(0)) == "_empty_" and "| 1 | 0.5000 | 0 |" in sinks.markdown(df)
    many = spark.range(1500).select(F.col("id").alias("n"))
    assert sinks.markdown(many).count("\n") == 1501
    assert sinks.markdown(many, limit=3).endswith("_1497 more rows_") and "more" not in sinks.markdown(many, limit=1500)
    root = tree(tmp_path / "f", {"a.csv": b"h\n1\n2\n"})
    rec = json.loads(sinks.artifact_manifest(files.file_tree(spark, root, content=True)).first().value)
    assert rec["rows"] == 2 and rec["bytes"] == 6


def test_text_functions(spark):
    r = spark.createDataFrame([("a.b.jpg", "2024-02-30", " ", float("nan"))], "f string, d string, b string, x double").select(
        TF.stem(F.col("f")).alias("s"), TF.suffix(F.col("f")).alias("e"), TF.iso_date(F.col("d")).alias("d"), TF.blank_to_null(F.col("b")).alias("b"), TF.clean_number(F.col("x")).alias("x"),
        TF.csv_cell(F.lit('q"q')).alias("c"), TF.day(F.lit(None).cast("long")).alias("n"), TF.half_even(F.lit(2.5)).alias("h"),
    ).first()
    assert tuple(r) == ("a.b", ".jpg", None, None, None, '"q""q"', "—", 2.0)


def test_stream_windows_and_latest(spark, tmp_path):
    src = f"{tmp_path}/events"
    rows = [(k, 3_600_000 * (k % 3), f"t{k % 2}", float(k)) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, ms long, event_type string, value double").withColumn("ts", F.timestamp_millis("ms"))
    df.repartition(3).write.parquet(src)
    schema = "id long, ms long, event_type string, value double, ts timestamp"
    stream = recent.event_stream(spark, src, schema)
    q = recent.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start.hour, r.event_type): r.n for r in spark.table("w").collect()}
    assert sum(got.values()) == 30 and len(got) == 6
    q = recent.latest_values(recent.event_stream(spark, src, schema), "event_type", "id", "value", "string").writeStream.outputMode("update").format("memory").queryName("l").trigger(availableNow=True).start()
    q.awaitTermination(120)
    best = {}
    for r in spark.table("l").collect():
        best[r.event_type] = max(best.get(r.event_type, (-1, 0)), (r.at, r.value))
    assert best == {"t0": (28, 28.0), "t1": (29, 29.0)}


def disk(n, r):
    y, x = np.ogrid[:n, :n]
    return (y - n // 2) ** 2 + (x - n // 2) ** 2 <= r * r


def star(n, r, k=9):
    y, x = np.mgrid[:n, :n] - n // 2
    return np.hypot(y, x) <= r * (0.65 + 0.35 * np.cos(k * np.arctan2(y, x)))


def test_shapes():
    d, s, j = disk(256, 90), np.zeros((256, 256), bool), star(256, 90)
    s[60:200, 60:200] = True
    assert X.asymmetry(d) == pytest.approx(1) and X.asymmetry(np.zeros((4, 4), bool)) == 1.0 and X.asymmetry(np.ones((4, 4), bool)) == 1.0
    b, feret = X.border(d)
    assert 1.0 <= b < 1.2 and abs(feret - 180) < 2 and X.border(j)[0] > 1.5 * b
    assert X.border(np.zeros((5, 5), bool)) == (0.0, 0.0)
    smooth, jagged = X.minkowski(d)[-1], X.minkowski(j)[-1]
    assert abs(smooth - 1) < 0.15 and jagged > smooth and X.minkowski(np.zeros((9, 9), bool)) == [0.0] * 11
    assert abs(X.box_dimension(X.boundary(d)) - 1) < 0.2 and X.box_dimension(X.boundary(np.eye(3, dtype=bool))) == 0.0
    assert X.largest_component(np.array([[1, 0, 1], [0, 0, 1]], bool)).sum() == 2
    assert X.components(np.array([[1, 0, 1], [0, 1, 0], [1, 0, 1]], bool)).max() == X.components(np.array([[1, 0, 1], [0, 1, 0], [1, 0, 1]], bool))[0, 0]
    got = X.shape(d)
    assert got["solidity"] > 0.97 and X.shape(j)["solidity"] < got["solidity"] and X.shape(np.zeros((9, 9), bool)) is None
    assert X.fallback_mask(np.zeros((10, 10), bool), 0.05, "frame").all() and X.fallback_mask(np.zeros((10, 10), bool), 0.05, "disk").any()


def test_morphology_against_definition():
    rng = np.random.default_rng(0)
    m = rng.random((23, 31)) < 0.2
    k = X.ellipse(2)
    want = np.zeros_like(m)
    for y, x in np.argwhere(m):
        for dy, dx in np.argwhere(k) - 2:
            if 0 <= y + dy < 23 and 0 <= x + dx < 31:
                want[y + dy, x + dx] = True
    assert (X.dilate(m, k) == want).all() and (X.erode(m, k) == ~X.dilate(~m, k)).all()


def test_textures_colours_and_hashes():
    g = np.tile(np.array([[0, 255], [255, 0]], np.uint8), (8, 8))
    m = np.ones_like(g, bool)
    contrast, dissim, homog, energy, corr = X.glcm(g, m)
    assert contrast == 225 and dissim == 15 and corr == pytest.approx(-1) and X.glcm(g, ~m) == [0.0] * 5
    assert X.lbp(np.full((5, 5), 9, np.uint8), np.ones((5, 5), bool)) == [0.0, 1.0]
    red = np.zeros((8, 8, 3), np.uint8)
    red[..., 2] = 200
    assert X.spread(red, np.ones((8, 8), bool)) == pytest.approx([0, 255, 0, 0, 1])
    assert X.colour(red, np.ones((8, 8), bool)) == [0.0] * 4
    white = X.lab(np.full((1, 1, 3), 255, np.uint8))[0, 0]
    assert white.tolist() == [100, 128, 128]
    rng = np.random.default_rng(1)
    img = rng.integers(0, 255, (64, 64, 3)).astype(np.uint8)
    assert X.perceptual_hash(img) == X.perceptual_hash(img.copy()) and X.difference_hash(img) != X.difference_hash(img[:, ::-1])
    assert len(X.image_features(img, np.ones((64, 64), bool))) == 16 and X.image_features(img, np.zeros((64, 64), bool)) == [0.0] * 16
    assert X.network_input(img, 32).shape == (3, 32, 32) and len(X.orientations(img)) == 8
    assert X.mask_from_logits(np.array([[-1.0, 0.0], [2.0, 1.0]]), 4, 4).sum() == 8
    assert X.dice(np.ones(4), np.ones(4)) == pytest.approx(1)
    line = np.full((40, 40, 3), 200, np.uint8)
    line[:, 20] = 20
    assert X.hair_mask(line)[:, 20].all() and abs(int(X.dehair(line)[5, 20, 0]) - 200) < 3
    dark = np.full((30, 30, 3), 220, np.uint8)
    dark[10:20, 10:20] = 30
    assert X.otsu_mask(dark).sum() == 100


def test_image_udfs_and_near_duplicates(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 250, (32, 40, 3)).astype(np.uint8)
    b = a.copy()
    b[0, 0, 0] += 1
    c = rng.integers(0, 250, (32, 40, 3)).astype(np.uint8)
    mask = np.zeros((32, 40), np.uint8)
    mask[8:24, 10:30] = 255
    rows = [(k, 32, 40, x.tobytes(), mask.tobytes()) for k, x in enumerate((a, b, c))] + [(9, 32, 40, b"short", mask.tobytes()), (10, None, 40, None, None)]
    df = spark.createDataFrame(rows, "id int, height int, width int, bgr binary, mask binary")
    f = {r.id: r.f for r in df.select("id", I.handcrafted_features("height", "width", "bgr", "mask").alias("f")).collect()}
    assert len(f[0]) == 18 and f[9] is None and f[10] is None and f[0] == pytest.approx(X.handcrafted(a, mask > 0))
    pairs = I.near_duplicate_images(df.where("id < 5")).collect()
    assert [(p.member_1, p.member_2, p.pixel_mae, p.pixel_max_abs_difference) for p in pairs] == [(0, 1, pytest.approx(1 / 3840), 1)]
    assert math.isfinite(struct.unpack("d", struct.pack("d", f[0][0]))[0])


def test_inference_survives_bad_rows(spark):
    def model():
        def run(rows):
            if any(v is None for _, v in rows):
                raise ValueError("no value")
            return [(k, 2.0 * v) for k, v in rows]

        return run

    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k long, v double").coalesce(1)
    df = df.withColumn("v", F.col("v").cast("string"))

    def session():
        inner = model()
        return lambda rows: inner([(k, None if v is None else float(v)) for k, v in rows])

    got = {r.k: (r.out, r.error) for r in I.infer(df, session, ["k", "v"], "k long, out double").collect() if r.k is not None}
    assert got[1] == (2.0, None) and got[3] == (6.0, None)
    bad = [r.error for r in I.infer(df, session, ["k", "v"], "k long, out double").collect() if r.error]
    assert bad == ["ValueError: no value"]


def test_near_duplicate_images_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 250, (32, 40, 3)).astype(np.uint8)
    b = a.copy()
    b[1, 1, 1] += 2
    other = rng.integers(0, 250, (32, 40, 3)).astype(np.uint8)
    mask = bytes(32 * 40)
    of = lambda k, x: (k, 32, 40, x.tobytes(), mask, "extra")
    rows = [of(1, a), of(1, a), of(2, b), of(2, other), of(None, a), of(3, other), (4, 32, 40, None, None, None), (5, 32, 40, b"short", mask, None)]
    df = spark.createDataFrame(rows, "key long, height int, width int, bgr binary, mask binary, id string")
    pairs = I.near_duplicate_images(df, id="key").collect()
    assert sorted((p.member_1, p.member_2, p.pixel_max_abs_difference) for p in pairs) == [(1, 2, 2), (2, 3, 0)]
    assert I.near_duplicate_images(df.where("key > 9"), id="key").count() == 0
