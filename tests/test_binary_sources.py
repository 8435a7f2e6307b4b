"""Model graphs and npz archives that the tests write, read by the data sources."""

import struct
import zipfile

import numpy as np
import pytest

from cohortal.sources import binary
from cohortal.sources.files import branch_counts


def number(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(no, value):
    """One protobuf field: an int, or bytes with their length."""
    if isinstance(value, int):
        return number(no << 3) + number(value)
    return number(no << 3 | 2) + number(len(value)) + value


def attr(name, kind, values, packed=True):
    body = field(binary.ATTRIBUTE_NAME, name.encode())
    if kind == "ints":
        body += field(binary.ATTRIBUTE_INTS, b"".join(map(number, values))) if packed else b"".join(field(binary.ATTRIBUTE_INTS, v) for v in values)
    elif kind == "floats":
        body += field(binary.ATTRIBUTE_FLOATS, struct.pack(f"<{len(values)}f", *values)) if packed else b"".join(number(binary.ATTRIBUTE_FLOATS << 3 | 5) + struct.pack("<f", v) for v in values)
    else:
        body += b"".join(field(binary.ATTRIBUTE_STRINGS, v.encode()) for v in values)
    return body + field(20, 7)


def model(trees, op="TreeEnsembleClassifier", name="head", packed=True):
    """An ONNX file of one scaler and one tree operator; ``trees`` are (tree, node, feature, mode, value, true, false)."""
    columns = list(zip(*trees, strict=True)) if trees else [()] * 7
    kinds = ("ints", "ints", "ints", "strings", "floats", "ints", "ints")
    names = [binary.TREE_COLUMNS[c] for c in ("tree_id", "node_id", "feature_id", "mode", "value", "true_id", "false_id")]
    attrs = b"".join(field(binary.NODE_ATTRIBUTE, attr(n, k, c, packed)) for n, k, c in zip(names, kinds, columns, strict=True))
    node = field(1, b"x") + field(2, b"y") + field(binary.NODE_NAME, name.encode()) + field(binary.NODE_OP, op.encode()) + attrs + field(7, b"ai.onnx.ml")
    scaler = field(binary.NODE_NAME, b"scale") + field(binary.NODE_OP, b"Scaler") + field(binary.NODE_ATTRIBUTE, attr("offset", "floats", [1.0, 2.0]))
    graph = field(binary.GRAPH_NODE, scaler) + field(binary.GRAPH_NODE, node) + field(2, b"graph")
    return field(1, 8) + field(2, b"test") + field(binary.MODEL_GRAPH, graph)


TREES = [(0, 0, 3, "BRANCH_LEQ", 0.5, 1, 2), (0, 1, 0, "LEAF", 0.0, 0, 0), (0, 2, 0, "LEAF", 0.0, 0, 0), (1, 0, 3, "BRANCH_LEQ", -1.25, 1, 2), (1, 1, 7, "BRANCH_LEQ", 2.0, 3, 4), (1, 2, 0, "LEAF", 0.0, 0, 0), (1, 3, 0, "LEAF", 0.0, 0, 0), (1, 4, 0, "LEAF", 0.0, 0, 0)]


@pytest.mark.parametrize("packed", [True, False])
def test_tree_nodes(spark, tmp_path, packed):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.onnx").write_bytes(model(TREES, packed=packed))
    (tmp_path / "sub" / "b.ONNX").write_bytes(model(TREES[:3], "TreeEnsembleRegressor", "other", packed))
    (tmp_path / "cut.onnx").write_bytes(model(TREES)[:-9])
    (tmp_path / "empty.onnx").write_bytes(b"")
    (tmp_path / "none.onnx").write_bytes(model([]))
    (tmp_path / "notes.txt").write_bytes(b"no model")
    t = binary.read_tree_nodes(spark, str(tmp_path))
    rows = t.collect()
    good = [r for r in rows if r.error is None]
    assert [r.path.rsplit("/", 1)[1] for r in rows if r.error] == ["cut.onnx"]
    own = sorted((r.tree_id, r.node_id, r.feature_id, r.mode, r.value, r.true_id, r.false_id) for r in good if r.path.endswith("a.onnx"))
    assert own == TREES
    assert {(r.node, r.op) for r in good} == {("head", "TreeEnsembleClassifier"), ("other", "TreeEnsembleRegressor")}
    assert {(r.feature_id, r.splits) for r in branch_counts(t.where("error is null and node = 'head'")).collect()} == {(3, 2), (7, 1)}
    only = binary.read_tree_nodes(spark, str(tmp_path), ["TreeEnsembleRegressor"]).where("error is null")
    assert only.count() == 3 and only.rdd.getNumPartitions() == 5


def test_negative_numbers_and_unequal_attributes(spark, tmp_path):
    (tmp_path / "neg.onnx").write_bytes(model([(0, 0, -1, "LEAF", 0.0, -5, 1 << 40)]))
    (tmp_path / "odd.onnx").write_bytes(model(TREES).replace(b"nodes_treeids", b"nodes_treeidz"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in binary.read_tree_nodes(spark, str(tmp_path)).collect()}
    assert (rows["neg.onnx"].feature_id, rows["neg.onnx"].true_id, rows["neg.onnx"].false_id) == (-1, -5, 1 << 40)
    assert "differ in length: tree_id 0" in rows["odd.onnx"].error


def test_a_missing_path_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        binary.read_arrays(spark, str(tmp_path / "nowhere")).collect()


def test_arrays(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    a = {"handcraft": rng.normal(size=(7, 3)).astype(np.float32), "lesion": rng.integers(-9, 9, size=(7, 2, 2)), "ok": np.array([True, False, True]), "one": np.float64(2.5), "columns": np.asfortranarray(rng.normal(size=(4, 5))), "none": np.zeros((0, 3)), "flat": np.zeros((2, 0))}
    np.savez(tmp_path / "stored.npz", **a)
    np.savez_compressed(tmp_path / "small.npz", **{k: a[k] for k in ("handcraft", "ok")})
    monkeypatch.setattr(binary, "RANGE_BYTES", 24)
    monkeypatch.setattr(binary, "BATCH_BYTES", 30)
    rows = binary.read_arrays(spark, str(tmp_path)).collect()
    assert not [r.error for r in rows if r.error]
    for name, value in a.items():
        own = sorted((r.row, r["values"]) for r in rows if r.path.endswith("stored.npz") and r.member == name)
        n = value.shape[0] if value.ndim else 1
        assert [i for i, _ in own] == list(range(n))
        assert np.array_equal(np.array([v for _, v in own]).reshape(value.shape), value.astype(float))
    one = next(r for r in rows if r.member == "lesion")
    assert list(one.shape) == [7, 2, 2] and one.dtype == "int64"
    assert len([p for p in binary.ArrayReader(str(tmp_path / "stored.npz"), "handcraft").partitions()]) == 4  # two rows a task


def test_chosen_members_failures_and_features(spark, tmp_path):
    x, y = np.arange(6.0).reshape(3, 2), np.arange(3) * 10
    np.savez(tmp_path / "a.npz", hc=x, deep=y, other=np.zeros(1000))
    np.savez(tmp_path / "b.npz", hc=x)
    np.savez(tmp_path / "text.npz", hc=np.array(["a", "b"]), deep=y)
    (tmp_path / "broken.npz").write_bytes(b"PK nothing")
    with zipfile.ZipFile(tmp_path / "short.npz", "w") as z:
        np.savez(tmp_path / "whole.npy.tmp", hc=x)
        whole = zipfile.ZipFile(f"{tmp_path}/whole.npy.tmp.npz").read("hc.npy")
        z.writestr("hc.npy", whole[:-8])
        z.writestr("deep.npy", b"no array")
    (tmp_path / "whole.npy.tmp.npz").unlink()
    t = binary.read_arrays(spark, str(tmp_path), ["hc", "deep"])
    rows = t.collect()
    failed = {(r.path.rsplit("/", 1)[1], r.member) for r in rows if r.error}
    assert failed == {("b.npz", "deep"), ("text.npz", "hc"), ("broken.npz", None), ("short.npz", "hc"), ("short.npz", "deep")}
    assert not [r for r in rows if r.member == "other"]
    got = {(r.path.rsplit("/", 1)[1], r.row): (r.features, r.present) for r in binary.joined_features(t, ["hc", "deep"]).collect()}
    assert got["a.npz", 1] == ([2.0, 3.0, 10.0], 2) and got["b.npz", 1] == (None, 1)


def test_arrays_are_written_and_read_again(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [(k, k / 7, [float(k), float(-k)], [k % 2, k, 3]) for k in range(100)]
    df = spark.createDataFrame(rows, "id long, x double, hc array<double>, n array<int>").repartition(3)
    for compressed in (False, True):
        binary.write_arrays(df, root, rows=16, compressed=compressed)
        t = binary.read_arrays(spark, root)
        assert t.where("error is not null").count() == 0
        files = {r.path for r in t.select("path").distinct().collect()}
        assert len(files) == 9 and {p.suffix for p in (tmp_path / "out").iterdir()} == {".npz"}
        got = {}
        for r in t.collect():
            got.setdefault((r.path, r.row), {})[r.member] = r["values"]
        assert sorted((v["id"][0], v["x"][0], v["hc"], v["n"]) for v in got.values()) == [(float(k), x, hc, [float(i) for i in n]) for k, x, hc, n in rows]
    binary.write_arrays(df.limit(5), root, mode="append")
    assert binary.read_arrays(spark, root, ["id"]).count() == 105
    binary.write_arrays(df.limit(0), root)
    assert not list((tmp_path / "out").iterdir())


@pytest.mark.parametrize(("value", "error"), [("case when id = 7 then null else array(1d) end", "has nulls"), ("array_repeat(1d, cast(1 + id % 2 as int))", "unequal lengths")])
def test_a_failed_write_leaves_what_was_there(spark, tmp_path, value, error):
    root = str(tmp_path / "out")
    df = spark.range(20)
    binary.write_arrays(df, root)
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    with pytest.raises(Exception, match=error):
        binary.write_arrays(df.selectExpr("id", f"{value} v"), root)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == before
