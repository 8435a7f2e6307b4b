"""Workbooks are written whole and read again; a demonstration store keeps its rules."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from cohortal.operators import audit as A
from cohortal.operators import demo as D
from cohortal.sources import workbook as W


def tables(spark):
    rows = [(1, 0.5, "a & <b> \"q\"", True), (2, None, "  two\nlines\t", False), (3, float("nan"), None, None), (1 << 60, -1e-300, "é 😀 \x07", True)]
    return {"Key Results": spark.createDataFrame(rows, "n long, x double, s string, b boolean"), "Größe": spark.range(2_500).select("id", (F.col("id") / 3).alias("v")), "none": spark.createDataFrame([], "k int, d date")}


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    given = tables(spark)
    assert W.write_workbook(given, path) == {"Key Results": 4, "Größe": 2_500, "none": 0}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.xlsx"] and zipfile.ZipFile(path).testzip() is None
    rows = W.read_workbooks(spark, path)
    assert rows.where("error is not null").count() == 0
    first = W.sheet_table(rows, "Key Results", {"n": "string", "x": "string", "s": "string", "b": "boolean"}).collect()
    assert [tuple(r) for r in first] == [("1", "0.5", "a & <b> \"q\"", True), ("2", None, "  two\nlines\t", False), ("3", "nan", None, None), (str(1 << 60), "-1e-300", "é 😀 ", True)]
    back = {"Größe": W.sheet_table(rows, "Größe", {"id": "long", "v": "double"}), "none": W.sheet_table(rows, "none", {"k": "int"})}
    got = A.completeness({k: given[k] for k in back}, back, {"Größe": ["id"], "none": ["k"]}, {"Größe": ["v"]}).collect()
    assert [(r.table, r.expected_rows, r.rows, r.status) for r in got] == [("Größe", 2_500, 2_500, "PASS"), ("none", 0, 0, "PASS")]
    with pytest.raises(ValueError, match="no sheet x"):
        W.sheet_table(rows, "x", {"n": "long"})
    with pytest.raises(ValueError, match="lacks y"):
        W.sheet_table(rows, "none", {"k": "int", "y": "int"})


def test_what_no_sheet_holds_raises(spark, tmp_path, monkeypatch):
    path, t = str(tmp_path / "a.xlsx"), spark.range(5)
    for bad, error in (({}, "needs a sheet"), ({"a/b": t}, "no names"), ({"x" * 32: t}, "no names"), ({"a": t, "A": t}, "repeat")):
        with pytest.raises(ValueError, match=error):
            W.write_workbook(bad, path)
    monkeypatch.setattr(W, "MOST_ROWS", 5)
    with pytest.raises(ValueError, match="more than 4 rows"):
        W.write_workbook({"a": t}, path)
    assert not (tmp_path / "a.xlsx").exists()
    assert W.write_workbook({"a": t.limit(4), "d": spark.createDataFrame([(dt.date(2024, 1, 2),)], "d date")}, path)["a"] == 4


def test_an_unreadable_workbook_is_a_row(spark, tmp_path):
    W.write_workbook({"a": spark.range(2)}, str(tmp_path / "good.xlsx"))
    (tmp_path / "bad.xlsx").write_bytes(b"nothing")
    got = {(r.path.rsplit("/", 1)[1], r.row): r.error for r in W.read_workbooks(spark, str(tmp_path)).collect()}
    assert got["good.xlsx", 2] is None and "BadZipFile" in got["bad.xlsx", None] and len(got) == 4


@pytest.mark.parametrize("n", [0, 1, 137])
def test_demo_store(spark, n):
    rows = [(k, 0.5 + 0.4 * (k % 2), 0.3 * (k % 3), 0.1, k % 2, k / 1000) for k in range(n)]
    df = spark.createDataFrame(rows, "row_index long, p0 double, p1 double, p2 double, truth int, coverage double")
    s = {k: t.collect() for k, t in D.demo_store(df, "row_index", ["p0", "p1", "p2"], "truth", "coverage", 10**12).items()}
    assert sorted(r.image_id for r in s["analysis"]) == list(range(n)) and len({r.id for r in s["analysis"]}) == n
    assert len(s["verified_label"]) == n - n // 13
    by = {}
    for r in sorted(s["analysis"], key=lambda r: r.id):
        by.setdefault(r.patient_id, []).append(r.ts)
    people = {r.id: r for r in s["patient"]}
    assert set(by) == set(people) and all(1 <= len(v) <= 5 and v == sorted(v) for v in by.values())
    assert all(people[p].created_ts <= t <= 10**12 for p, ts in by.items() for t in ts)
    if n > 100:
        assert {len(v) for v in by.values()} == {1, 2, 3, 4, 5}
        again = D.demo_store(df.repartition(3), "row_index", ["p0", "p1", "p2"], "truth", "coverage", 10**12)["analysis"].collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, s["analysis"]))
