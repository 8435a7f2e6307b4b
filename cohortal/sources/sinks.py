"""Writers: CSV with fixed formats, guarded tables, caches, snapshots, reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.operators.relational import duplicate_keys, require


def formatted(df: DataFrame, float_format: str = "%.6f") -> DataFrame:
    """Floating columns as strings of a fixed format; null stays null."""
    return df.select(*[F.when(F.col(c).isNotNull(), F.format_string(float_format, c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, float_format: str | None = None, allow_empty: bool = True) -> None:
    """CSV parts with a header; an empty table raises unless allowed."""
    require(allow_empty or not df.isEmpty(), f"{path}: nothing to write")
    out = formatted(df, float_format) if float_format else df
    out.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def ragged(spark: SparkSession, rows: Sequence[Mapping]) -> DataFrame:
    """Records of different keys: columns in first-seen order, all strings, missing cells null."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    text = [tuple(None if r.get(k) is None else str(r[k]) for k in names) for r in rows]
    return spark.createDataFrame(text, ", ".join(f"`{k}` string" for k in names)) if names else spark.createDataFrame([], "empty string")


def write_observations(tables: Sequence[DataFrame], path: str, key: Sequence[str] = ("condition", "row_index")) -> None:
    """Tables under each other, sorted by key; a repeated key raises and nothing is written."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    bad = duplicate_keys(df, key).take(1)
    require(not bad, f"repeated key: {bad[0] if bad else ''}")
    df.orderBy(*key).write.mode("overwrite").parquet(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], partition: Sequence[str] = ()) -> DataFrame:
    """The table at ``path``; made and written first if it is missing or cannot be read.

    Spark's committer renames finished parts, so that a table without its success marker is remade.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        writer = make().write.mode("overwrite")
        (writer.partitionBy(*partition) if partition else writer).parquet(path)
        return spark.read.parquet(path)


def resume(rows: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return rows if done is None else rows.join(done.select(key), key, "left_anti")


def snapshot(tables: Mapping[str, DataFrame], root: str, ts: int) -> str:
    """A copy of all tables under ``backup_<ts>``."""
    path = f"{root.rstrip('/')}/backup_{ts}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return path


def restore(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The tables of a snapshot; one that lacks a table raises before anything is used."""
    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as e:
            raise ValueError(f"invalid backup: {name} is missing") from e
    return out


def markdown(df: DataFrame, digits: int = 4, limit: int | None = None) -> str:
    """A report table, ``_empty_`` for no rows. All rows are in it; beyond ``limit`` the last line says how many more there are.

    Rows come to the driver in turn, a part of the table at a time.
    """

    def cell(v) -> str:
        return "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    lines, more = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)], 0
    for r in df.toLocalIterator():
        if limit is not None and len(lines) - 2 >= limit:
            more += 1
        else:
            lines.append("| " + " | ".join(map(cell, r)) + " |")
    if len(lines) == 2 and not more:
        return "_empty_"
    return "\n".join([*lines, f"_{more} more rows_"] if more else lines)


def artifact_manifest(files: DataFrame) -> DataFrame:
    """JSON records ``path, bytes, sha256, rows`` of files with content; rows are newlines less the header."""
    lines = F.length(F.regexp_replace(F.decode("content", "ISO-8859-1"), "[^\n]", "")) - 1
    return files.select(F.to_json(F.struct("path", "bytes", F.sha2("content", 256).alias("sha256"), lines.alias("rows"))).alias("value"))


def golden_records(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """One JSON record per row for exact replay."""
    return df.select(F.to_json(F.struct(key, *values)).alias("value"))
