"""Readers of files: CSV, text logs, JSON manifests, binary trees, parquet bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.functions.text import stem
from cohortal.operators.prefix import numbered

SPLITS = ("train", "valid", "test")
IMAGES = ("jpg", "jpeg", "png", "heic", "bmp", "webp")
MANIFEST = (
    "bundle_id string, created string, classes array<string>, thresholds struct<melanoma:double,atypical:double,nevus:double>, "
    "components array<struct<name:string,path:string,sha256:string>>"
)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """CSV with a header and a declared schema; only the columns that are used are parsed."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")


def read_strings(spark: SparkSession, path: str) -> DataFrame | None:
    """CSV with all columns as strings; None for a path that cannot be read."""
    try:
        return spark.read.csv(path, header=True, mode="PERMISSIVE", inferSchema=False)
    except AnalysisException:
        return None


def read_columns(spark: SparkSession, path: str, aliases: dict[str, Sequence[str]]) -> DataFrame | None:
    """The first column, regardless of case, that each name's aliases list; None if one has none."""
    df = read_strings(spark, path)
    if df is None:
        return None
    have = {c.lower(): c for c in df.columns}
    picked = {name: next((have[a.lower()] for a in names if a.lower() in have), None) for name, names in aliases.items()}
    if None in picked.values():
        return None
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in picked.items()])


def file_tree(spark: SparkSession, root: str, extensions: Sequence[str] | None = None, content: bool = False) -> DataFrame:
    """A row per file below ``root``: ``path`` (relative), ``file``, ``folder``, ``bytes``, on request ``content``.

    Only listings are read unless content or a digest is asked for.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "/" + root.split("://")[-1].strip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    out = raw.select(path.alias("path"), F.col("length").alias("bytes"), *(["content"] if content else []))
    out = out.withColumn("file", F.substring_index("path", "/", -1)).withColumn("folder", F.element_at(F.split(F.concat(F.lit("/"), "path"), "/"), -2))
    if extensions:
        out = out.where(F.lower(F.substring_index("file", ".", -1)).isin(*extensions))
    return out


def split_tree(spark: SparkSession, root: str) -> DataFrame:
    """Images below ``<root>/<split>/<class>/`` with ``row_index`` by split order, then path."""
    t = file_tree(spark, root, IMAGES)
    t = t.withColumn("split_original", F.split("path", "/")[0]).withColumn("class_name", F.col("folder"))
    rank = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split_original"))
    t = t.withColumn("_rank", rank).where("_rank > 0")
    return numbered(t, [F.col("_rank"), F.col("path")], "row_index").withColumn("row_index", F.col("row_index") - 1).drop("_rank")


def class_tree(spark: SparkSession, root: str, classes: dict[str, int], extensions: Sequence[str] = IMAGES) -> DataFrame:
    """Images in class folders with the class number; other folders are left out."""
    t = file_tree(spark, root, extensions)
    table = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    return t.withColumn("true", table[F.col("folder")]).where(F.col("true").isNotNull())


def raw_manifest(spark: SparkSession, root: str, expected: int | None = None, extensions: Sequence[str] | None = None) -> DataFrame:
    """``path, file, folder, bytes, sha256`` of all files; another count than expected raises."""
    t = file_tree(spark, root, extensions, content=True).withColumn("sha256", F.sha2("content", 256)).drop("content")
    if expected is not None and (n := t.count()) != expected:
        raise ValueError(f"{root}: {n} files, expected {expected}")
    return t


def stem_index(spark: SparkSession, root: str) -> DataFrame:
    """``stem, path`` of JPEGs; of equal stems the last path."""
    t = file_tree(spark, root, ("jpg", "jpeg")).withColumn("stem", stem(F.col("file")))
    return t.groupBy("stem").agg(F.max("path").alias("path"))


def metadata_files(spark: SparkSession, roots: Sequence[str], patterns: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """``path, bytes`` of files that match a pattern below a root, once each, without those under an excluded folder.

    Roots that cannot be listed have no files.
    """
    found = spark.createDataFrame([], "path string, bytes long")
    for root in roots:
        for p in patterns:
            try:
                files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", p).load(root)
            except AnalysisException:
                continue
            found = found.union(files.select("path", F.col("length").alias("bytes")))
    for x in exclude:
        found = found.where(~F.contains("path", F.lit(x)))
    return found.distinct()


def log_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``metric ...`` with at least 8 numbers 0.x: the fifth and sixth as ``low, high``."""
    n = F.regexp_extract_all(F.regexp_extract("value", r"^metric\s+(.+)$", 1), F.lit(r"(0\.\d+)"), 1)
    rows = spark.read.text(path).where(F.col("value").rlike(r"^metric\s+")).select("value", n.alias("n"))
    return rows.where(F.size("n") >= 8).select("value", F.get("n", F.lit(4)).cast("double").alias("low"), F.get("n", F.lit(5)).cast("double").alias("high"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A model manifest; a required key that is missing, or of another type, raises."""
    m = spark.read.schema(MANIFEST).json(path, multiLine=True, mode="PERMISSIVE")
    row = m.first()
    missing = [c for c in m.columns if row is None or row[c] is None]
    if missing:
        raise ValueError(f"{path}: missing or of a wrong type: {', '.join(missing)}")
    return m


def read_bundle(spark: SparkSession, path: str, parts: Sequence[str] = ("handcraft", "lesion")) -> DataFrame:
    """A parquet table of array columns with ``features``, the named parts in turn."""
    return spark.read.parquet(path).withColumn("features", F.concat(*parts))


def branch_counts(nodes: DataFrame, feature: str = "feature_id", mode: str = "mode") -> DataFrame:
    """Inner nodes of trees per feature."""
    return nodes.where(F.col(mode) != "LEAF").groupBy(feature).agg(F.count("*").alias("splits"))


def list_backups(spark: SparkSession, root: str) -> DataFrame:
    """Folders ``backup_<ts>`` with their bytes, newest first; a name without a number has ts 0."""
    t = file_tree(spark, root).withColumn("name", F.split("path", "/")[0]).where("name like 'backup\\_%'")
    ts: Column = F.coalesce(F.expr("try_cast(substring(name, 8) as bigint)"), F.lit(0))
    return t.groupBy("name").agg(F.sum("bytes").alias("bytes")).withColumn("ts", ts).orderBy(F.col("ts").desc(), "name")
