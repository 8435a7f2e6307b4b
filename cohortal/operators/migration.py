"""A store of Parquet tables with a version: ordered, resumable schema steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.operators.relational import require

#: The table of versions: what was done, in which order and when, and where the tables that it wrote lie.
VERSIONS = "seq long, version int, step string, ts long, tables map<string, string>"


@dataclass(frozen=True)
class Step:
    """One schema change. Tables are created empty, columns are added with a default; what is there already stays."""

    version: int
    name: str
    create: Mapping[str, str] = field(default_factory=dict)
    add: Mapping[str, Mapping[str, tuple[str, object]]] = field(default_factory=dict)
    also: Callable[[dict[str, DataFrame]], Mapping[str, DataFrame]] | None = None

    def changed(self, spark: SparkSession, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """The tables that this step makes anew; none if all it asks for is there."""
        out = {}
        for name, schema in self.create.items():
            if name not in tables:
                out[name] = spark.createDataFrame([], schema)
        for name, columns in self.add.items():
            t = out.get(name, tables.get(name))
            require(t is not None, f"step {self.version} ({self.name}): there is no table {name}")
            lacking = {c: F.lit(value).cast(kind).alias(c) for c, (kind, value) in columns.items() if c not in t.columns}
            if lacking:
                out[name] = t.select("*", *lacking.values())
        if self.also is not None:
            out.update(self.also({**tables, **out}))
        return out


# Tables and columns of the record store by version.
STORE_STEPS = (
    Step(
        1, "first tables",
        create={
            "patient": "id string, name string, sex int, sun_exposure int, antecedents string, created_ts long, updated_ts long",
            "analysis": "id string, ts long, image_hash string, image_path string, model_version string, pred_class int, probs string, "
            "verdict int, non_benign int, quality_flag int",
            "validation": "id long, analysis_id string, ts long, md_agree int, md_class int",
        },
    ),
    Step(
        2, "patients and scores",
        create={"verified_label": "id long, analysis_id string, ts long, verified_class int, source string, note string"},
        add={
            "analysis": {
                "patient_id": ("string", None), "lesion_id": ("string", None), "capture_date": ("long", None), "confidence": ("double", None), "features": ("string", None),
                **{f"{kind}_{c}": ("double", None) for kind in ("score", "thr") for c in ("mel", "atyp", "nevus")},
            }
        },
    ),
    Step(
        3, "archive and audit",
        create={"audit_log": "id long, ts long, event string, analysis_id string, detail string"},
        add={"analysis": {"archived": ("int", 0)}},
    ),
    Step(4, "settings", create={"settings": "key string, value string"}),
    Step(
        5, "provenance",
        add={"analysis": {c: ("string", None) for c in ("model_bundle_sha256", "preprocessing_version", "decision_policy_version")}},
    ),
)


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The table of versions; empty for a store that is not there yet."""
    try:
        return spark.read.schema(VERSIONS).parquet(f"{root}/_versions")
    except AnalysisException:
        return spark.createDataFrame([], VERSIONS)


def store_version(spark: SparkSession, root: str) -> int:
    return versions(spark, root).agg(F.max("version")).first()[0] or 0


def open_store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The current tables: of each the one that was finished last."""
    rows = versions(spark, root).select("seq", F.explode("tables").alias("name", "path"))
    newest = rows.groupBy("name").agg(F.max_by("path", "seq").alias("path")).collect()  # a row per table
    return {r["name"]: spark.read.parquet(f"{root}/{r.path}") for r in newest}


def commit(spark: SparkSession, root: str, version: int, name: str, ts: int, tables: Mapping[str, DataFrame]) -> None:
    """Write tables to folders of their own, then the one row that makes them current.

    What a failed commit has written is no part of the store, and the next one overwrites it. One writer
    at a time.
    """
    seq = (versions(spark, root).agg(F.max("seq")).first()[0] or 0) + 1
    paths = {k: f"{k}/{seq}" for k in tables}
    for k, t in tables.items():
        t.write.mode("overwrite").parquet(f"{root}/{paths[k]}")
    spark.createDataFrame([(seq, version, name, ts, paths)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{root}/_versions")


def migrate(spark: SparkSession, root: str, ts: int, steps: Sequence[Step] = STORE_STEPS, to: int | None = None) -> list[int]:
    """Bring the store to version ``to`` (default: the last step's); returns the versions of the steps that ran.

    A step that fails leaves the store as it was, and the next call starts with it again. A store
    that is up to date is not touched. Versions have to rise, and a store newer than the steps
    raises.
    """
    order = [s.version for s in steps]
    require(order == sorted(set(order)), f"versions of steps have to rise: {order}")
    now, last = store_version(spark, root), steps[-1].version if to is None else to
    require(now <= steps[-1].version, f"{root} has version {now}, newer than step {steps[-1].version}")
    todo = [s for s in steps if now < s.version <= last]
    for step in todo:
        commit(spark, root, step.version, step.name, ts, step.changed(spark, open_store(spark, root)))
    return [s.version for s in todo]


def replace_tables(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], ts: int) -> None:
    """New states of tables at the store's version; readers see all of them or none."""
    commit(spark, root, store_version(spark, root), f"write {', '.join(tables)}", ts, tables)


def upgraded(spark: SparkSession, tables: Mapping[str, DataFrame], version: int, steps: Sequence[Step] = STORE_STEPS) -> dict[str, DataFrame]:
    """Tables of a version as the later steps leave them, without a store."""
    out = dict(tables)
    for step in steps:
        if step.version > version:
            out.update(step.changed(spark, out))
    return out
