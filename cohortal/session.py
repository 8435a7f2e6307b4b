"""Session settings and the small helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def local_session(cores: str = "8", app: str = "cohortal") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names, else a fresh local one.

    ``spark.checkpoint.dir`` names a folder that the driver and all executors share.
    Only where it is unset, as in tests on one machine, a temporary folder is used; with
    executors on other machines that is an error. A session that sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` (as ``local_session`` does) removes
    checkpoints once nothing refers to them.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "cohortal-checkpoints"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_bytes: int = 8 << 20, otherwise: str | None = None) -> DataFrame:
    """Mark a materialized table for broadcast after measuring its rows as JSON, on the executors.

    Beyond ``max_bytes`` the table is returned unmarked, or with the hint ``otherwise``, and the join shuffles.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})))).first()[0]
    if (size or 0) <= max_bytes:
        return F.broadcast(df)
    return df.hint(otherwise) if otherwise else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
