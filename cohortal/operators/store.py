"""The append-only record store: views, merges, soft deletes, export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.operators.classify import THRESHOLDS
from cohortal.operators.relational import latest_per_key

DAY_MS = 86_400_000
#: Columns of the CSV export, in order: name in the file, expression over the joined view.
EXPORT = (
    ("analysis_id", "id"), ("capture_date", "raw_capture_date"), ("image_path", "image_path"), ("patient", "patient_name"),
    ("sex", "sex"), ("sun_exposure", "sun_exposure"), ("antecedents", "antecedents"), ("model_bundle_id", "model_version"),
    ("model_bundle_sha256", "model_bundle_sha256"), ("preprocessing_version", "preprocessing_version"),
    ("decision_policy_version", "decision_policy_version"), ("pred_class", "pred_class"), ("probs", "probs"),
    ("verdict", "verdict"), ("non_benign", "non_benign"), ("score_mel", "score_mel"), ("score_atyp", "score_atyp"),
    ("score_nevus", "score_nevus"), ("thr_mel", "thr_mel"), ("thr_atyp", "thr_atyp"), ("thr_nevus", "thr_nevus"),
    ("quality_flag", "quality_flag"), ("verified_class", "verified_class"), ("verified_source", "verified_source"),
)


def not_archived(archived: str | Column = "archived") -> Column:
    c = F.col(archived) if isinstance(archived, str) else archived
    return c.isNull() | (c == 0)


def latest_labels(labels: DataFrame) -> DataFrame:
    """The newest label per analysis; null times are oldest, of equal times the greatest id."""
    newest = latest_per_key(labels.select("analysis_id", "ts", "id", "verified_class", "source"), ["analysis_id"], ["ts", "id"])
    return newest.select(F.col("analysis_id").alias("id"), "verified_class", F.col("source").alias("verified_source"))


def joined_view(analysis: DataFrame, patient: DataFrame, labels: DataFrame, archived: bool = False) -> DataFrame:
    """Analyses with their patient and newest label; without archived ones unless asked for."""
    rows = analysis if archived else analysis.where(not_archived())
    people = patient.select(F.col("id").alias("patient_id"), F.col("name").alias("patient_name"), "sex", "sun_exposure", "antecedents")
    # Rows without a patient have nothing to join: their nulls would all meet in one task.
    named = rows.where(F.col("patient_id").isNotNull()).join(people, "patient_id", "left")
    joined = named.unionByName(rows.where(F.col("patient_id").isNull()), allowMissingColumns=True)
    known = labels.join(rows.select(F.col("id").alias("analysis_id")), "analysis_id", "left_semi")
    return joined.join(latest_labels(known), "id", "left")


def analysis_view(analysis: DataFrame, patient: DataFrame, labels: DataFrame, archived: bool = False) -> DataFrame:
    """``joined_view`` with the defaults that readers of a row expect."""
    v = joined_view(analysis, patient, labels, archived)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return v.withColumn("raw_capture_date", F.col("capture_date")).withColumns(
        {
            "capture_date": F.coalesce("capture_date", "ts"),
            "pred_class": zero("pred_class"),
            "verdict": zero("verdict"),
            "non_benign": zero("non_benign") == 1,
            "quality_flag": zero("quality_flag") == 1,
        }
    )


def export_table(analysis: DataFrame, patient: DataFrame, labels: DataFrame) -> DataFrame:
    """The export's columns as strings, null as empty, archived rows included; ``_ts`` orders them."""
    v = joined_view(analysis, patient, labels, archived=True).withColumn("raw_capture_date", F.col("capture_date"))
    return v.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in EXPORT], F.col("ts").alias("_ts"))


def csv_lines(table: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Lines of a CSV with an unquoted header and every cell quoted: ``value``, in order by ``line``."""
    cells = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    rows = table.select(F.struct(F.lit(1), *order).alias("line"), F.concat_ws(",", *cells).alias("value"))
    return rows.orderBy("line").select("value")


def write_export(table: DataFrame, path: str) -> None:
    """The export as text: the header in a first part, sorted rows in the following ones."""
    names = [name for name, _ in EXPORT]
    spark = table.sparkSession
    header = spark.createDataFrame([(",".join(names),)], "value string").coalesce(1)
    header.write.mode("overwrite").text(f"{path}/header")
    csv_lines(table, names, ["_ts", "analysis_id"]).write.mode("overwrite").text(f"{path}/rows")


def merge_by_key(base: DataFrame, changes: DataFrame, key: str, insert: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of ``changes`` replace those of equal key; others are added if ``insert``.

    ``keep`` names columns whose old value stays. Of several changes to a key one wins, by the
    greatest values of the row.
    """
    last = latest_per_key(changes, [key], [c for c in changes.columns if c != key])
    renamed = last.select(*[F.col(c).alias(f"_{c}") for c in last.columns], F.lit(True).alias("_hit"))
    joined = base.join(renamed, F.col(key) == F.col(f"_{key}"), "left")
    pick = [
        (F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) if c in last.columns and c not in keep and c != key else F.col(c)).alias(c)
        for c in base.columns
    ]
    out = joined.select(*pick)
    if insert:
        new = last.join(base.select(key), key, "left_anti")
        out = out.unionByName(new, allowMissingColumns=True)
    return out


def archive(analysis: DataFrame, ids: DataFrame, ts: int, reason: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The table with the given ids archived, and the audit rows to append."""
    marked = ids.select("id").distinct().withColumn("_hit", F.lit(1))
    out = analysis.join(marked, "id", "left")
    out = out.withColumn("archived", F.coalesce("_hit", "archived")).select(*analysis.columns)
    log = marked.select(F.lit(ts).alias("ts"), F.lit("archive").alias("event"), F.col("id").alias("analysis_id"), F.lit(reason).alias("detail"))
    return out, log


def append(base: DataFrame, new: DataFrame, event: str, ts: int, analysis: str = "id", detail: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The table with rows appended (columns that they lack are null), and the audit rows to append.

    ``analysis`` is the column of ``new`` that has the analysis; serves analyses, labels and validations.
    """
    log = new.select(F.lit(ts).cast("long").alias("ts"), F.lit(event).alias("event"), F.col(analysis).alias("analysis_id"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))
    return base.unionByName(new.select(*[c for c in base.columns if c in new.columns]), allowMissingColumns=True), log


def log_analysis(analysis: DataFrame, new: DataFrame, ts: int) -> tuple[DataFrame, DataFrame]:
    """Append analyses, and an audit row of each."""
    return append(analysis, new, "analysis", ts)


def add_verified_label(labels: DataFrame, new: DataFrame, ts: int) -> tuple[DataFrame, DataFrame]:
    """Append labels (``analysis_id, verified_class, source`` and more); the audit row's detail is the class."""
    return append(labels, new.withColumn("ts", F.lit(ts).cast("long")), "label", ts, "analysis_id", F.col("verified_class"))


def add_validation(validations: DataFrame, new: DataFrame, ts: int) -> tuple[DataFrame, DataFrame]:
    """Append a clinician's answers: agreement, or the class that is right instead."""
    rows = new.withColumn("ts", F.lit(ts).cast("long"))
    detail = F.when(F.col("md_agree") == 1, "agree").otherwise(F.concat(F.lit("class "), F.col("md_class").cast("string")))
    return append(validations, rows, "validation", ts, "analysis_id", detail)


def bulk_labels(ids: DataFrame, verified_class: int, ts: int, source: str = "biopsy", note: str | None = None) -> DataFrame:
    """One label per id to append."""
    return ids.select(
        F.col("id").alias("analysis_id"), F.lit(ts).alias("ts"), F.lit(verified_class).alias("verified_class"), F.lit(source).alias("source"), F.lit(note).cast("string").alias("note")
    )


def thresholds_for(settings: DataFrame, versions: DataFrame) -> DataFrame:
    """Thresholds per policy version: those saved under ``thresholds:<version>``, else the clinical ones.

    A value that is no JSON object with the three numbers counts as not saved.
    """
    parsed = F.from_json("value", "mel double, atyp double, nevus double", {"mode": "PERMISSIVE"})
    saved = settings.select(F.regexp_extract("key", r"^thresholds:(.*)$", 1).alias("version"), parsed.alias("t")).where("version != ''")
    good = saved.where("t.mel is not null and t.atyp is not null and t.nevus is not null")
    names = {"mel": "melanoma", "atyp": "atypical", "nevus": "nevus"}
    return versions.join(good, "version", "left").select(
        "version", *[F.coalesce(F.col("t")[k], F.lit(THRESHOLDS[v])).alias(f"thr_{k}") for k, v in names.items()]
    )


def search_patients(patient: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Names like ``%query%`` regardless of case, its own wildcards live; newest first."""
    rows = patient.where(F.col("name").ilike(f"%{query}%")) if query else patient
    return rows.orderBy(F.col("updated_ts").desc_nulls_last(), "id").limit(limit)


def store_counts(analysis: DataFrame, patient: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: patients, analyses that are not archived, analyses with a label (archived too)."""
    a = patient.agg(F.count("*").alias("patients"))
    b = analysis.where(not_archived()).agg(F.count("*").alias("analyses"))
    c = labels.agg(F.countDistinct("analysis_id").alias("verified"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def status_cards(view: DataFrame) -> DataFrame:
    """Per verdict (clamped to 0..2): rows, verified rows, coverage in %, and the bias flag of all."""
    v = view.withColumn("status", F.greatest(F.least("verdict", F.lit(2)), F.lit(0)))
    c = v.groupBy("status").agg(F.count("*").alias("n"), F.count("verified_class").alias("n_verified"))
    grid = view.sparkSession.range(3).select(F.col("id").cast("int").alias("status"))
    c = grid.join(F.broadcast(c), "status", "left").na.fill({"n": 0, "n_verified": 0})  # three rows
    ok = lambda x: F.max(F.when(F.col("status") == 0, F.col(x)))
    other = F.sum(F.when(F.col("status") > 0, F.col("n_verified")).otherwise(0))
    flag = c.agg(((ok("n") > 0) & (ok("n_verified") < 0.5 * ok("n")) & (other > 0)).alias("ok_biased"))
    share = 100.0 * F.col("n_verified") / F.nullif(F.col("n"), F.lit(0))
    return c.crossJoin(F.broadcast(flag)).withColumn("coverage_pct", share)


def fill_missing_columns(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Additive migration: columns of the schema that the table lacks, as nulls."""
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in schema.items() if c not in have])
