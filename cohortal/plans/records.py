"""Queries over the record store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortal.operators import classify as C
from cohortal.operators import relational as R
from cohortal.operators import store as S
from cohortal.plans import views as V
from cohortal.plans.registry import query
from cohortal.session import table

COLUMNS = ", ".join(V.VIEW_COLUMNS)
#: "Now" of the period filter and of log entries.
NOW = 900_000_000_000


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.analysis_view(V.analysis(spark, sf_dir), V.patient(spark, sf_dir), V.verified_label(spark, sf_dir))
    return v.select(*V.VIEW_COLUMNS)


@query(f"SELECT {COLUMNS} FROM av", V.VIEW + "\n")
def analysis_view(spark, sf_dir):
    return view(spark, sf_dir).orderBy(F.col("capture_date").asc_nulls_first(), F.col("ts").asc_nulls_first())


@query(f"SELECT {COLUMNS} FROM av ORDER BY ts DESC NULLS LAST, id LIMIT 100", V.VIEW + "\n")
def recent_analyses(spark, sf_dir):
    return view(spark, sf_dir).orderBy(F.col("ts").desc_nulls_last(), "id").limit(100)


@query(f"SELECT {COLUMNS} FROM av WHERE patient_id = '7'", V.VIEW + "\n")
def patient_analyses(spark, sf_dir):
    return view(spark, sf_dir).where("patient_id = '7'").orderBy(F.col("capture_date").asc_nulls_first(), F.col("ts").asc_nulls_first())


@query("SELECT analysis_id AS id, verified_class, source AS verified_source FROM newest", V.LABELS + ",\n" + V.NEWEST + "\n")
def latest_label(spark, sf_dir):
    return S.latest_labels(V.verified_label(spark, sf_dir))


@query(
    """SELECT (SELECT count(*) FROM patient) AS patients, (SELECT count(*) FROM analysis WHERE archived IS NULL OR archived = 0) AS analyses,
    (SELECT count(DISTINCT analysis_id) FROM verified_label) AS verified""",
    V.STORE + "\n",
)
def store_counts(spark, sf_dir):
    return S.store_counts(V.analysis(spark, sf_dir), V.patient(spark, sf_dir), V.verified_label(spark, sf_dir))


@query("SELECT id, name, updated_ts FROM patient WHERE name ILIKE '%CUST%00_1%' ORDER BY updated_ts DESC NULLS LAST, id LIMIT 30", V.PATIENT + "\n")
def search_patients(spark, sf_dir):
    return S.search_patients(V.patient(spark, sf_dir), "CUST%00_1").select("id", "name", "updated_ts")


@query("SELECT id, name, updated_ts FROM patient", V.PATIENT + "\n")
def all_patients(spark, sf_dir):
    return V.patient(spark, sf_dir).select("id", "name", "updated_ts").orderBy(F.col("updated_ts").desc_nulls_last())


@query("SELECT id, name FROM patient WHERE contains(lower(name), '00_1') OR contains(lower(name), '#00000001')", V.PATIENT + "\n")
def filter_patients(spark, sf_dir):
    n = F.lower("name")
    return V.patient(spark, sf_dir).where(F.contains(n, F.lit("00_1")) | F.contains(n, F.lit("#00000001"))).select("id", "name")


@query(
    """SELECT id, verdict, verified_class, label FROM (
      SELECT *, CASE pred_class WHEN 0 THEN 'Nevus' WHEN 1 THEN 'Melanoma' ELSE 'Atypical' END AS label FROM av)
    WHERE verdict = 2 AND verified_class IS NOT NULL AND contains(lower(coalesce(patient_name, '') || ' ' || label), '1 mel')""",
    V.VIEW + "\n",
)
def list_filter(spark, sf_dir):
    label = F.when(F.col("pred_class") == 0, "Nevus").when(F.col("pred_class") == 1, "Melanoma").otherwise("Atypical")
    v = view(spark, sf_dir).withColumn("label", label)
    text = F.lower(F.concat(F.coalesce("patient_name", F.lit("")), F.lit(" "), F.col("label")))
    return v.where((F.col("verdict") == 2) & F.col("verified_class").isNotNull() & F.contains(text, F.lit("1 mel"))).select(
        "id", "verdict", "verified_class", "label"
    )


@query(f"SELECT id, capture_date FROM av WHERE capture_date >= {NOW} - CAST(90 AS BIGINT) * 86400000", V.VIEW + "\n")
def period_filter(spark, sf_dir):
    return view(spark, sf_dir).where(F.col("capture_date") >= NOW - 90 * S.DAY_MS).select("id", "capture_date")


@query(
    "SELECT id, ts, verdict FROM (SELECT * FROM av ORDER BY ts DESC NULLS LAST, id LIMIT 100) WHERE verified_class IS NULL OR verdict = 2",
    V.VIEW + "\n",
)
def review_queue(spark, sf_dir):
    """The filter stands above the limit: it looks at the hundred newest rows only."""
    newest = view(spark, sf_dir).orderBy(F.col("ts").desc_nulls_last(), "id").limit(100)
    return newest.where("verified_class is null or verdict = 2").select("id", "ts", "verdict")


@query("SELECT id, image_path, capture_date FROM av WHERE image_path IS NOT NULL AND patient_id IN ('1', '2', '3')", V.VIEW + "\n")
def gallery(spark, sf_dir):
    v = view(spark, sf_dir).where(F.col("image_path").isNotNull() & F.col("patient_id").isin("1", "2", "3"))
    return v.select("id", "image_path", "capture_date")


@query(
    """, c AS (SELECT least(greatest(verdict, 0), 2) AS status, count(*) AS n, count(verified_class) AS n_verified FROM av GROUP BY 1),
    g AS (SELECT CAST(status AS INT) AS status, coalesce(n, 0) AS n, coalesce(n_verified, 0) AS n_verified
          FROM (SELECT unnest([0, 1, 2]) AS status) LEFT JOIN c USING (status))
    SELECT status, n, n_verified, max(CASE WHEN status = 0 THEN n END) OVER () > 0
      AND max(CASE WHEN status = 0 THEN n_verified END) OVER () < 0.5 * max(CASE WHEN status = 0 THEN n END) OVER ()
      AND sum(CASE WHEN status > 0 THEN n_verified ELSE 0 END) OVER () > 0 AS ok_biased,
      round(100.0::DOUBLE * n_verified / nullif(n, 0), 6) AS coverage_pct FROM g""",
    V.VIEW,
)
def status_cards(spark, sf_dir):
    return V.rounded(S.status_cards(view(spark, sf_dir)))


@query(
    """, v AS (SELECT a.*, p.name AS patient_name, p.sex, p.sun_exposure, p.antecedents, n.verified_class, n.source AS verified_source
      FROM analysis a LEFT JOIN patient p ON p.id = a.patient_id LEFT JOIN newest n ON n.analysis_id = a.id)
    SELECT """
    + ", ".join(
        f"coalesce(CAST({'capture_date' if c == 'raw_capture_date' else c} AS VARCHAR), '') AS {name}" for name, c in S.EXPORT
    )
    + " FROM v",
    V.STORE,
)
def export_dataset(spark, sf_dir):
    t = S.export_table(V.analysis(spark, sf_dir), V.patient(spark, sf_dir), V.verified_label(spark, sf_dir))
    return t.orderBy("_ts", "analysis_id").drop("_ts")


@query(
    """SELECT analysis_id AS id, probs, round(p[1]::DOUBLE, 6) AS p_nevus, round(p[2]::DOUBLE, 6) AS p_mel,
    round(p[3]::DOUBLE, 6) AS p_atyp FROM (SELECT id AS analysis_id, probs, CAST(from_json(probs, '["DOUBLE"]') AS DOUBLE[]) AS p FROM analysis)""",
    V.ANALYSIS + "\n",
)
def parsed_probabilities(spark, sf_dir):
    p = F.from_json("probs", "array<double>")
    return V.rounded(
        V.analysis(spark, sf_dir).select("id", "probs", *[F.get(p, F.lit(k)).alias(n) for k, n in enumerate(("p_nevus", "p_mel", "p_atyp"))])
    )


SETTINGS = [
    ("thresholds:d0", '{"mel": 0.2, "atyp": 0.4, "nevus": 0.5}'),
    ("thresholds:d1", '{"mel": "x"'),
    ("other", "{}"),
]


@query(
    """SELECT version, CASE WHEN version = 'd0' THEN 0.2::DOUBLE ELSE 0.188::DOUBLE END AS thr_mel,
    CASE WHEN version = 'd0' THEN 0.4::DOUBLE ELSE 0.412::DOUBLE END AS thr_atyp, CASE WHEN version = 'd0' THEN 0.5::DOUBLE ELSE 0.508::DOUBLE END AS thr_nevus
    FROM (SELECT DISTINCT decision_policy_version AS version FROM analysis)""",
    V.ANALYSIS + "\n",
)
def policy_thresholds(spark, sf_dir):
    settings = spark.createDataFrame(SETTINGS, "key string, value string")
    versions = V.analysis(spark, sf_dir).select(F.col("decision_policy_version").alias("version")).distinct()
    return S.thresholds_for(settings, versions)


@query(
    """, live AS (SELECT *, CASE decision_policy_version WHEN 'd0' THEN 0.2::DOUBLE ELSE 0.188::DOUBLE END AS m,
      CASE decision_policy_version WHEN 'd0' THEN 0.4::DOUBLE ELSE 0.412::DOUBLE END AS t FROM analysis)
    SELECT verdict AS stored, CASE WHEN score_mel >= m THEN 2 WHEN score_atyp >= t THEN 1 ELSE 0 END AS live, count(*) AS n
    FROM live GROUP BY ALL""",
    V.ANALYSIS,
)
def stored_and_live_verdicts(spark, sf_dir):
    """Verdicts frozen when they were logged against those of the thresholds in force."""
    rows = V.analysis(spark, sf_dir)
    t = policy_thresholds(spark, sf_dir).withColumnsRenamed({"thr_mel": "m", "thr_atyp": "t", "version": "decision_policy_version"}).drop("thr_nevus")
    live = C.verdict(F.col("score_mel"), F.col("score_atyp"), F.col("m"), F.col("t"))
    return rows.join(t, "decision_policy_version").groupBy(F.col("verdict").alias("stored"), live.alias("live")).agg(F.count("*").alias("n"))


@query(
    """, r AS (SELECT patient_id, id, capture_date, score_mel, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY patient_id) AS n
      FROM av WHERE patient_id IS NOT NULL WINDOW w AS (PARTITION BY patient_id ORDER BY capture_date NULLS FIRST, ts NULLS FIRST, id))
    SELECT patient_id, id, round(CASE WHEN n > 1 THEN i / (n - 1)::DOUBLE ELSE 0 END, 6) AS x, round(least(greatest(score_mel, 0), 1), 6) AS y,
      score_mel >= 0.188::DOUBLE AS above FROM r""",
    V.VIEW,
)
def patient_trend(spark, sf_dir):
    """Scores of a patient in order of capture, x from 0 to 1, against the clinical threshold."""
    w = W.partitionBy("patient_id")
    order = w.orderBy(F.col("capture_date").asc_nulls_first(), F.col("ts").asc_nulls_first(), "id")
    v = view(spark, sf_dir).where("patient_id is not null")
    v = v.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(w))
    x = F.when(F.col("n") > 1, F.col("i") / F.nullif(F.col("n") - 1, F.lit(0)).cast("double")).otherwise(0.0)
    y = F.least(F.greatest("score_mel", F.lit(0.0)), F.lit(1.0))
    return V.rounded(v.select("patient_id", "id", x.alias("x"), y.alias("y"), (F.col("score_mel") >= C.THRESHOLDS["melanoma"]).alias("above")))


CHANGES = "CAST(s_suppkey * 20 AS VARCHAR) AS id, s_name AS name, CAST(floor(s_acctbal) AS BIGINT) AS updated_ts"


@query(
    f""", ch AS (SELECT {CHANGES} FROM supplier)
    SELECT p.id, coalesce(c.name, p.name) AS name, p.created_ts, coalesce(c.updated_ts, p.updated_ts) AS updated_ts
    FROM patient p LEFT JOIN ch c ON c.id = p.id""",
    V.PATIENT,
)
def upsert_patients(spark, sf_dir):
    """Updates of known ids; unknown ids change nothing, and creation times stay."""
    changes = table(spark, sf_dir, "supplier").selectExpr(
        "cast(s_suppkey * 20 as string) id", "s_name name", "cast(floor(s_acctbal) as bigint) updated_ts"
    )
    base = V.patient(spark, sf_dir).select("id", "name", "created_ts", "updated_ts")
    return S.merge_by_key(base, changes, "id", insert=False, keep=["created_ts"])


@query(
    """SELECT id, CASE WHEN CAST(id AS BIGINT) % 13 = 0 THEN 1 ELSE archived END AS archived FROM analysis""",
    V.ANALYSIS + "\n",
)
def archive_analyses(spark, sf_dir):
    a = V.analysis(spark, sf_dir)
    return S.archive(a, a.where("cast(id as bigint) % 13 = 0"), NOW)[0].select("id", "archived")


@query(
    f"SELECT CAST({NOW} AS BIGINT) AS ts, 'archive' AS event, id AS analysis_id, 'duplicate' AS detail FROM analysis WHERE CAST(id AS BIGINT) % 13 = 0",
    V.ANALYSIS + "\n",
)
def archive_log(spark, sf_dir):
    a = V.analysis(spark, sf_dir)
    return S.archive(a, a.where("cast(id as bigint) % 13 = 0"), NOW, "duplicate")[1]


@query(
    f""", more AS (SELECT analysis_id, ts, verified_class, source FROM verified_label UNION ALL
      SELECT id, CAST({NOW} * 2 AS BIGINT), 1, 'biopsy' FROM analysis WHERE CAST(id AS BIGINT) % 29 = 0)
    SELECT verified_class, source, count(*) AS n FROM more GROUP BY ALL""",
    V.ANALYSIS + ",\n" + V.LABELS,
)
def bulk_verify(spark, sf_dir):
    """Labels after one was appended for every selected analysis."""
    ids = V.analysis(spark, sf_dir).where("cast(id as bigint) % 29 = 0")
    old = V.verified_label(spark, sf_dir).select("analysis_id", "ts", "verified_class", "source")
    new = S.bulk_labels(ids, 1, 2 * NOW).select(*old.columns)
    return old.unionByName(new).groupBy("verified_class", "source").agg(F.count("*").alias("n"))


@query(
    """SELECT conv_id, turn, role, text FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1"""
)
def latest_turn(spark, sf_dir):
    return R.latest_per_key(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "role", "text")


@query(
    """SELECT user_id, count(*) AS n, max(value) AS max_value, min(value) AS min_value, round(median(value), 6) AS median_value FROM events GROUP BY 1"""
)
def patient_table(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id")
    return V.rounded(
        e.agg(
            F.count("*").alias("n"), F.max("value").alias("max_value"), F.min("value").alias("min_value"), F.median("value").alias("median_value")
        )
    )


@query(
    """, s AS (SELECT id, pred_class, score_mel, score_nevus, score_atyp, greatest(score_nevus, score_mel, score_atyp) AS top,
      CASE WHEN score_nevus >= score_mel AND score_nevus >= score_atyp THEN 0 WHEN score_mel >= score_atyp THEN 1 ELSE 2 END AS idx FROM analysis),
    m AS (SELECT *, top - list_sort([score_nevus, score_mel, score_atyp], 'DESC')[2] AS margin FROM s)
    SELECT id, idx AS top_index, round(top, 6) AS confidence, round(margin, 6) AS margin, round(score_mel - 0.188::DOUBLE, 6) AS margin_mel,
      round(greatest(score_mel / 0.188::DOUBLE, score_atyp / 0.412::DOUBLE), 6) AS exceedance,
      round(CASE WHEN score_mel + score_nevus > 1e-12 THEN score_mel / (score_mel + score_nevus) ELSE 0 END, 6) AS two_class,
      CASE WHEN idx = 1 THEN 'suspicious' WHEN idx = 2 THEN 'caution' WHEN top >= 0.85 AND margin >= 0.5 THEN 'benign' ELSE 'caution' END AS risk
    FROM m""",
    V.ANALYSIS,
)
def clinical_readout(spark, sf_dir):
    p = F.array("score_nevus", "score_mel", "score_atyp")
    a = V.analysis(spark, sf_dir).withColumn("top_index", C.argmax(p)).withColumn("confidence", F.array_max(p)).withColumn("margin", C.top_margin(p))
    return V.rounded(
        a.select(
            "id", "top_index", "confidence", "margin",
            (F.col("score_mel") - C.THRESHOLDS["melanoma"]).alias("margin_mel"),
            C.exceedance(F.col("score_mel"), F.col("score_atyp")).alias("exceedance"),
            C.two_class_readout(F.col("score_mel"), F.col("score_nevus")).alias("two_class"),
            C.clinical_risk(F.col("top_index"), F.col("confidence"), F.col("margin")).alias("risk"),
        )
    )
