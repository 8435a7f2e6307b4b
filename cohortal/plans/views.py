"""The driver's tables in the roles of patients, analyses, labels and predictions.

Each view is given twice: as a DataFrame and as a SQL common table expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.session import table

PATIENT = """patient AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey % 3 AS INT) AS sex,
    CAST(c_nationkey % 4 AS INT) AS sun_exposure, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS antecedents,
    CAST(1000 * c_custkey AS BIGINT) AS created_ts, CAST(floor(c_acctbal * 100) AS BIGINT) AS updated_ts
  FROM customer)"""

ANALYSIS = """raw_analysis AS (
  SELECT o_orderkey AS k, o_custkey, o_orderstatus, CAST(epoch_ms(o_orderdate) AS BIGINT) AS ts,
    CAST(o_orderkey % 50 AS INT) AS a, CAST((o_orderkey * 7) % 50 AS INT) AS b FROM orders),
analysis AS (
  SELECT CAST(k AS VARCHAR) AS id, ts, CASE WHEN k % 17 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS patient_id,
    CASE WHEN k % 5 <> 0 THEN ts + (k % 7) * 86400000 END AS capture_date,
    CASE WHEN k % 4 <> 0 THEN 'img_' || CAST(k AS VARCHAR) || '.jpg' END AS image_path,
    'v' || CAST(k % 3 AS VARCHAR) AS model_version, CASE WHEN k % 3 <> 0 THEN 'sha' || CAST(k % 3 AS VARCHAR) END AS model_bundle_sha256,
    'p1' AS preprocessing_version, 'd' || CAST(k % 2 AS VARCHAR) AS decision_policy_version,
    CAST(k % 3 AS INT) AS pred_class,
    '[' || CAST(a AS VARCHAR) || 'e-2,' || CAST(b AS VARCHAR) || 'e-2,' || CAST(100 - a - b AS VARCHAR) || 'e-2]' AS probs,
    a / 100.0::DOUBLE AS score_nevus, b / 100.0::DOUBLE AS score_mel, (100 - a - b) / 100.0::DOUBLE AS score_atyp,
    0.508::DOUBLE AS thr_nevus, 0.188::DOUBLE AS thr_mel, 0.412::DOUBLE AS thr_atyp,
    CASE WHEN b / 100.0::DOUBLE >= 0.188::DOUBLE THEN 2 WHEN (100 - a - b) / 100.0::DOUBLE >= 0.412::DOUBLE THEN 1 ELSE 0 END AS verdict,
    CASE WHEN b / 100.0::DOUBLE >= 0.188::DOUBLE OR (100 - a - b) / 100.0::DOUBLE >= 0.412::DOUBLE THEN 1 ELSE 0 END AS non_benign,
    CASE WHEN k % 10 = 0 THEN 1 WHEN k % 11 <> 0 THEN 0 END AS quality_flag,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 0 END AS archived
  FROM raw_analysis)"""

LABELS = """verified_label AS (
  SELECT l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS id, CAST(l_orderkey AS VARCHAR) AS analysis_id,
    CASE WHEN l_quantity <> 50 THEN CAST(epoch_ms(l_shipdate) AS BIGINT) END AS ts,
    CAST(l_linenumber % 3 AS INT) AS verified_class, l_returnflag AS source
  FROM lineitem)"""

NEWEST = """newest AS (
  SELECT analysis_id, verified_class, source FROM verified_label
  QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY ts DESC NULLS LAST, id DESC) = 1)"""

STORE = f"{PATIENT},\n{ANALYSIS},\n{LABELS},\n{NEWEST}"

VIEW = f"""{STORE},
av AS (
  SELECT a.id, a.ts, a.patient_id, p.name AS patient_name, coalesce(a.capture_date, a.ts) AS capture_date, a.image_path,
    coalesce(a.pred_class, 0) AS pred_class, coalesce(a.verdict, 0) AS verdict, coalesce(a.non_benign, 0) = 1 AS non_benign,
    coalesce(a.quality_flag, 0) = 1 AS quality_flag, a.score_mel, a.score_atyp, a.score_nevus, n.verified_class
  FROM analysis a LEFT JOIN patient p ON p.id = a.patient_id LEFT JOIN newest n ON n.analysis_id = a.id
  WHERE a.archived IS NULL OR a.archived = 0)"""

#: Columns of the analysis view that queries return.
VIEW_COLUMNS = (
    "id ts patient_id patient_name capture_date image_path pred_class verdict non_benign quality_flag "
    "score_mel score_atyp score_nevus verified_class"
).split()

PRED = """raw_pred AS (
  SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1, CAST(embedding[3] AS DOUBLE) AS x2,
    CAST(embedding[4] AS DOUBLE) AS e4, CAST(embedding[5] AS DOUBLE) AS y0, CAST(embedding[6] AS DOUBLE) AS y1, CAST(embedding[7] AS DOUBLE) AS y2
  FROM embeddings),
pred AS (
  SELECT vec_id AS row_index, CAST(label % 3 AS INT) AS truth, CAST(label % 3 = 1 AS INT) AS y,
    x0 * x0 / (x0 * x0 + x1 * x1 + x2 * x2) AS p_nevus, x1 * x1 / (x0 * x0 + x1 * x1 + x2 * x2) AS p_mel,
    x2 * x2 / (x0 * x0 + x1 * x1 + x2 * x2) AS p_atyp,
    floor(100 * (x1 * x1 / (x0 * x0 + x1 * x1 + x2 * x2))) / 100 AS s_a,
    floor(100 * (y1 * y1 / (y0 * y0 + y1 * y1 + y2 * y2))) / 100 AS s_b,
    abs(e4) / (1 + abs(e4)) AS coverage,
    'src' || CAST(vec_id % 4 AS VARCHAR) AS source, 'p' || CAST(vec_id % 53 AS VARCHAR) AS patient_id,
    'g' || CAST(vec_id % 137 AS VARCHAR) AS group_key,
    CASE WHEN vec_id % 10 < 6 THEN 'train' WHEN vec_id % 10 < 8 THEN 'valid' ELSE 'test' END AS split,
    CAST(vec_id % 5 AS INT) AS fold,
    CASE WHEN x0 * x0 >= x1 * x1 AND x0 * x0 >= x2 * x2 THEN 0 WHEN x1 * x1 >= x2 * x2 THEN 1 ELSE 2 END AS pred
  FROM raw_pred)"""


def patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as string) id", "c_name name", "cast(c_nationkey % 3 as int) sex", "cast(c_nationkey % 4 as int) sun_exposure",
        "case when c_mktsegment <> 'BUILDING' then c_mktsegment end antecedents", "1000 * c_custkey created_ts",
        "cast(floor(c_acctbal * 100) as bigint) updated_ts",
    )


def _ms(column: str) -> str:
    return f"unix_millis(cast({column} as timestamp))"


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey k", "o_custkey", "o_orderstatus", f"{_ms('o_orderdate')} ts", "cast(o_orderkey % 50 as int) a", "cast((o_orderkey * 7) % 50 as int) b"
    )
    rows = raw.selectExpr(
        "cast(k as string) id", "ts", "case when k % 17 <> 0 then cast(o_custkey as string) end patient_id",
        "case when k % 5 <> 0 then ts + (k % 7) * 86400000 end capture_date",
        "case when k % 4 <> 0 then concat('img_', k, '.jpg') end image_path",
        "concat('v', k % 3) model_version", "case when k % 3 <> 0 then concat('sha', k % 3) end model_bundle_sha256",
        "'p1' preprocessing_version", "concat('d', k % 2) decision_policy_version", "cast(k % 3 as int) pred_class",
        "concat('[', a, 'e-2,', b, 'e-2,', 100 - a - b, 'e-2]') probs",
        "a / 100.0D score_nevus", "b / 100.0D score_mel", "(100 - a - b) / 100.0D score_atyp",
        "0.508D thr_nevus", "0.188D thr_mel", "0.412D thr_atyp",
        "case when k % 10 = 0 then 1 when k % 11 <> 0 then 0 end quality_flag",
        "case o_orderstatus when 'F' then 1 when 'P' then 0 end archived",
    )
    from cohortal.operators import classify as C

    scores = [F.col(c) for c in ("score_mel", "score_atyp", "thr_mel", "thr_atyp")]
    return rows.withColumn("verdict", C.verdict(*scores)).withColumn("non_benign", C.non_benign(*scores).cast("int"))


def verified_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey id", "cast(l_orderkey as string) analysis_id",
        f"case when l_quantity <> 50 then {_ms('l_shipdate')} end ts", "cast(l_linenumber % 3 as int) verified_class", "l_returnflag source",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    x = [F.element_at("embedding", k).cast("double").alias(n) for k, n in enumerate(("x0", "x1", "x2", "e4", "y0", "y1", "y2"), 1)]
    raw = e.select("vec_id", "label", *x)
    return raw.selectExpr(
        "vec_id row_index", "cast(label % 3 as int) truth", "cast(label % 3 = 1 as int) y",
        "x0 * x0 / (x0 * x0 + x1 * x1 + x2 * x2) p_nevus", "x1 * x1 / (x0 * x0 + x1 * x1 + x2 * x2) p_mel",
        "x2 * x2 / (x0 * x0 + x1 * x1 + x2 * x2) p_atyp",
        "floor(100 * (x1 * x1 / (x0 * x0 + x1 * x1 + x2 * x2))) / 100D s_a",
        "floor(100 * (y1 * y1 / (y0 * y0 + y1 * y1 + y2 * y2))) / 100D s_b",
        "abs(e4) / (1 + abs(e4)) coverage", "concat('src', vec_id % 4) source", "concat('p', vec_id % 53) patient_id",
        "concat('g', vec_id % 137) group_key",
        "case when vec_id % 10 < 6 then 'train' when vec_id % 10 < 8 then 'valid' else 'test' end split", "cast(vec_id % 5 as int) fold",
        "cast(array_position(array(x0 * x0, x1 * x1, x2 * x2), array_max(array(x0 * x0, x1 * x1, x2 * x2))) - 1 as int) pred",
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded for comparison."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
