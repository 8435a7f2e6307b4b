"""Queries of contracts and the store: digests, manifests, completeness, positions, schema steps, appends."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortal.operators import alignment as L
from cohortal.operators import audit as A
from cohortal.operators import migration as G
from cohortal.operators import store as S
from cohortal.plans import views as V
from cohortal.plans.records import NOW
from cohortal.plans.registry import query
from cohortal.plans.views import rounded
from cohortal.session import table

FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(hex(encode({0}))), 2), lambda p: ('0x' || hex(encode({0}))[p:p+1])::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616::HUGEINT)"


@query(
    f"""SELECT c_custkey, lpad(lower(hex(h::UBIGINT)), 16, '0') AS fnv,
      CASE WHEN h >= 9223372036854775808::HUGEINT THEN lpad('-' || lower(hex((18446744073709551616::HUGEINT - h)::UBIGINT)), greatest(16, 1 + length(hex((18446744073709551616::HUGEINT - h)::UBIGINT)))::INT, '0') ELSE lpad(lower(hex(h::UBIGINT)), 16, '0') END AS fnv_signed
    FROM (SELECT c_custkey, {FNV.format("c_name || c_mktsegment")} AS h FROM customer)"""
)
def fnv_hashes(spark, sf_dir):
    """Content hashes as they are stored, unsigned and signed."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.encode(F.concat("c_name", "c_mktsegment"), "utf-8").alias("b"))
    return c.select("c_custkey", A.fnv1a_64("b").alias("fnv"), A.fnv1a_64("b", signed=True).alias("fnv_signed"))


COMPONENTS, CLASSES, CUTS = ("unet", "cnn", "trees"), ("nevus", "melanoma", "atypical"), ("mel", "atyp")
_DIGEST = "sha256(s_name || '{0}')"
_DECLARED = [f"CASE WHEN k % 5 = 1 AND '{c}' = 'cnn' THEN upper({_DIGEST.format(c)}) ELSE {_DIGEST.format(c)} END" for c in COMPONENTS]
_RAW = " || ".join(f"'{c}'::BLOB || '\\x00'::BLOB || unhex(d{i})" for i, c in enumerate(COMPONENTS))


@query(
    f"""m AS (SELECT s_suppkey, s_suppkey % 60 AS k, s_name, s_acctbal FROM supplier),
    d AS (SELECT *, {", ".join(f"{x} AS d{i}" for i, x in enumerate(_DECLARED))} FROM m),
    b AS (SELECT *, sha256({_RAW}) AS bundle FROM d),
    f AS (
      SELECT s_suppkey, 'components' AS "check", 'cnn,unet,trees' AS detail FROM b WHERE k % 4 = 1
      UNION ALL SELECT s_suppkey, 'sha256', 'cnn' FROM b WHERE k % 4 <> 1 AND k % 5 = 1
      UNION ALL SELECT s_suppkey, 'classes', 'nevus,atypical' FROM b WHERE k % 6 = 1
      UNION ALL SELECT s_suppkey, 'thresholds', 'mel' FROM b WHERE NOT (s_acctbal / 5000 BETWEEN 0 AND 1)
      UNION ALL SELECT s_suppkey, 'thresholds', 'atyp' FROM b WHERE k % 7 = 1
      UNION ALL SELECT s_suppkey, 'bundle_sha256', 'not that of the components' FROM b WHERE k % 4 <> 1 AND k % 5 <> 1 AND k % 3 = 1
      UNION ALL SELECT s_suppkey, 'file', 'trees' FROM b WHERE k % 4 <> 1 AND k % 10 = 3)
    SELECT * FROM f""",
    " ",
)
def manifest_contract(spark, sf_dir):
    """Faults of a manifest per supplier, some of them made on purpose."""
    k = F.pmod("s_suppkey", F.lit(60))
    digest = lambda c: F.sha2(F.concat("s_name", F.lit(c)), 256)
    declared = lambda c: F.when((k % 5 == 1) & F.lit(c == "cnn"), F.upper(digest(c))).otherwise(digest(c))
    item = lambda c: F.struct(F.lit(c).alias("name"), declared(c).alias("sha256"))
    own = A.bundle_sha256(F.array(*map(F.lit, COMPONENTS)), F.array(*[declared(c) for c in COMPONENTS]))
    names = lambda cs: F.array(*map(F.lit, cs))
    m = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.when(k % 4 == 1, F.array(item("cnn"), item("unet"), item("trees"))).otherwise(F.array(*map(item, COMPONENTS))).alias("components"),
        F.when(k % 6 == 1, names(["nevus", "atypical"])).otherwise(names(CLASSES)).alias("classes"),
        F.create_map(F.lit("mel"), F.col("s_acctbal") / 5000, F.lit("atyp"), F.when(k % 7 != 1, 0.4)).alias("thresholds"),
        F.when((k % 3 == 1) & (k % 4 != 1) & (k % 5 != 1), F.sha2("s_name", 256)).otherwise(own).alias("bundle_sha256"),
        F.array(*[F.when((k % 10 == 3) & F.lit(c == "trees"), F.sha2("s_name", 256)).otherwise(F.lower(digest(c))) for c in COMPONENTS]).alias("files"),
    )
    return A.manifest_checks(m, "s_suppkey", COMPONENTS, CLASSES, CUTS, "files")


_SIDES = {
    "orders": ("o_orderkey", "o_totalprice", "SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 300 = 0 THEN 1e-4 ELSE 1e-8 END AS o_totalprice FROM orders WHERE o_orderkey % 1000 <> 1"),
    "customer": ("c_custkey", "c_acctbal", "SELECT c_custkey, c_acctbal FROM customer"),
    "part": ("p_partkey", "p_retailprice", "SELECT p_partkey + CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE 0 END AS p_partkey, p_retailprice FROM part"),
    "nation": ("n_nationkey", "n_regionkey", "SELECT n_nationkey, n_regionkey FROM nation WHERE false"),
}


def _complete_sql(name: str, key: str, value: str, written: str) -> str:
    return f"""SELECT '{name}' AS "table", *, CASE WHEN expected_rows = "rows" AND greatest(missing_keys, extra_keys, repeated_keys, off_values) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
      SELECT coalesce(sum(na), 0)::BIGINT AS expected_rows, coalesce(sum(nb), 0)::BIGINT AS "rows", count(*) FILTER (nb IS NULL) AS missing_keys, count(*) FILTER (na IS NULL) AS extra_keys,
        count(*) FILTER (nb > na) AS repeated_keys, count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL AND abs(va - vb) > 1e-6) AS off_values
      FROM (SELECT {key} AS k, count(*) AS na, min({value}) AS va FROM {name} GROUP BY 1) FULL JOIN (SELECT {key} AS k, count(*) AS nb, min({value}) AS vb FROM ({written}) GROUP BY 1) USING (k))"""


@query(" UNION ALL ".join(_complete_sql(n, *s) for n, s in _SIDES.items()))
def table_completeness(spark, sf_dir):
    """Written tables against their sources: rows lost, keys moved, values off, a table that is not there."""
    source = {n: table(spark, sf_dir, n).select(k, v) for n, (k, v, _) in _SIDES.items()}
    o, p = source["orders"], source["part"]
    written = {
        "orders": o.where("o_orderkey % 1000 <> 1").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 300 == 0, 1e-4).otherwise(1e-8)),
        "customer": source["customer"],
        "part": p.withColumn("p_partkey", F.col("p_partkey") + F.when(F.col("p_partkey") % 97 == 0, 1).otherwise(0)),
    }
    return A.completeness(source, written, {n: [s[0]] for n, s in _SIDES.items()}, {n: [s[1]] for n, s in _SIDES.items()})


@query(
    """placed AS (SELECT row_number() OVER () - 1 AS pos, o_orderkey, o_orderstatus, o_custkey FROM orders),
    n AS (SELECT count(*) AS n FROM placed), c AS (SELECT pos + CASE WHEN pos % 50 = 7 THEN 1 ELSE 0 END AS pos, CASE WHEN pos % 20 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM placed WHERE pos % 41 <> 5),
    u AS (SELECT pos, count(*) AS k, min((o_custkey::VARCHAR, o_orderstatus)) AS v FROM c GROUP BY pos),
    j AS (SELECT placed.pos AS a, u.pos AS b, k, v, (placed.o_custkey::VARCHAR, placed.o_orderstatus) AS w FROM placed FULL JOIN u USING (pos)),
    m AS (SELECT n, (SELECT count(*) FROM c) AS nc FROM n)
    SELECT * FROM (
      SELECT t AS "table", x AS "check", CAST(0 AS BIGINT) AS observed, 'PASS' AS status FROM (SELECT unnest(['hc', 'lesion']) AS t), (SELECT unnest(['repeated', 'null', 'gaps']) AS x)
      UNION ALL SELECT 'lesion', x, 0, 'PASS' FROM (SELECT unnest(['rows', 'unmatched', 'column o_custkey', 'column o_orderstatus']) AS x)
      UNION ALL SELECT 'dehair', 'null', 0, 'PASS'
      UNION ALL SELECT 'dehair', x, o, CASE WHEN o = 0 THEN 'PASS' ELSE 'FAIL' END FROM (
        SELECT 'rows' AS x, abs(n - nc) AS o FROM m
        UNION ALL SELECT 'repeated', (SELECT CAST(sum(k - 1) AS BIGINT) FROM u) FROM m
        UNION ALL SELECT 'gaps', nc - (SELECT count(*) FROM u WHERE pos < nc) FROM m
        UNION ALL SELECT 'unmatched', count(*) FILTER (a IS NULL OR b IS NULL) FROM j
        UNION ALL SELECT 'column o_custkey', count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND v[1] <> w[1]) FROM j
        UNION ALL SELECT 'column o_orderstatus', count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND v[2] <> w[2]) FROM j))""",
    " ",
)
def positional_alignment(spark, sf_dir):
    """Checks of feature tables that belong together by position in the file: one fits, one has shifts, losses and other classes."""
    at = L.file_positions(table(spark, sf_dir, "orders")).select("row_index", "o_custkey", "o_orderstatus")
    shifted = at.where("row_index % 41 <> 5").select(
        (F.col("row_index") + F.when(F.col("row_index") % 50 == 7, 1).otherwise(0)).alias("row_index"), "o_custkey",
        F.when(F.col("row_index") % 20 == 3, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    return L.alignment_checks({"hc": at, "lesion": at, "dehair": shifted}, ["o_custkey", "o_orderstatus"])


@query(
    """SELECT id, ts, patient_id, archived, lesion_id, thr_mel, decision_policy_version FROM (
      SELECT id, ts, NULL::VARCHAR AS patient_id, 0 AS archived, NULL::VARCHAR AS lesion_id, NULL::DOUBLE AS thr_mel, NULL::VARCHAR AS decision_policy_version FROM analysis)""",
    V.ANALYSIS + "\n",
)
def migrated_analysis(spark, sf_dir):
    """The analyses of a store of version 1 as the schema steps leave them."""
    old = V.analysis(spark, sf_dir).select("id", "ts", "image_path", "model_version", "pred_class", "probs", "verdict", "non_benign", "quality_flag")
    new = G.upgraded(spark, {"analysis": old, "patient": V.patient(spark, sf_dir)}, 1)["analysis"]
    return new.select("id", "ts", "patient_id", "archived", "lesion_id", "thr_mel", "decision_policy_version")


_LOG = f"SELECT CAST({NOW} AS BIGINT) AS ts, '{{event}}' AS event, {{id}} AS analysis_id, {{detail}} AS detail FROM ({{rows}})"
_NEW = "SELECT 'new' || id AS id, pred_class, verdict, o FROM (SELECT *, CAST(id AS BIGINT) AS o FROM analysis) WHERE o % 40 = 3"


@query(
    f"""SELECT 'row' AS kind, id, CAST({NOW} AS BIGINT) AS ts, NULL::VARCHAR AS event, pred_class, NULL::VARCHAR AS image_path FROM ({_NEW})
    UNION ALL SELECT 'row', id, ts, NULL, pred_class, image_path FROM analysis
    UNION ALL SELECT 'log', analysis_id, ts, event, NULL, NULL FROM ({_LOG.format(event="analysis", id="id", detail="NULL", rows=_NEW)})""",
    V.ANALYSIS + "\n",
)
def logged_analyses(spark, sf_dir):
    """Analyses after new ones are appended, and the audit rows of these."""
    a = V.analysis(spark, sf_dir)
    new = a.where("cast(id as long) % 40 = 3").select(F.concat(F.lit("new"), "id").alias("id"), F.lit(NOW).alias("ts"), "pred_class", "verdict")
    rows, log = S.log_analysis(a, new, NOW)
    rows = rows.select(F.lit("row").alias("kind"), "id", "ts", F.lit(None).cast("string").alias("event"), "pred_class", "image_path")
    return rows.unionByName(log.select(F.lit("log").alias("kind"), F.col("analysis_id").alias("id"), "ts", "event"), allowMissingColumns=True)


@query(
    f"""SELECT 'row' AS kind, analysis_id, CAST(verified_class AS VARCHAR) AS what, ts FROM verified_label
    UNION ALL SELECT 'row', id, CAST(pred_class AS VARCHAR), {NOW} FROM analysis WHERE quality_flag = 1
    UNION ALL SELECT 'log', analysis_id, detail, ts FROM ({_LOG.format(event="label", id="id", detail="CAST(pred_class AS VARCHAR)", rows="SELECT * FROM analysis WHERE quality_flag = 1")})""",
    f"{V.ANALYSIS},\n{V.LABELS}\n",
)
def added_labels(spark, sf_dir):
    """Labels after those of a review are appended, and their audit rows."""
    new = V.analysis(spark, sf_dir).where("quality_flag = 1").select(F.col("id").alias("analysis_id"), F.col("pred_class").alias("verified_class"), F.lit("review").alias("source"))
    rows, log = S.add_verified_label(V.verified_label(spark, sf_dir), new, NOW)
    rows = rows.select(F.lit("row").alias("kind"), "analysis_id", F.col("verified_class").cast("string").alias("what"), "ts")
    return rows.unionByName(log.select(F.lit("log").alias("kind"), "analysis_id", F.col("detail").alias("what"), "ts"))


_ANSWERS = "SELECT id AS analysis_id, CAST(pred_class = verdict AS INT) AS md_agree, CASE WHEN pred_class <> verdict THEN verdict END AS md_class FROM analysis WHERE patient_id IS NULL"


@query(
    f"""SELECT 'row' AS kind, analysis_id, CAST({NOW} AS BIGINT) AS ts, md_agree, md_class, NULL::VARCHAR AS detail FROM ({_ANSWERS})
    UNION ALL SELECT 'log', analysis_id, {NOW}, NULL, NULL, CASE WHEN md_agree = 1 THEN 'agree' ELSE 'class ' || CAST(md_class AS VARCHAR) END FROM ({_ANSWERS})""",
    V.ANALYSIS + "\n",
)
def added_validations(spark, sf_dir):
    """A clinician's answers appended to an empty table, and their audit rows."""
    a = V.analysis(spark, sf_dir).where("patient_id is null")
    agree = F.col("pred_class") == F.col("verdict")
    new = a.select(F.col("id").alias("analysis_id"), agree.cast("int").alias("md_agree"), F.when(~agree, F.col("verdict")).alias("md_class"))
    rows, log = S.add_validation(spark.createDataFrame([], "id long, analysis_id string, ts long, md_agree int, md_class int"), new, NOW)
    rows = rows.select(F.lit("row").alias("kind"), "analysis_id", "ts", "md_agree", "md_class")
    return rows.unionByName(log.select(F.lit("log").alias("kind"), "analysis_id", "ts", "detail"), allowMissingColumns=True)
