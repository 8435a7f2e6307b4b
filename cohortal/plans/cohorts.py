"""Cohort construction and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.operators import audit as A
from cohortal.operators import classify as C
from cohortal.operators import effects as E
from cohortal.operators import relational as R
from cohortal.operators.graph import connected_components
from cohortal.operators.prefix import numbered
from cohortal.operators.ranking import paired_delong, quantiles
from cohortal.plans import views as V
from cohortal.plans.registry import query
from cohortal.plans.views import predictions, rounded
from cohortal.session import table

META = """meta AS (
  SELECT doc_id AS row_index, CASE doc_id % 5 WHEN 0 THEN 'ham_' WHEN 1 THEN 'isic2019_' WHEN 2 THEN 's1_' WHEN 3 THEN 's2_' ELSE 'x_' END || CAST(doc_id % 400 AS VARCHAR) AS stem,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'L' || CAST(doc_id % 211 AS VARCHAR) END AS lesion_id,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'P' || CAST(doc_id % 97 AS VARCHAR) END AS patient_id,
    CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'valid' ELSE 'test' END AS split,
    CASE doc_id % 3 WHEN 0 THEN 'nevus' WHEN 1 THEN 'melanoma' ELSE 'atypical' END AS class_name, lang
  FROM documents),
image AS (
  SELECT *, CASE WHEN starts_with(stem, 'ham_') THEN 'ham' WHEN starts_with(stem, 'isic2019_') THEN 'isic2019' WHEN starts_with(stem, 's1_') THEN 's1' WHEN starts_with(stem, 's2_') THEN 's2' ELSE 'unknown' END AS source,
    regexp_replace(stem, '^(ham_|isic2019_|s1_|s2_)', '') AS image_id,
    coalesce(nullif(lesion_id, ''), nullif(patient_id, ''), stem) AS group_key FROM meta)"""


def images(spark, sf_dir) -> DataFrame:
    m = table(spark, sf_dir, "documents").selectExpr(
        "doc_id row_index",
        "concat(case doc_id % 5 when 0 then 'ham_' when 1 then 'isic2019_' when 2 then 's1_' when 3 then 's2_' else 'x_' end, doc_id % 400) stem",
        "case when doc_id % 3 = 0 then '' else concat('L', doc_id % 211) end lesion_id",
        "case when doc_id % 4 = 0 then '' else concat('P', doc_id % 97) end patient_id",
        "case when doc_id % 10 < 6 then 'train' when doc_id % 10 < 8 then 'valid' else 'test' end split",
        "case doc_id % 3 when 0 then 'nevus' when 1 then 'melanoma' else 'atypical' end class_name",
        "lang",
    )
    return m.withColumns(
        {"source": C.source_of(F.col("stem")), "image_id": C.canonical_id(F.col("stem")), "group_key": R.first_nonempty("lesion_id", "patient_id", "stem")}
    )


@query("SELECT row_index, stem, source, image_id, group_key, split, class_name FROM image", META + "\n")
def image_metadata(spark, sf_dir):
    return images(spark, sf_dir).select("row_index", "stem", "source", "image_id", "group_key", "split", "class_name")


@query(
    """SELECT source, count(*) AS n_images, round(100 * avg((lesion_id <> '')::INT), 6) AS lesion_id_resolved_pct,
    round(100 * avg((patient_id <> '')::INT), 6) AS patient_id_resolved_pct FROM image GROUP BY source""",
    META + "\n",
)
def id_coverage(spark, sf_dir):
    share = lambda c: 100 * F.avg((F.col(c) != "").cast("double"))
    return rounded(
        images(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_images"), share("lesion_id").alias("lesion_id_resolved_pct"), share("patient_id").alias("patient_id_resolved_pct"))
    )


def duplication_sql(by: str, name: str) -> str:
    g = f"{by}, " if by else ""
    return f"""SELECT {name} AS source, CAST(sum(n) AS BIGINT) AS n_images, count(*) AS n_groups, max(n) AS max_images_per_group, round(avg(n), 6) AS mean_images_per_group,
      round(100.0::DOUBLE * sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS pct_images_in_multi_image_group
      FROM (SELECT {g} group_key, count(*) AS n FROM image GROUP BY ALL) {'GROUP BY ' + by if by else ''}"""


@query(f"{duplication_sql('source', 'source')} UNION ALL {duplication_sql('', chr(39) + 'ALL' + chr(39))}", META + "\n")
def duplication_table(spark, sf_dir):
    i = images(spark, sf_dir)
    everything = R.group_sizes(i, "group_key").withColumn("source", F.lit("ALL"))
    return rounded(R.group_sizes(i, "group_key", ["source"]).unionByName(everything))


@query(
    """SELECT source, split, count(*) FILTER (class_name = 'nevus') AS nevus, count(*) FILTER (class_name = 'melanoma') AS melanoma, count(*) FILTER (class_name = 'atypical') AS atypical, count(*) AS total
    FROM image GROUP BY ALL""",
    META + "\n",
)
def composition(spark, sf_dir):
    names = ["nevus", "melanoma", "atypical"]
    p = images(spark, sf_dir).groupBy("source", "split").pivot("class_name", names).count().na.fill(0)
    return p.withColumn("total", reduce(lambda a, b: a + b, [F.col(c) for c in names]))


@query(
    """SELECT coalesce(source, 'overall') AS source, count(DISTINCT lesion_id) AS n_keys, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS images_in_multi, coalesce(max(n), 1) AS max_per_key
    FROM (SELECT source, lesion_id, count(*) AS n FROM image WHERE lesion_id <> '' GROUP BY ALL) GROUP BY source
    UNION ALL SELECT 'overall', count(*), coalesce(sum(n) FILTER (n > 1), 0)::BIGINT, coalesce(max(n), 1) FROM (SELECT lesion_id, count(*) AS n FROM image WHERE lesion_id <> '' GROUP BY ALL)""",
    META + "\n",
)
def lesion_keys(spark, sf_dir):
    i = images(spark, sf_dir).where("lesion_id != ''")

    def stats(each: DataFrame, *by: str) -> DataFrame:
        return each.groupBy(*by).agg(
            F.count("*").alias("n_keys"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("images_in_multi"),
            F.coalesce(F.max("n"), F.lit(1)).alias("max_per_key"),
        )

    own = stats(i.groupBy("source", "lesion_id").agg(F.count("*").alias("n")), "source")
    return own.unionByName(stats(i.groupBy("lesion_id").agg(F.count("*").alias("n"))).withColumn("source", F.lit("overall")))


@query(
    """, tv AS (SELECT DISTINCT group_key, image_id FROM image WHERE split <> 'test'), te AS (SELECT DISTINCT group_key, image_id FROM image WHERE split = 'test'),
    g AS (SELECT DISTINCT group_key FROM te WHERE group_key IN (SELECT group_key FROM tv)), i AS (SELECT DISTINCT image_id FROM te WHERE image_id IN (SELECT image_id FROM tv))
    SELECT (SELECT count(*) FROM g) AS group_overlap_count, (SELECT count(*) FROM i) AS image_id_overlap_count,
      coalesce((SELECT string_agg(group_key, ',' ORDER BY group_key) FROM (SELECT group_key FROM g ORDER BY group_key LIMIT 20)), '') AS group_overlap_examples,
      (SELECT count(*) FROM image WHERE split = 'test' AND group_key IN (SELECT group_key FROM tv)) AS leaking_images""",
    META,
)
def split_audit(spark, sf_dir):
    i = images(spark, sf_dir)
    g = R.leaking(i, "group_key", "split")
    keys = g.select("group_key").distinct()
    examples = keys.orderBy("group_key").limit(20).agg(F.array_join(F.array_sort(F.collect_list("group_key")), ",").alias("group_overlap_examples"))
    ids = R.leaking(i, "image_id", "split").agg(F.countDistinct("image_id").alias("image_id_overlap_count"))
    counts = g.agg(F.countDistinct("group_key").alias("group_overlap_count"), F.count("*").alias("leaking_images"))
    return counts.crossJoin(ids).crossJoin(examples)  # a row each


@query(
    """, off AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%'), known AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-06-01')
    SELECT row_index, CASE WHEN row_index IN (SELECT k FROM off) THEN 'official_duplicate' WHEN row_index * 3 IN (SELECT k FROM known) THEN 'id_overlap' WHEN lang IS NULL THEN 'missing_file'
      WHEN image_id IN (SELECT image_id FROM image WHERE split = 'train' AND source = 'ham') AND split = 'test' THEN 'internal_copy' ELSE 'kept' END AS status FROM image""",
    META,
)
def exclusion_cascade(spark, sf_dir):
    """Every row with the first reason that applies to it."""
    i = images(spark, sf_dir)
    off = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("k1"), F.lit(True).alias("off")).distinct()
    known = table(spark, sf_dir, "lineitem").where("l_shipdate > timestamp_ntz'1998-06-01'").select(F.col("l_partkey").alias("k2"), F.lit(True).alias("known")).distinct()
    own = i.where("split = 'train' and source = 'ham'").select(F.col("image_id").alias("k3"), F.lit(True).alias("own")).distinct()
    j = i.join(off, i.row_index == F.col("k1"), "left").join(known, i.row_index * 3 == F.col("k2"), "left").join(own, i.image_id == F.col("k3"), "left")
    status = R.first_reason(
        [
            ("official_duplicate", F.col("off").isNotNull()),
            ("id_overlap", F.col("known").isNotNull()),
            ("missing_file", F.col("lang").isNull()),
            ("internal_copy", F.col("own").isNotNull() & (F.col("split") == "test")),
        ]
    )
    return j.select("row_index", status.alias("status"))


@query(
    """SELECT l_orderkey AS key, CAST(arg_max(v, [t, o]) AS VARCHAR) AS value FROM (
      SELECT l_orderkey, l_shipmode_like AS v, 0 AS t, o FROM (SELECT l_orderkey, l_returnflag AS l_shipmode_like, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS o FROM lineitem WHERE l_linestatus = 'O')
      UNION ALL SELECT l_orderkey, l_linestatus || '2', 1, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1"""
)
def metadata_map(spark, sf_dir):
    """One value per key from two tables; the later table wins."""
    line = table(spark, sf_dir, "lineitem").withColumn("o", F.expr("l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey"))
    first = line.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("value"), "o")
    second = line.where("l_quantity > 45").select(F.col("l_orderkey").alias("key"), F.concat("l_linestatus", F.lit("2")).alias("value"), "o")
    return R.last_writer_wins([first, second], "key", "value", "o")


@query(
    """SELECT o.o_orderkey AS id, c.c_name AS name, n.n_name AS nation, coalesce(nullif(c.c_mktsegment, 'BUILDING'), n.n_name) AS resolved
    FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey"""
)
def metadata_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = R.checked_join(o, table(spark, sf_dir, "customer"), ["c_custkey"], "left", "many_to_one").withColumnRenamed("c_nationkey", "n_nationkey")
    j = R.checked_join(c, table(spark, sf_dir, "nation"), ["n_nationkey"], "left", "many_to_one")
    return j.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("nation"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), "n_name").alias("resolved"))


PAIRS = "pairs AS (SELECT a.p_partkey AS member_1, b.p_partkey AS member_2, a.p_name AS n1, b.p_name AS n2 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 25)"


def part_pairs(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return R.near_duplicate_pairs(p, "p_partkey", ["p_brand", "p_size"], F.abs(F.col("a.p_retailprice") - F.col("b.p_retailprice")), 25)


def part_links(spark, sf_dir) -> DataFrame:
    """What connects the parts that ``part_pairs`` pairs, without the pairs."""
    return R.near_duplicate_links(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_size"], "p_retailprice", 25)


@query(f"{PAIRS} SELECT member_1, member_2 FROM pairs", " ")
def near_duplicate_pairs(spark, sf_dir):
    return part_pairs(spark, sf_dir)


@query(
    f"""{PAIRS}, k AS (SELECT member_1, member_2, CAST(member_1 AS VARCHAR) AS a, CAST(member_2 AS VARCHAR) AS b FROM pairs),
    r AS (SELECT member_1, member_2, CASE WHEN (length(a), a) <= (length(b), b) THEN a ELSE b END AS retained, CASE WHEN (length(a), a) <= (length(b), b) THEN b ELSE a END AS removed FROM k)
    SELECT member_1, member_2, retained, removed FROM r""",
    " ",
)
def kept_derivatives(spark, sf_dir):
    return R.keep_shorter(part_pairs(spark, sf_dir))


@query(
    f"""RECURSIVE {PAIRS}, e AS (SELECT member_1 AS u, member_2 AS v FROM pairs UNION SELECT member_2, member_1 FROM pairs),
    r AS (SELECT u AS node, u AS root FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.root)
    SELECT node, min(root) AS root FROM r GROUP BY node""",
    " ",
)
def duplicate_components(spark, sf_dir):
    return connected_components(part_links(spark, sf_dir), "member_1", "member_2")


@query(
    f"""RECURSIVE {PAIRS}, e AS (SELECT member_1 AS u, member_2 AS v FROM pairs UNION SELECT member_2, member_1 FROM pairs),
    r AS (SELECT u AS node, u AS root FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.root),
    g AS (SELECT node, min(root) AS root FROM r GROUP BY node)
    SELECT p_partkey, CASE WHEN g.root IS NULL OR g.root = p_partkey THEN 'KEPT' ELSE 'EXCLUDED' END AS status FROM part LEFT JOIN g ON g.node = p_partkey""",
    " ",
)
def kept_of_components(spark, sf_dir):
    g = connected_components(part_links(spark, sf_dir), "member_1", "member_2")
    p = table(spark, sf_dir, "part").join(g, F.col("p_partkey") == F.col("node"), "left")
    return p.select("p_partkey", F.when(F.col("root").isNull() | (F.col("root") == F.col("p_partkey")), "KEPT").otherwise("EXCLUDED").alias("status"))


ORDER_SQL = "(row_index * 7919 + 104729 * {seed}) % 1000003"


@query(
    f""", pos AS (SELECT * FROM pred WHERE y = 1), clean AS (SELECT * FROM pred WHERE y = 0 AND patient_id NOT IN (SELECT patient_id FROM pos))
    SELECT row_index, y FROM pos UNION ALL (SELECT row_index, y FROM (SELECT row_index, y, row_number() OVER (ORDER BY {ORDER_SQL.format(seed=42)}, row_index) AS k FROM clean) WHERE k <= 3 * (SELECT count(*) FROM pos))""",
    V.PRED,
)
def powered_subset(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return R.select_subset(p, "y", "patient_id", R.modular_order(F.col("row_index"), 42)).select("row_index", "y")


@query(
    f""", s AS (SELECT row_index, truth, row_number() OVER (PARTITION BY truth ORDER BY {ORDER_SQL.format(seed=7)}, row_index) AS k FROM pred)
    SELECT row_index, truth FROM s WHERE k <= CAST(floor((SELECT count(*) FROM pred) * 0.1) AS INT)""",
    V.PRED,
)
def class_sample(spark, sf_dir):
    p = predictions(spark, sf_dir).select("row_index", "truth")
    return R.sample_per_class(p, "truth", R.modular_order(F.col("row_index"), 7), share=0.1)


@query(
    f"""SELECT row_index, truth, CAST((row_number() OVER (PARTITION BY truth ORDER BY {ORDER_SQL.format(seed=1)}, row_index) - 1) % 10 AS INT) AS fold FROM pred""",
    V.PRED + "\n",
)
def stratified_folds(spark, sf_dir):
    p = predictions(spark, sf_dir).select("row_index", "truth")
    return R.fold_of(p, "truth", R.modular_order(F.col("row_index"), 1), 10)


@query(
    """SELECT group_key, CAST(CASE WHEN k < 5 THEN k ELSE 9 - k END AS INT) AS fold FROM (
      SELECT group_key, (row_number() OVER (ORDER BY count(*) DESC, sum(y) DESC, md5('0|' || group_key), group_key) - 1) % 10 AS k FROM pred GROUP BY group_key)""",
    V.PRED + "\n",
)
def grouped_folds(spark, sf_dir):
    return R.group_folds(predictions(spark, sf_dir), "group_key", "y", 5)


def greedy_sql(folds: int) -> str:
    """The greedy rule as a recursion over the groups; the state has rows of class 0 and 1 per fold."""
    at = lambda k: f"list_transform(range(1, {folds + 1}), lambda i: s{k}[i] + CASE WHEN i = f THEN c{k} ELSE 0 END)"
    spread = lambda k: f"sqrt({folds} * list_sum(list_transform({at(k)}, lambda v: v * v)) - list_sum({at(k)}) ** 2) / t{k}"
    cost = f"list_sort(list_transform(range(1, {folds + 1}), lambda f: {{'cost': round(coalesce({spread(0)}, 0) + coalesce({spread(1)}, 0), 12), 'n': s0[f] + s1[f], 'f': f}}))[1].f"
    grown = lambda k: f"list_transform(range(1, {folds + 1}), lambda i: s{k}[i] + CASE WHEN i = fold THEN c{k} ELSE 0 END)"
    return f"""RECURSIVE {V.PRED}, g AS (SELECT group_key, count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM pred GROUP BY 1),
    o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY 2 * (c0 * c0 + c1 * c1) - (c0 + c1) * (c0 + c1) DESC, c0 DESC, c1 DESC, md5('0|' || group_key), group_key) AS k,
      nullif(sum(c0) OVER (), 0)::DOUBLE AS t0, nullif(sum(c1) OVER (), 0)::DOUBLE AS t1 FROM g),
    deal(k, group_key, fold, s0, s1) AS (
      SELECT CAST(0 AS BIGINT), NULL::VARCHAR, NULL::BIGINT, list_transform(range({folds}), lambda i: 0::BIGINT), list_transform(range({folds}), lambda i: 0::BIGINT)
      UNION ALL
      SELECT k, group_key, fold, {grown(0)}, {grown(1)} FROM (
        SELECT o.k, o.group_key, o.c0, o.c1, s0, s1, {cost} AS fold FROM deal JOIN o ON o.k = deal.k + 1))
    SELECT group_key, CAST(fold - 1 AS INT) AS fold FROM deal WHERE k > 0"""


@query(greedy_sql(5), " ")
def greedy_grouped_folds(spark, sf_dir):
    """Folds of whole groups by the greedy rule."""
    return R.greedy_group_folds(predictions(spark, sf_dir), "group_key", "y", 5)


@query(
    f"""SELECT row_index, truth, CASE WHEN row_number() OVER (PARTITION BY truth ORDER BY {ORDER_SQL.format(seed=3)}, row_index) % 5 = 1 THEN 'test' ELSE 'train' END AS split FROM pred""",
    V.PRED + "\n",
)
def train_test_split(spark, sf_dir):
    p = predictions(spark, sf_dir).select("row_index", "truth")
    f = R.fold_of(p, "truth", R.modular_order(F.col("row_index"), 3), 5)
    return f.select("row_index", "truth", F.when(F.col("fold") == 0, "test").otherwise("train").alias("split"))


@query(
    """SELECT t.source AS held_out, count(*) FILTER (p.source = t.source) AS n_test, count(*) FILTER (p.source <> t.source) AS n_train, count(*) FILTER (p.source = t.source AND y = 1) AS test_positives
    FROM pred p, (SELECT DISTINCT source FROM pred) t GROUP BY 1 HAVING count(*) FILTER (p.source = t.source AND y = 1) > 0""",
    V.PRED + "\n",
)
def leave_one_source_out(spark, sf_dir):
    p = predictions(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_test"), F.count_if(F.col("y") == 1).alias("test_positives"))
    total = F.broadcast(p.agg(F.sum("n_test").alias("n")))  # one row
    out = p.crossJoin(total).select(F.col("source").alias("held_out"), "n_test", (F.col("n") - F.col("n_test")).alias("n_train"), "test_positives")
    return out.where("test_positives > 0")


@query(
    """SELECT count(*) AS n, count(DISTINCT row_index) AS n_distinct, (count(*) = count(DISTINCT row_index) AND count(*) = (SELECT count(*) FROM embeddings)) AS complete FROM (
      SELECT row_index FROM pred WHERE fold = 0 UNION ALL SELECT row_index FROM pred WHERE fold = 1 UNION ALL SELECT row_index FROM pred WHERE fold = 2 UNION ALL SELECT row_index FROM pred WHERE fold = 3 UNION ALL SELECT row_index FROM pred WHERE fold = 4)""",
    V.PRED + "\n",
)
def out_of_fold_assembly(spark, sf_dir):
    p = predictions(spark, sf_dir).select("row_index", "fold")
    folds = reduce(DataFrame.unionByName, [p.where(F.col("fold") == k) for k in range(5)])
    want = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("want"))
    c = folds.agg(F.count("*").alias("n"), F.countDistinct("row_index").alias("n_distinct"))
    return c.crossJoin(want).select("n", "n_distinct", ((F.col("n") == F.col("n_distinct")) & (F.col("n") == F.col("want"))).alias("complete"))


@query(
    """SELECT l_suppkey AS feature_id, count(*) AS splits, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS rank, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share
    FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1 ORDER BY rank LIMIT 30"""
)
def split_importance(spark, sf_dir):
    """Branch counts per feature, ranked, with their share: the top 30 report."""
    n = table(spark, sf_dir, "lineitem").where("l_linestatus <> 'F'").groupBy(F.col("l_suppkey").alias("feature_id")).agg(F.count("*").alias("splits"))
    total = F.broadcast(n.agg(F.sum("splits").alias("all")))  # one row
    ranked = numbered(n, [F.col("splits").desc(), F.col("feature_id")], "rank")
    return rounded(ranked.crossJoin(total).select("feature_id", "splits", "rank", (F.col("splits") / F.col("all")).alias("share")).where("rank <= 30"))


@query(
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.975), 6) AS q975 FROM lineitem GROUP BY 1"""
)
def percentiles(spark, sf_dir):
    return rounded(quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", {"q25": 0.25, "median": 0.5, "q975": 0.975}, ["l_returnflag"]))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return R.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """SELECT 'l_discount' AS "column", count(*) FILTER (a.l_discount <> b.d) AS mismatches, round(max(abs(a.l_discount - b.d)), 6) AS max_abs_diff, count(*) AS rows, CAST(0 AS BIGINT) AS unmatched
    FROM (SELECT o_orderkey, o_totalprice AS l_discount FROM orders) a JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS d FROM orders) b USING (o_orderkey)"""
)
def table_parity(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("l_discount"))
    changed = o.withColumn("l_discount", F.when(F.col("o_orderkey") % 100 == 0, F.col("l_discount") + 1).otherwise(F.col("l_discount")))
    return rounded(A.parity(o, changed, ["o_orderkey"]))


@query(
    """SELECT * FROM (SELECT 'negative_quantity' AS "check", 'PASS' AS status, CAST(0 AS BIGINT) AS observed UNION ALL
    SELECT 'repeated_line', CASE WHEN count(*) - count(DISTINCT (l_orderkey, l_linenumber)) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem UNION ALL
    SELECT 'high_discount', CASE WHEN count(*) FILTER (l_discount > 0.09) = 0 THEN 'PASS' ELSE 'CAUTION' END, count(*) FILTER (l_discount > 0.09) FROM lineitem)"""
)
def audit_checks(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return A.check_rows(
        line,
        {
            "negative_quantity": F.count_if(F.col("l_quantity") < 0),
            "repeated_line": F.count("*") - F.countDistinct("l_orderkey", "l_linenumber"),
            "high_discount": F.count_if(F.col("l_discount") > 0.09),
        },
        caution=["high_discount"],
    )


@query(
    """, r AS (SELECT source, round(avg(p_mel), 6) AS v FROM pred GROUP BY source), c AS (SELECT source, avg(p_mel) AS v FROM pred GROUP BY source)
    SELECT source, round(r.v, 6) AS recorded, round(c.v, 6) AS computed, abs(r.v - c.v) <= 1e-6 AS within, CASE WHEN abs(c.v - 0.33) <= 0.1 THEN 'ok' ELSE 'failed_sanity_gate' END AS status FROM r JOIN c USING (source)""",
    V.PRED,
)
def recorded_values(spark, sf_dir):
    c = predictions(spark, sf_dir).groupBy("source").agg(F.avg("p_mel").alias("v"))
    out = A.recorded_against_recomputed(c.withColumn("v", F.round("v", 6)), c, ["source"], "v", 1e-6)
    return rounded(A.sanity_gate(out, "computed", 0.33, 0.1))


@query(
    """SELECT 'only_left' AS part, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'both', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'either', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'all', (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer WHERE c_acctbal > 0)"""
)
def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    parts = {"only_left": a.exceptAll(b).distinct().join(b, "k", "left_anti"), "both": a.intersect(b), "either": a.union(b).distinct(), "all": a.union(b)}
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, d in parts.items()])


@query(
    """, want AS (SELECT unnest([42, 7, 99, 3]) AS row_index, unnest([0, 1, 2, 3]) AS place) SELECT CAST(want.place AS INT) AS place, pred.row_index, truth FROM pred JOIN want USING (row_index)""",
    V.PRED,
)
def ordered_subset(spark, sf_dir):
    return R.ordered_subset(predictions(spark, sf_dir).select("row_index", "truth"), "row_index", [42, 7, 99, 3]).select("place", "row_index", "truth")


LATTICE = """sc AS (SELECT m AS mask, y, s_a + CASE WHEN m & 1 > 0 THEN p_nevus ELSE 0 END + CASE WHEN m & 2 > 0 THEN p_atyp / 2 ELSE 0 END + CASE WHEN m & 4 > 0 THEN coverage ELSE 0 END + CASE WHEN m & 8 > 0 THEN s_b ELSE 0 END AS s
  FROM pred, (SELECT CAST(unnest(range(16)) AS INT) AS m)),
pv AS (SELECT mask, y, (sum(1 - y) OVER (PARTITION BY mask ORDER BY s) - sum(1 - y) OVER (PARTITION BY mask, s) / 2.0::DOUBLE) / sum(1 - y) OVER (PARTITION BY mask) AS v FROM sc),
auc AS (SELECT mask, avg(v) FILTER (y = 1) AS auc FROM pv GROUP BY mask)"""


def lattice(spark, sf_dir) -> DataFrame:
    p = predictions(spark, sf_dir)
    return E.auc_by_condition(p, F.col("s_a"), [F.col("p_nevus"), F.col("p_atyp") / 2, F.col("coverage"), F.col("s_b")], "y")


@query(
    f""", {LATTICE}, d AS (SELECT b.block, a.mask, c.mask AS other, c.auc - a.auc AS d FROM (SELECT CAST(unnest(range(4)) AS INT) AS block) b, auc a JOIN auc c ON true WHERE a.mask & (1 << b.block) = 0 AND c.mask = a.mask + (1 << b.block))
    SELECT block, 'add_one' AS effect_type, round(d, 6) AS delta FROM d WHERE mask = 0 UNION ALL SELECT block, 'leave_one_out', round(d, 6) FROM d WHERE other = 15
    UNION ALL SELECT block, 'main_effect_factorial', round(avg(d), 6) FROM d GROUP BY block""",
    V.PRED,
)
def factorial_effects(spark, sf_dir):
    return rounded(E.main_effects(lattice(spark, sf_dir)))


@query(
    f""", {LATTICE}, p AS (SELECT CAST(i AS INT) AS b1, CAST(j AS INT) AS b2 FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j) WHERE i < j),
    d AS (SELECT b1, b2, a.mask, d12.auc - d1.auc - d2.auc + a.auc AS d FROM p, auc a, auc d1, auc d2, auc d12 WHERE a.mask & (1 << b1) = 0 AND a.mask & (1 << b2) = 0
      AND d1.mask = a.mask + (1 << b1) AND d2.mask = a.mask + (1 << b2) AND d12.mask = a.mask + (1 << b1) + (1 << b2))
    SELECT b1, b2, round(avg(d), 6) AS delta FROM d GROUP BY ALL""",
    V.PRED,
)
def pair_interactions(spark, sf_dir):
    return rounded(E.pair_interactions(lattice(spark, sf_dir)))


@query(
    """SELECT CAST(m AS INT) AS mask, d AS deep, CASE WHEN m & 1 > 0 THEN 'A' ELSE '' END || CASE WHEN m & 2 > 0 THEN 'B' ELSE '' END || CASE WHEN m & 4 > 0 THEN 'C' ELSE '' END || CASE WHEN m & 8 > 0 THEN 'D' ELSE '' END || CASE WHEN d THEN '+deep' ELSE '' END AS label
    FROM (SELECT unnest(range(16)) AS m), (SELECT unnest([true, false]) AS d) WHERE d OR m > 0"""
)
def factorial_conditions(spark, sf_dir):
    return E.conditions(spark)


#: Resamples of the predictions in SQL: every row with its weight in each replicate.
REPLICATES = 200
BOOT = f""", drawn AS (SELECT pred.*, rep, CAST('0x' || substr(md5('42|' || rep || '|' || row_index), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM pred, (SELECT unnest(range({REPLICATES})) AS rep)),
boot AS (SELECT *, {" + ".join(f"(u >= {x!r}::DOUBLE)::INT" for x in E.POISSON)} AS w FROM drawn WHERE u >= {E.POISSON[0]!r}::DOUBLE)"""
SUMMARY = """count(*) AS replicates, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.025), 6) AS ci_low,
    round(quantile_cont(value, 0.975), 6) AS ci_high, count(*) FILTER (value IS NULL) AS n_undefined"""


def auc_sql(score: str, positive: str = "y = 1", by: str = "rep") -> str:
    """Weighted AUC per replicate."""
    cells = f"SELECT {by}, {score} AS s, sum(CASE WHEN {positive} THEN w ELSE 0 END) AS pos, sum(CASE WHEN {positive} THEN 0 ELSE w END) AS neg FROM boot GROUP BY ALL"
    ranked = f"SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY s) - neg / 2.0::DOUBLE AS below FROM ({cells})"
    return f"SELECT {by}, sum(pos * below) / nullif(sum(pos) * sum(neg), 0)::DOUBLE AS value, sum(pos) AS n_pos FROM ({ranked}) GROUP BY {by}"


@query(f"{BOOT} SELECT {SUMMARY} FROM ({auc_sql('s_a')})", V.PRED)
def bootstrap_auc(spark, sf_dir):
    """Bootstrap interval of an AUC."""
    return rounded(E.bootstrap_auc(predictions(spark, sf_dir), "row_index", "y", "s_a", replicates=REPLICATES))


@query(f"{BOOT} SELECT {SUMMARY} FROM (SELECT b.value - a.value AS value FROM ({auc_sql('s_a')}) a JOIN ({auc_sql('s_b')}) b USING (rep))", V.PRED)
def bootstrap_delta(spark, sf_dir):
    """Paired bootstrap interval of a difference of AUCs."""
    return rounded(E.bootstrap_auc(predictions(spark, sf_dir), "row_index", "y", "s_a", "s_b", replicates=REPLICATES))


def ap_sql(score: str) -> str:
    cells = f"SELECT rep, {score} AS s, sum(w * y) AS pos, sum(w) AS every FROM boot GROUP BY ALL"
    ranked = f"SELECT *, sum(pos) OVER (PARTITION BY rep ORDER BY s DESC) AS tp, sum(every) OVER (PARTITION BY rep ORDER BY s DESC) AS called FROM ({cells})"
    return f"SELECT rep, sum(pos * tp / called::DOUBLE) / nullif(sum(pos), 0)::DOUBLE AS value FROM ({ranked}) GROUP BY rep"


@query(f"{BOOT} SELECT {SUMMARY} FROM (SELECT b.value - a.value AS value FROM ({ap_sql('s_a')}) a JOIN ({ap_sql('s_b')}) b USING (rep))", V.PRED)
def bootstrap_ap(spark, sf_dir):
    """Paired bootstrap interval of a difference of average precisions."""
    return rounded(E.bootstrap_ap_delta(predictions(spark, sf_dir), "row_index", "y", "s_a", "s_b", replicates=REPLICATES))


OVR = " UNION ALL ".join(f"SELECT {i} AS class, * FROM ({auc_sql(c, f'truth = {i}')})" for i, c in enumerate(("p_nevus", "p_mel", "p_atyp")))
F1 = [f"coalesce(2 * tp{i} / nullif(t{i} + p{i}, 0)::DOUBLE, 0)" for i in range(3)]


SEVEN = f""", wide AS (SELECT rep, sum(w)::DOUBLE AS n, sum(w * -ln(greatest([p_nevus, p_mel, p_atyp][truth + 1], 2.220446049250313e-16::DOUBLE))) / sum(w) AS log_loss,
      sum(w * ((p_nevus - (truth = 0)::INT) ** 2 + (p_mel - (truth = 1)::INT) ** 2 + (p_atyp - (truth = 2)::INT) ** 2)) / sum(w) AS brier,
      {", ".join(f"sum(w * (truth = {i})::INT)::DOUBLE AS t{i}, sum(w * (pred = {i})::INT)::DOUBLE AS p{i}, sum(w * (truth = {i} AND pred = {i})::INT)::DOUBLE AS tp{i}" for i in range(3))} FROM boot GROUP BY rep),
    ovr AS (SELECT rep, avg(value) AS macro, sum(value * n_pos) / sum(n_pos) AS weighted FROM ({OVR}) GROUP BY rep),
    v AS (SELECT rep, ({" + ".join(f"tp{i} / nullif(t{i}, 0)" for i in range(3))}) / 3 AS balanced_accuracy, ({" + ".join(F1)}) / 3 AS macro_f1, ({" + ".join(f"{x} * t{i}" for i, x in enumerate(F1))}) / n AS weighted_f1,
      macro AS macro_auc_ovr, weighted AS weighted_auc_ovr, log_loss, brier FROM wide JOIN ovr USING (rep))
    SELECT metric, {SUMMARY} FROM v UNPIVOT (value FOR metric IN (balanced_accuracy, macro_f1, weighted_f1, macro_auc_ovr, weighted_auc_ovr, log_loss, brier)) GROUP BY metric"""


@query(BOOT + SEVEN, V.PRED)
def bootstrap_multiclass(spark, sf_dir):
    """Bootstrap intervals of seven metrics."""
    p = predictions(spark, sf_dir)
    return rounded(E.bootstrap_multiclass(p, "row_index", "truth", "pred", ["p_nevus", "p_mel", "p_atyp"], replicates=REPLICATES))


def stirred_sql(x: str, source: str, name: str) -> str:
    """Steps of ``effects.stirred`` as common table expressions; the last is ``name`` and has the number as ``h``."""
    once = f"(xor(x, x >> 16) * {E.MULTIPLIER}) & {E.MASK}"
    return (
        f"{name}_0 AS (SELECT c, k, n, rep, ({x}) & {E.MASK} AS x FROM {source}), {name}_1 AS (SELECT * EXCLUDE x, {once} AS x FROM {name}_0), "
        f"{name}_2 AS (SELECT * EXCLUDE x, {once} AS x FROM {name}_1), {name} AS (SELECT * EXCLUDE x, xor(x, x >> 16) AS h FROM {name}_2)"
    )


def stratified_sql(stratum: str) -> str:
    """Draws with replacement within each class, as rows ``boot`` of weight 1."""
    first = stirred_sql(f"k + {E.STEPS[0]} * (rep + 1)", "asked", "d1")
    second = stirred_sql(f"h + {E.STEPS[1]} * (c + 1) + 42", "d1", "d2")
    return f""", placed AS (SELECT pred.*, row_number() OVER (PARTITION BY {stratum} ORDER BY row_index) - 1 AS k, count(*) OVER (PARTITION BY {stratum}) AS n FROM pred),
    asked AS (SELECT CAST({stratum} AS BIGINT) AS c, k, n, CAST(rep AS BIGINT) AS rep FROM placed, (SELECT unnest(range({REPLICATES})) AS rep)),
    {first}, {second},
    boot AS (SELECT placed.*, d2.rep, 1 AS w FROM d2 JOIN placed ON placed.{stratum} = d2.c AND placed.k = (d2.h * d2.n) >> 32)"""


@query(stratified_sql("truth") + SEVEN, V.PRED)
def stratified_multiclass(spark, sf_dir):
    """Intervals of seven metrics from draws within each class."""
    p = predictions(spark, sf_dir)
    return rounded(E.bootstrap_multiclass(p, "row_index", "truth", "pred", ["p_nevus", "p_mel", "p_atyp"], replicates=REPLICATES, stratify=True))


@query(f"{stratified_sql('y')} SELECT {SUMMARY} FROM (SELECT b.value - a.value AS value FROM ({auc_sql('s_a')}) a JOIN ({auc_sql('s_b')}) b USING (rep))", V.PRED)
def stratified_delta(spark, sf_dir):
    """Paired interval of a difference of AUCs from draws within each class, the same for both scores."""
    return rounded(E.bootstrap_auc(predictions(spark, sf_dir), "row_index", "y", "s_a", "s_b", replicates=REPLICATES, stratify=True))


@query(f"{stratified_sql('y')} SELECT {SUMMARY} FROM (SELECT b.value - a.value AS value FROM ({ap_sql('s_a')}) a JOIN ({ap_sql('s_b')}) b USING (rep))", V.PRED)
def stratified_ap(spark, sf_dir):
    """Paired interval of a difference of average precisions from draws within each class."""
    return rounded(E.bootstrap_ap_delta(predictions(spark, sf_dir), "row_index", "y", "s_a", "s_b", replicates=REPLICATES, stratify=True))


@query(
    f"""{BOOT}, cells AS (SELECT rep, s_a AS s, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM boot GROUP BY ALL),
    ranked AS (SELECT *, sum(pos) OVER o AS pos_le, sum(neg) OVER o AS neg_le, sum(pos) OVER (PARTITION BY rep) AS n_pos, sum(neg) OVER (PARTITION BY rep) AS n_neg FROM cells WINDOW o AS (PARTITION BY rep ORDER BY s)),
    j AS (SELECT rep, s, round((n_pos - pos_le + pos) / nullif(n_pos, 0)::DOUBLE + (neg_le - neg) / nullif(n_neg, 0)::DOUBLE - 1, 12) AS j FROM ranked),
    best AS (SELECT rep, CASE WHEN j IS NOT NULL THEN s END AS threshold FROM j QUALIFY row_number() OVER (PARTITION BY rep ORDER BY j DESC NULLS LAST, s) = 1),
    v AS (SELECT threshold, (SELECT count(*) FILTER (y = 1 AND s_a >= threshold) / count(*) FILTER (y = 1)::DOUBLE FROM pred) AS sens, (SELECT count(*) FILTER (y = 0 AND s_a < threshold) / count(*) FILTER (y = 0)::DOUBLE FROM pred) AS spec FROM best)
    SELECT metric, {SUMMARY} FROM v UNPIVOT (value FOR metric IN (threshold, sens, spec)) GROUP BY metric""",
    V.PRED,
)
def bootstrap_youden(spark, sf_dir):
    """Bootstrap intervals of a refitted threshold and of its rates on the whole sample."""
    return rounded(E.bootstrap_youden(predictions(spark, sf_dir), "row_index", "y", "s_a", replicates=REPLICATES))


@query(
    """, f AS (SELECT row_index, source, y, s_a, s_b FROM pred),
    v AS (SELECT source, y, """
    + ", ".join(
        f"(sum(1 - y) OVER (PARTITION BY source ORDER BY {k}) - sum(1 - y) OVER (PARTITION BY source, {k}) / 2.0::DOUBLE) / sum(1 - y) OVER (PARTITION BY source) AS p_{k}, "
        f"1 - (sum(y) OVER (PARTITION BY source ORDER BY {k}) - sum(y) OVER (PARTITION BY source, {k}) / 2.0::DOUBLE) / sum(y) OVER (PARTITION BY source) AS n_{k}"
        for k in ("s_a", "s_b")
    )
    + """ FROM f),
    d AS (SELECT source, avg(p_s_b - p_s_a) FILTER (y = 1) AS delta, var_samp(p_s_b - p_s_a) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(n_s_b - n_s_a) FILTER (y = 0) / count(*) FILTER (y = 0) AS var FROM v GROUP BY source),
    z AS (SELECT source, delta, delta / sqrt(var) AS z, abs(delta) / sqrt(2 * var) AS x FROM d)
    SELECT source, round(delta, 6) AS delta, round(z, 6) AS z, round(1 - CASE WHEN x > 0 THEN exp(-x * x) * list_sum(list_transform(range(0, 300), lambda n: exp((2 * n + 1) * ln(x) - lgamma(n + 1.5)))) ELSE 0 END, 6) AS p FROM z""",
    V.PRED,
)
def paired_delong_p(spark, sf_dir):
    """The p-value of the paired test; SQL sums the series of the error function."""
    d = paired_delong(predictions(spark, sf_dir), "s_a", "s_b", "y", ["source"])
    return rounded(d.select("source", "delta", "z", E.normal_p("z").alias("p")))


@query(
    """, n AS (SELECT source, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (b AND NOT a) AS c FROM (
      SELECT source, (s_a >= 0.5) = (y = 1) AS a, (s_b >= 0.5) = (y = 1) AS b FROM pred) GROUP BY source)
    SELECT source, b, c, round(least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))), 6) AS p FROM n""",
    V.PRED,
)
def mcnemar_exact(spark, sf_dir):
    a, b = (((F.col(s) >= 0.5) == (F.col("y") == 1)) for s in ("s_a", "s_b"))
    n = predictions(spark, sf_dir).groupBy("source").agg(F.count_if(a & ~b).alias("b"), F.count_if(b & ~a).alias("c"))
    return rounded(n.withColumn("p", E.mcnemar_p("b", "c")))
