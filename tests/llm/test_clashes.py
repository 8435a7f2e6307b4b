"""Columns of any name beside those that are read change nothing."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortal.llm import fingerprint, html, jaccard, licenses, mixing, packing, quality, secrets, toxicity, urls
from tests.llm.helpers import documents

NAMES = (
    "key digest sig bands node root members bucket chunk a b other own_key own_hash row_hash maybe stays times row kept score predicted "
    "fingerprint canon lead packed part head c q m s ids short rule verdict host path site_host site_low token shard size cell_size "
    "quota start blocks target taken copies copy piece n n_tokens batch slot rank offset live_spans hash widely text_hash held_out toxic fired"
).split()
ROWS = [(k, f"some words of document {k} that go on and on to make ten or more, token = 1c383cd30b7c298ab50293adfecb7b18bb{k % 2}") for k in range(12)] + [(12, None), (3, "x"), (None, "")]


def wide(df):
    return df.select("*", *[F.lit("z").alias(n) for n in NAMES if n not in df.columns])


def same(a, b):
    rows = lambda df: sorted(map(str, (r.asDict() for r in df.collect())))
    assert a.columns == b.columns and rows(a) == rows(b)


@pytest.mark.parametrize(
    "operator",
    [quality.line_quality, licenses.scan_licenses, packing.pack_documents, jaccard.jaccard_links, secrets.secret_scan, mixing.mix_documents,
     fingerprint.edited_fingerprints, fingerprint.fingerprint_groups],
)
def test_document_operators(spark, operator):
    docs = documents(spark, ROWS)
    same(operator(wide(docs)), operator(docs))


def test_page_operators(spark):
    pages = spark.createDataFrame([(1, "http://net/en/", "<p>a"), (None, None, None)], "page_id long, url string, html string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    same(html.extract(wide(pages)), html.extract(pages))
    same(urls.filter_urls(wide(pages), rules, keep=("page_id",)), urls.filter_urls(pages, rules, keep=("page_id",)))


def test_toxicity_and_stages(spark, tmp_path):
    docs = documents(spark, ROWS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int")
    same(toxicity.toxicity(wide(docs), wide(labels)), toxicity.toxicity(docs, labels))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, plain = wide(docs), docs
    for name, stage in corpus_pipeline.STAGES:
        now, plain = stage(spark, now, str(tmp_path)), stage(spark, plain, str(tmp_path))
        if name != "packing":
            assert now.columns == wide(docs).columns
        same(now.select(*plain.columns), plain)


def test_empty_documents_through_all_stages(spark, tmp_path):
    now = documents(spark, ROWS).limit(0)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.count() == 0
