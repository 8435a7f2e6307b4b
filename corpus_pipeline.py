"""The corpus pipeline: toxicity, near duplicates, secrets, source mix, packing.

Each stage takes what the one before kept, and all but the last return the columns of
``documents``, whatever further columns there are and whatever their names. Null ids, texts and
sources are allowed, an empty table passes through. It belongs to ``cohortal.llm`` and goes
with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.llm.jaccard import drop_near_duplicates
from cohortal.llm.mixing import mix_documents
from cohortal.llm.packing import pack_documents
from cohortal.llm.secrets import redact_secrets
from cohortal.llm.text import packed, unpacked
from cohortal.llm.toxicity import fit_toxicity, score_toxicity
from cohortal.session import materialize, table

#: No SQL: the label model, the MinHash join and the packing are tested against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    Null and empty texts are not toxic. Repeated rows share their verdict. Without labels of both
    kinds, lexicons and patterns decide.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(packed(docs, text=F.col("text")), model, keep=["row"])
    return unpacked(scored.where("predicted = 0"), docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that links of 0.8 or more connect: that of the least id.

    Rows without a word stay, as do rows whose ids are null or repeat, if their texts differ.
    Repeated rows (equal id and text) stay once.
    """
    return drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, credentials replaced by markers where they are not widely copied.

    Null and empty texts and repeated rows pass as they are; ``n_chars`` follows the text.
    """
    return redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times.

    A document goes only if its source exceeds its target share: blocks are chosen in a seeded
    order, ties by hash. Texts without a word take part in no mix and go. Null sources are a
    source; of repeated rows each is its own.
    """
    rows = packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), text=F.col("text"))
    mixed = mix_documents(rows, keep=("row",)).where("copies > 0")
    return unpacked(mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences with their length bucket, batch and slot; a document without words has one of bucket 0."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard_join", keep_one_of_each),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is computed once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
