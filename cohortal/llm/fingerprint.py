"""Canonical exact digests of documents."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.llm.bitfilter import bit_array, has_bit
from cohortal.llm.text import small_batches
from cohortal.session import materialize


def canonical(text: str | None) -> str:
    """NFKC, case folded, NFKC again (folding can undo it), white space runs to one space, trimmed."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return " ".join(text.split())


def digest(text: str | None) -> str:
    """128-bit xxhash of the canonical text, in hex."""
    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))


def likeness(a: str, b: str) -> float:
    """Exact digests are alike or not: 1 or 0."""
    return 1.0 if a == b else 0.0


def collisions(docs: DataFrame, shared: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows whose canonical bytes are not the least of their digest.

    ``shared`` has the ``fingerprint`` of digests that occur more than once. Only rows that pass a
    fixed-size bit filter of these are compared: the least and the greatest canonical text of
    each digest, by an aggregate that keeps two texts per digest and task before its shuffle. Where
    the two are equal so are all bytes; where not, the digest's rows are read again and told
    apart. Returns ``doc_id, fingerprint, told`` (the digest with a SHA-256 suffix); as a rule it is empty.
    """
    # The first 24 bits of a digest are its place in the filter.
    bits = bit_array(shared.select(F.conv(F.substring("fingerprint", 1, 6), 16, 10).cast("long").alias("slot")), 1 << 24)

    @F.pandas_udf("fingerprint string, canon string")
    def compared(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            d = digest(t)
            rows.append((d, canonical(t)) if has_bit(bits, int(d[:6], 16)) else (None, None))
        return pd.DataFrame(rows, columns=["fingerprint", "canon"], dtype=object)

    rows = docs.select(F.col(id).alias("doc_id"), compared(F.col(text)).alias("c")).select("doc_id", "c.*")
    rows = rows.where("fingerprint is not null")
    ends = rows.groupBy("fingerprint").agg(F.min("canon").alias("lead"), F.max("canon").alias("last"))
    odd = materialize(ends.where("lead != last").drop("last"))
    if odd.isEmpty():
        return rows.sparkSession.createDataFrame([], f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint string, told string")
    differ = rows.join(odd, "fingerprint").where("canon != lead")
    return differ.select("doc_id", "fingerprint", F.concat_ws("-", "fingerprint", F.sha2("canon", 256)).alias("told"))


def fingerprint_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Group documents of equal canonical text.

    Returns one row per input row: ``doc_id``, ``fingerprint``, ``group_id`` (the least id of
    the group) and ``group_size``. Rows meet by their 128-bit digest; within equal digests the
    canonical bytes are compared (see ``collisions``), and texts other than the least get a
    fingerprint of their own. A group's size and least id come from an
    aggregate that combines before its shuffle.

    Null and empty texts are equal to each other. Null ids stay, and are a group's id only if
    the group has no other. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    hashed = F.pandas_udf(lambda s: s.map(digest, na_action=None), "string")
    found = materialize(docs.select(F.col(id).alias("doc_id"), hashed(F.col(text)).alias("fingerprint")))
    found = _resolve(docs, found, id, text)
    groups = found.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    return found.join(groups, "fingerprint").select("doc_id", "fingerprint", "group_id", "group_size")


def _resolve(docs: DataFrame, found: DataFrame, id: str, text: str) -> DataFrame:
    """``found`` with the fingerprints of colliding rows replaced."""
    shared = materialize(found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    odd = materialize(collisions(docs, shared, id, text))
    if odd.isEmpty():
        return found
    told = odd.groupBy("doc_id", "fingerprint").agg(F.min("told").alias("told"))
    on = found["doc_id"].eqNullSafe(told["doc_id"]) & (found["fingerprint"] == told["fingerprint"])
    kept = [found[c] for c in found.columns if c != "fingerprint"]
    return found.join(told, on, "left").select(*kept, F.coalesce(told["told"], found["fingerprint"]).alias("fingerprint"))


def edited_fingerprints(
    docs: DataFrame, id: str = "doc_id", text: str = "text", partitions: int | None = None
) -> DataFrame:
    """Fingerprints of every text, and of a copy of it that a third of the next document overwrites.

    Documents are ordered by descending id; the last third of a text (rounded down) is
    replaced by as many code points (or all) of the start of the next text, after the last
    document those of the first. Rows are dealt by ranges of id and text hash and sorted, so that the next
    document is the next row of the task; each task also hands out its first and its last
    text, and these, two rows a task, meet in a second small step.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. Null texts are empty texts. Null ids come last; rows of equal id follow each
    other in an order that their texts decide. One document alone is its own next. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.col("doc_id").desc_nulls_last()
    packed = F.pandas_udf(lambda s: s.map(lambda t: zstandard.compress(t.encode("utf-8", "surrogatepass"), 3)), "binary")
    own = own.select("doc_id", packed("text").alias("packed"))  # a third of the text, half of Spark's own compression
    # Rows of one id are dealt by a hash of their texts: one id for many rows is no single task.
    own = own.withColumn("order", F.xxhash64("packed"))
    dealt = own.repartitionByRange(n, key, "order").sortWithinPartitions(key, "order", "packed").drop("order")
    kind = dict(own.dtypes)["doc_id"]
    fields = (
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "next_fingerprint string, part int, is_last boolean, text string, head string"
    )
    names = [x.split()[0] for x in fields.split(", ")]

    def judged(doc_id, text: str, mine: str, after: str, theirs: str) -> tuple:
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), sha, mine, digest(edited) if k else mine, theirs

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = head = schema = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

        for batch in batches:
            if schema is None:
                types = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 4, pa.int32(), pa.bool_()]
                schema = pa.schema(list(zip(names, [*types, pa.string(), pa.string()], strict=True)))
            rows = []
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = zstandard.decompress(packed).decode("utf-8", "surrogatepass")
                mine = digest(text)
                if before is None:
                    head = text
                else:
                    rows.append((*judged(*before, text, mine), part, False, None, None))
                before = (doc_id, text, mine)
            yield out(rows)
        if before is not None:
            yield out([(before[0], len(before[1]), None, before[2], None, None, part, True, before[1], head)])

    found = materialize(dealt.mapInArrow(walk, fields))
    # One row a task: its last document, with the text that its first document starts with.
    ends = found.where("is_last")
    firsts = ends.select(F.col("part").alias("next_part"), F.col("head").alias("after"))
    order = sorted(x[0] for x in ends.select("part").collect())
    follows = spark.createDataFrame(
        [(a, b) for a, b in zip(order, [*order[1:], *order[:1]], strict=True)], "part int, next_part int"
    )

    @F.pandas_udf("edited_sha256 string, edited_fingerprint string, next_fingerprint string")
    def close(text: pd.Series, mine: pd.Series, after: pd.Series) -> pd.DataFrame:
        rows = [judged(None, t, m, a, digest(a)) for t, m, a in zip(text, mine, after, strict=True)]
        return pd.DataFrame(
            [(x[2], x[4], x[5]) for x in rows], columns=["edited_sha256", "edited_fingerprint", "next_fingerprint"]
        )

    closed = (
        ends.join(follows, "part")
        .join(firsts, "next_part")
        .select("doc_id", "n_chars", "fingerprint", close("text", "fingerprint", "after").alias("c"))
        .select("doc_id", "n_chars", "fingerprint", "c.*")
    )
    all_rows = found.where("not is_last").select(*closed.columns).unionByName(closed)
    all_rows = _resolve(docs, all_rows, id, text)
    alike = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return all_rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        alike("edited_fingerprint").alias("near_edited"),
        alike("next_fingerprint").alias("near_next"),
    )
