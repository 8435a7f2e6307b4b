"""Words, texts and digests as all corpus operators define them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
#: The same six separators as plain characters.
BLANKS = " \t\n\x0b\x0c\r"


def n_words(text: str | Column) -> Column:
    """Number of words of a text column (null: 0), as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows in an Arrow batch of texts: some MB at usual lengths, and still bounded for very long ones.
BATCH_ROWS = 2_000
#: Words that a task counts before it hands them out.
MAX_MEMO = 100_000
#: Words whose hashes or features a task remembers; beyond that it starts anew. Few words are frequent, so that more would only fill memory.
MAX_KNOWN = 20_000
#: Rows in such a batch where an executor's memory is short of other things.
FEW_ROWS = 500


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Send texts to Python in batches of at most ``rows`` rows for the rest of the session.

    A worker holds a batch several times over (Arrow, strings, results), and Spark's default of
    10,000 rows is meant for narrow rows.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns as one struct ``row``, with ``more`` beside it: no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``packed`` rows again, some of them changed."""
    return rows.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in columns])
