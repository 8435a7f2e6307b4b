"""Spelling variants: words one edit apart, found by rolling-hash deletion keys that are dealt by radix and sorted."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.llm.text import MAX_MEMO, small_batches
from cohortal.session import materialize, shuffle_partitions

#: Maximal runs of A-Z, a-z and U+00C0 to U+00FF in lower-cased UTF-8, where the latter begin with C3.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: Base of the polynomial hashes (odd, modulo 2 ** 64) and the multipliers that mix a key's bits.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bytes of a text whose runs may be listed at once.
LONG_TEXT = 4 << 20
#: Keys in a radix bucket, on average.
BUCKET_ROWS = 1 << 15


def edited_run(run: bytes, at: int) -> bytes:
    """The run without its code point ``at``."""
    text = run.decode()
    return (text[:at] + text[at + 1 :]).encode()


def runs_of(text: bytes) -> Iterable[bytes]:
    """All runs of a text; those of a very long one are never in memory together."""
    return RUN.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in RUN.finditer(text))


def run_counts(docs: DataFrame, text: str, id: str, every: int = 199) -> DataFrame:
    """``word, n``: occurrences of lower-cased runs per task and batch, some with a code point deleted.

    A run whose crc32 with its document's id is divisible by ``every`` loses the code point at that
    remainder of its length (null ids: of ''). Runs of fewer than six bytes are left out, as no
    word comes of them. Counts leave a task whenever it holds ``MAX_MEMO`` words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode() for w in total], "n": list(total.values())})

        total: Counter = Counter()
        for b in batches:
            for key, t in zip(b["key"], b["text"], strict=True):
                start = zlib.crc32(f"{key}:".encode())
                for w, n in Counter(runs_of(t.encode().lower())).items():
                    h = zlib.crc32(w, start)
                    if h % every == 0:
                        w = edited_run(w, h % len(w.decode()))
                    if len(w) >= 6:
                        total[w] += n
                if len(total) > MAX_MEMO:
                    yield told()
                    total.clear()
        if total:  # an empty frame has no kinds of columns
            yield told()

    key = F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("key")
    return docs.where(F.col(f"`{text}`").isNotNull()).select(key, F.col(f"`{text}`").alias("text")).mapInPandas(run, "word string, n long")


def mixed(key: np.ndarray) -> np.ndarray:
    """Keys with all bits stirred, so that their leading bits deal them evenly."""
    for shift, by in zip((30, 27), MIX, strict=True):
        key = (key ^ (key >> np.uint64(shift))) * by
    return key ^ (key >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words of one length, as they are (column 0) and without each code point (columns 1 on); and which to count.

    A deletion joins the polynomial hash of the prefix before it to that of the suffix after it;
    all words go through at once. Of equal neighbouring code points only the first counts as
    deleted, as the others leave the same string.
    """
    length = len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.uint64)
    powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(length, BASE)])
    prefix = np.zeros((len(words), length + 1), np.uint64)
    suffix = np.zeros((len(words), length + 1), np.uint64)
    for k in range(length):
        prefix[:, k + 1] = prefix[:, k] * BASE + codes[:, k]
    for k in range(length - 1, -1, -1):
        suffix[:, k] = codes[:, k] * powers[length - 1 - k : length - k] + suffix[:, k + 1]
    out = np.empty((len(words), length + 1), np.uint64)
    out[:, 0] = prefix[:, length]
    out[:, 1:] = prefix[:, :length] * powers[:length][::-1] + suffix[:, 1:]
    first = np.ones((len(words), length + 1), bool)
    first[:, 2:] = codes[:, 1:] != codes[:, :-1]
    return mixed(out + np.r_[np.uint64(length), np.full(length, length - 1, np.uint64)] * MIX[:1]), first


def keyed(words: DataFrame, bits: int, by_name: bool = False) -> DataFrame:
    """``part, key, at, first, word, n``: a row for the whole word (``at`` -1) and one per deleted position.

    ``by_name`` puts a digest in place of the word.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for length, own in b.groupby(b["word"].str.len(), sort=True):
                # A portion has about a million keys, or one word.
                step = max(1, 1_000_000 // (length + 1))
                for lo in range(0, len(own), step):
                    some = own.iloc[lo : lo + step]
                    keys, first = deletion_keys(list(some["word"]))
                    flat, words = keys.ravel(), some["digest" if by_name else "word"].to_numpy(object)
                    yield pd.DataFrame({
                        "part": (flat >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(flat), np.int32),
                        "key": flat.view(np.int64), "at": np.tile(np.arange(-1, length, dtype=np.int32), len(some)), "first": first.ravel(),
                        "word": np.repeat(words, length + 1), "n": np.repeat(some["n"].to_numpy(), length + 1),
                    })

    return words.mapInPandas(run, "part int, key long, at int, first boolean, word string, n long")


def near_in_bucket(b: pd.DataFrame) -> pd.DataFrame:
    """What one radix bucket says about its words: ``word, near_n, best_n, best``.

    Sorted keys bring together what may have one string in common; the strings themselves decide.
    Words that lose the same position are a replacement apart; a word that is what another
    becomes is a deletion apart from it, counted at the first of equal neighbouring
    code points. A string has at most 90 words per position, so no list of pairs arises.
    """
    key = b["key"].to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    shared = np.repeat(np.diff(edge) > 1, np.diff(edge))
    c = b.iloc[order[shared]]
    out = pd.DataFrame({"word": pd.Series([], dtype=object), "near_n": np.zeros(0, np.int64), "best_n": np.zeros(0, np.int64), "best": pd.Series([], dtype=object)})
    if c.empty:
        return out
    at = c["at"].to_numpy()
    left = [w if k < 0 else w[:k] + w[k + 1 :] for w, k in zip(c["word"], at, strict=True)]
    c = pd.DataFrame({"left": pd.factorize(pd.Series(left, dtype=object))[0], "at": at, "first": c["first"].to_numpy(), "word": c["word"].to_numpy(object), "n": c["n"].to_numpy()})
    c = c.sort_values(["n", "word"], ascending=[False, True], kind="stable")

    parts = []
    swaps = c[c["at"] >= 0].sort_values(["left", "at"], kind="stable")
    if len(swaps):
        group = swaps["left"].to_numpy().astype(np.int64) * (int(at.max()) + 1) + swaps["at"].to_numpy()
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[start, len(group)])
        own, many = np.repeat(start, size), np.repeat(size, size)
        here = np.arange(len(group))
        # The best other word of a group is its first, for that one its second.
        other = np.where(here == own, own + 1, own)[many > 1]
        word, n = swaps["word"].to_numpy(object), swaps["n"].to_numpy()
        parts.append(pd.DataFrame({"word": word[many > 1], "near_n": many[many > 1] - 1, "best_n": n[other], "best": word[other]}))
    whole = c[c["at"] < 0]
    longer = c[(c["at"] >= 0) & c["first"]]
    both = longer.merge(whole[["left", "word", "n"]], on="left", suffixes=("", "_short"))
    if len(both):
        parts.append(pd.DataFrame({"word": both["word"], "near_n": 1, "best_n": both["n_short"], "best": both["word_short"]}))
        g = both.sort_values(["n", "word"], ascending=[False, True], kind="stable").groupby("word_short", sort=False)
        parts.append(pd.DataFrame({"word": list(g.groups), "near_n": g.size().to_numpy(), "best_n": g["n"].first().to_numpy(), "best": g["word"].first().to_numpy(object)}))
    return pd.concat([out, *parts], ignore_index=True)


def one_apart(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def near_long_words(words: DataFrame, longest: int) -> DataFrame:
    """As ``near_in_bucket``, for words of ``longest`` code points and more and pairs with at least one beyond.

    Here rows carry digests; pairs with a key in common meet their strings again, which decide.
    """

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one_apart(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    named = words.where(F.length("word") >= longest).withColumn("digest", F.sha2("word", 256))
    rows = keyed(named, 0, by_name=True).select("key", "at", "first", "word")
    other = rows.select("key", F.col("at").alias("at2"), F.col("word").alias("word2"))
    swapped = rows.where("at >= 0").join(other.withColumnRenamed("at2", "at"), ["key", "at"]).where("word < word2")
    longer = rows.where("at >= 0 and first").join(other.where("at2 < 0"), "key")
    pairs = swapped.select("word", "word2").union(longer.select("word", "word2")).distinct()
    left = named.select(F.col("digest").alias("word"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = named.select(F.col("digest").alias("word2"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    found = pairs.join(left, "word").join(right, "word2").where((F.greatest(F.length("a"), F.length("b")) > longest) & near("a", "b"))
    told = lambda x, y: found.select(F.col(x).alias("word"), F.lit(1).cast("long").alias("near_n"), F.col(f"n_{y}").alias("best_n"), F.col(y).alias("best"))
    return told("a", "b").unionByName(told("b", "a"))


def near_words(words: DataFrame, longest: int = 64) -> DataFrame:
    """``word, n, near_n, best, best_n`` for distinct words: how many others are one edit away, and the most frequent (ties: the least).

    A word travels once per code point; those of more than ``longest`` leave their string behind.
    """
    usual = words.where(F.length("word") <= longest)
    rows = usual.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(rows / BUCKET_ROWS, shuffle_partitions(words.sparkSession), 1)))))
    found = keyed(usual, bits).groupBy("part").applyInPandas(near_in_bucket, "word string, near_n long, best_n long, best string")
    found = found.unionByName(near_long_words(words, longest))
    best = F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))
    told = words.select("word", "n", F.lit(0).cast("long").alias("near_n"), F.lit(None).cast("struct<n: long, word: string>").alias("b")).unionByName(
        found.select("word", F.lit(None).cast("long").alias("n"), "near_n", best.alias("b"))
    )
    one = told.groupBy("word").agg(F.max("n").alias("n"), F.sum("near_n").alias("near_n"), F.min("b").alias("b"))
    return one.select("word", "n", "near_n", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root``: where the chain of ``word, form`` ends; each round doubles the steps taken.

    Counts grow along a chain by a factor, so there are no circles and few rounds.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, text: str = "text", id: str = "doc_id", min_length: int = 6, min_n: int = 5, ratio: int = 5) -> DataFrame:
    """Every word with its main form: ``word, form, root, n, near_n, form_n``.

    Words are lower-cased runs of Latin letters (see ``run_counts``) of at least ``min_length`` code points
    and ``min_n`` occurrences. Two words are near if one code point is inserted, deleted or
    replaced between them. A word's form is its near word of largest n (ties: the least
    in code-point order) if that n is at least ``ratio`` times its own; its root follows forms to the last.

    Counts combine before their shuffle. Keys are dealt by their leading bits into buckets of bounded
    size; within a bucket a string meets at most 90 words per position. Null and empty texts have
    no words; null ids count as ''; repeated rows count as often as they occur; an empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    counts = run_counts(docs, text, id).groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(counts.where((F.col("n") >= min_n) & (F.length("word") >= min_length)))
    near = near_words(words)
    has = F.col("best_n") >= ratio * F.col("n")
    formed = materialize(near.select("word", F.when(has, F.col("best")).alias("form"), "n", "near_n", F.when(has, F.col("best_n")).alias("form_n")))
    roots = roots_of(formed.where("form is not null"))
    out = formed.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "near_n", "form_n")
