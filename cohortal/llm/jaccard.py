"""Similarity join of documents on the Jaccard index of their word n-grams."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.llm.bitfilter import marked
from cohortal.llm.text import FEW_ROWS, MAX_KNOWN, WORDS, packed, small_batches, unpacked
from cohortal.operators.graph import connected_components
from cohortal.session import materialize

BANDS, ROWS = 32, 5
N_HASHES = BANDS * ROWS
#: Hash values compared at a time before a pair is judged again.
STEP = 16
#: Rows of a chunk when a bucket is pruned, and when a group is verified; and the most bytes of shingles of the latter.
PRUNE_CHUNK, VERIFY_CHUNK, VERIFY_BYTES = 8192, 1024, 1 << 22
#: Groups up to this size are compared together with others, larger ones each on its own.
SMALL = 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20_240_501)
FACTORS = _rng.integers(1, 2**32, N_HASHES, dtype=np.uint32) | np.uint32(1)
SHIFTS = _rng.integers(0, 2**32, N_HASHES, dtype=np.uint32)


def shingles(text: str | None, n: int, memo: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; of all words where there are fewer."""
    words = WORDS.findall(text or "")
    if not words:
        return np.zeros(0, np.uint64)
    if len(memo) > MAX_KNOWN:
        memo.clear()
    ids = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        ids[i] = h
    k = min(n, len(words))
    out = ids[: len(words) - k + 1].copy()
    for i in range(1, k):
        out *= MULTIPLIER
        out ^= out >> np.uint64(29)
        out += ids[i : len(words) - k + 1 + i]
    out ^= out >> np.uint64(32)
    out *= MULTIPLIER
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least value of every hash function over the shingles."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(N_HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        values = np.multiply.outer(FACTORS, x[at : at + 1024])
        values += SHIFTS[:, None]
        np.minimum(best, values.min(1), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band's values, different bands being told apart."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MULTIPLIER
    for i in range(ROWS):
        key = (key ^ rows[:, i]) * MULTIPLIER
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """Per compared hash values (in steps) the fewest matches with which a pair stays.

    With a uniform prior, the index given m matches among n values is Beta(m + 1, n - m + 1); it
    reaches the threshold with the probability that a binomial of n + 1 draws at the
    threshold is at most m. A pair goes when that is below the tolerance.
    """
    out = []
    for n in range(STEP, N_HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of signature rows that stay after all comparisons."""
    matches = np.zeros(len(i), np.int32)
    for k, floor in enumerate(least):
        if not len(i):
            break
        at = slice(k * STEP, (k + 1) * STEP)
        matches += (sig[i, at] == sig[j, at]).sum(1, dtype=np.int32)
        keep = matches >= floor
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


class Forest:
    """Classes of the numbers below n under unions: ``label`` is the least of each."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        roots = np.unique(self.label[members])
        if len(roots) > 1:
            self.label[np.isin(self.label, roots)] = roots[0]

    def join_pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        """Union of many pairs by spreading least labels."""
        while True:
            low = np.minimum(self.label[i], self.label[j])
            before = self.label.copy()
            np.minimum.at(self.label, self.label[i], low)
            np.minimum.at(self.label, self.label[j], low)
            self.label = self.label[self.label]
            if (before == self.label).all() and (self.label[i] == self.label[j]).all():
                return


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a sorted input, with the first row of each and the end."""
    carry = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if carry is None else pa.concat_tables([carry, t])
        starts = group_starts(t, keys)
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield t.slice(0, last), np.append(starts[:-1], last)
        carry = t.slice(last)
    if carry is not None and carry.num_rows:
        yield carry, np.append(group_starts(carry, keys), carry.num_rows)


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(t.num_rows, bool)
    if t.num_rows:
        change[0] = True
    for k in keys:
        values = t.column(k).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def _blocks(rows: DataFrame, group: str, n_chunks: Column, node: str, partitions: int) -> DataFrame:
    """Deal the rows of each group into chunks and send each pair of chunks to a task.

    Adds ``chunk`` (of the row) and ``a <= b`` (the pair); a row of k chunks goes to k pairs.
    """
    rows = rows.withColumn("n_chunks", n_chunks.cast("int")).withColumn("chunk", F.pmod(F.xxhash64(node), F.col("n_chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("other")
    rows = rows.select("*", other)
    rows = rows.withColumn("a", F.least("chunk", "other")).withColumn("b", F.greatest("chunk", "other"))
    rows = rows.drop("other", "n_chunks")
    return rows.repartition(partitions, group, "a", "b").sortWithinPartitions(group, "a", "b", node)


def join_sized(rows: DataFrame, keyed: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join with a table that has each key once and ``size``, the rows of that key, out of ``total``.

    Keys of more than 200 rows and a ten-thousandth of all are less than 10,000, whatever the
    data: they are broadcast. No other key can fill a task.
    """
    hot = F.col(size) > max(200, total // 10_000)
    most = F.broadcast(keyed.where(hot))
    rest = rows.join(most.select(key), key, "left_anti").join(keyed.where(~hot), key)
    return rows.join(most, key).unionByName(rest)


def row_key(docs: DataFrame, id: str, text: str) -> Column:
    """What stands for a row: its id, or a hash of its text where that is null. No part is null."""
    kind, missing = dict(docs.dtypes)[id], F.col(id).isNull()
    of_text = F.when(missing, F.coalesce(F.xxhash64(text), F.lit(0))).otherwise(F.lit(0).cast("long"))
    return F.struct(missing.alias("missing"), F.coalesce(F.col(id), F.lit(0).cast(kind)).alias("id"), of_text.alias("hash"))


def as_id(key: Column, kind: str) -> Column:
    """A key as an id: the hash takes the place of a null id, as a negative number where the type is narrow."""
    bits = {"tinyint": 7, "smallint": 15, "int": 31}.get(kind)
    number = -1 - F.pmod(key["hash"], F.lit((1 << bits) - 1)) if bits else key["hash"]
    return F.when(key["missing"], number.cast(kind)).otherwise(key["id"])


def sketches(docs: DataFrame, id: str, text: str, n: int) -> DataFrame:
    """Per row its id and key, a hash of its text, the number and the digest of its shingles, 8 bits of
    each MinHash value, and band keys. Rows without a word have nulls for the last three."""
    rows = docs.select(
        F.col(id).alias("doc_id"),
        row_key(docs, id, text).alias("key"),
        F.xxhash64(text).alias("text_hash"),
        F.col(text).alias("text"),
    )
    types = dict(rows.dtypes)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            sizes, digests, sigs, keys = [], [], [], []
            for t in batch.column(3).to_pylist():
                h = shingles(t, n, memo)
                sizes.append(len(h))
                if not len(h):
                    digests.append(None), sigs.append(None), keys.append(None)
                    continue
                s = signature(h)
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                sigs.append((s & np.uint32(255)).astype(np.uint8).tobytes())
                keys.append(band_keys(s))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(sigs, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "text_hash", "n_shingles", "digest", "sig", "bands"],
            )

    schema = f"doc_id {types['doc_id']}, key {types['key']}, text_hash long, n_shingles long, digest binary, sig binary, bands array<long>"
    return rows.mapInArrow(sketch, schema)


def little_pairs(starts: np.ndarray, side: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within groups of up to SMALL rows, across the sides of a cross block only."""
    sizes = np.diff(starts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    little = sizes[group] <= SMALL
    for d in range(1, min(SMALL, len(group))):
        i = np.flatnonzero((group[:-d] == group[d:]) & little[:-d])
        if not len(i):
            break
        i = i[~cross[i] | (side[i] != side[i + d])]
        yield i, i + d


def pruner(least: np.ndarray) -> Callable:
    """Compare signatures within blocks; hand out a forest of the pairs that stay.

    Pairs that the forest already connects are not compared here: those of one group are all
    compared before they are verified.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in complete_groups(batches, ["bucket", "a", "b"]):
            node = t.column("node").to_numpy()
            side = t.column("chunk").to_numpy()
            cross = t.column("a").to_numpy() != t.column("b").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, N_HASHES)
            edges: set[tuple[int, int]] = set()
            for i, j in little_pairs(starts, side, cross):
                i, j = surviving(sig, i, j, least)
                edges.update(zip(node[j].tolist(), node[i].tolist(), strict=True))
            for g in np.flatnonzero(np.diff(starts) > SMALL):
                lo, hi = int(starts[g]), int(starts[g + 1])
                forest = Forest(hi - lo)
                for i in range(hi - lo - 1):
                    j = np.flatnonzero(forest.label[i + 1 :] != forest.label[i]) + i + 1
                    if cross[lo]:
                        j = j[side[lo + j] != side[lo + i]]
                    if len(j):
                        _, j = surviving(sig, np.full(len(j), lo + i), lo + j, least)
                        if len(j):
                            forest.join(np.append(j - lo, i))
                edges.update((node[lo + k].item(), node[lo + r].item()) for k, r in enumerate(forest.label.tolist()) if k != r)
            u, v = zip(*edges, strict=True) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs (i, j) of sorted distinct arrays.

    Few pairs are merged one by one; for many, rows of a table of the values that several of
    the sets have are multiplied, in slices of some MB.
    """
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    own = [sets[k] for k in used.tolist()]
    values = np.concatenate(own) if own else np.zeros(0, np.uint64)
    if len(i) < 64 or len(i) * 20 < len(values):
        out = [len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        return np.array(out, np.int64)
    owner = np.repeat(np.arange(len(own)), [len(s) for s in own])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    keep = (count > 1)[column]
    owner, column = owner[keep], (np.cumsum(count > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(256, (1 << 24) // (4 * len(own)))
    total = np.zeros((len(own), len(own)), np.float32)  # counts stay below 2^24, where floats are exact
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        x = np.zeros((len(own), min(width, int(column[-1]) + 1 - first)), np.float32)
        x[owner[a:b], column[a:b] - first] = 1
        total += x @ x.T
    return np.rint(total[at[: len(i)], at[len(i) :]]).astype(np.int64)


def verifier(threshold: float, least: np.ndarray, pairs: bool) -> Callable:
    """Exact index of those pairs of a block that are not pruned; links per row with a forest, or the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in complete_groups(batches, ["root_key", "a", "b"]):
            node = t.column("node").to_numpy()
            side = t.column("chunk").to_numpy()
            cross = t.column("a").to_numpy() != t.column("b").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, N_HASHES)
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            n = np.array([len(s) for s in sets])
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def verify(i: np.ndarray, j: np.ndarray) -> None:
                if len(i):
                    both = shared(sets, i, j)  # noqa: B023
                    union = n[i] + n[j] - both  # noqa: B023
                    linked = both >= threshold * union - 1e-9
                    found.append((i[linked], j[linked], (both / union)[linked]))  # noqa: B023

            for i, j in little_pairs(starts, side, cross):
                verify(*surviving(sig, i, j, least))
            for g in np.flatnonzero(np.diff(starts) > SMALL):
                lo, hi = int(starts[g]), int(starts[g + 1])
                some: list[tuple[np.ndarray, np.ndarray]] = []
                waiting = 0
                for i in range(lo, hi - 1):
                    j = np.arange(i + 1, hi)
                    if cross[lo]:
                        j = j[side[j] != side[i]]
                    some.append(surviving(sig, np.full(len(j), i), j, least))
                    waiting += len(some[-1][0])
                    if waiting > 1 << 20:
                        verify(*map(np.concatenate, zip(*some, strict=True)))
                        some, waiting = [], 0
                if some:
                    verify(*map(np.concatenate, zip(*some, strict=True)))
            i, j, index = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            if pairs:
                u, v = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(index)], names=["u", "v", "jaccard"])
                continue
            links = np.bincount(i, minlength=len(node)) + np.bincount(j, minlength=len(node))
            forest = Forest(len(node))
            forest.join_pairs(i, j)
            some_links = np.flatnonzero(links)
            columns = [node[some_links], links[some_links], node[forest.label[some_links]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "n_links", "parent"])

    return run


class JaccardJoin:
    """The steps of the join over one table; ``links`` and ``pairs`` are its results.

    1. Each row is read once into a sketch: a digest of its shingle set and the MinHash values of
       160 functions. Rows of equal digest are copies: the row of least id stands for all.
    2. Representatives that share one of 32 bands of 5 values meet in that band's bucket (a pair at
       0.8 misses all with a probability of 3e-6). In a bucket MinHash values are compared 16
       at a time, and a pair goes as soon as the posterior probability that it reaches the
       threshold falls below ``tolerance``. Of each value 8 bits are compared: chance
       matches can only keep a pair.
    3. Connected components of the pairs that stayed are the groups in which links can be.
    4. In a group all pairs are compared like that, and those that stay, and only those, are
       verified exactly on the full shingle sets.

    Large buckets and groups are dealt into chunks and the pairs of chunks to tasks, so that no
    task holds a group; what a task hands out is a row per document, never a group's pairs.
    Chunks have ``prune_chunk`` and ``verify_chunk`` rows, the latter at most 4 MB of shingles: a
    row of a group of m rows travels m / chunk times, and up to eight times in smaller groups. Texts travel only for documents in
    groups, after a filter of fixed size. Keys that may be hot are joined by ``join_sized``.
    """

    def __init__(
        self,
        docs: DataFrame,
        id: str = "doc_id",
        text: str = "text",
        n: int = 5,
        threshold: float = 0.8,
        tolerance: float = 1e-6,
        partitions: int | None = None,
        prune_chunk: int = PRUNE_CHUNK,
        verify_chunk: int = VERIFY_CHUNK,
    ):
        self.threshold, self.n, self.docs, self.id, self.text = threshold, n, docs, id, text
        self.kind, self.least = dict(docs.dtypes)[id], least_matches(threshold, tolerance)
        self.prune_chunk, self.verify_chunk = prune_chunk, verify_chunk
        spark = docs.sparkSession
        small_batches(spark, FEW_ROWS)
        self.partitions = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.sketches = materialize(sketches(docs, id, text, n))
        sets = self.sketches.where("digest is not null").groupBy("digest")
        sets = sets.agg(
            F.min(F.struct("key", "text_hash")).alias("rep"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sig").alias("sig"),
            F.first("bands").alias("bands"),
            F.count("*").alias("n_copies"),
        )
        # Numbers of shingle sets; the checkpoint keeps them as they are.
        self.nodes = materialize(sets.withColumn("node", F.monotonically_increasing_id()))
        self.groups = self._groups()

    def _groups(self) -> DataFrame:
        """Nodes that may have links, with what their verification needs: ``root`` and ``n_chunks`` of their group."""
        bands = self.nodes.select("node", F.explode("bands").alias("bucket"))
        full = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        members = join_sized(bands, full, "bucket", "n", self.nodes.count() * BANDS).join(self.nodes.select("node", "sig"), "node")
        rows = members.select("bucket", "n", "node", "sig")
        dealt = _blocks(rows, "bucket", F.ceil(F.col("n") / self.prune_chunk), "node", self.partitions)
        edges = dealt.mapInArrow(pruner(self.least), "u long, v long").distinct()
        found = connected_components(edges, "u", "v").join(self.nodes.select("node", "n_shingles", "rep", "digest", "sig"), "node")
        found = materialize(found)
        sizes = found.groupBy("root").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("all_shingles"))
        sizes = materialize(sizes)
        # A middling group is split up to eight times, so that it does not fill one task.
        split = F.least(F.lit(8.0), F.col("members") / 128)
        needed = F.ceil(F.greatest(F.col("members") / self.verify_chunk, split, F.col("all_shingles") * 8 / F.lit(VERIFY_BYTES)))
        sizes = sizes.select("root", "members", F.greatest(needed, F.lit(1)).cast("int").alias("n_chunks"))
        return materialize(join_sized(found, sizes, "root", "members", found.count()))

    def _verified(self, pairs: bool) -> DataFrame:
        wanted = self.groups.select("root", "n_chunks", "node", "sig", "digest", "rep.key", F.col("rep.text_hash").alias("own_hash"))
        texts = self.docs.select(
            row_key(self.docs, self.id, self.text).alias("key"), F.xxhash64(self.text).alias("own_hash"), F.col(self.text).alias("text")
        )
        n = self.n

        @F.pandas_udf("struct<shingles:binary,own:binary>")
        def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            memo: dict[str, int] = {}
            for s in batches:
                sets = [shingles(t, n, memo).tobytes() for t in s]
                yield pd.DataFrame({"shingles": sets, "own": [xxhash.xxh3_128_digest(x) for x in sets]})

        rows = marked(texts, "own_hash", wanted, "own_hash").where("maybe").drop("maybe").join(wanted, ["key", "own_hash"]).withColumn("s", read("text")).drop("text")
        rows = rows.where("s.own = digest").dropDuplicates(["node"])
        rows = rows.select(F.xxhash64("root").alias("root_key"), "n_chunks", "node", "sig", F.col("s.shingles").alias("shingles"))
        dealt = _blocks(rows, "root_key", F.col("n_chunks"), "node", self.partitions)
        schema = "u long, v long, jaccard double" if pairs else "node long, n_links long, parent long"
        return dealt.mapInArrow(verifier(self.threshold, self.least, pairs), schema)

    def pairs(self) -> DataFrame:
        """A row per link of two shingle sets: their least ids ``a_id, b_id`` and the exact ``jaccard``."""
        names = self.nodes.select("node", as_id(F.col("rep.key"), self.kind).alias("rep_id"))
        a, b = names.toDF("u", "a_id"), names.toDF("v", "b_id")
        return self._verified(pairs=True).join(a, "u").join(b, "v").select("a_id", "b_id", "jaccard")

    def links(self) -> DataFrame:
        """One row per input row: ``doc_id, class_id, rep_id, n_copies, n_links, leads, text_hash``.

        ``rep_id`` is the least id of the rows with the same shingles, ``n_copies`` their number,
        ``n_links`` the other shingle sets at or above the threshold, and ``class_id`` the
        least id of all that links connect. ``leads`` marks the rows of the class's least id
        and one shingle set, which are equal rows if they are several. Rows without a word are
        their own class, of one copy without links.
        """
        found = materialize(self._verified(pairs=False))
        links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
        classes = connected_components(found, "node", "parent")
        rated = materialize(
            self.nodes.select("digest", "node", F.col("rep.key").alias("rep"), "n_copies")
            .join(links, "node", "left")
            .join(classes, "node", "left")
        )
        # A set without links is its own class and needs no join.
        alone = rated.where("root is null").withColumn("first", F.struct("rep", "digest")).drop("root")
        linked = rated.where("root is not null")
        first = materialize(linked.groupBy("root").agg(F.min(F.struct("rep", "digest")).alias("first"), F.count("*").alias("members")))
        linked = join_sized(linked, first, "root", "members", linked.count()).drop("root", "members")
        rated = alone.unionByName(linked).select(
            "digest",
            F.col("first.rep").alias("class_key"),
            "rep",
            "n_copies",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            (F.col("first.digest") == F.col("digest")).alias("leads"),
        )
        rated = materialize(rated)
        worded = self.sketches.where("digest is not null").select("doc_id", "key", "text_hash", "digest")
        worded = join_sized(worded, rated, "digest", "n_copies", worded.count())
        empty = self.sketches.where("digest is null").select(
            "doc_id", "key", "text_hash", F.col("key").alias("class_key"), F.col("key").alias("rep"), F.lit(1).cast("long").alias("n_copies"),
            F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("leads"),
        )
        return worded.select(*empty.columns).unionByName(empty).select(
            "doc_id",
            "text_hash",
            as_id(F.col("class_key"), self.kind).alias("class_id"),
            as_id(F.col("rep"), self.kind).alias("rep_id"),
            "n_copies",
            "n_links",
            (F.col("leads") & (F.col("key") == F.col("class_key"))).alias("leads"),
            "key",
        )


def jaccard_links(docs: DataFrame, **options) -> DataFrame:
    """Classes and numbers of links of all rows (see ``JaccardJoin.links``).

    Shingles are ``n`` words in a row, words being runs between white space; a text of fewer words
    has one shingle of them all. Null and empty texts have no shingle and no link. Rows may
    repeat; ids are numbers or strings and may be null (a hash of the text stands in), other
    columns are not read. An empty table gives an empty result.
    """
    return JaccardJoin(docs, **options).links().drop("key")


def jaccard_pairs(docs: DataFrame, **options) -> DataFrame:
    """Linked pairs of shingle sets with their exact index (see ``JaccardJoin.pairs``)."""
    return JaccardJoin(docs, **options).pairs()


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, one of each class: that of the least id.

    Rows that go, and repeated rows, are found by id and text hash. Only rows that may be among
    them, by a filter of fixed size, are shuffled with their texts. Rows without a word stay,
    repeated ones (equal id and text) once.
    """
    links = JaccardJoin(docs, id=id, text=text, **options).links()
    worded = links.select(F.col("key").alias("own_key"), F.coalesce("text_hash", F.lit(0)).alias("own_hash"), "leads")
    # Per id and text: whether it stays, and if it is there more than once.
    judged = worded.groupBy("own_key", "own_hash").agg(F.max("leads").alias("stays"), F.count("*").alias("times"))
    judged = materialize(judged.where("not stays or times > 1"))
    rows = packed(docs, own_key=row_key(docs, id, text), own_hash=F.coalesce(F.xxhash64(text), F.lit(0)))
    rows = marked(rows, "own_hash", judged, "own_hash")
    some = rows.where("maybe").join(judged, ["own_key", "own_hash"], "left")
    once = some.where("stays and times > 1").dropDuplicates(["own_key", "own_hash"])
    kept = rows.where("not maybe").select("row").unionByName(some.where("stays is null").select("row"))
    return unpacked(kept.unionByName(once.select("row")), docs.columns)
