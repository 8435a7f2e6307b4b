"""Hard negatives by branch and bound: ball trees per block of rows bound inner products above and below."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortal.session import materialize, shuffle_partitions

#: Rows of a leaf, and components of a block: 64 MB as doubles.
LEAF_ROWS = 64
BLOCK_VALUES = 8 << 20
#: Anchors that a tree is searched for at a time.
BATCH_ANCHORS = 512
#: Bytes of a component by the tag before a stored vector.
KINDS = {1: np.dtype("<i2"), 2: np.dtype("<i4"), 3: np.dtype("<f8")}


def stored(vectors: pd.Series) -> list[bytes]:
    """Whole-numbered vectors in the narrowest kind that holds them, after a tag."""
    out = []
    for v in vectors:
        v = np.asarray(v, np.float64)
        top = np.abs(v).max(initial=0.0)
        kind = 1 if top < 1 << 15 else 2 if top < 1 << 31 else 3
        out.append(bytes([kind]) + v.astype(KINDS[kind]).tobytes())
    return out


def matrix(vectors: list[bytes], width: int = 0) -> np.ndarray:
    """Stored vectors as rows of doubles; shorter ones end in zeros."""
    rows = [np.frombuffer(v, KINDS[v[0]], offset=1) for v in vectors]
    out = np.zeros((len(rows), max([width, *map(len, rows)])))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


class BallTree:
    """Balls around contiguous runs of the rows of one block.

    Nodes split by label until one is left or they are leaves, then halve along the line
    between two far rows. A node knows its centre and radius and its least and greatest label.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, end, left child, right child (-1: leaf)
        centres, radii = [], []
        todo = [(0, len(order), -1, 0)]
        while todo:
            lo, hi, above, side = todo.pop()
            at = len(self.nodes)
            if above >= 0:
                first, end, left, right = self.nodes[above]
                self.nodes[above] = (first, end, at if side == 0 else left, at if side == 1 else right)
            own = rows[order[lo:hi]]
            centre = own.mean(axis=0)
            off = own - centre
            far = np.einsum("ij,ij->i", off, off)
            centres.append(centre)
            radii.append(np.sqrt(far.max()))
            self.nodes.append((lo, hi, -1, -1))
            if hi - lo <= LEAF_ROWS:
                continue
            kinds = labels[order[lo:hi]]
            if kinds[0] != kinds[-1]:
                mid = kinds[(hi - lo) // 2]
                cut = int(np.searchsorted(kinds, mid, "left" if mid != kinds[0] else "right"))
            else:
                one = int(far.argmax())
                away = own - own[one]
                other = int(np.einsum("ij,ij->i", away, away).argmax())
                along = own @ (own[other] - own[one])
                order[lo:hi] = order[lo:hi][np.argsort(along, kind="stable")]
                cut = (hi - lo) // 2
            todo += [(lo, lo + cut, at, 0), (lo + cut, hi, at, 1)]
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.lengths = np.sqrt(np.einsum("ij,ij->i", self.centres, self.centres))

    def search(
        self, vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per query the ``k`` best rows (query, id, score) within its window, of its label or of others.

        Query ``i`` has the vector ``vectors[own[i]]``. Best is the higher score, then the smaller id;
        the row of the query's own id is no candidate. A node is passed over if its upper
        bound is below the window or below the current k-th score, its lower bound above the
        window, or its labels cannot fit. Bounds allow for rounding, scores are exact.
        """
        n = len(own)
        score, found = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
        reach = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))

        def bounds(at: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            middle = (vectors @ self.centres[at])[own[q]]
            spread = reach[own[q]] * self.radii[at]
            slack = 1e-9 * (reach[own[q]] * (self.lengths[at] + self.radii[at]) + 1)
            return middle - spread - slack, middle + spread + slack

        todo = [(0, np.arange(n))]
        while todo:
            at, q = todo.pop()
            lo, hi, left, right = self.nodes[at]
            least, most = self.labels[lo:hi].min(), self.labels[lo:hi].max()
            fits = (labels[q] >= least) & (labels[q] <= most) if same else ~((labels[q] == least) & (least == most))
            q = q[fits]
            if not len(q):
                continue
            under, over = bounds(at, q)
            q = q[(over >= np.maximum(low[q], score[q, -1])) & (under <= high[q])]
            if not len(q):
                continue
            if left >= 0:
                ahead = [bounds(c, q)[1].mean() for c in (left, right)]
                todo += [(left, q), (right, q)] if ahead[0] <= ahead[1] else [(right, q), (left, q)]
                continue
            used, back = np.unique(own[q], return_inverse=True)
            s = (vectors[used] @ self.rows[lo:hi].T)[back]
            ok = (s >= np.maximum(low[q], score[q, -1])[:, None]) & (s <= high[q][:, None])
            ok &= (self.labels[lo:hi] == labels[q][:, None]) == same
            ok &= self.ids[lo:hi] != ids[q][:, None]
            r, c = np.nonzero(ok)
            if not len(r):
                continue
            hit = np.unique(r)
            who = np.concatenate([q[r], np.repeat(q[hit], k)])
            all_s = np.concatenate([s[r, c], score[q[hit]].ravel()])
            all_i = np.concatenate([self.ids[lo:hi][c], found[q[hit]].ravel()])
            best = np.lexsort((all_i, -all_s, who))
            who, all_s, all_i = who[best], all_s[best], all_i[best]
            starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            take = starts[:, None] + np.arange(k)
            score[who[starts]], found[who[starts]] = all_s[take], all_i[take]
        i, j = np.nonzero(score > -np.inf)
        return i, found[i, j], score[i, j].astype(np.int64)


def usable_rows(df: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """``vec_id, label, vec``: one row per id, components ``floor(256 * x)``, labels of every seventh id moved on.

    Rows with a null id, label or vector, or a null or not finite component, take no part. Of rows
    that share an id the one of the least label, then of the least stored vector, stands for all.
    """
    x = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda v: F.floor(v * 256).cast("double"))
    odd = F.exists(F.col(f"`{vector}`").cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    own = F.col(f"`{label}`").cast("long")
    moved = F.when(F.col(f"`{id}`") % 7 == 0, F.pmod(own + 1, F.lit(10))).otherwise(own)
    sound = F.col(f"`{id}`").isNotNull() & own.isNotNull() & F.col(f"`{vector}`").isNotNull() & ~odd
    rows = df.where(sound).select(F.col(f"`{id}`").cast("long").alias("vec_id"), moved.alias("label"), x.alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "vec": stored(b["x"])})

    narrow = rows.mapInPandas(run, "vec_id long, label long, vec binary")
    one = narrow.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r"))
    return one.select("vec_id", "r.label", "r.vec")


def searched(rows: DataFrame, anchors: DataFrame, n_blocks: int, same: bool, k: int) -> DataFrame:
    """Per block of ``rows`` and query of ``anchors`` the best ``k`` rows: ``anchor_id, positive_id, positive_score, vec_id, score``.

    ``anchors`` has ``vec_id, label, vec, wanted``, an array of (positive_id, low, high) windows.
    Rows and anchors of a block meet in one partition, rows first: the task builds the tree of a
    block, then the anchors pass by in batches.
    """
    spread = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    none = F.lit(None).cast("array<struct<positive_id: long, low: double, high: double>>")
    both = rows.select("block", F.lit(0).alias("kind"), "vec_id", "label", "vec", none.alias("wanted")).unionByName(
        anchors.select(spread.alias("block"), F.lit(1).alias("kind"), "vec_id", "label", "vec", "wanted")
    )
    dealt = both.repartition(n_blocks, "block").sortWithinPartitions("block", "kind", "vec_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, kept, tree = None, [], None

        def answers(b: pd.DataFrame) -> pd.DataFrame:
            vectors = matrix(list(b["vec"]), tree.rows.shape[1])
            if vectors.shape[1] > tree.rows.shape[1]:
                # Components beyond the longest row meet zeros only.
                vectors = vectors[:, : tree.rows.shape[1]]
            w = [(i, p["positive_id"], p["low"], p["high"]) for i, ps in enumerate(b["wanted"]) for p in ps]
            own = np.array([x[0] for x in w], np.int64)
            low, high = np.array([x[2] for x in w]), np.array([x[3] for x in w])
            ids, labels = b["vec_id"].to_numpy(), b["label"].to_numpy()
            i, found, score = tree.search(vectors, own, ids[own], labels[own], same, low, high, k)
            positive = np.array([x[1] for x in w], np.int64)
            return pd.DataFrame({"anchor_id": ids[own[i]], "positive_id": positive[i], "positive_score": np.where(np.isfinite(high[i]), high[i], 0).astype(np.int64), "vec_id": found, "score": score})

        for batch in batches:
            for now, part in batch.groupby("block", sort=True):
                if now != block:
                    block, kept, tree = now, [], None
                rows = part[part["kind"] == 0]
                if len(rows):
                    kept.append((rows["vec_id"].to_numpy(), rows["label"].to_numpy(), matrix(list(rows["vec"]))))
                asked = part[part["kind"] == 1]
                if not len(asked) or not kept and tree is None:
                    continue
                if tree is None:
                    width = max(m.shape[1] for _, _, m in kept)
                    full = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, _, m in kept])
                    tree = BallTree(np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept]), full)
                    kept = []
                for at in range(0, len(asked), BATCH_ANCHORS):
                    yield answers(asked.iloc[at : at + BATCH_ANCHORS])

    return dealt.mapInPandas(run, "anchor_id long, positive_id long, positive_score long, vec_id long, score long")


def first_of(found: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    """The ``k`` rows of a key with the highest scores (ties: the smaller id); Spark cuts each task's share before it shuffles."""
    ranked = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn(rank, F.row_number().over(ranked)).where(F.col(rank) <= k)


def hard_negatives(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", anchor: Column | None = None, positives: int = 5, negatives: int = 5, floor: int = 80
) -> DataFrame:
    """Negatives that score nearly as high as a positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are usable rows (see ``usable_rows``) that satisfy ``anchor`` (default: ids divisible by
    100). Positives of an anchor are the ``positives`` other rows of its label with the highest
    inner products, ties by smaller id. For each positive the first ``negatives`` rows of other labels follow
    whose score is at most the positive's and at least ``floor`` percent of it.

    Rows are dealt into blocks of bounded size by id, each with a ball tree in one task; every
    block sees every anchor, in batches, first for positives, then for negatives within the
    windows that the positives set. Per block and query at most ``positives`` or ``negatives``
    rows leave a task. Exact as long as inner products stay below 2 ** 53.

    Shorter vectors count as ending in zeros. Negative positive scores leave an empty window. An anchor
    without positives or without negatives gives no rows; an empty table gives none. Repeated
    ids count once.
    """
    spark = df.sparkSession
    rows = materialize(usable_rows(df, id, vector, label))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vec")).alias("w")).first()
    n_blocks = max(shuffle_partitions(spark), -(-(size.n * ((size.w or 1) // 2)) // BLOCK_VALUES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    chosen = rows.where(F.col("vec_id") % 100 == 0 if anchor is None else anchor).drop("block")

    window = lambda p, lo, hi: F.struct(p.cast("long").alias("positive_id"), lo.cast("double").alias("low"), hi.cast("double").alias("high"))
    any_score = F.array(window(F.lit(-1), F.lit(float("-inf")), F.lit(float("inf"))))
    near = searched(rows, chosen.withColumn("wanted", any_score), n_blocks, True, positives)
    best = first_of(near.select("anchor_id", "vec_id", "score"), ["anchor_id"], positives, "k")
    # The least whole number that is at least floor percent of the score.
    low = F.ceil(F.lit(floor) * F.col("score") / F.lit(100))
    windows = best.where("score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(window(F.col("vec_id"), low, F.col("score"))).alias("wanted"))
    asked = materialize(chosen.join(windows, "vec_id"))
    hard = first_of(searched(rows, asked, n_blocks, False, negatives), ["anchor_id", "positive_id"], negatives, "rank")
    return hard.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
