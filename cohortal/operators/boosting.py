"""Gradient-boosted trees on feature arrays: the models of all folds and classes grow together, level by level.

A level is one pass over the rows: tasks sum gradients per (fold, class, node, feature, bin), the sums
meet by key, and the best split of each node goes to the driver. Nothing else does but the edges of the
bins. Gradients are summed in whole units, so the order of tasks leaves no trace.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.session import materialize

#: Units of a gradient of one.
UNIT = 1 << 20
#: Rounds whose trees are applied anew in each pass before scores are written.
HELD_ROUNDS = 8
CELLS = "model int, output int, node int, feature int, bin int, g long, h long, n long"
SPLITS = "model int, output int, node int, feature int, cut int, left double, right double"


@dataclass
class Plan:
    """What a pass over the rows needs to know; the same for all passes."""

    n_models: int
    n_outputs: int
    n_features: int
    n_bins: int
    depth: int
    loss: str
    scale: float
    ridge: float
    rate: float
    min_rows: int

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_models, self.n_outputs


@dataclass
class Round:
    """One tree per model and output: feature and last bin to the left of each inner node, values of the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    @classmethod
    def empty(cls, p: Plan) -> Round:
        inner = (*p.shape, (1 << p.depth) - 1)
        return cls(np.zeros(inner, np.int64), np.full(inner, p.n_bins, np.int64), np.zeros((*p.shape, 1 << p.depth)))

    def place(self, x: np.ndarray, model: int, output: int, levels: int) -> np.ndarray:
        """Node of each row within its level, after some levels."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for level in range(levels):
            node = at + (1 << level) - 1
            at = 2 * at + (x[rows, self.feature[model, output, node]] > self.cut[model, output, node])
        return at


def with_rounds(p: Plan, x: np.ndarray, scores: np.ndarray, rounds: Sequence[Round]) -> np.ndarray:
    """Scores (rows, models, outputs) after some more rounds."""
    out = scores.copy()
    for r in rounds:
        for m in range(p.n_models):
            for k in range(p.n_outputs):
                out[:, m, k] += r.leaf[m, k][r.place(x, m, k, p.depth)]
    return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def slopes(p: Plan, scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, in whole units."""
    if p.loss == "squared":
        g, h = (scores - y[:, None, None]) / p.scale, np.ones_like(scores)
    else:
        q = softmax(scores)
        g, h = q - (y[:, None, None] == np.arange(p.n_outputs)), q * (1 - q)
    return np.rint(g * UNIT), np.rint(h * UNIT)


def unpacked_batch(p: Plan, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(b["x"]), np.uint8).reshape(len(b), p.n_features)
    return x, np.array(b["scores"].tolist(), float).reshape(len(b), *p.shape)


def histograms(state: DataFrame, p: Plan, held: Sequence[Round], now: Round, level: int) -> DataFrame:
    """Sums of the gradients of training rows per cell of the nodes of a level."""
    width = (1 << level) * p.n_features * p.n_bins

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, *p.shape, width))
        for b in batches:
            x, scores = unpacked_batch(p, b)
            y, fold = b["y"].to_numpy(float), b["fold"].to_numpy()
            g, h = slopes(p, with_rounds(p, x, scores, held), y)
            for m in range(p.n_models):
                train = np.flatnonzero((fold != m) & ~np.isnan(y))
                for k in range(p.n_outputs):
                    node = now.place(x[train], m, k, level)
                    cell = ((node[:, None] * p.n_features + np.arange(p.n_features)) * p.n_bins + x[train]).ravel()
                    for i, w in enumerate((g[train, m, k], h[train, m, k], np.ones(len(train)))):
                        total[i, m, k] += np.bincount(cell, np.repeat(w, p.n_features), width)
        m, k, cell = np.nonzero(total[2])
        g, h, n = (t[m, k, cell].astype(np.int64) for t in total)
        yield pd.DataFrame({"model": m, "output": k, "node": cell // (p.n_features * p.n_bins), "feature": cell // p.n_bins % p.n_features, "bin": cell % p.n_bins, "g": g, "h": h, "n": n})

    cells = state.mapInPandas(run, CELLS)
    return cells.groupBy("model", "output", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def best_splits(cells: DataFrame, p: Plan) -> DataFrame:
    """A row per node: the split of the greatest gain (ties: least feature, then least bin) and the values of both sides.

    A node that no split improves sends all its rows to the left, and both sides have its value.
    """

    def best(b: pd.DataFrame) -> pd.DataFrame:
        g, h, n = (np.zeros((p.n_features, p.n_bins)) for _ in range(3))
        at = b["feature"].to_numpy(), b["bin"].to_numpy()
        g[at], h[at], n[at] = b["g"] / UNIT, b["h"] / UNIT, b["n"]
        all_g, all_h, all_n = g[0].sum(), h[0].sum(), n[0].sum()
        lg, lh, ln = g.cumsum(1), h.cumsum(1), n.cumsum(1)
        weight = lambda c: np.maximum(c + p.ridge, 1e-12)
        strength = lambda a, c: a * a / weight(c)
        gain = strength(lg, lh) + strength(all_g - lg, all_h - lh) - strength(all_g, all_h)
        gain[(ln < p.min_rows) | (all_n - ln < p.min_rows)] = -np.inf
        value = lambda a, c: -p.rate * p.scale * a / weight(c)
        gain = np.round(gain, 9)
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        if gain[i, j] <= 1e-9:
            i, j, sides = 0, p.n_bins, [value(all_g, all_h)] * 2
        else:
            sides = [value(lg[i, j], lh[i, j]), value(all_g - lg[i, j], all_h - lh[i, j])]
        first = b.iloc[0]
        return pd.DataFrame([(first["model"], first["output"], first["node"], i, j, *sides)], columns=["model", "output", "node", "feature", "cut", "left", "right"])

    return cells.groupBy("model", "output", "node").applyInPandas(best, SPLITS)


def bin_edges(df: DataFrame, features: str, n_bins: int) -> np.ndarray:
    """Upper edges of the bins of each feature: its quantiles over all rows, without a look at labels."""
    each = df.select(F.posexplode(features).alias("k", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    cuts = [i / n_bins for i in range(1, n_bins)]
    rows = each.groupBy("k").agg(F.percentile_approx("v", cuts, 10_000).alias("e")).collect()
    width = df.agg(F.max(F.size(features))).first()[0] or 0
    out = np.full((max(width, 0), n_bins - 1), np.inf)
    for r in rows:
        out[r.k] = r.e
    return out


def boosted_scores(
    df: DataFrame, features: str, target: str, fold: str, n_outputs: int, loss: str = "softmax", exclude: Sequence[int] = (),
    rounds: int = 20, depth: int = 3, rate: float = 0.3, n_bins: int = 32, ridge: float = 1.0, min_rows: int = 5,
) -> DataFrame:
    """All columns and ``boosted``: raw scores of each row by the model of all other folds.

    ``features`` is an array column of one length (null and NaN go to the lowest bin), ``fold`` not null.
    ``loss`` is ``softmax`` over the classes 0 to ``n_outputs`` - 1, or ``squared`` with one output. Rows of an
    excluded, missing or unknown target teach nothing but are scored. A pass per level and round;
    scores are written every few rounds, which also cuts the lineage.
    """
    edges = bin_edges(df, features, n_bins)
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    y = F.col(target).cast("double")
    known = y.isNotNull() & ~F.isnan(y)
    if loss == "softmax":
        known &= y.isin([float(k) for k in range(n_outputs) if k not in exclude])
    n_features = len(edges)

    @F.pandas_udf("binary")
    def binned(values: pd.Series) -> pd.Series:
        x = np.array([np.asarray(v, float) for v in values]).reshape(len(values), n_features)
        x = np.where(np.isnan(x), -np.inf, x)
        out = np.stack([np.searchsorted(edges[k], x[:, k], "left") for k in range(n_features)], axis=1).astype(np.uint8)
        return pd.Series([r.tobytes() for r in out])

    index = (F.array_position(F.array(*[F.lit(f) for f in folds]), F.col(fold)) - 1).cast("int")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    start = df.select(row.alias("row"), binned(F.col(features).cast("array<double>")).alias("x"), F.when(known, y).otherwise(F.lit(float("nan"))).alias("y"), index.alias("fold"))
    own = start.where(~F.isnan("y")).groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.max(F.abs("y")).alias("top"), *[F.count_if(F.col("y") == k).alias(f"c{k}") for k in range(n_outputs)])
    sums = own.collect()
    first = np.zeros((len(folds), n_outputs))
    for m in range(len(folds)):
        rest = [r for r in sums if r.fold != m]
        n = sum(r.n for r in rest)
        if loss == "softmax":
            first[m] = np.log([(sum(r[f"c{k}"] for r in rest) + 1e-3) / (n + 1e-3 * n_outputs) for k in range(n_outputs)])
        else:
            first[m] = sum(r.s for r in rest) / n if n else 0.0
    scale = max((r.top for r in sums), default=1.0) if loss == "squared" else 1.0
    p = Plan(len(folds), n_outputs, n_features, n_bins, depth, loss, scale or 1.0, ridge, rate, min_rows)
    state = materialize(start.withColumn("scores", F.array(*[F.lit(float(v)) for v in first.ravel()])))

    def written(state: DataFrame, held: list[Round]) -> DataFrame:
        """Scores with the held rounds in."""

        @F.pandas_udf("array<double>")
        def add(x: pd.Series, scores: pd.Series) -> pd.Series:
            bins, before = unpacked_batch(p, pd.DataFrame({"x": x, "scores": scores}))
            return pd.Series(list(with_rounds(p, bins, before, held).reshape(len(x), -1)))

        return materialize(state.withColumn("scores", add("x", "scores")))

    held: list[Round] = []
    for _ in range(rounds):
        now = Round.empty(p)
        for level in range(depth):
            for s in best_splits(histograms(state.drop("row"), p, held, now, level), p).collect():
                at = (s.model, s.output, (1 << level) - 1 + s.node)
                now.feature[at], now.cut[at] = s.feature, s.cut
                # The values of inner nodes are those of the leaves below until these are split themselves.
                span = 1 << (depth - level - 1)
                for side, v in ((0, s.left), (1, s.right)):
                    lo = (2 * s.node + side) * span
                    now.leaf[s.model, s.output, lo : lo + span] = v
        held.append(now)
        if len(held) == HELD_ROUNDS:
            state, held = written(state, held), []
    if held:
        state = written(state, held)
    mine = F.slice("scores", F.col("fold") * n_outputs + 1, n_outputs)
    return state.select(*[F.col("row")[c].alias(c) for c in df.columns], mine.alias("boosted"))


def probabilities(scores: str) -> Column:
    """Softmax of an array column."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda x: x / total)


def boosted_heads(df: DataFrame, views: Sequence[str], label: str, fold: str, n_classes: int = 3, exclude: Sequence[int] = (), **options) -> DataFrame:
    """Class probabilities ``proba`` by boosted trees of the other folds, one model per view, averaged.

    With ``exclude`` a class is left out of the fit, as in heads that tell two of three classes
    apart: its probability is near 0 for all rows, which are all scored. See ``boosted_scores``.
    """
    out, names = df, []
    for k, v in enumerate(views):
        name = f"_boosted_{k}"
        out = boosted_scores(out, v, label, fold, n_classes, "softmax", exclude, **options).withColumnRenamed("boosted", name)
        out = out.withColumn(name, probabilities(name))
        names.append(name)
    mean = F.array(*[sum((F.get(n, F.lit(c)) for n in names), F.lit(0.0)) / len(names) for c in range(n_classes)])
    return out.select(*df.columns, mean.alias("proba"))


def boosted_regression(df: DataFrame, features: str, target: str, fold: str, **options) -> DataFrame:
    """All columns and ``prediction`` by boosted trees of the other folds on squared loss."""
    out = boosted_scores(df, features, target, fold, 1, "squared", **options)
    return out.select(*df.columns, F.get("boosted", F.lit(0)).alias("prediction"))
