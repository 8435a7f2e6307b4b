"""Quality of a text by a convolutional network over its bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.llm.text import small_batches
from cohortal.llm.toxicity import held_out

#: Bytes of a block, blocks of a chunk; a chunk starts at every block, so that each overlaps the next by half.
BLOCK, CHUNK_BLOCKS = 256, 2
#: A filter sees two strides of bytes and moves on by one; its responses are pooled per part of a block first.
STRIDE, PARTS, DIMS, FILTERS, HIDDEN = 4, 4, 8, 32, 16
#: Blocks that go through the filters at a time, and bytes of texts that are scored together.
SLICE_BLOCKS, PACK_BYTES = 512, 1 << 20


def padded(text: str | None) -> np.ndarray:
    """Bytes of a text in whole blocks, a chunk at least; at least one stride of zeros follows the text."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    out = np.zeros(max(CHUNK_BLOCKS, -(-(len(raw) + STRIDE) // BLOCK)) * BLOCK, np.uint8)
    out[: len(raw)] = raw
    return out


def spread_chunks(text: str | None, most: int) -> np.ndarray:
    """At most ``most`` chunks, evenly over the whole text, each with the stride that follows it (a row a chunk)."""
    x = padded(text)
    starts = np.unique(np.linspace(0, len(x) // BLOCK - CHUNK_BLOCKS, most).round().astype(np.int64))
    x = np.r_[x, np.zeros(STRIDE, np.uint8)]
    return np.stack([x[s * BLOCK : (s + CHUNK_BLOCKS) * BLOCK + STRIDE] for s in starts])


@dataclass
class ByteNet:
    """Byte vectors, filters, max-pooling per chunk, a hidden layer per chunk, and a logistic unit on the mean of all chunks.

    Of each filter a chunk keeps the greatest response, and the least among the greatest of its
    parts, negated: where words repeat the two lie close together. The mean makes the probability
    independent of a text's length. Byte 0 pads.
    """

    codes: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, seed: int, share: float) -> ByteNet:
        """Small random weights; the output starts at the share of label 1."""
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        codes = draw(256, DIMS, scale=0.5)
        width = 2 * STRIDE * DIMS
        base = np.log(share / (1 - share))
        return cls(
            codes, draw(width, FILTERS, scale=width**-0.5), np.zeros(2 * FILTERS, np.float32), draw(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5),
            np.zeros(HIDDEN, np.float32), draw(HIDDEN, scale=0.1), np.array([base], np.float32),
        )

    @classmethod
    def constant(cls, share: float) -> ByteNet:
        """A network that knows only the share of label 1."""
        net = cls.start(0, min(max(share, 1e-3), 1 - 1e-3))
        net.out[:] = 0
        return net

    def both_halves(self) -> np.ndarray:
        """Filters as two matrices side by side: what a stride adds to the window it begins, and to the one it ends."""
        half = STRIDE * DIMS
        return np.concatenate([self.filters[:half], self.filters[half:]], axis=1)

    def pooled(self, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Per block the maxima of the filters whose windows begin in it, and the least of its parts' maxima, negated.

        ``ends``: last blocks of the texts in ``x``. The last window of a text is padding, and does not
        see the text that follows.
        """
        n, w = len(x) // BLOCK, self.both_halves()
        x = np.r_[x, np.zeros(STRIDE, np.uint8)]
        pad = np.tile(self.codes[0], STRIDE) @ w
        out = np.empty((n, 2 * FILTERS), np.float32)
        for lo in range(0, n, SLICE_BLOCKS):
            hi = min(n, lo + SLICE_BLOCKS)
            z = self.codes[x[lo * BLOCK : hi * BLOCK + STRIDE]].reshape(-1, STRIDE * DIMS) @ w
            c = z[:-1, :FILTERS] + z[1:, FILTERS:]
            c = c.reshape(hi - lo, BLOCK // STRIDE, FILTERS)
            c[ends[(ends >= lo) & (ends < hi)] - lo, -1] = pad[:FILTERS] + pad[FILTERS:]
            parts = c.reshape(hi - lo, PARTS, -1, FILTERS).max(axis=2)
            out[lo:hi, :FILTERS], out[lo:hi, FILTERS:] = parts.max(axis=1), -parts.min(axis=1)
        return out

    def scores(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """Probability of label 1 of some padded texts, every byte of which is read."""
        sizes = np.array([len(t) // BLOCK for t in texts])
        ends = np.cumsum(sizes) - 1
        m = self.pooled(np.concatenate(texts), ends)
        first = np.delete(np.arange(len(m)), ends)
        chunk = np.maximum(m[first], m[first + 1])
        h = np.maximum(np.maximum(chunk + self.bias, 0) @ self.hidden + self.hidden_bias, 0).astype(np.float64)
        many = sizes - 1
        mean = np.add.reduceat(h, np.cumsum(many) - many) / many[:, None]
        return 1 / (1 + np.exp(-np.clip(mean @ self.out + self.out_bias[0], -30, 30)))

    def gradients(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Log loss and its slopes on chunks ``x`` (a row each) of the documents ``doc`` with the labels ``y``."""
        n, half, w = len(x), STRIDE * DIMS, self.both_halves()
        strides = x.reshape(n, -1, STRIDE)
        a = self.codes[x].reshape(n, -1, half)
        z = a @ w
        c = z[:, :-1, :FILTERS] + z[:, 1:, FILTERS:]
        # Where each filter has its greatest response, and the least of its parts' greatest.
        parts = c.reshape(n, CHUNK_BLOCKS * PARTS, -1, FILTERS)
        size, best, top = parts.shape[2], parts.argmax(axis=2), parts.max(axis=2)
        rows, filters = np.arange(n)[:, None], np.arange(FILTERS)
        chosen = [part * size + best[rows, part, filters] for part in (top.argmax(axis=1), top.argmin(axis=1))]
        at, which, sign = np.concatenate(chosen, axis=1), np.tile(filters, 2), np.repeat(np.array([1, -1], self.codes.dtype), FILTERS)
        p = np.maximum(c[rows, at, which] * sign + self.bias, 0)
        h = np.maximum(p @ self.hidden + self.hidden_bias, 0)
        many = np.bincount(doc, minlength=len(y)).astype(self.codes.dtype)
        mean = np.stack([np.bincount(doc, h[:, k], len(y)) for k in range(HIDDEN)], axis=1) / many[:, None]
        score = 1 / (1 + np.exp(-np.clip(mean @ self.out + self.out_bias[0], -30, 30)))
        loss = -np.mean(y * np.log(score + 1e-9) + (1 - y) * np.log(1 - score + 1e-9))

        up = ((score - y) / len(y)).astype(self.codes.dtype)
        d_h = (up / many)[doc][:, None] * self.out * (h > 0)
        d_p = d_h @ self.hidden.T * (p > 0)
        d_c = d_p * sign
        both = lambda v: v[..., :FILTERS] + v[..., FILTERS:]
        d_filters = np.concatenate([both(np.einsum("nfk,nf->kf", a[rows, at + k], d_c)) for k in (0, 1)])
        d_codes = np.zeros_like(self.codes)
        for k, part in enumerate((self.filters[:half], self.filters[half:])):
            slope = (d_c[:, :, None] * part.T[which]).reshape(-1, DIMS)
            byte = strides[rows, at + k].ravel()
            d_codes += np.stack([np.bincount(byte, slope[:, d], 256) for d in range(DIMS)], axis=1).astype(self.codes.dtype)
        return float(loss), [d_codes, d_filters, d_p.sum(0), p.T @ d_h, d_h.sum(0), mean.T @ up, np.array([up.sum()])]

    def fit(self, chunks: Sequence[np.ndarray], labels: np.ndarray, epochs: int, batch: int = 64, rate: float = 4e-3, seed: int = 1) -> list[float]:
        """Adam over shuffled documents, the rate falling to nothing; returns the mean loss per epoch."""
        rng = np.random.default_rng(seed)
        weights = [getattr(self, f.name) for f in fields(self)]
        mean, square = ([np.zeros_like(w) for w in weights] for _ in range(2))
        steps, t, out = epochs * -(-len(chunks) // batch), 0, []
        for _ in range(epochs):
            order, losses = rng.permutation(len(chunks)), []
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                doc = np.repeat(np.arange(len(own)), [len(chunks[i]) for i in own])
                loss, slopes = self.gradients(np.concatenate([chunks[i] for i in own]), doc, labels[own])
                losses.append(loss)
                t += 1
                for w, g, m, s in zip(weights, slopes, mean, square, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    w -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-7)
            out.append(float(np.mean(losses)))
        return out


def labelled_chunks(docs: DataFrame, labels: DataFrame, text: str, id: str, label: str, max_labelled: int, max_chunks: int, folds: int) -> DataFrame:
    """``y, size, chunks``: about ``max_labelled`` labelled ids outside the held-out fold, by a hash of the id, one row each.

    Of an id's rows the text of the least hash counts, of its labels the greatest.
    """
    known = labels.where(F.col(f"`{id}`").isNotNull() & F.col(f"`{label}`").isNotNull() & ~held_out(F.col(f"`{id}`"), folds))
    known = known.groupBy(F.col(f"`{id}`").alias("key")).agg(F.max(F.col(f"`{label}`")).cast("int").alias("y"))
    n = known.count()
    share = min(1.0, max_labelled / n) if n else 1.0
    # Bounded by max_labelled, as each id has one row.
    chosen = F.broadcast(known.where(F.pmod(F.xxhash64("key", F.lit("bytes")), F.lit(1_000_000)) < int(share * 1_000_000)))
    rows = docs.select(F.col(f"`{id}`").alias("key"), F.col(f"`{text}`").alias("text")).join(chosen, "key")
    one = rows.groupBy("key").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [spread_chunks(t, max_chunks) for t in b["text"]]
            if found:
                yield pd.DataFrame({"key": b["key"].astype(str), "y": b["y"], "size": [len(c) for c in found], "chunks": [c.tobytes() for c in found]})

    return one.mapInPandas(run, "key string, y int, size int, chunks binary")


def fit_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality",
    max_labelled: int = 4_000, max_chunks: int = 8, epochs: int = 14, folds: int = 5,
) -> ByteNet:
    """Train the network on a bounded sample outside the held-out fold.

    The driver gets at most about ``max_labelled`` documents of ``max_chunks`` chunks each, evenly
    over their texts: 16 MB. Equal input gives an equal network. Without labels of both
    kinds the network says the share of label 1 (0.5 if there is none).
    """
    small_batches(docs.sparkSession)
    rows = labelled_chunks(docs, labels, text, id, label, max_labelled, max_chunks, folds).collect()
    rows.sort(key=lambda r: (r.key, r.y))
    y = np.array([r.y for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return ByteNet.constant(float(y.mean()) if len(y) else 0.5)
    net = ByteNet.start(7, float(y.mean()))
    net.fit([np.frombuffer(r.chunks, np.uint8).reshape(r.size, -1) for r in rows], y, epochs)
    return net


def score_quality(docs: DataFrame, net: ByteNet, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, ``score`` and ``predicted`` (1 from ``threshold``). No shuffle.

    Texts are scored a megabyte at a time, longer ones alone, in slices: memory grows with the
    longest text only. A null text scores as an empty one.
    """

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, pack, size = [], [], 0
            for t in texts:
                pack.append(padded(t))
                size += len(pack[-1])
                if size >= PACK_BYTES:
                    out.append(net.scores(pack))
                    pack, size = [], 0
            if pack:
                out.append(net.scores(pack))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scored = docs.select(row, rate(F.col(f"`{text}`")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def byte_quality(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", threshold: float = 0.3, folds: int = 5, **options) -> DataFrame:
    """Fit on labelled rows, score every row: ``doc_id, held_out, score, predicted``.

    Only the bytes of a text count; labels of the held-out fold, languages, sources and ids do not.
    Repeated rows get equal scores (up to rounding); null ids are kept; labels of unknown
    documents and null labels do no harm. An empty table gives an empty result.
    """
    net = fit_quality(docs, labels, text, id, label, folds=folds, **options)
    own = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scored = score_quality(own, net, threshold=threshold)
    return scored.select("row.doc_id", held_out(F.col("row.doc_id"), folds).alias("held_out"), "score", "predicted")
