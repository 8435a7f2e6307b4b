"""Image operators: Arrow batches of decoded images, and descriptors of pictures held as arrays."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortal.functions import pixels as X
from cohortal.session import broadcast_if_small, materialize


def _arrays(height, width, bgr, mask) -> Iterator[tuple[np.ndarray | None, np.ndarray | None]]:
    """Decoded image and mask per row; None for a row that is missing or of another size."""
    for h, w, b, m in zip(height, width, bgr, mask, strict=True):
        if pd.isna(h) or pd.isna(w) or b is None or m is None or len(b) != 3 * h * w or len(m) != h * w:
            yield None, None
        else:
            h, w = int(h), int(w)
            yield np.frombuffer(b, np.uint8).reshape(h, w, 3), np.frombuffer(m, np.uint8).reshape(h, w) > 0


def _per_image(f):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(height: pd.Series, width: pd.Series, bgr: pd.Series, mask: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else f(a, m) for a, m in _arrays(height, width, bgr, mask)], dtype=object)

    return run


#: Columns height, width, bgr (bytes), mask (bytes) to arrays; null where the row cannot be read.
handcrafted_features = _per_image(X.handcrafted)
image_features = _per_image(X.image_features)
border_block_of_otsu = _per_image(lambda a, m: [X.border(o := X.otsu_mask(a))[0], *X.minkowski(o)])


@F.pandas_udf(T.StructType().add("phash", T.LongType()).add("dhash", T.LongType()))
def image_hashes(height: pd.Series, width: pd.Series, bgr: pd.Series, mask: pd.Series) -> pd.DataFrame:
    """Perceptual and difference hash as signed 64-bit integers."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(None, None) if a is None else (signed(X.perceptual_hash(a)), signed(X.difference_hash(a))) for a, _ in _arrays(height, width, bgr, mask)]
    return pd.DataFrame(rows, columns=["phash", "dhash"]).astype("Int64")


@F.pandas_udf(T.StructType().add("mae", T.DoubleType()).add("max", T.IntegerType()))
def pixel_difference(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Mean and greatest absolute difference of two images of equal size."""
    rows = []
    for x, y in zip(a, b, strict=True):
        d = abs(np.frombuffer(x, np.uint8).astype(int) - np.frombuffer(y, np.uint8).astype(int)) if len(x) == len(y) else None
        rows.append((None, None) if d is None or not len(d) else (float(d.mean()), int(d.max())))
    return pd.DataFrame(rows, columns=["mae", "max"]).astype({"mae": "float64", "max": "Int32"})


def dehaired(height: str = "height", width: str = "width", bgr: str = "bgr") -> Column:
    @F.pandas_udf("binary")
    def run(h: pd.Series, w: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([X.dehair(np.frombuffer(d, np.uint8).reshape(int(y), int(x), 3)).tobytes() for y, x, d in zip(h, w, b, strict=True)], dtype=object)

    return run(height, width, bgr)


def near_duplicate_images(images: DataFrame, id: str = "id", max_mae: float = 1.0) -> DataFrame:
    """Links between images of equal size: ``member_1, member_2, pixel_mae, pixel_max_abs_difference``.

    Exact copies are linked to the one of the least id only, so that n copies give n - 1 links. These
    representatives are linked if both hashes are equal and their pixels differ by at most ``max_mae`` on
    average; pixels are fetched for the members of such pairs only. Rows of one id count as several if
    their pixels differ; rows without an id or that cannot be read have no link.
    """
    own = F.sha2("bgr", 256)
    hashes = image_hashes("height", "width", "bgr", "mask")
    h = images.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), own.alias("own"), "height", "width", hashes.alias("h"))
    h = materialize(h.select("id", "own", "height", "width", "h.phash", "h.dhash").where("phash is not null").dropDuplicates(["id", "own", "height", "width"]))
    reps = materialize(h.groupBy("own", "height", "width").agg(F.min("id").alias("rep"), F.first("phash").alias("phash"), F.first("dhash").alias("dhash")))
    copies = h.join(reps.drop("phash", "dhash"), ["own", "height", "width"]).where("id != rep")
    copies = copies.select(F.col("rep").alias("member_1"), F.col("id").alias("member_2"), F.lit(0.0).alias("pixel_mae"), F.lit(0).alias("pixel_max_abs_difference"))
    on = ["height", "width", "phash", "dhash"]
    side = lambda k: reps.select(*on, F.col("rep").alias(f"member_{k}"), F.col("own").alias(f"own_{k}"))
    pairs = materialize(side(1).join(side(2), on).where("member_1 < member_2").drop("phash", "dhash"))
    of = lambda k: pairs.select(F.col(f"member_{k}").alias("id"), F.col(f"own_{k}").alias("own"))
    wanted = materialize(of(1).union(of(2)).distinct())
    found = images.select(F.col(id).alias("id"), own.alias("own"), "height", "width", "bgr").join(broadcast_if_small(wanted), ["id", "own"], "left_semi")
    found = found.dropDuplicates(["id", "own", "height", "width"])
    for k, name in ((1, "a"), (2, "b")):
        pixels = found.select(F.col("id").alias(f"member_{k}"), F.col("own").alias(f"own_{k}"), "height", "width", F.col("bgr").alias(name))
        pairs = pairs.join(pixels, [f"member_{k}", f"own_{k}", "height", "width"])
    pairs = pairs.withColumn("d", pixel_difference("a", "b")).where(F.col("d.mae") <= max_mae)
    return copies.unionByName(pairs.select("member_1", "member_2", F.col("d.mae").alias("pixel_mae"), F.col("d.max").alias("pixel_max_abs_difference")))


def with_fallback(
    rows: DataFrame, prepared: DataFrame, raw: DataFrame, key: Sequence[str], content: Sequence[str],
    readable: Column | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, tags: tuple[str, str] = ("dehair_file", "dehair_fallback_raw"),
) -> DataFrame:
    """Rows with the content of their prepared image, or else of the raw one, and ``view_source`` that tells which.

    ``prepared`` and ``raw`` have a row per key at most, with the columns ``content``; an image counts if
    ``readable`` holds for it (default: all content is there). ``prepare`` is applied to what comes
    from the raw side. Only raw images of rows without a prepared one travel. A row with neither
    keeps nulls and a null tag.
    """
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in content]) if readable is None else F.coalesce(readable, F.lit(False))
    first = prepared.where(ok).select(*key, *content)
    lacking = rows.select(*key).join(first.select(*key), list(key), "left_anti").distinct()
    second = raw.where(ok).select(*key, *content).join(lacking, list(key), "left_semi")
    second = second if prepare is None else prepare(second)
    tagged = first.withColumn("view_source", F.lit(tags[0])).unionByName(second.withColumn("view_source", F.lit(tags[1])))
    return rows.join(tagged, list(key), "left")


def embedded_views(
    rows: DataFrame, prepared: DataFrame, raw: DataFrame, key: Sequence[str], content: Sequence[str], model, schema: str, batch: int = 16, **options
) -> DataFrame:
    """Embeddings of each row's view: the rows' columns, ``view_source``, the columns of ``schema``, ``error``.

    A row without an image has the error ``missing``; one whose inference fails has that error, and the
    rest goes on (see ``infer``; the model sees the content columns).
    """
    viewed = with_fallback(rows, prepared, raw, key, content, **options)
    return infer(viewed, model, content, schema, batch, keep=[*rows.columns, "view_source"], missing=F.col("view_source").isNull())


def infer(
    images: DataFrame, model, columns: Sequence[str], schema: str, batch: int = 16, keep: Sequence[str] = (), missing: Column | None = None
) -> DataFrame:
    """Run a model over images in batches: ``model()`` opens a session once per task.

    The session maps a list of column tuples to a list of result tuples. A batch that fails is tried
    row by row; a row that fails gets nulls and its error, and the job goes on. Rows that are
    ``missing`` are not shown to the model. The columns ``keep`` come before the results.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    lacks = F.lit(False) if missing is None else F.coalesce(missing, F.lit(True))
    kept = ", ".join(f"`{c}` {t}" for c, t in images.select(*keep).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = model()
        for pdf in batches:
            there = ~pdf["_lacks"].to_numpy(bool)
            rows = list(pdf.loc[there, list(columns)].itertuples(index=False, name=None))
            out = []
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                try:
                    out += [(*r, None) for r in session(part)]
                except Exception:
                    for one in part:
                        try:
                            out.append((*session([one])[0], None))
                        except Exception as e:
                            out.append((*[None] * len(names), f"{type(e).__name__}: {e}"))
            done = iter(out)
            all_rows = [next(done) if t else (*[None] * len(names), "missing") for t in there]
            found = pd.DataFrame(all_rows, columns=[*names, "error"], index=pdf.index, dtype=object)
            yield pd.concat([pdf[list(keep)], found], axis=1)

    shown = images.select(*dict.fromkeys([*keep, *columns]), lacks.alias("_lacks"))
    return shown.mapInPandas(run, f"{kept + ', ' if kept else ''}{schema}, error string")


def mask_of(values: str) -> Column:
    """Which entries of an array are above 0; null and NaN are not."""
    return F.transform(values, lambda v: F.coalesce((v > 0) & ~F.isnan(v.cast("double")), F.lit(False)))


def asymmetry_table(df: DataFrame, id: str, values: str, width: int) -> DataFrame:
    """Correlation of row and column sums of the mask of each picture, over the shorter side; 1 where undefined.

    Pictures are arrays, row by row, of ``width`` values each; all sums stay in their row of the table.
    """
    m = df.where(F.size(values) > 0).select(id, F.transform(mask_of(values), lambda b: b.cast("long")).alias("m"))
    height = F.ceil(F.size("m") / width).cast("int")
    rows = F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.aggregate(F.slice("m", y * width + 1, width), F.lit(0).cast("long"), lambda a, v: a + v))
    zero = F.array_repeat(F.lit(0).cast("long"), width)
    add = lambda a, y: F.zip_with(a, F.slice("m", y * width + 1, width), lambda p, q: p + F.coalesce(q, F.lit(0)))
    cols = F.aggregate(F.sequence(F.lit(0), height - 1), zero, add)
    n = F.least(height, F.lit(width))
    both = m.select(id, n.cast("double").alias("n"), F.zip_with(F.slice(rows, 1, n), F.slice(cols, 1, n), lambda r, c: F.struct(r.alias("r"), c.alias("c"))).alias("p"))
    total = lambda f: F.aggregate(F.transform("p", f), F.lit(0).cast("long"), lambda a, v: a + v).cast("double")
    sums = both.select(
        id, "n", total(lambda p: p["r"]).alias("sr"), total(lambda p: p["c"]).alias("sc"), total(lambda p: p["r"] * p["r"]).alias("rr"),
        total(lambda p: p["c"] * p["c"]).alias("cc"), total(lambda p: p["r"] * p["c"]).alias("rc"),
    )
    cov, vr, vc = (F.expr(e) for e in ("n * rc - sr * sc", "n * rr - sr * sr", "n * cc - sc * sc"))
    return sums.select(id, F.when((vr > 0) & (vc > 0), cov / F.sqrt(F.when(vr * vc > 0, vr * vc))).otherwise(1.0).alias("a4"))


def box_counts(df: DataFrame, id: str, values: str, width: int, sizes: Sequence[int]) -> DataFrame:
    """Occupied boxes of all sizes per picture, and the slope of log count on log 1 / size; pictures without a mask have no row."""
    m = df.select(id, mask_of(values).alias("m")).where(F.exists("m", lambda b: b))

    def occupied(size: int) -> Column:
        across = -(-width // size)
        down = F.ceil(F.size("m") / (width * size)).cast("int")

        def hit(box: Column) -> Column:
            top, left = F.floor(box / across).cast("int") * size, F.pmod(box, F.lit(across)) * size
            line = lambda dy: F.slice("m", (top + dy) * width + left + 1, F.least(F.lit(size), width - left))
            return F.exists(F.sequence(F.lit(0), F.lit(size - 1)), lambda dy: F.exists(line(dy), lambda b: b))

        return F.size(F.filter(F.sequence(F.lit(0), down * across - 1), hit)).cast("long")

    counts = m.select(id, *[occupied(s).alias(f"n{s}") for s in sizes])
    x = np.array([-math.log(s) for s in sizes])
    off = x - x.mean()
    slope = sum((F.lit(float(o)) * F.ln(f"n{s}") for o, s in zip(off, sizes, strict=True)), F.lit(0.0)) / F.nullif(F.lit(float(off @ off)), F.lit(0.0))
    return counts.select(id, sum((F.col(f"n{s}") for s in sizes), F.lit(0)).alias("boxes"), slope.alias("dimension"))


def moments_table(df: DataFrame, id: str, values: str) -> DataFrame:
    """Population moments of the values above 0 per picture; zero where constant, no row where there are none."""
    on = df.select(id, F.filter(F.transform(values, lambda v: v.cast("double")), lambda v: (v > 0) & ~F.isnan(v)).alias("v")).where(F.size("v") > 0)
    total = lambda f: F.aggregate("v", F.lit(0.0), lambda a, v: a + f(v))
    mean = on.select(id, "v", F.size("v").cast("long").alias("n"), (total(lambda v: v) / F.size("v")).alias("mu"))
    power = lambda k: total(lambda v: F.pow(v - F.col("mu"), F.lit(float(k)))) / F.col("n")
    m = mean.select(id, "n", *[power(k).alias(f"m{k}") for k in (2, 3, 4)])
    some = F.col("m2") > 0
    skew, kurt = F.col("m3") / F.pow("m2", F.lit(1.5)), F.col("m4") / (F.col("m2") * F.col("m2")) - 3
    return m.select(id, "n", F.sqrt("m2").alias("std"), F.when(some, skew).otherwise(0.0).alias("skew"), F.when(some, kurt).otherwise(0.0).alias("kurt"))


def cooccurrence_table(df: DataFrame, id: str, values: str, width: int, level: Callable[[Column], Column], levels: int) -> DataFrame:
    """Contrast, dissimilarity, homogeneity, energy and correlation of right and lower neighbours above 0, each pair both ways.

    ``level`` maps a value to 0 to ``levels`` - 1. Correlation is 1 where all levels are equal. A picture
    without a pair has no row.
    """
    kept = lambda v: F.when((v > 0) & ~F.isnan(v), level(v).cast("int"))
    q = df.where(F.size(values) > 0).select(id, F.transform(F.transform(values, lambda v: v.cast("double")), kept).alias("l"))
    at = F.sequence(F.lit(0), F.size("l") - 1)
    beside = lambda step, where: F.transform(at, lambda i: F.when(where(i), F.struct(F.get("l", i - step).alias("a"), F.get("l", i).alias("b"))))
    pairs = F.concat(beside(1, lambda i: i % width != 0), beside(width, lambda i: i >= width))
    q = q.select(id, F.filter(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull()).alias("p")).where(F.size("p") > 0)
    codes = F.array_sort(F.concat(F.transform("p", lambda p: p["a"] * levels + p["b"]), F.transform("p", lambda p: p["b"] * levels + p["a"])))
    long = lambda v: F.lit(v).cast("long")

    def count(acc: Column, code: Column) -> Column:
        # A cell that grows from r to r + 1 adds 2 r + 1 to the sum of squares.
        run = F.when(code == acc["code"], acc["run"]).otherwise(long(0))
        return F.struct(code.alias("code"), (run + 1).alias("run"), (acc["squares"] + 2 * run + 1).alias("squares"))

    squares = F.aggregate(codes, F.struct(F.lit(-1).alias("code"), long(0).alias("run"), long(0).alias("squares")), count, lambda acc: acc["squares"])
    d = lambda p: p["a"] - p["b"]
    total = lambda f: F.aggregate(F.transform("p", f), long(0), lambda a, v: a + v).cast("double")
    near = F.aggregate("p", F.lit(0.0), lambda a, p: a + F.lit(1.0) / (1 + d(p) * d(p)))
    s = q.select(
        id, F.size("p").cast("double").alias("n"), squares.cast("double").alias("squares"), near.alias("near"), total(lambda p: F.abs(d(p))).alias("d1"), total(lambda p: d(p) * d(p)).alias("d2"),
        total(lambda p: p["a"] + p["b"]).alias("s"), total(lambda p: p["a"] * p["a"] + p["b"] * p["b"]).alias("q"), total(lambda p: p["a"] * p["b"]).alias("x"),
    )
    n = F.col("n")
    # Whole numbers, so that equal levels give exactly 0.
    var, cov = 2 * n * F.col("q") - F.col("s") * F.col("s"), 4 * n * F.col("x") - F.col("s") * F.col("s")
    return s.select(
        id, (F.col("d2") / n).alias("contrast"), (F.col("d1") / n).alias("dissimilarity"), (F.col("near") / n).alias("homogeneity"),
        (F.sqrt("squares") / (2 * n)).alias("energy"), F.when(var > 0, cov / F.when(var > 0, var)).otherwise(1.0).alias("correlation"),
    )
