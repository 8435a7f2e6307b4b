"""Image operators over the 64 values of an embedding as an 8 x 8 picture."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortal.operators import image as I
from cohortal.operators import inference as N
from cohortal.operators import picture as P
from cohortal.plans.registry import query
from cohortal.plans.views import rounded
from cohortal.session import table
from cohortal.sources import graphs

PIX = """pix AS (SELECT vec_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""


@query(
    f"""{PIX}, r AS (SELECT vec_id, y AS k, sum((v > 0)::INT)::DOUBLE AS r FROM pix GROUP BY ALL), c AS (SELECT vec_id, x AS k, sum((v > 0)::INT)::DOUBLE AS c FROM pix GROUP BY ALL)
    SELECT vec_id, round(CASE WHEN stddev_pop(r) > 0 AND stddev_pop(c) > 0 THEN corr(r, c) ELSE 1 END, 6) AS a4 FROM r JOIN c USING (vec_id, k) GROUP BY vec_id""",
    " ",
)
def picture_asymmetry(spark, sf_dir):
    return rounded(I.asymmetry_table(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8))


@query(
    f"""{PIX}, n AS (SELECT vec_id, size, count(DISTINCT (y // size, x // size)) AS n FROM pix, (SELECT unnest([1, 2, 4]) AS size) WHERE v > 0 GROUP BY ALL)
    SELECT vec_id, CAST(sum(n) AS BIGINT) AS boxes, round(regr_slope(ln(n), -ln(size)), 6) AS dimension FROM n GROUP BY vec_id""",
    " ",
)
def picture_box_dimension(spark, sf_dir):
    return rounded(I.box_counts(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, [1, 2, 4]))


@query(
    f"""{PIX}, m AS (SELECT vec_id, v, avg(v) OVER (PARTITION BY vec_id) AS mu FROM pix WHERE v > 0),
    s AS (SELECT vec_id, count(*) AS n, avg((v - mu) ** 2) AS m2, avg((v - mu) ** 3) AS m3, avg((v - mu) ** 4) AS m4 FROM m GROUP BY vec_id)
    SELECT vec_id, n, round(sqrt(m2), 6) AS std, round(CASE WHEN m2 > 0 THEN m3 / m2 ** 1.5 ELSE 0 END, 6) AS skew, round(CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 ELSE 0 END, 6) AS kurt FROM s""",
    " ",
)
def picture_moments(spark, sf_dir):
    return rounded(I.moments_table(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


@query(
    f"""{PIX}, q AS (SELECT vec_id, y, x, CAST(least(floor(v * 16), 15) AS INT) AS l FROM pix WHERE v > 0),
    p AS (SELECT a.vec_id, a.l AS a, b.l AS b FROM q a JOIN q b ON a.vec_id = b.vec_id AND ((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x))),
    s AS (SELECT vec_id, a, b FROM p UNION ALL SELECT vec_id, b, a FROM p), c AS (SELECT vec_id, a, b, count(*) AS n FROM s GROUP BY ALL), n AS (SELECT *, sum(n) OVER (PARTITION BY vec_id)::DOUBLE AS t FROM c),
    u AS (SELECT vec_id, sum(n / t * a) AS mu, sum(n * a * a) * max(t) - sum(n * a) ** 2 AS var FROM n GROUP BY vec_id)
    SELECT vec_id, round(sum(n / t * (a - b) * (a - b)), 6) AS contrast, round(sum(n / t * abs(a - b)), 6) AS dissimilarity, round(sum(n / t / (1 + (a - b) * (a - b))), 6) AS homogeneity, round(sqrt(sum(n / t * n / t)), 6) AS energy,
      round(CASE WHEN max(var) > 0 THEN sum(n / t * (a - mu) * (b - mu)) / max(var) * max(t) * max(t) ELSE 1 END, 6) AS correlation
    FROM n JOIN u USING (vec_id) GROUP BY vec_id""",
    " ",
)
def picture_cooccurrence(spark, sf_dir):
    level = lambda v: F.least(F.floor(v * 16), F.lit(15))
    return rounded(I.cooccurrence_table(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, level, 16))


@query(
    """SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN 'dehair_file' WHEN vec_id % 3 <> 0 THEN 'dehair_fallback_raw' END AS view_source,
      CASE WHEN vec_id % 7 = 0 AND vec_id % 3 = 0 THEN 'missing' WHEN vec_id % 11 = 0 THEN 'ValueError: dark' END AS error,
      CASE WHEN vec_id % 11 <> 0 AND (vec_id % 7 <> 0 OR vec_id % 3 <> 0) THEN round(list_sum(list_transform(range(1, 33), lambda k:
        floor(64 * embedding[k + CASE WHEN vec_id % 7 <> 0 THEN 0 ELSE 32 END]::DOUBLE) + 512)) / 32, 6) END AS mean FROM embeddings"""
)
def view_fallback(spark, sf_dir):
    """Embeddings of prepared views, of raw ones where these lack, and what fails, with a mean as the model."""
    e = table(spark, sf_dir, "embeddings")
    half = lambda lo: F.transform(F.slice("embedding", lo, 32), lambda v: F.floor(v.cast("double") * 64) + 512)
    prepared = e.where("vec_id % 7 <> 0").select("vec_id", half(1).alias("pixels"), (F.col("vec_id") % 11 == 0).alias("dark"))
    raw = e.where("vec_id % 3 <> 0").select("vec_id", half(33).alias("pixels"), (F.col("vec_id") % 11 == 0).alias("dark"))

    def model():
        def run(rows):
            if any(dark for _, dark in rows):
                raise ValueError("dark")
            return [(float(sum(pixels)) / len(pixels),) for pixels, _ in rows]

        return run

    return rounded(I.embedded_views(e.select("vec_id"), prepared, raw, ["vec_id"], ["pixels", "dark"], model, "mean double"))


@query()
def picture_descriptors(spark, sf_dir):
    """All 18 descriptors of the picture scaled to bytes; checked by tests on known shapes."""
    e = table(spark, sf_dir, "embeddings")
    byte = F.transform("embedding", lambda v: F.lpad(F.hex(F.least(F.greatest(F.floor((v + 4) * 32), F.lit(0)), F.lit(255))), 2, "0"))
    on = F.transform("embedding", lambda v: F.when(v > 0, "01").otherwise("00"))
    images = e.select(
        "vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.unhex(F.array_join(F.transform(byte, lambda b: F.concat(b, b, b)), "")).alias("bgr"), F.unhex(F.array_join(on, "")).alias("mask"),
    )
    names = [n.lower() for n in I.X.NAMES]
    f = images.select("vec_id", I.handcrafted_features("height", "width", "bgr", "mask").alias("f"))
    return rounded(f.select("vec_id", *[F.get("f", F.lit(k)).alias(n) for k, n in enumerate(names)]))


_BYTE = "least(greatest(floor(256 * embedding[{0}]::DOUBLE) + 128, 0), 255)"
#: Three channels, gray and mask of the picture, in SQL a row per pixel with lists of the whole picture beside it.
CHANNELS = f"""chan AS (SELECT vec_id, list_transform(range(0, 64), lambda i: {_BYTE.format("i + 1")}) AS b, list_transform(range(0, 64), lambda i: {_BYTE.format("(i + 16) % 64 + 1")}) AS g,
  list_transform(range(0, 64), lambda i: {_BYTE.format("(i + 32) % 64 + 1")}) AS r, list_transform(range(0, 64), lambda i: embedding[i + 1] > 0) AS m FROM embeddings),
shade AS (SELECT *, list_transform(range(0, 64), lambda i: round_even(0.114::DOUBLE * b[i + 1] + 0.587::DOUBLE * g[i + 1] + 0.299::DOUBLE * r[i + 1], 0)) AS y FROM chan),
dots AS (SELECT vec_id, p, p // 8 AS py, p % 8 AS px, b[p + 1] AS b, g[p + 1] AS g, r[p + 1] AS r, m[p + 1] AS m, y[p + 1] AS y FROM (SELECT *, unnest(range(0, 64)) AS p FROM shade))"""


def channels(spark, sf_dir):
    """Bytes ``b, g, r`` and the mask ``m`` of the picture of each embedding; ``y`` is its gray."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    byte = lambda v: F.least(F.greatest(F.floor(v * 256) + 128, F.lit(0)), F.lit(255)).cast("double")
    turned = lambda k: F.concat(F.slice("e", k + 1, 64 - k), F.slice("e", 1, k)) if k else F.col("e")
    c = e.select("vec_id", *[F.transform(turned(k), byte).alias(n) for n, k in (("b", 0), ("g", 16), ("r", 32))], F.transform("e", lambda v: v > 0).alias("m"))
    return c.withColumn("y", P.gray(F.col("b"), F.col("g"), F.col("r")))


def _cols(names: str):
    return [F.col(n) for n in names]


_MOMENTS = "round(coalesce(CASE WHEN {c}2 > 1e-24 THEN {f} ELSE 0 END, 0), 6)"


@query(
    f"""{CHANNELS}, lin AS (SELECT vec_id, list_transform([r, g, b], lambda v: CASE WHEN v / 255 > 0.04045 THEN pow((v / 255 + 0.055) / 1.055::DOUBLE, 2.4) ELSE v / 255 / 12.92::DOUBLE END) AS c FROM dots WHERE m),
    xyz AS (SELECT vec_id, [{", ".join(f"({' + '.join(f'{w}::DOUBLE * c[{i + 1}]' for i, w in enumerate(row))}) / {white}::DOUBLE" for row, white in zip(P.XYZ, P.WHITE, strict=True))}] AS t FROM lin),
    f AS (SELECT vec_id, list_transform(t, lambda v: CASE WHEN v > 0.008856 THEN cbrt(v) ELSE 7.787::DOUBLE * v + 16 / 116::DOUBLE END) AS f FROM xyz),
    ab AS (SELECT vec_id, round_even(greatest(least(500 * (f[1] - f[2]) + 128, 255), 0), 0) AS a, round_even(greatest(least(200 * (f[2] - f[3]) + 128, 255), 0), 0) AS b FROM f),
    mu AS (SELECT *, avg(a) OVER (PARTITION BY vec_id) AS ma, avg(b) OVER (PARTITION BY vec_id) AS mb FROM ab),
    s AS (SELECT vec_id, avg((a - ma) ** 2) AS a2, avg((a - ma) ** 4) AS a4, avg((b - mb) ** 2) AS b2, avg((b - mb) ** 3) AS b3 FROM mu GROUP BY vec_id)
    SELECT chan.vec_id, {_MOMENTS.format(c="a", f="a4 / (a2 * a2) - 3")} AS a_kurt, {_MOMENTS.format(c="b", f="sqrt(b2)")} AS b_std, {_MOMENTS.format(c="a", f="sqrt(a2)")} AS a_std,
      {_MOMENTS.format(c="b", f="b3 / b2 ** 1.5")} AS b_skew FROM chan LEFT JOIN s ON s.vec_id = chan.vec_id""",
    " ",
)
def picture_colour(spark, sf_dir):
    """Moments of Lab under the mask."""
    return rounded(channels(spark, sf_dir).select("vec_id", P.colour_moments(*_cols("bgrm")).alias("c")).select("vec_id", "c.*"))


_NEAR = " + ".join(f"(y[least(greatest(p // 8 + {dy}, 0), 7) * 8 + least(greatest(p % 8 + {dx}, 0), 7) + 1] >= y[p + 1])::INT * {1 << k}" for k, (dy, dx) in enumerate(P.AROUND))


@query(
    f"""{CHANNELS}, code AS (SELECT vec_id, {_NEAR} AS c FROM (SELECT *, unnest(range(0, 64)) AS p FROM shade) WHERE m[p + 1]),
    n AS (SELECT *, sum(k) OVER (PARTITION BY vec_id)::DOUBLE AS n FROM (SELECT vec_id, c, count(*) AS k FROM code GROUP BY vec_id, c)),
    s AS (SELECT vec_id, -sum(k / n * log2(k / n)) AS entropy, sum(k / n * k / n) AS uniformity FROM n GROUP BY vec_id)
    SELECT chan.vec_id, round(coalesce(entropy, 0) + 0.0, 6) AS entropy, round(coalesce(uniformity, 0), 6) AS uniformity FROM chan LEFT JOIN s ON s.vec_id = chan.vec_id""",
    " ",
)
def picture_patterns(spark, sf_dir):
    """Entropy and uniformity of binary patterns under the mask."""
    return rounded(channels(spark, sf_dir).select("vec_id", P.binary_patterns(F.col("y"), F.col("m"), 8).alias("t")).select("vec_id", "t.*"))


@query(
    f"""{CHANNELS}, q AS (SELECT vec_id, b, g, r, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM dots WHERE m),
    h AS (SELECT vec_id, v, CASE WHEN v > 0 THEN 255 * d / v ELSE 0 END AS s, CASE WHEN d = 0 THEN 0 WHEN v = r THEN CASE WHEN (g - b) / d < 0 THEN (g - b) / d + 6 ELSE (g - b) / d END WHEN v = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END * pi() / 3 AS h,
      floor(b / 32) * 64 + floor(g / 32) * 8 + floor(r / 32) AS bin FROM q),
    s AS (SELECT vec_id, least(sqrt(avg(cos(h)) ** 2 + avg(sin(h)) ** 2), 1) AS l, avg(s) AS sat_mean, stddev_pop(s) AS sat_std, stddev_pop(v) AS val_std, count(*) AS n FROM h GROUP BY vec_id),
    c AS (SELECT vec_id, count(*) AS n_colors FROM (SELECT vec_id, bin, count(*) AS k, sum(count(*)) OVER (PARTITION BY vec_id) AS n FROM h GROUP BY vec_id, bin) WHERE k > 0.01 * n GROUP BY vec_id)
    SELECT chan.vec_id, round(coalesce(CASE WHEN l > 1e-9 THEN sqrt(greatest(-2 * ln(l), 0)) END, 0), 6) AS hue_std, round(coalesce(sat_mean, 0), 6) AS sat_mean, round(coalesce(sat_std, 0), 6) AS sat_std,
      round(coalesce(val_std, 0), 6) AS val_std, coalesce(n_colors, 0) AS n_colors FROM chan LEFT JOIN s ON s.vec_id = chan.vec_id LEFT JOIN c ON c.vec_id = chan.vec_id""",
    " ",
)
def picture_spread(spark, sf_dir):
    """Spread of hue, saturation, value and colours under the mask."""
    return rounded(channels(spark, sf_dir).select("vec_id", P.colour_spread(*_cols("bgrm")).alias("c")).select("vec_id", "c.*"))


@query(
    f"""{CHANNELS}, basis AS (SELECT u, k, sum(cos(pi() * (2 * i + 1) * u / 64) * sqrt(CASE WHEN u = 0 THEN 1 ELSE 2 END / 32)) AS w FROM (SELECT u, i, i // 4 AS k FROM (SELECT unnest(range(0, 8)) AS u), (SELECT unnest(range(0, 32)) AS i)) GROUP BY u, k),
    c AS (SELECT vec_id, a.u * 8 + b.u AS pos, sum(a.w * b.w * y) AS c FROM dots JOIN basis a ON a.k = py JOIN basis b ON b.k = px GROUP BY ALL),
    md AS (SELECT vec_id, median(c) AS md FROM c WHERE pos > 0 GROUP BY vec_id),
    ph AS (SELECT vec_id, string_agg(CASE WHEN c > md THEN '1' ELSE '0' END, '' ORDER BY pos) AS phash FROM c JOIN md USING (vec_id) GROUP BY vec_id),
    nine AS (SELECT t, k, greatest(least((t + 1) * 8 / 9, k + 1) - greatest(t * 8 / 9, k), 0) * 9 / 8 AS w FROM (SELECT unnest(range(0, 9)) AS t), (SELECT unnest(range(0, 8)) AS k)),
    small AS (SELECT vec_id, py, t, round_even(round(sum(w * y), 9), 0) AS v FROM dots JOIN nine ON k = px GROUP BY ALL),
    dh AS (SELECT a.vec_id, string_agg(CASE WHEN b.v > a.v THEN '1' ELSE '0' END, '' ORDER BY a.py, a.t) AS dhash FROM small a JOIN small b ON a.vec_id = b.vec_id AND a.py = b.py AND b.t = a.t + 1 GROUP BY a.vec_id)
    SELECT vec_id, phash, dhash FROM ph JOIN dh USING (vec_id)""",
    " ",
)
def picture_hashes(spark, sf_dir):
    """Perceptual and difference hash as bits."""
    y = F.col("y")
    return channels(spark, sf_dir).select("vec_id", P.as_bits(P.perceptual_bits(y, 8)).alias("phash"), P.as_bits(P.difference_bits(y, 8)).alias("dhash"))


@query(
    f"""{CHANNELS}, l AS (SELECT vec_id, m, y, list_transform(m, lambda x: x::INT) AS m01, list_transform(range(0, 64), lambda i: 1 / (1 + exp(-(b[i + 1] - 140) / 16)) > 0.5) AS net FROM shade),
    c AS (SELECT *, list_avg(list_transform(net, lambda x: x::INT)) AS cov FROM l),
    v AS (SELECT *, CASE WHEN cov >= 0.45 THEN net ELSE list_transform(range(0, 64), lambda i: (i // 8 - 4) ** 2 + (i % 8 - 4) ** 2 <= 4) END AS disk, CASE WHEN cov >= 0.45 THEN net ELSE list_transform(net, lambda x: true) END AS frame FROM c)
    SELECT vec_id, round(cov, 6) AS coverage, len(list_filter(disk, lambda x: x)) AS n_disk, len(list_filter(frame, lambda x: x)) AS n_frame,
      round(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN disk[i + 1] THEN y[i + 1] ELSE 0 END)), 6) AS shade_in_disk,
      round((2 * list_sum(list_transform(range(0, 64), lambda i: m01[i + 1] * net[i + 1]::INT)) + 1e-6) / (list_sum(m01) + list_sum(list_transform(net, lambda x: x::INT)) + 1e-6), 6) AS dice,
      list_sum(list_transform(range(0, 15), lambda i: CASE WHEN net[(i // 5) * 8 // 3 * 8 + (i % 5) * 8 // 5 + 1] THEN 1 << i ELSE 0 END))::BIGINT AS small FROM v""",
    " ",
)
def picture_masks(spark, sf_dir):
    """Masks from logits: coverage, fallbacks where it is low, what lies under them, overlap with another mask, a small copy."""
    c = channels(spark, sf_dir).withColumn("net", P.mask_from_logits(F.transform("b", lambda v: (v - 140) / 16)))
    number = lambda v: F.transform(v, lambda x: x.cast("int"))
    n = lambda v: F.size(F.filter(v, lambda x: x)).cast("long")
    c = c.withColumns({k: P.fallback_mask(F.col("net"), 8, 0.45, k) for k in ("disk", "frame")})
    small = P.nearest_resize(F.col("net"), 8, 3, 5)
    bits = F.aggregate(F.transform(small, lambda b, i: F.when(b, F.pow(F.lit(2.0), i)).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v).cast("long")
    return rounded(
        c.select(
            "vec_id", P.coverage(F.col("net")).alias("coverage"), n("disk").alias("n_disk"), n("frame").alias("n_frame"), P.total(P.apply_mask(F.col("y"), F.col("disk"))).alias("shade_in_disk"),
            P.dice(number("m"), number("net")).alias("dice"), bits.alias("small"),
        )
    )


@query(
    f"""{CHANNELS}, v AS (SELECT vec_id, y AS l, t, f, unnest(range(0, 64)) AS i FROM shade, (SELECT unnest(range(0, 4)) AS t), (SELECT unnest([false, true]) AS f)),
    w AS (SELECT vec_id, l, t, f, i, i // 8 AS y, CASE WHEN f THEN 7 - i % 8 ELSE i % 8 END AS x FROM v),
    s AS (SELECT vec_id, t, f, sum((i + 1) * l[CASE t WHEN 0 THEN y * 8 + x WHEN 1 THEN x * 8 + 7 - y WHEN 2 THEN (7 - y) * 8 + 7 - x ELSE (7 - x) * 8 + y END + 1]) AS s FROM w GROUP BY ALL)
    SELECT vec_id, round(avg(s), 6) AS mean_of_views FROM s GROUP BY vec_id""",
    " ",
)
def picture_views(spark, sf_dir):
    """Mean over eight views of a feature that depends on places."""
    place = lambda v: P.total(F.zip_with(v, P.places(v), lambda x, i: x * (i + 1.0)))
    return rounded(channels(spark, sf_dir).select("vec_id", P.over_orientations(F.col("y"), 8, place).alias("mean_of_views")))


@query(
    f"""{CHANNELS}, spot AS (SELECT o, (o + 0.5::DOUBLE) * 8 / 5 - 0.5 AS s, floor((o + 0.5::DOUBLE) * 8 / 5 - 0.5) AS k FROM (SELECT unnest(range(0, 5)) AS o)),
    w AS (SELECT o, CAST(least(greatest(k + d, 0), 7) AS INT) AS src, CASE d WHEN 0 THEN 1 - (s - k) ELSE s - k END AS w FROM spot, (SELECT unnest([0, 1]) AS d)),
    p AS (SELECT vec_id, ty.o AS oy, tx.o AS ox, sum(ty.w * tx.w * r) AS r, sum(ty.w * tx.w * g) AS g, sum(ty.w * tx.w * b) AS b FROM dots JOIN w ty ON ty.src = py JOIN w tx ON tx.src = px GROUP BY ALL)
    SELECT vec_id, {", ".join(f"round(avg(({c} / 255 - {m}) / {s}), 6) AS mean_{c}" for c, m, s in zip("rgb", P.CHANNEL_MEAN, P.CHANNEL_STD, strict=True))},
      round(max(CASE WHEN oy = 1 AND ox = 3 THEN (g / 255 - {P.CHANNEL_MEAN[1]}) / {P.CHANNEL_STD[1]} END), 6) AS g_1_3 FROM p GROUP BY vec_id""",
    " ",
)
def picture_network_input(spark, sf_dir):
    """Planes of 5 x 5 as a network takes them: their means and one value."""
    n = channels(spark, sf_dir).select("vec_id", P.network_input(*_cols("bgr"), 8, 5).alias("v"))
    plane = lambda k: F.aggregate(F.slice("v", 25 * k + 1, 25), F.lit(0.0), lambda a, v: a + v) / 25
    return rounded(n.select("vec_id", *[plane(k).alias(f"mean_{c}") for k, c in enumerate("rgb")], F.get("v", F.lit(25 + 8)).alias("g_1_3")))


#: A linear head per view, in place of trees: a row per feature, a column per class.
HEADS = {"a": (((0.9, -0.4, 0.1), (-0.3, 0.8, 0.2), (0.2, 0.1, -0.7)), (0.1, 0.0, -0.1)), "c": (((-0.2, 0.5, 0.3), (0.6, -0.1, 0.4), (0.1, 0.3, 0.2)), (0.0, 0.2, 0.1))}


def _plane(channel: str, mean: float, std: float) -> str:
    return f"list_avg(list_transform(range(0, 64), lambda i: ({channel} / 255 - {mean}) / {std}))"


_Z = " UNION ALL ".join(
    f"SELECT vec_id, '{k}' AS head, [{', '.join(f'{bias[c]} + ' + ' + '.join(f'{w[j][c]} * {v}[{j + 1}]' for j in range(3)) for c in range(3))}] AS z FROM views"
    for (k, (w, bias)), v in zip(HEADS.items(), ("lesion", "dehair"), strict=True)
)


@query(
    f"""{CHANNELS}, logit AS (SELECT *, list_transform(range(0, 64), lambda i: ({" + ".join(f"({c}[i + 1] / 255 - {m}) / {s}" for c, m, s in zip("rgb", P.CHANNEL_MEAN, P.CHANNEL_STD, strict=True))}) / 3 > 0) AS net FROM shade),
    views AS (SELECT vec_id, list_avg(list_transform(net, lambda x: x::INT)) AS coverage,
      [{", ".join(_plane(f"CASE WHEN net[i + 1] THEN {c}[i + 1] ELSE 0 END", m, s) for c, m, s in zip("rgb", P.CHANNEL_MEAN, P.CHANNEL_STD, strict=True))}] AS lesion,
      [{", ".join(_plane(f"{c}[i + 1]", m, s) for c, m, s in zip("rgb", P.CHANNEL_MEAN, P.CHANNEL_STD, strict=True))}] AS dehair FROM logit),
    z AS ({_Z}), e AS (SELECT vec_id, head, list_transform(z, lambda v: exp(v)) AS e FROM z),
    p AS (SELECT vec_id, avg(e[1] / list_sum(e)) AS p0, avg(e[2] / list_sum(e)) AS p1, avg(e[3] / list_sum(e)) AS p2 FROM e GROUP BY vec_id)
    SELECT vec_id, CASE WHEN vec_id % 10 <> 7 THEN round(coverage, 6) END AS coverage, CASE WHEN vec_id % 10 <> 7 THEN round(p0, 3) END AS score_nevus, CASE WHEN vec_id % 10 <> 7 THEN round(p1, 3) END AS score_mel, CASE WHEN vec_id % 10 <> 7 THEN round(p2, 3) END AS score_atyp,
      CASE WHEN vec_id % 10 <> 7 THEN CASE WHEN p1 >= 0.188 THEN 2 WHEN p2 >= 0.412 THEN 1 ELSE 0 END END AS verdict, CASE WHEN vec_id % 10 = 7 THEN 'missing' END AS error
    FROM views JOIN p USING (vec_id)""",
    " ",
)
def network_readout(spark, sf_dir):
    """Five networks one after the other (stand-ins with the real inputs and outputs), and the rows that have no picture."""
    size = 8
    models = {
        "mask": graphs.mean_over([1], ["n", 3, size, size], ["n", 1, size, size], True),
        **{k: graphs.mean_over([2, 3], ["n", 3, size, size], ["n", 3], False) for k in ("lesion", "dehair")},
        **{f"trees_{k}": graphs.linear_head(w, b) for k, (w, b) in HEADS.items()},
    }
    c = channels(spark, sf_dir)
    there = c.select("vec_id", *[F.when(F.col("vec_id") % 10 != 7, F.col(n)).alias(n) for n in "bgr"])
    out = N.classify_pictures(there, models, size, {"mask": size, "view": size})
    return rounded(out.select("vec_id", "coverage", *[F.round(s, 3).alias(s) for s in ("score_nevus", "score_mel", "score_atyp")], "verdict", "error"))
