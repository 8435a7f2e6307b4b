"""Descriptors and transforms of pictures held as arrays, row by row: expressions that never leave the JVM or their row.

A picture is one array per channel, of ``width`` values a line (a number or a column); a mask is an array of
booleans. All functions map columns to a column, null for a null picture.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB to XYZ of daylight, its white point, and the mean and deviation of channels that image networks expect.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: Neighbours of a pixel (dy, dx), clockwise from the upper left.
AROUND = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))


def let(*values: Column, use: Callable[..., Column]) -> Column:
    """``use`` of some values that are computed once: within ``use``, also inside lambdas, they are variables."""
    if not values:
        return use()
    first, *rest = values
    one = F.transform(F.array(first), lambda v: let(*rest, use=lambda *more: use(v, *more)))
    return F.get(one, F.lit(0))


def bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """Columns that a function is given are computed once each, whatever it does with them."""

    @functools.wraps(f)
    def run(*args, **options) -> Column:
        at = [k for k, a in enumerate(args) if isinstance(a, Column)]

        def use(*values: Column) -> Column:
            now = list(args)
            for k, v in zip(at, values, strict=True):
                now[k] = v
            return f(*now, **options)

        return let(*[args[k] for k in at], use=use)

    return run


def _int(v: int | Column) -> Column:
    return F.lit(v).cast("int") if isinstance(v, int) else v.cast("int")


def places(values: Column) -> Column:
    """Positions 0, 1, ... of an array; none for an empty one."""
    return F.filter(F.sequence(F.lit(0), F.size(values)), lambda i: i < F.size(values))


def total(values: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


@bound
def mean(values: Column) -> Column:
    """Mean of an array of doubles; null if it is empty."""
    return total(values) / F.nullif(F.size(values), F.lit(0))


@bound
def deviation(values: Column) -> Column:
    """Population deviation of an array of doubles; null if it is empty."""
    return let(mean(values), use=lambda m: F.sqrt(F.greatest(mean(F.transform(values, lambda v: (v - m) * (v - m))), F.lit(0.0))))


@bound
def moments(values: Column) -> Column:
    """Struct ``std, skew, kurt`` (excess) of an array of doubles, zeros for a constant, null if it is empty."""
    central = lambda m: [mean(F.transform(values, lambda v: F.pow(v - m, F.lit(float(k))))) for k in (2, 3, 4)]

    def of(m2: Column, m3: Column, m4: Column) -> Column:
        some = m2 > 1e-24
        safe = F.when(some, m2)
        parts = {"std": F.sqrt(m2), "skew": m3 / F.pow(safe, F.lit(1.5)), "kurt": m4 / (safe * safe) - 3}
        return F.struct(*[F.when(some, v).otherwise(0.0).alias(k) for k, v in parts.items()])

    return F.when(F.size(values) > 0, let(mean(values), use=lambda m: let(*central(m), use=of)))


def runs(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold over the values of an array that are equal: ``step(state, r)`` sees each value as the ``r + 1``-th of its kind.

    Counts of kinds follow from a sort, without a table of kinds.
    """
    zero = F.struct(F.lit(None).cast("long").alias("kind"), F.lit(0).cast("long").alias("run"), start.alias("state"))

    def one(acc: Column, v: Column) -> Column:
        r = F.when(acc["kind"].eqNullSafe(v), acc["run"]).otherwise(F.lit(0).cast("long"))
        return F.struct(v.alias("kind"), (r + 1).alias("run"), step(acc["state"], r).alias("state"))

    return F.aggregate(F.array_sort(F.transform(values, lambda v: v.cast("long"))), zero, one, lambda acc: acc["state"])


@bound
def masked(values: Column, mask: Column) -> Column:
    """The values inside the mask."""
    both = F.zip_with(values, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m")))
    return F.transform(F.filter(both, lambda p: F.coalesce(p["m"], F.lit(False))), lambda p: p["v"])


def gray(b: Column, g: Column, r: Column) -> Column:
    """Luma of the common broadcast weights, rounded."""
    pair = F.zip_with(b, g, lambda x, y: 0.114 * x + 0.587 * y)
    return F.zip_with(pair, r, lambda x, y: F.rint(x + 0.299 * y))


def at(values: Column, width: int | Column, y: Column, x: Column) -> Column:
    """A value of a picture; places beyond its rim have the nearest rim's."""
    w = _int(width)
    last = F.floor((F.size(values) - 1) / w).cast("int")
    inside = lambda v, top: F.greatest(F.least(v, top), F.lit(0))
    return F.get(values, inside(y, last) * w + inside(x, w - 1))


# Masks ------------------------------------------------------------------------------------------


def mask_from_logits(logits: Column) -> Column:
    """Where the sigmoid of a logit is above one half; null logits are outside."""
    return F.transform(logits, lambda v: F.coalesce(1 / (1 + F.exp(-v)) > 0.5, F.lit(False)))


@bound
def coverage(mask: Column) -> Column:
    """Share of the mask in its frame."""
    return mean(F.transform(mask, lambda m: m.cast("double")))


def apply_mask(values: Column, mask: Column) -> Column:
    """Values outside the mask become 0."""
    return F.zip_with(values, mask, lambda v, m: F.when(m, v).otherwise(F.lit(0)))


@bound
def nearest_resize(values: Column, width: int | Column, new_height: int, new_width: int) -> Column:
    """Each new pixel is the old one under its upper left corner."""
    w = _int(width)
    h = F.ceil(F.size(values) / w).cast("int")
    pick = lambda i: at(values, w, F.floor(F.floor(i / new_width) * h / new_height).cast("int"), F.floor(F.pmod(i, F.lit(new_width)) * w / new_width).cast("int"))
    return F.when(values.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(new_height * new_width - 1)), pick))


@bound
def bilinear_resize(values: Column, width: int | Column, new_height: int, new_width: int) -> Column:
    """Linear mixture of the four pixels around each new centre; the rim repeats."""
    w = _int(width)
    h = F.ceil(F.size(values) / w).cast("int")

    def pick(i: Column) -> Column:
        sy, sx = (F.floor(i / new_width) + 0.5) * h / new_height - 0.5, (F.pmod(i, F.lit(new_width)) + 0.5) * w / new_width - 0.5
        y, x = F.floor(sy).cast("int"), F.floor(sx).cast("int")
        fy, fx = sy - y, sx - x
        v = lambda dy, dx: at(values, w, y + dy, x + dx).cast("double")
        return (v(0, 0) * (1 - fx) + v(0, 1) * fx) * (1 - fy) + (v(1, 0) * (1 - fx) + v(1, 1) * fx) * fy

    return F.when(values.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(new_height * new_width - 1)), pick))


def network_input(b: Column, g: Column, r: Column, width: int | Column, size: int) -> Column:
    """Red, green and blue planes of ``size`` x ``size``, resized, in units of the channels' deviation."""
    planes = [bilinear_resize(c, width, size, size) for c in (r, g, b)]
    scaled = lambda plane, m, s: F.transform(plane, lambda v: (v / 255 - m) / s)
    return F.concat(*[scaled(*p) for p in zip(planes, CHANNEL_MEAN, CHANNEL_STD, strict=True)])


@bound
def fallback_mask(mask: Column, width: int | Column, cut: float, kind: str, radius: float = 0.3) -> Column:
    """The mask if it covers the cut; else a centred disk, the whole frame, or (another kind) still the mask."""
    w = _int(width)
    h = F.ceil(F.size(mask) / w).cast("int")
    if kind == "frame":
        other = F.transform(mask, lambda m: F.lit(True))
    elif kind == "disk":
        r = F.floor(w * radius)
        off = lambda i: (F.floor(i / w) - F.floor(h / 2), F.pmod(i, w) - F.floor(w / 2))
        other = F.transform(places(mask), lambda i: (lambda d: d[0] * d[0] + d[1] * d[1] <= r * r)(off(i)))
    else:
        return mask
    return F.when(coverage(mask) >= cut, mask).otherwise(other)


def dice(p: Column, t: Column, eps: float = 1e-6) -> Column:
    """Overlap of two masks of numbers: twice the common part over the sum of both."""
    both = F.zip_with(p, t, lambda x, y: x.cast("double") * y.cast("double"))
    number = lambda v: total(F.transform(v, lambda x: x.cast("double")))
    return (2 * total(both) + eps) / (number(p) + number(t) + eps)


# Orientations -----------------------------------------------------------------------------------


def orientations(values: Column, side: int | Column) -> list[Column]:
    """The eight views of a square picture: four quarter turns, and each of them mirrored."""
    n = _int(side) - 1

    def view(turn: int, mirrored: bool) -> Column:
        def pick(i: Column) -> Column:
            y, x = F.floor(i / (n + 1)).cast("int"), F.pmod(i, n + 1)
            x = n - x if mirrored else x
            sy, sx = ((y, x), (x, n - y), (n - y, n - x), (n - x, y))[turn]
            return F.get(values, sy * (n + 1) + sx)

        return F.transform(places(values), pick)

    return [view(turn, mirrored) for mirrored in (False, True) for turn in range(4)]


def over_orientations(values: Column, side: int | Column, feature: Callable[[Column], Column]) -> Column:
    """Mean of a number that ``feature`` makes of a picture, over its eight views."""
    views = F.array(*orientations(values, side))
    return mean(F.transform(views, feature))


# Colour -----------------------------------------------------------------------------------------


def lab_planes(b: Column, g: Column, r: Column) -> Column:
    """Array of structs ``l, a, b``: CIE Lab of sRGB in 8 bits, a and b shifted by 128."""
    pixels = F.zip_with(F.zip_with(b, g, lambda x, y: F.struct(x.alias("b"), y.alias("g"))), r, lambda p, z: F.struct(p["b"].alias("b"), p["g"].alias("g"), z.alias("r")))

    def linear(v: Column) -> Column:
        c = v / F.lit(255.0)
        return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)

    light = F.transform(pixels, lambda p: F.array(linear(p["r"]), linear(p["g"]), linear(p["b"])))

    def tone(rgb: Column, k: int) -> Column:
        t = sum((F.lit(XYZ[k][i]) * F.get(rgb, F.lit(i)) for i in range(3)), F.lit(0.0)) / WHITE[k]
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)

    tones = F.transform(light, lambda rgb: F.array(*[tone(rgb, k) for k in range(3)]))
    byte = lambda v: F.rint(F.greatest(F.least(v, F.lit(255.0)), F.lit(0.0)))
    f = lambda t, k: F.get(t, F.lit(k))
    return F.transform(
        tones,
        lambda t: F.struct(byte(116 * f(t, 1) - 16).alias("l"), byte(500 * (f(t, 0) - f(t, 1)) + 128).alias("a"), byte(200 * (f(t, 1) - f(t, 2)) + 128).alias("b")),
    )


@bound
def colour_moments(b: Column, g: Column, r: Column, mask: Column) -> Column:
    """Struct ``a_kurt, b_std, a_std, b_skew`` of Lab under the mask; zeros for an empty mask."""
    zero = lambda v: F.coalesce(v, F.lit(0.0))

    def of(inside: Column) -> Column:
        both = [moments(F.transform(inside, lambda p: p["a"])), moments(F.transform(inside, lambda p: p["b"]))]
        return let(*both, use=lambda a, c: F.struct(zero(a["kurt"]).alias("a_kurt"), zero(c["std"]).alias("b_std"), zero(a["std"]).alias("a_std"), zero(c["skew"]).alias("b_skew")))

    return let(masked(lab_planes(b, g, r), mask), use=of)


def hsv_planes(b: Column, g: Column, r: Column) -> Column:
    """Array of structs ``h`` (radians), ``s`` and ``v`` (0 to 255), and ``bin``, one of 512 colours."""
    pixels = F.zip_with(F.zip_with(b, g, lambda x, y: F.array(x.cast("double"), y.cast("double"))), r, lambda p, z: F.array_append(p, z.cast("double")))

    def one(p: Column) -> Column:
        blue, green, red = (F.get(p, F.lit(k)) for k in range(3))
        top = F.array_max(p)
        span = top - F.array_min(p)
        safe = F.when(span > 0, span)
        turn = (green - blue) / safe
        sector = F.when(top == red, F.when(turn < 0, turn + 6).otherwise(turn)).when(top == green, (blue - red) / safe + 2).otherwise((red - green) / safe + 4)
        part = lambda v, weight: F.floor(v / 32) * weight
        return F.struct(
            F.coalesce(sector * (math.pi / 3), F.lit(0.0)).alias("h"), F.coalesce(255 * span / F.when(top > 0, top), F.lit(0.0)).alias("s"), top.alias("v"),
            (part(blue, 64) + part(green, 8) + part(red, 1)).alias("bin"),
        )

    return F.transform(pixels, one)


@bound
def colour_spread(b: Column, g: Column, r: Column, mask: Column) -> Column:
    """Struct ``hue_std`` (circular), ``sat_mean, sat_std, val_std, n_colors`` (bins of over 1 %) under the mask; zeros for an empty one."""
    zero = lambda v: F.coalesce(v, F.lit(0.0))

    def of(p: Column, least: Column) -> Column:
        part = lambda k: F.transform(p, lambda x: x[k])
        c, s = mean(F.transform(p, lambda x: F.cos(x["h"]))), mean(F.transform(p, lambda x: F.sin(x["h"])))
        length = F.least(F.sqrt(c * c + s * s), F.lit(1.0))
        hue = let(length, use=lambda v: F.when(v > 1e-9, F.sqrt(F.greatest(-2 * F.ln(F.when(v > 1e-9, v)), F.lit(0.0)))))
        colors = runs(part("bin"), F.lit(0).cast("long"), lambda n, run: n + F.when((run + 1 > least) & (run <= least), 1).otherwise(0))
        return F.struct(
            zero(hue).alias("hue_std"), zero(mean(part("s"))).alias("sat_mean"), zero(deviation(part("s"))).alias("sat_std"), zero(deviation(part("v"))).alias("val_std"),
            colors.alias("n_colors"),
        )

    return let(masked(hsv_planes(b, g, r), mask), use=lambda p: let(0.01 * F.size(p), use=lambda least: of(p, least)))


# Texture and hashes -----------------------------------------------------------------------------


@bound
def binary_patterns(values: Column, mask: Column, width: int | Column) -> Column:
    """Struct ``entropy`` (bits) and ``uniformity`` of the 8-neighbour patterns inside the mask; the rim repeats, zeros for an empty mask."""
    w = _int(width)

    def code(i: Column) -> Column:
        y, x, own = F.floor(i / w).cast("int"), F.pmod(i, w), F.get(values, i)
        return sum((F.when(at(values, w, y + dy, x + dx) >= own, 1 << k).otherwise(0) for k, (dy, dx) in enumerate(AROUND)), F.lit(0))

    weight = lambda k: k * F.log2(F.greatest(k, F.lit(1)).cast("double"))
    zero = F.struct(F.lit(0.0).alias("plogp"), F.lit(0).cast("long").alias("squares"))
    # A kind that grows from r to r + 1 changes both sums by the difference of its terms.
    step = lambda a, r: F.struct((a["plogp"] + weight(r + 1) - weight(r)).alias("plogp"), (a["squares"] + 2 * r + 1).alias("squares"))

    def of(codes: Column, s: Column) -> Column:
        n = F.when(F.size(codes) > 0, F.size(codes).cast("double"))
        return F.struct(F.coalesce(F.log2(n) - s["plogp"] / n, F.lit(0.0)).alias("entropy"), F.coalesce(s["squares"] / (n * n), F.lit(0.0)).alias("uniformity"))

    inside = F.filter(places(values), lambda i: F.coalesce(F.get(mask, i), F.lit(False)))
    return let(F.transform(inside, code), use=lambda codes: let(runs(codes, zero, step), use=lambda s: of(codes, s)))


def area_weights(n: Column, m: int) -> Column:
    """Per target pixel of ``m`` the weights of ``n`` source pixels: their shares of its area."""
    low, high = (lambda i: i * n / m), (lambda i: (i + 1) * n / m)
    share = lambda i, k: F.greatest(F.least(high(i), k + 1) - F.greatest(low(i), k), F.lit(0.0)) * m / n
    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda k: share(i, k.cast("double"))))


@bound
def times(rows: Column, columns: Column) -> Column:
    """All inner products of the rows of one matrix with the rows of another, each an array of arrays."""
    inner = lambda p, q: total(F.zip_with(p, q, lambda x, y: x * y))
    return F.transform(rows, lambda p: F.transform(columns, lambda q: inner(p, q)))


def lines_of(values: Column, width: int | Column) -> Column:
    """A picture as an array of lines of doubles."""
    w = _int(width)
    h = F.ceil(F.size(values) / w).cast("int")
    return F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.transform(F.slice(values, y * w + 1, w), lambda v: v.cast("double")))


@bound
def perceptual_bits(values: Column, width: int | Column) -> Column:
    """64 booleans: the low 8 x 8 cosine coefficients of the 32 x 32 picture over their median without the first.

    Resize and transform are one product: 8 x height, then 8 x 8. Of a picture that is not shrunk each
    coefficient is one sum along its pixels, as a query would write it: symmetric coefficients
    may tie exactly, and then the order of the sum says which of them exceeds the other.
    """
    basis = [[math.cos(math.pi * (2 * i + 1) * k / 64) * math.sqrt((1 if k == 0 else 2) / 32) for i in range(32)] for k in range(8)]
    matrix = F.array(*[F.array(*[F.lit(v) for v in row]) for row in basis])
    w = _int(width)
    h = F.ceil(F.size(values) / w).cast("int")
    # Weights of source pixels per target, turned so that their rows meet the basis.
    turned = lambda n: let(area_weights(n, 32), use=lambda a: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.transform(a, lambda row: F.get(row, k))))
    of_lines = lambda across, down: times(down, times(across, lines_of(values, w)))
    weights = lambda d, a: F.flatten(F.transform(d, lambda x: F.transform(a, lambda y: x * y)))
    along = lambda d, a: total(F.zip_with(weights(d, a), values, lambda x, v: x * v))
    of_pixels = lambda across, down: F.transform(down, lambda d: F.transform(across, lambda a: along(d, a)))
    either = lambda across, down: F.when(F.size(values) <= 32 * 32, of_pixels(across, down)).otherwise(of_lines(across, down))
    weighed = lambda across: let(F.when(h == w, across).otherwise(times(matrix, turned(h))), use=lambda down: either(across, down))
    c = F.flatten(let(times(matrix, turned(w)), use=weighed))
    above = lambda c, middle: F.transform(c, lambda v: v > middle)
    bits = let(c, use=lambda c: let(F.get(F.array_sort(F.slice(c, 2, 63)), F.lit(31)), use=lambda middle: above(c, middle)))
    return F.when(values.isNotNull() & (F.size(values) > 0), bits)


@bound
def difference_bits(values: Column, width: int | Column) -> Column:
    """64 booleans: whether a pixel of the picture of 8 lines of 9 exceeds its left neighbour."""
    w = _int(width)
    h = F.ceil(F.size(values) / w).cast("int")
    half = let(area_weights(w, 9), lines_of(values, w), use=times)  # 9 x height
    rounded = lambda m: F.flatten(F.transform(m, lambda row: F.transform(row, lambda v: F.rint(F.round(v, 9)))))
    small = let(area_weights(h, 8), half, use=lambda down, half: rounded(times(down, half)))
    beside = lambda i: F.floor(i / 8).cast("int") * 9 + F.pmod(i, F.lit(8))
    more = lambda v: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(v, beside(i) + 1) > F.get(v, beside(i)))
    return F.when(values.isNotNull() & (F.size(values) > 0), let(small, use=more))


def as_bits(bits: Column) -> Column:
    """Booleans as a string of 0 and 1."""
    return F.array_join(F.transform(bits, lambda b: b.cast("int").cast("string")), "")
