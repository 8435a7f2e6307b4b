"""Descriptors of one decoded image or mask; numpy only, used inside Arrow batches.

Masks are boolean arrays [h, w], images are uint8 arrays [h, w, 3] in blue, green, red order.
Where a descriptor depends on a library's inner choices (contour tracing, inpainting, 8-bit Lab), the
definition here is a plain one: values are close to, not equal to, those of that library.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

RADII = (1, 2, 4, 8, 16)
# The order of the descriptors.
NAMES = (
    ["A4", "B", "D", "Lab_a_kurt", "Lab_b_std", "Lab_a_std", "Lab_b_skew"]
    + [f"internal_R{r}" for r in RADII]
    + [f"external_R{r}" for r in RADII]
    + ["fractal_D"]
)
IMAGE_NAMES = (
    ["canny_fd", "glcm_contrast", "glcm_dissimilarity", "glcm_homogeneity", "glcm_energy", "glcm_correlation"]
    + ["lbp_entropy", "lbp_uniformity", "lap_var", "grad_mean", "grad_std", "hue_circstd", "sat_mean", "sat_std", "val_std", "n_colors"]
)


def gray(bgr: np.ndarray) -> np.ndarray:
    """Luma of the common broadcast weights, rounded."""
    return np.rint(bgr @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def asymmetry(mask: np.ndarray) -> float:
    """Correlation of the row sums and column sums, over the shorter side; 1 where undefined."""
    rows, cols = mask.sum(1, dtype=float), mask.sum(0, dtype=float)
    n = min(len(rows), len(cols))
    rows, cols = rows[:n] - rows[:n].mean(), cols[:n] - cols[:n].mean()
    scale = math.sqrt((rows @ rows) * (cols @ cols))
    return float(rows @ cols / scale) if scale > 0 else 1.0


def components(mask: np.ndarray) -> np.ndarray:
    """Labels (from 1) of the 8-connected parts: runs of each row are merged with those above."""
    h, w = mask.shape
    labels = np.zeros((h, w), np.int64)
    parent: list[int] = [0]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    above: list[tuple[int, int, int]] = []
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        own = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            near = {find(k) for s, e, k in above if s <= b and a <= e}
            if near:
                k = min(near)
                for other in near:
                    parent[other] = k
            else:
                k = len(parent)
                parent.append(k)
            labels[y, a:b] = k
            own.append((a, b, k))
        above = own
    return np.array([find(k) for k in range(len(parent))])[labels]


def largest_component(mask: np.ndarray) -> np.ndarray:
    labels = components(mask)
    sizes = np.bincount(labels.ravel())
    sizes[0] = 0
    return labels == sizes.argmax() if sizes.any() else mask


def boundary(mask: np.ndarray) -> np.ndarray:
    """Pixels of the mask with a 4-neighbour outside it."""
    p = np.pad(mask, 1)
    inner = p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return mask & ~inner


def outline(mask: np.ndarray) -> np.ndarray:
    """Boundary pixels (y, x) of a mask in order around it, by Moore neighbour tracing."""
    points = np.argwhere(mask)
    if not len(points):
        return points
    p = np.pad(mask, 1)
    around = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    start = at = tuple(points[0] + 1)
    back, out, first = 0, [], None
    for _ in range(8 * len(points) + 8):
        out.append(at)
        for k in range(1, 9):
            d = (back + k) % 8
            to = (at[0] + around[d][0], at[1] + around[d][1])
            if p[to]:
                break
        else:
            break
        if at == start:
            if first == d:
                out.pop()
                break
            first = d if first is None else first
        at, back = to, (d + 5) % 8 if d % 2 else (d + 6) % 8
    return np.array(out) - 1


def polygon(points: np.ndarray) -> tuple[float, float]:
    """Area and perimeter of a closed polygon."""
    y, x = points[:, 0].astype(float), points[:, 1].astype(float)
    ny, nx = np.roll(y, -1), np.roll(x, -1)
    return abs(float((x * ny - nx * y).sum())) / 2, float(np.hypot(nx - x, ny - y).sum())


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull by two monotone chains."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p).reshape(-1, 2)

    def chain(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(reversed(p)))


def border(mask: np.ndarray) -> tuple[float, float]:
    """Compactness P^2 / (4 pi A) and greatest diameter of the largest part; (0, 0) without area."""
    c = outline(largest_component(mask))
    if len(c) < 3:
        return 0.0, 0.0
    area, length = polygon(c)
    if area == 0:
        return 0.0, 0.0
    h = hull(c).astype(float)
    feret = float(np.sqrt(((h[:, None] - h[None]) ** 2).sum(-1)).max()) if len(h) > 1 else 0.0
    return length * length / (4 * math.pi * area), feret


def ellipse(r: int) -> np.ndarray:
    """A filled disk of 2 r + 1 pixels, row by row the rounded half chord."""
    d = np.arange(-r, r + 1)
    half = np.rint(np.sqrt(np.maximum(r * r - d * d, 0))).astype(int)
    return np.abs(d)[None, :] <= half[:, None]


def dilate(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Union of the mask shifted by every pixel of the kernel; rows of the kernel are runs."""
    r = kernel.shape[0] // 2
    h, w = mask.shape
    runs = np.pad(mask, r).astype(np.int32)
    total = np.pad(np.cumsum(runs, 1), ((0, 0), (1, 0)))
    out = np.zeros((h, w), bool)
    for k, row in enumerate(kernel):
        half = int(row.sum()) // 2
        x = np.arange(w) + r
        out |= (total[k : k + h][:, x + half + 1] - total[k : k + h][:, x - half]) > 0
    return out


def erode(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Outside the frame counts as inside the mask."""
    return ~dilate(~mask, kernel)


def rings(mask: np.ndarray, radii: Sequence[int] = RADII) -> tuple[list[float], list[float]]:
    """Pixels that erosion takes and dilation adds, per radius."""
    kernels = [ellipse(r) for r in radii]
    inner = [float((mask & ~erode(mask, k)).sum()) for k in kernels]
    outer = [float((dilate(mask, k) & ~mask).sum()) for k in kernels]
    return inner, outer


def slope(x: Sequence[float], y: Sequence[float]) -> float:
    x, y = np.asarray(x, float), np.asarray(y, float)
    d = x - x.mean()
    return float(d @ y / (d @ d)) if (d @ d) > 0 else 0.0


def minkowski(mask: np.ndarray, radii: Sequence[int] = RADII) -> list[float]:
    """Inner rings, outer rings, and 2 less the slope of log ring size on log radius; zeros if empty."""
    if not mask.any():
        return [0.0] * (2 * len(radii) + 1)
    inner, outer = rings(mask, radii)
    return [*inner, *outer, 2 - slope(np.log(radii), np.log([max(a + b, 1) for a, b in zip(inner, outer, strict=True)]))]


def box_dimension(edge: np.ndarray, sizes: Sequence[int] = (2, 4, 8, 16, 32, 64), offsets: int = 1) -> float:
    """Slope of log occupied boxes on log 1 / size; 0 for fewer than 16 points or 2 usable sizes."""
    points = np.argwhere(edge)
    usable = [s for s in sizes if 1 <= s <= max(edge.shape)]
    if len(points) < 16 or len(usable) < 2:
        return 0.0
    n = [np.mean([len({*map(tuple, ((points + s * k // offsets) // s).tolist())}) for k in range(offsets)]) for s in usable]
    return slope(-np.log(usable), np.log(np.maximum(n, 1)))


def lab(bgr: np.ndarray) -> np.ndarray:
    """CIE Lab (D65) of sRGB, a and b shifted by 128 as 8-bit values."""
    c = bgr[..., ::-1] / 255.0
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    m = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    xyz = c @ m.T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    out = np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1)
    return np.rint(np.clip(out, 0, 255))


def moments(v: np.ndarray) -> tuple[float, float, float]:
    """Population deviation, skewness and excess kurtosis; zeros for a constant."""
    d = v - v.mean()
    s2 = float((d * d).mean())
    if s2 <= 1e-24:
        return 0.0, 0.0, 0.0
    return math.sqrt(s2), float((d**3).mean()) / s2**1.5, float((d**4).mean()) / s2**2 - 3


def colour(bgr: np.ndarray, mask: np.ndarray) -> list[float]:
    if not mask.any():
        return [0.0] * 4
    v = lab(bgr)[mask]
    a, b = moments(v[:, 1]), moments(v[:, 2])
    return [a[2], b[0], a[0], b[1]]


def handcrafted(bgr: np.ndarray, mask: np.ndarray) -> list[float]:
    """All 18 descriptors in the order of ``NAMES``."""
    return [asymmetry(mask), *border(mask), *colour(bgr, mask), *minkowski(mask)]


def glcm(g: np.ndarray, mask: np.ndarray, levels: int = 16) -> list[float]:
    """Contrast, dissimilarity, homogeneity, energy, correlation of right and lower neighbours inside the mask."""
    q = g.astype(np.int64) * levels // 256
    pairs = []
    for a, b in ((np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:-1], np.s_[1:])):
        both = mask[a] & mask[b]
        pairs.append(np.stack([q[a][both], q[b][both]], 1))
    pair = np.concatenate(pairs)
    if not len(pair):
        return [0.0] * 5
    count = np.bincount(pair @ [levels, 1], minlength=levels * levels).reshape(levels, levels).astype(float)
    p = (count + count.T) / (2 * len(pair))
    i = np.arange(levels, dtype=float)
    d = i[:, None] - i[None]
    margin = p.sum(1)
    mean = float(margin @ i)
    var = float(margin @ (i - mean) ** 2)
    corr = float((i - mean) @ p @ (i - mean)) / var if var > 0 else 0.0
    return [float((p * d * d).sum()), float((p * abs(d)).sum()), float((p / (1 + d * d)).sum()), math.sqrt(float((p * p).sum())), corr]


def lbp(g: np.ndarray, mask: np.ndarray) -> list[float]:
    """Entropy (bits) and uniformity of the 8-neighbour patterns inside the mask; edges repeat."""
    if not mask.any():
        return [0.0, 0.0]
    p = np.pad(g.astype(int), 1, mode="edge")
    h, w = g.shape
    ring = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]
    code = sum((p[y : y + h, x : x + w] >= g).astype(int) << k for k, (y, x) in enumerate(ring))
    share = np.bincount(code[mask], minlength=256) / mask.sum()
    some = share[share > 0]
    return [float(-(some * np.log2(some)).sum()), float((share * share).sum())]


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue in radians, saturation and value in 0..255."""
    c = bgr.astype(float)
    b, g, r = c[..., 0], c[..., 1], c[..., 2]
    top, span = c.max(-1), np.ptp(c, -1)
    safe = np.where(span > 0, span, 1)
    sector = np.where(top == r, ((g - b) / safe) % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4))
    hue = np.where(span > 0, sector * math.pi / 3, 0.0)
    return np.stack([hue, np.where(top > 0, 255 * span / np.where(top > 0, top, 1), 0.0), top], -1)


def spread(bgr: np.ndarray, mask: np.ndarray) -> list[float]:
    """Circular deviation of hue, mean and deviation of saturation, deviation of value, colours above 1 %."""
    if not mask.any():
        return [0.0] * 5
    v = hsv(bgr)[mask]
    r = abs(np.exp(1j * v[:, 0]).mean())
    bins = np.bincount((bgr[mask].astype(int) >> 5) @ [64, 8, 1], minlength=512)
    hue = math.sqrt(max(0.0, -2 * math.log(min(r, 1.0)))) if r > 1e-9 else 0.0
    return [hue, float(v[:, 1].mean()), float(v[:, 1].std()), float(v[:, 2].std()), float((bins > 0.01 * mask.sum()).sum())]


def gradients(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel magnitude and Laplacian, mirrored at the edges."""
    p = np.pad(g.astype(float), 1, mode="reflect" if min(g.shape) > 1 else "edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return np.hypot(gx, gy), p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def image_features(bgr: np.ndarray, mask: np.ndarray) -> list[float]:
    """The 16 texture and colour descriptors of ``IMAGE_NAMES``; zeros for fewer than 32 pixels.

    Edges are pixels of strong gradient; no thinning or hysteresis is done.
    """
    if mask.sum() < 32:
        return [0.0] * len(IMAGE_NAMES)
    g = gray(bgr)
    grad, lap = gradients(g)
    edge = mask & (grad > 120)
    return [
        box_dimension(edge, offsets=2), *glcm(g, mask), *lbp(g, mask), float(lap[mask].var()), float(grad[mask].mean()), float(grad[mask].std()),
        *spread(bgr, mask),
    ]


def hair_mask(bgr: np.ndarray, arm: int = 8, level: int = 10) -> np.ndarray:
    """Thin dark structures: closing by a cross less the image, above the level."""
    g = gray(bgr).astype(int)

    def run(v: np.ndarray, f) -> np.ndarray:
        across = np.lib.stride_tricks.sliding_window_view(np.pad(v, ((0, 0), (arm, arm)), mode="edge"), 2 * arm + 1, 1)
        down = np.lib.stride_tricks.sliding_window_view(np.pad(v, ((arm, arm), (0, 0)), mode="edge"), 2 * arm + 1, 0)
        return f(f(across, -1), f(down, -1)) if f is np.maximum.reduce else f(np.stack([f(across, -1), f(down, -1)]), 0)

    largest = lambda a, axis: a.max(axis)
    least = lambda a, axis: a.min(axis)
    return run(run(g, largest), least) - g > level


def dehair(bgr: np.ndarray) -> np.ndarray:
    """Hair pixels replaced, from the rim inwards, by the mean of their known neighbours."""
    out, todo = bgr.astype(float), hair_mask(bgr)
    while todo.any() and not todo.all():
        known = np.pad((~todo).astype(float), 1)
        value = np.pad(np.where(todo[..., None], 0, out), ((1, 1), (1, 1), (0, 0)))
        h, w = todo.shape
        around = [(y, x) for y in range(3) for x in range(3)]
        n = sum(known[y : y + h, x : x + w] for y, x in around)
        s = sum(value[y : y + h, x : x + w] for y, x in around)
        rim = todo & (n > 0)
        out[rim] = s[rim] / n[rim][:, None]
        todo = todo & ~rim
    return np.rint(out).astype(np.uint8)


def resize(a: np.ndarray, height: int, width: int, nearest: bool = False) -> np.ndarray:
    """Bilinear (or nearest) samples at pixel centres."""
    y = (np.arange(height) + 0.5) * a.shape[0] / height - 0.5
    x = (np.arange(width) + 0.5) * a.shape[1] / width - 0.5
    if nearest:
        return a[np.clip(np.floor(y + 0.5).astype(int), 0, a.shape[0] - 1)][:, np.clip(np.floor(x + 0.5).astype(int), 0, a.shape[1] - 1)]
    y, x = np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    v = a.astype(float)
    if a.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    return (v[y0][:, x0] * (1 - fx) + v[y0][:, x1] * fx) * (1 - fy) + (v[y1][:, x0] * (1 - fx) + v[y1][:, x1] * fx) * fy


def network_input(bgr: np.ndarray, size: int, mean: Sequence[float] = (0.485, 0.456, 0.406), std: Sequence[float] = (0.229, 0.224, 0.225)) -> np.ndarray:
    """[3, size, size] float32 in red, green, blue order, scaled and normalised."""
    rgb = resize(bgr, size, size)[..., ::-1] / 255.0
    return ((rgb - np.asarray(mean)) / np.asarray(std)).transpose(2, 0, 1).astype(np.float32)


def mask_from_logits(logits: np.ndarray, height: int, width: int) -> np.ndarray:
    """Sigmoid over one half is a positive logit; nearest resize to the image."""
    return resize(logits > 0, height, width, nearest=True)


def orientations(a: np.ndarray) -> list[np.ndarray]:
    """The 8 rotations and mirrors of an image."""
    return [np.rot90(b, k) for b in (a, a[:, ::-1]) for k in range(4)]


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the source area of each target pixel."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        lo, hi = edge[:-1, None], edge[1:, None]
        k = np.arange(n)[None]
        return np.clip(np.minimum(hi, k + 1) - np.maximum(lo, k), 0, None) * m / n

    return weights(a.shape[0], height) @ a.astype(float) @ weights(a.shape[1], width).T


def perceptual_hash(bgr: np.ndarray) -> int:
    """64 bits: the low 8 x 8 cosine coefficients of a 32 x 32 image over their median without the first."""
    g = area_resize(gray(bgr), 32, 32)
    k, n = np.arange(8)[:, None], np.arange(32)[None]
    basis = np.cos(math.pi * (2 * n + 1) * k / 64) * np.where(k == 0, math.sqrt(1 / 32), math.sqrt(2 / 32))
    c = (basis @ g @ basis.T).ravel()
    return int("".join("1" if v else "0" for v in c > np.median(c[1:])), 2)


def difference_hash(bgr: np.ndarray) -> int:
    """64 bits: whether a pixel of the 8 x 9 image exceeds its left neighbour."""
    g = np.rint(area_resize(gray(bgr), 8, 9))
    return int("".join("1" if v else "0" for v in (g[:, 1:] > g[:, :-1]).ravel()), 2)


def otsu_mask(bgr: np.ndarray) -> np.ndarray:
    """Dark side of the threshold of greatest between-class variance, flipped above 70 %, largest part."""
    g = gray(bgr)
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    w = np.cumsum(n)
    s = np.cumsum(n * np.arange(256))
    rest = w[-1] - w
    ok = (w > 0) & (rest > 0)
    between = np.where(ok, (s[-1] * w - s * w[-1]) ** 2 / np.where(ok, w * rest, 1), -1.0)
    mask = g <= between.argmax()
    return largest_component(~mask if mask.mean() > 0.7 else mask)


def fallback_mask(mask: np.ndarray, cut: float, kind: str, radius: float = 0.3) -> np.ndarray:
    """The mask if it covers the cut, else a centred disk or the whole frame."""
    if mask.mean() >= cut or kind not in ("disk", "frame"):
        return mask
    if kind == "frame":
        return np.ones_like(mask)
    h, w = mask.shape
    y, x = np.ogrid[:h, :w]
    return (y - h // 2) ** 2 + (x - w // 2) ** 2 <= int(radius * w) ** 2


def shape(mask: np.ndarray) -> dict[str, float] | None:
    """Solidity, convexity, radial spectrum and curvature of the largest outline; none for a tiny one."""
    c = outline(largest_component(mask)).astype(float)
    if len(c) < 8:
        return None
    area, length = polygon(c)
    if area < 20:
        return None
    hull_area, hull_length = polygon(hull(c))
    centre = c - c.mean(0)
    angle, radius = np.arctan2(centre[:, 0], centre[:, 1]), np.hypot(*centre.T)
    order = np.argsort(angle, kind="stable")
    at = np.linspace(-math.pi, math.pi, 256, endpoint=False)
    r = np.interp(at, angle[order], radius[order], period=2 * math.pi)
    power = abs(np.fft.rfft(r / r.mean() - 1)) ** 2
    total = power[1:].sum()
    some = c[:: max(1, len(c) // 128)]
    step = np.roll(some, -1, 0) - some
    turn = np.diff(np.unwrap(np.append(np.arctan2(step[:, 0], step[:, 1]), np.arctan2(step[0, 0], step[0, 1]))))
    return {
        "solidity": area / hull_area if hull_area else 1.0,
        "convexity": hull_length / length if length else 1.0,
        "radial_fft_2_5": float(power[2:6].sum() / total) if total else 0.0,
        "radial_fft_high": float(power[6:].sum() / total) if total else 0.0,
        "curv_var": float(((turn + math.pi) % (2 * math.pi) - math.pi).var()),
    }


def dice(p: np.ndarray, t: np.ndarray, eps: float = 1e-6) -> float:
    return float((2 * (p * t).sum() + eps) / (p.sum() + t.sum() + eps))
