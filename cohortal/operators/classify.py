"""Decisions on class probabilities and other row-wise expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clinical thresholds, quality gate, descriptor blocks.
THRESHOLDS = {"melanoma": 0.188, "atypical": 0.412, "nevus": 0.508}
MIN_COVERAGE = 0.05
PREFIXES = {"ham_": "ham", "isic2019_": "isic2019", "s1_": "s1", "s2_": "s2"}


def verdict(p_mel: Column, p_atyp: Column, t_mel: Column, t_atyp: Column) -> Column:
    """2 (alert) if melanoma reaches its threshold, else 1 (watch) if atypical does, else 0."""
    return F.when(p_mel >= t_mel, 2).when(p_atyp >= t_atyp, 1).otherwise(0)


def non_benign(p_mel: Column, p_atyp: Column, t_mel: Column, t_atyp: Column) -> Column:
    return (p_mel >= t_mel) | (p_atyp >= t_atyp)


def argmax(p: Column) -> Column:
    """Index of the first greatest entry of an array."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def top_margin(p: Column) -> Column:
    s = F.sort_array(p, asc=False)
    return F.get(s, F.lit(0)) - F.get(s, F.lit(1))


def low_quality(coverage: Column) -> Column:
    return coverage < MIN_COVERAGE


def error_transition(truth: Column, pred: Column) -> Column:
    return F.when(truth == pred, "correct").otherwise(F.concat(truth.cast("string"), F.lit(" -> "), pred.cast("string")))


def case_bucket(truth: Column, pred: Column, p_nevus: Column, ceiling: float = 0.997) -> Column:
    """Cases of the third class: recognised, hidden under a near-certain benign score, or other."""
    return F.when((truth == 2) & (pred == 2), "atypical_well").when((truth == 2) & (p_nevus > ceiling), "nevus_ceiling").otherwise("other")


def miss_cause(coverage: Column, p: Column, threshold: float) -> Column:
    return F.when(coverage < MIN_COVERAGE, "segmentation").when(p >= threshold, "threshold").otherwise("model")


def source_of(stem: Column) -> Column:
    out = F.lit("unknown")
    for prefix, name in reversed(PREFIXES.items()):
        out = F.when(F.startswith(stem, F.lit(prefix)), name).otherwise(out)
    return out


def canonical_id(stem: Column) -> Column:
    return F.regexp_replace(stem, "^(" + "|".join(PREFIXES) + ")", "")


def exceedance(p_mel: Column, p_atyp: Column, t_mel: float = THRESHOLDS["melanoma"], t_atyp: float = THRESHOLDS["atypical"]) -> Column:
    """Greatest score in units of its threshold."""
    return F.greatest(p_mel / t_mel, p_atyp / t_atyp)


def two_class_readout(p_mel: Column, p_nevus: Column) -> Column:
    """Melanoma's share of the two classes; 0 where both are (nearly) 0."""
    d = p_mel + p_nevus
    return F.when(d > 1e-12, p_mel / F.when(d > 1e-12, d)).otherwise(0.0)


def descriptor_block(name: Column) -> Column:
    return F.when(name == "A4", "A").when(name == "D", "D").when(F.startswith(name, F.lit("Lab_")), "C").otherwise("B")


def oriented_z(x: Column, mean: Column, std: Column, sign: Column) -> Column:
    """Deviation from a mean in standard deviations, positive where it is suspicious; null for a constant feature."""
    return sign * (x - mean) / F.nullif(std, F.lit(0.0))


def level(z: Column) -> Column:
    return F.when(z >= 2.5, "high").when(z >= 1.0, "moderate").otherwise("normal")


def probing_verdict(r2: Column, auc: Column) -> Column:
    return F.when(r2 >= 0.5, "encoded").when(r2 >= 0.2, "partly encoded").when(auc >= 0.6, "independent signal").otherwise("weak")


def clinical_risk(top: Column, confidence: Column, margin: Column) -> Column:
    return (
        F.when(top == 1, "suspicious")
        .when(top == 2, "caution")
        .when((confidence >= 0.85) & (margin >= 0.5), "benign")
        .otherwise("caution")
    )


def mean_vectors(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def normalised(p: Column) -> Column:
    """Entries divided by their sum; equal shares where that is 0."""
    s = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.when(s > 0, F.transform(p, lambda x: x / F.when(s > 0, s))).otherwise(F.transform(p, lambda x: F.lit(1.0) / F.size(p)))


def entropy_fused(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Two probability arrays weighed by the inverse of their entropies."""
    h = lambda p: -F.aggregate(p, F.lit(0.0), lambda s, x: s + x * F.ln(x + eps))
    wa, wb = 1 / (h(a) + eps), 1 / (h(b) + eps)
    return F.zip_with(a, b, lambda x, y: (wa * x + wb * y) / (wa + wb))


def as_features(*parts: Column) -> Column:
    return F.concat(*parts)


def named_columns(prefix: str, n: int) -> Sequence[str]:
    return [f"{prefix}{k}" for k in range(n)]
