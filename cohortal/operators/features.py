"""Feature columns: choice by name and block, replacement from another table, statistics, comparison of two variants."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.operators import ranking as Q
from cohortal.operators.alignment import alignment_checks
from cohortal.operators.effects import mcnemar_p, normal_p
from cohortal.operators.relational import require

# Blocks of the 18 descriptors.
RADII = (1, 2, 4, 8, 16)
BLOCK_COLUMNS = {
    "A": ("A4",),
    "B": ("B", *(f"internal_R{r}" for r in RADII), *(f"external_R{r}" for r in RADII), "fractal_D"),
    "C": ("Lab_a_kurt", "Lab_b_std", "Lab_a_std", "Lab_b_skew"),
    "D": ("D",),
}


def columns_like(df: DataFrame, *patterns: str) -> list[str]:
    """Columns whose whole name fits one of the patterns (a plain prefix ends in ``*``), in the table's order, of the first pattern first.

    A pattern that no column fits raises: a silent empty block would change a model.
    """
    out: list[str] = []
    for p in patterns:
        rule = re.compile(re.escape(p[:-1]) + ".*" if p.endswith("*") and not p.endswith(".*") else p)
        found = [c for c in df.columns if rule.fullmatch(c)]
        require(bool(found), f"no column fits {p}")
        out += [c for c in found if c not in out]
    return out


def block_columns(blocks: Sequence[str], columns: Mapping[str, Sequence[str]] = BLOCK_COLUMNS) -> list[str]:
    """Columns of the named blocks, in the order given; an unknown block raises."""
    unknown = [b for b in blocks if b not in columns]
    require(not unknown, f"unknown blocks: {', '.join(unknown)}")
    return [c for b in blocks for c in columns[b]]


def overwritten(df: DataFrame, other: DataFrame, columns: Sequence[str], position: str = "row_index", prefix: str = "") -> DataFrame:
    """``df`` with some columns taken from the rows of ``other`` at the same position (there with a prefix).

    Both tables have to have the same positions, each once; a lacking column or position raises.
    """
    missing = [c for c in columns if f"{prefix}{c}" not in other.columns or c not in df.columns]
    require(not missing, f"missing columns: {', '.join(missing)}")
    failed = alignment_checks({"table": df, "other": other}, [], position).where("status = 'FAIL'").orderBy("table", "check").collect()
    require(not failed, "not aligned: " + ", ".join(f"{r.table}: {r.check} {r.observed}" for r in failed))
    new = other.select(position, *[F.col(f"`{prefix}{c}`").alias(f"_new_{c}") for c in columns])
    return df.join(new, position).select(*[F.col(f"_new_{c}").alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def statistics(x: Column, y: Column) -> dict[str, Column]:
    """Aggregates of pairs: population mean, deviation, skewness and excess kurtosis of ``x``, correlation and slope of ``y`` on ``x``.

    A constant has skewness, kurtosis and slope 0 and correlation 1, as has a group without a pair. All
    are sums that combine before the shuffle.
    """
    flat = lambda v: F.coalesce(F.stddev_pop(v), F.lit(0.0)) == 0
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return {
        "mean": F.avg(x), "std": F.stddev_pop(x), "skew": F.when(flat(x), 0.0).otherwise(F.skewness(x)), "kurtosis": F.when(flat(x), 0.0).otherwise(F.kurtosis(x)),
        "pearson": F.coalesce(F.covar_pop(px, py) / F.nullif(F.stddev_pop(px) * F.stddev_pop(py), F.lit(0.0)), F.lit(1.0)),
        "slope": F.coalesce(F.covar_pop(px, py) / F.nullif(F.var_pop(px), F.lit(0.0)), F.lit(0.0)),
    }


def variant_comparison(df: DataFrame, truth: str, base: str, new: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Two variants of a score on the same rows: both AUCs, their difference with the paired DeLong test, and McNemar's exact test at the threshold.

    ``by, auc_base, auc_new, delta_auc, ci95_low, ci95_high, p_delong, b, c, p_mcnemar``; ``b`` counts the rows that only
    the base gets right. Without variance there is no p of DeLong's test.
    """
    rows = df.where(F.col(truth).isNotNull() & F.col(base).isNotNull() & F.col(new).isNotNull())
    d = Q.paired_delong(rows, base, new, truth, by)
    half = F.lit(1.959963984540054) * F.sqrt("var")
    d = d.select(*by, "auc_base", "auc_new", F.col("delta").alias("delta_auc"), (F.col("delta") - half).alias("ci95_low"), (F.col("delta") + half).alias("ci95_high"), normal_p("z").alias("p_delong"))
    right = lambda s: (F.col(s) >= threshold) == (F.col(truth) == 1)
    m = rows.groupBy(*by).agg(F.count_if(right(base) & ~right(new)).alias("b"), F.count_if(~right(base) & right(new)).alias("c"))
    m = m.select(*by, "b", "c", mcnemar_p("b", "c").alias("p_mcnemar"))
    return d.join(m, list(by)) if by else d.crossJoin(F.broadcast(m))  # one row
