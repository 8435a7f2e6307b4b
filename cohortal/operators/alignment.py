"""Tables whose rows belong together by position: positions from files, checks, the join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.operators.prefix import running_totals
from cohortal.operators.relational import require
from cohortal.session import broadcast_if_small, materialize


def file_positions(df: DataFrame, name: str = "row_index", file: Column | None = None, row: Column | None = None) -> DataFrame:
    """The rows of a scan with their position (from 0): by file name, then by place in the file.

    ``file`` and ``row`` default to what Spark knows about rows of Parquet files. Sizes are counted a row
    per file and summed in the order of names, so rows stay in the tasks that read them.
    """
    file = F.col("_metadata.file_path") if file is None else file
    row = F.col("_metadata.row_index") if row is None else row
    placed = df.select("*", file.alias("_file"), row.cast("long").alias("_row"))
    sizes = placed.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    starts = running_totals(sizes, [F.col("_file")], {"_end": F.col("_n")}).select("_file", (F.col("_end") - F.col("_n")).alias("_start"))
    out = placed.join(broadcast_if_small(materialize(starts)), "_file")
    return out.select(*df.columns, (F.col("_start") + F.col("_row")).alias(name))


def _by_position(tables: Mapping[str, DataFrame], audit: Sequence[str], position: str) -> DataFrame:
    """A row per position: how often each table has it, and its audit values there (as strings)."""
    names = list(tables)
    value = lambda c: F.col(f"`{c}`").cast("string").alias(f"_{c}")
    stacked = reduce(
        DataFrame.unionByName,
        [t.select(F.lit(k).alias("_t"), F.col(position).cast("long").alias("_at"), F.struct(F.lit(1).alias("_has"), *[value(c) for c in audit]).alias("_v")) for k, t in enumerate(tables.values())],
    )
    own = [F.count_if(F.col("_t") == k).alias(f"_n{k}") for k in range(len(names))]
    # Of a position that repeats, the least values stand for it; the repetition is counted.
    first = [F.min(F.when(F.col("_t") == k, F.col("_v"))).alias(f"_v{k}") for k in range(len(names))]
    return stacked.groupBy("_at").agg(*own, *first)


def alignment_checks(tables: Mapping[str, DataFrame], audit: Sequence[str], position: str = "row_index") -> DataFrame:
    """What keeps tables from being joined by position: ``table, check, observed, status``, a row per table and check.

    Each table is held against the first: ``rows`` is the difference of their numbers, ``repeated`` the rows whose
    position another row has, ``null`` those without one, ``gaps`` the positions from 0 up to the
    number of rows that no row has, ``unmatched`` the positions that only one of the two has, and each
    audit column counts the positions of both at which its values differ. All are 0 for tables
    that fit. The tables meet in one shuffle of position and audit columns.
    """
    names = list(tables)
    at = materialize(_by_position(tables, audit, position))
    sizes = at.agg(*[F.coalesce(F.sum(f"_n{k}"), F.lit(0)).alias(f"all{k}") for k in range(len(names))])
    wide = at.crossJoin(F.broadcast(sizes))  # one row
    known = F.col("_at").isNotNull()
    checks = []
    for k, name in enumerate(names):
        n, has = F.col(f"_n{k}"), (F.col(f"_n{k}") > 0) & known
        both = has & (F.col("_n0") > 0)
        inside = has & (F.col("_at") >= 0) & (F.col("_at") < F.col(f"all{k}"))
        found = {
            "rows": F.abs(F.max(f"all{k}") - F.max("all0")),
            "repeated": F.sum(F.when(has, n - 1).otherwise(0)),
            "null": F.sum(F.when(~known, n).otherwise(0)),
            "gaps": F.max(f"all{k}") - F.count_if(inside),
            "unmatched": F.count_if(has != ((F.col("_n0") > 0) & known)),
            **{f"column {c}": F.count_if(both & ~F.col(f"_v{k}._{c}").eqNullSafe(F.col(f"_v0._{c}"))) for c in audit},
        }
        checks += [(name, check, F.coalesce(v, F.lit(0)).cast("long")) for check, v in found.items() if k or check in ("repeated", "null", "gaps")]
    one = wide.agg(*[v.alias(f"c{i}") for i, (_, _, v) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(c).alias("check"), F.col(f"c{i}").alias("observed")) for i, (t, c, _) in enumerate(checks)])
    out = one.select(F.inline(rows))
    return out.withColumn("status", F.when(F.col("observed") == 0, "PASS").otherwise("FAIL"))


def aligned(tables: Mapping[str, DataFrame], audit: Sequence[str], position: str = "row_index") -> DataFrame:
    """The tables joined by position, with the audit columns once; raises and names the checks that fail.

    Other columns of equal names get the table's name in front.
    """
    failed = alignment_checks(tables, audit, position).where("status = 'FAIL'").orderBy("table", "check").collect()
    require(not failed, "not aligned: " + ", ".join(f"{r.table}: {r.check} {r.observed}" for r in failed))
    own = {name: [c for c in t.columns if c != position and c not in audit] for name, t in tables.items()}
    shared = {c for name, cs in own.items() for c in cs if sum(c in other for other in own.values()) > 1}
    out = None
    for name, t in tables.items():
        columns = [F.col(f"`{c}`").alias(f"{name}_{c}" if c in shared else c) for c in own[name]]
        if out is None:
            out = t.select(position, *audit, *columns)
        else:
            out = out.join(t.select(position, *columns), position)
    return out
