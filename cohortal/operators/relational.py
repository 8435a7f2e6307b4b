"""Joins, lookups and cohort selection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortal.operators.prefix import numbered
from cohortal.session import broadcast_if_small, materialize, shuffle_partitions


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of the greatest ``order`` per key (nulls least), by an aggregate, not a window."""
    others = [c for c in df.columns if c not in key]
    # max_by leaves out null orderings; a struct is never null, and in it null sorts first.
    best = df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return best.select(*key, "_row.*")


def first_nonempty(*columns: str) -> Column:
    """The first of the columns that is neither null nor an empty string."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def checked_join(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner", validate: str = "one_to_one") -> DataFrame:
    """A join that raises where a key repeats on a side that ``validate`` says is unique."""
    one_left, one_right = validate.startswith("one_"), validate.endswith("_one")
    for unique, side, name in ((one_left, left, "left"), (one_right, right, "right")):
        if unique and (bad := duplicate_keys(side, key).take(1)):
            raise ValueError(f"{validate}: the key repeats on the {name}: {bad[0]}")
    return left.join(right, list(key), how)


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def last_writer_wins(tables: Sequence[DataFrame], key: str, value: str, order: str) -> DataFrame:
    """One value per key from several tables: that of the last table, in it of the greatest ``order``.

    Blank and ``nan`` values are skipped.
    """
    parts = [
        t.select(F.col(key).alias("key"), F.trim(F.col(value).cast("string")).alias("value"), F.struct(F.lit(k), F.col(order)).alias("at"))
        for k, t in enumerate(tables)
    ]
    rows = reduce(DataFrame.unionByName, parts).where("value is not null and value != '' and lower(value) != 'nan'")
    return rows.groupBy("key").agg(F.max_by("value", "at").alias("value"))


def first_reason(reasons: Sequence[tuple[str, Column]], otherwise: str = "kept") -> Column:
    """The name of the first condition that holds: an ordered exclusion cascade."""
    out = F.lit(otherwise)
    for name, condition in reversed(reasons):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def leaking(rows: DataFrame, key: str, split: str, test: str = "test") -> DataFrame:
    """Rows of the test split whose key occurs in another split (a semi join; null keys never do)."""
    known = rows.where(F.col(split) != test).select(key)
    return rows.where(F.col(split) == test).join(known, key, "left_semi")


def hashed_order(seed: int, *columns: str) -> Column:
    """A pseudo-random, reproducible order of rows."""
    return F.xxhash64(F.lit(seed), *columns)


def modular_order(key: Column, seed: int) -> Column:
    """A reproducible shuffle of integer keys that any SQL engine can compute alike."""
    return F.pmod(key * F.lit(7_919) + F.lit(104_729) * F.lit(seed), F.lit(1_000_003))


def sample_per_class(df: DataFrame, label: str, order: Column, share: float | None = None, n: int | None = None) -> DataFrame:
    """The first ``n`` rows, or int(share of all rows), of each class in the given order."""
    size = n if n is not None else int(df.count() * share)
    ranked = df.withColumn("_o", order)
    ranked = numbered(ranked, [F.col("_o"), *[F.col(c) for c in df.columns if c != label][:1]], "_k", [label])
    return ranked.where(F.col("_k") <= size).select(*df.columns)


def select_subset(df: DataFrame, truth: str, group: str, order: Column, per_positive: int = 3) -> DataFrame:
    """All positives, and up to three times as many negatives from groups without a positive."""
    positives = df.where(F.col(truth) == 1)
    n = per_positive * positives.count()
    clean = df.where(F.col(truth) == 0).join(positives.select(group).distinct(), group, "left_anti").select(*df.columns)
    # Numbered in parts: n grows with the table, so it is no top-k for one task.
    ranked = numbered(clean.withColumn("_o", order), [F.col("_o"), F.col(df.columns[0])], "_k")
    chosen = ranked.where(F.col("_k") <= n).select(*df.columns)
    return positives.unionByName(chosen)


def group_sizes(df: DataFrame, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Per ``by``: rows, groups, greatest and mean group, share of rows in groups of several (%)."""
    each = df.groupBy(*by, group).agg(F.count("*").alias("_n"))
    return each.groupBy(*by).agg(
        F.sum("_n").alias("n_images"),
        F.count("*").alias("n_groups"),
        F.max("_n").alias("max_images_per_group"),
        F.avg("_n").alias("mean_images_per_group"),
        (100 * F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("pct_images_in_multi_image_group"),
    )


def fold_of(df: DataFrame, label: str, order: Column, folds: int) -> DataFrame:
    """Stratified folds: rows of each class in the given order go to the folds in turn."""
    ranked = numbered(df.withColumn("_o", order), [F.col("_o"), F.col(df.columns[0])], "_k", [label])
    return ranked.select(*df.columns, F.pmod(F.col("_k") - 1, F.lit(folds)).cast("int").alias("fold"))


def group_folds(df: DataFrame, group: str, label: str, folds: int, seed: int = 0) -> DataFrame:
    """Folds that keep groups whole and spread classes: ``group, fold``, a row per group.

    Groups are sorted by size class and label make-up, and dealt to the folds back and forth in
    that order, which evens out both; there is no greedy pass over all groups in one task.
    """
    g = df.groupBy(group).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))
    g = g.withColumn("_o", F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string"))))
    ranked = numbered(g, [F.col("_n").desc(), F.col("_p").desc(), F.col("_o"), F.col(group)], "_k")
    k = F.pmod(F.col("_k") - 1, F.lit(2 * folds))
    return ranked.select(group, F.when(k < folds, k).otherwise(2 * folds - 1 - k).cast("int").alias("fold"))


def spread_of(counts: Sequence[int]) -> int:
    """Their variance times the square of their number: a whole number, so that equal spreads tie in any engine."""
    return len(counts) * sum(c * c for c in counts) - sum(counts) ** 2


def next_fold(state: list[list[int]], counts: Sequence[int], totals: Sequence[int]) -> int:
    """The fold that a group with these class counts evens out most: least mean deviation of the classes' shares, then least rows, then first."""

    def cost(f: int) -> float:
        out = 0.0
        for k, t in enumerate(totals):
            if t:
                column = [s[k] + (counts[k] if i == f else 0) for i, s in enumerate(state)]
                low = min(column)
                out += math.sqrt(spread_of([c - low for c in column])) / t
        return round(out, 12)

    return min(range(len(state)), key=lambda f: (cost(f), sum(state[f]), f))


def dealt_alike(state: list[list[int]], counts: Sequence[int], totals: Sequence[int], n: int) -> tuple[list[int], list[int]]:
    """Folds of ``n`` groups of equal class counts, one after the other: the first ones, and the cycle that follows.

    Costs depend on differences between folds only, so once the groups that the folds got differ as
    they did before, their order repeats. ``state`` is brought up to date.
    """
    got, order, seen = [0] * len(state), [], {}
    while len(order) < n:
        shape = tuple(g - min(got) for g in got)
        if shape in seen:
            cycle = order[seen[shape] :]
            rest = n - len(order)
            for i, f in enumerate(cycle):
                times = rest // len(cycle) + (i < rest % len(cycle))
                state[f] = [s + times * c for s, c in zip(state[f], counts, strict=True)]
            return order[: seen[shape]], cycle
        seen[shape] = len(order)
        f = next_fold(state, counts, totals)
        state[f] = [s + c for s, c in zip(state[f], counts, strict=True)]
        got[f] += 1
        order.append(f)
    return order, []


def greedy_group_folds(df: DataFrame, group: str, label: str, folds: int, seed: int = 0) -> DataFrame:
    """Folds that keep groups whole, by the greedy rule: ``group, fold``, a row per group.

    Groups come in the order of the spread of their class counts, widest first, then of the counts,
    then of a seeded hash; each goes to the fold that ``next_fold`` names. Groups of equal counts are
    alike to the rule, so the driver deals such profiles, one row each, and not groups: their
    groups are numbered on Spark and read their fold off the profile's order. Null labels count for
    no class; a null group is a group.
    """
    classes = [r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]
    g = df.groupBy(group).agg(F.array(*[F.count_if(F.col(label) == c) for c in classes]).alias("_c"))
    g = materialize(g)
    profiles = sorted(((tuple(r["_c"]), r.n) for r in g.groupBy("_c").agg(F.count("*").alias("n")).collect()), key=lambda p: (-spread_of(p[0]), [-c for c in p[0]]))
    totals = [sum(c[k] * n for c, n in profiles) for k in range(len(classes))]
    state = [[0] * len(classes) for _ in range(folds)]
    plan = [(k, list(c), *dealt_alike(state, c, totals, n)) for k, (c, n) in enumerate(profiles)]
    table = df.sparkSession.createDataFrame(plan, "_p int, _c array<long>, _first array<int>, _cycle array<int>")
    named = g.join(broadcast_if_small(table.select("_p", "_c")), "_c").withColumn("_o", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(group).cast("string"), F.lit("")))))
    placed = numbered(named, [F.col("_o"), F.col(group)], "_k", ["_p"]).join(broadcast_if_small(table.drop("_c")), "_p")
    k = F.col("_k") - 1
    later = F.get("_cycle", F.pmod(k - F.size("_first"), F.greatest(F.size("_cycle"), F.lit(1))).cast("int"))
    return placed.select(group, F.when(k < F.size("_first"), F.get("_first", k.cast("int"))).otherwise(later).alias("fold"))


def fold_leaks(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups that occur in more than one fold, with their number of folds: empty if nothing leaks."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(fold).alias("n_folds")).where("n_folds > 1")


#: Rows of one key that are compared with all rows of the key at a time, and comparisons of one task.
PAIR_ROWS, PAIR_TASK = 2_048, 50_000_000


def near_duplicate_pairs(df: DataFrame, id: str, keys: Sequence[str], distance: Column | None = None, limit: float = 1.0) -> DataFrame:
    """Pairs a < b with equal hash keys and, if given, a distance up to the limit.

    ``distance`` is an expression over the columns of ``a`` and ``b``. The join is on the keys. All
    pairs grow with the square of a key's rows, and few bytes make many of them: rows ``a`` of a key are
    dealt into portions that meet all its rows ``b``, and the number of tasks follows that of comparisons.
    """
    known = df.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in [id, *keys]]))
    sizes = materialize(known.groupBy(*keys).agg(F.count("*").alias("_n")))
    work = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_n"))).first()[0] or 0.0
    parts = max(shuffle_partitions(df.sparkSession), min(10_000, math.ceil(work / PAIR_TASK)))
    portions = F.ceil(F.col("_n") / PAIR_ROWS)
    rows = known.join(broadcast_if_small(sizes), list(keys)).withColumn("_m", portions.cast("long"))
    a = rows.withColumn("_part", F.pmod(F.xxhash64(id), "_m"))
    b = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    # The second side of a merge join is held by key: that is a portion.
    a, b = (d.repartition(parts, *keys, "_part").alias(n) for d, n in ((a, "a"), (b, "b")))
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_part"]] + [F.col(f"a.{id}") < F.col(f"b.{id}")]
    if distance is not None:
        on.append(distance <= limit)
    return b.join(a.hint("merge"), reduce(lambda x, y: x & y, on)).select(F.col(f"a.{id}").alias("member_1"), F.col(f"b.{id}").alias("member_2"))


def near_duplicate_links(df: DataFrame, id: str, keys: Sequence[str], value: str, limit: float = 1.0) -> DataFrame:
    """Links ``member_1, member_2`` that join what ``near_duplicate_pairs`` joins by the distance of two numbers, at most one a row.

    In the order of the numbers of a key, rows are connected until a gap exceeds the limit; each is linked to
    the least id of its run, and no pairs are made. Equal numbers are one row of the ordering. Null ids and keys
    and numbers that are null or not finite have no link.
    """
    require(limit >= 0, "the limit is negative")
    known = df.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in [id, *keys]]) & (F.col(value) - F.col(value) == 0))
    known = known.select(F.col(id).alias("_id"), *keys, F.col(value).alias("_v"))
    order = W.partitionBy(*keys).orderBy("_v")
    gap = F.col("_v") - F.lag("_v").over(order)
    each = known.groupBy(*keys, "_v").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).withColumn("_new", F.when(gap <= limit, 0).otherwise(1))
    each = each.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy(*keys, "_run")
    runs = each.withColumns({"_least": F.min("_least").over(run), "_most": F.max("_most").over(run)}).where("_least < _most")
    links = known.join(runs.select(*keys, "_v", "_least"), [*keys, "_v"]).where("_least < _id")
    return links.select(F.col("_least").alias("member_1"), F.col("_id").alias("member_2"))


def keep_shorter(pairs: DataFrame, a: str = "member_1", b: str = "member_2") -> DataFrame:
    """Per pair the member to keep (shorter name, then least) and the one to drop."""
    x, y = (F.col(c).cast("string") for c in (a, b))
    n, m = (F.coalesce(F.length(c), F.lit(-1)) for c in (x, y))
    first = (n < m) | ((n == m) & (x <= y))
    return pairs.select(a, b, F.when(first, x).otherwise(y).alias("retained"), F.when(first, y).otherwise(x).alias("removed"))


def ordered_subset(df: DataFrame, key: str, wanted: Sequence) -> DataFrame:
    """Rows of the wanted keys with their place in the list; a missing key raises."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    names = spark.createDataFrame([(k, v) for k, v in enumerate(wanted)], f"place int, {key} {kind}")
    missing = materialize(names.join(df.select(key), key, "left_anti"))
    require(missing.isEmpty(), f"missing keys: {[r[key] for r in missing.take(5)]}")
    return df.join(F.broadcast(names), key)  # as long as the list
