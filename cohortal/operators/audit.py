"""Checks of tables, and digests of files and bundles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_rows(df: DataFrame, checks: Mapping[str, Column], caution: Sequence[str] = ()) -> DataFrame:
    """Long table ``check, status, observed``: each check is an aggregate that counts offending rows.

    Status is PASS for 0, FAIL otherwise (CAUTION for the named ones), NOT_VERIFIABLE for null.
    """
    wide = df.agg(*[c.cast("long").alias(k) for k, c in checks.items()])
    long = wide.unpivot([], list(checks), "check", "observed")
    bad = F.when(F.col("check").isin(*caution), "CAUTION").otherwise("FAIL")
    return long.select("check", F.when(F.col("observed").isNull(), "NOT_VERIFIABLE").when(F.col("observed") == 0, "PASS").otherwise(bad).alias("status"), "observed")


def parity(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per shared column: rows on both sides, on one side only, unequal cells, greatest numeric difference."""
    shared = [c for c in a.columns if c in b.columns and c not in key]
    kinds = dict(a.dtypes)
    left = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in shared], F.lit(1).alias("_a"))
    right = b.select(*key, *[F.col(c).alias(f"b_{c}") for c in shared], F.lit(1).alias("_b"))
    both = left.join(right, list(key), "full")
    met = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    aggs = []
    for c in shared:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        numeric = kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint")
        diff = F.max(F.when(met, F.abs(x.cast("double") - y.cast("double")))) if numeric else F.lit(None).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count_if(met & ~x.eqNullSafe(y)).alias("mismatches"), diff.alias("max_abs_diff")).alias(f"s_{c}"))
    one = both.agg(F.count_if(met).alias("rows"), F.count_if(~met).alias("unmatched"), *aggs)
    return one.select("rows", "unmatched", F.explode(F.array(*[f"s_{c}" for c in shared])).alias("s")).select("s.*", "rows", "unmatched")


def recorded_against_recomputed(recorded: DataFrame, computed: DataFrame, key: Sequence[str], value: str, tolerance: float = 5e-7) -> DataFrame:
    """Both values per key, their difference, and whether it is within the tolerance (missing: false)."""
    r, c = recorded.withColumnRenamed(value, "recorded"), computed.withColumnRenamed(value, "computed")
    j = r.join(c, list(key), "full")
    d = F.abs(F.col("recorded") - F.col("computed"))
    return j.select(*key, "recorded", "computed", F.coalesce(d <= tolerance, F.lit(False)).alias("within"))


def sanity_gate(df: DataFrame, value: str, target: float, tolerance: float) -> DataFrame:
    ok = F.abs(F.col(value) - target) <= tolerance
    return df.withColumn("status", F.when(ok, "ok").otherwise("failed_sanity_gate"))


def blocked(spark, rows: Sequence[tuple[str, str]]) -> DataFrame:
    """Conditions that could not run: ``condition, status, reason``."""
    return spark.createDataFrame([(c, "blocked", r) for c, r in rows], "condition string, status string, reason string")


def registry(*tables: DataFrame) -> DataFrame:
    """Tables of different columns under each other; missing cells are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def bundle_sha256(names: Column, digests: Column) -> Column:
    """SHA-256 over name, NUL and raw digest of each entry, in the order of the arrays."""
    zero = F.unhex(F.lit("00"))
    parts = F.zip_with(names, digests, lambda n, d: F.concat(F.encode(n, "utf-8"), zero, F.unhex(d)))
    return F.sha2(F.aggregate(parts, F.unhex(F.lit("")), lambda a, x: F.concat(a, x)), 256)


def aggregate_fingerprint(files: DataFrame, path: str = "path", size: str = "bytes", digest: str = "sha256", by: Sequence[str] = ()) -> DataFrame:
    """SHA-256 over path, NUL, size, NUL, raw digest of all files of a group, sorted by path.

    The digest is defined over one byte sequence, so a group's entries (about 100 bytes a file) meet in one
    task; use ``by`` to split a large tree into folders.
    """
    zero = F.unhex(F.lit("00"))
    part = F.concat(F.encode(F.col(path), "utf-8"), zero, F.encode(F.col(size).cast("string"), "utf-8"), zero, F.unhex(digest))
    entries = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), part.alias("b"))))
    whole = F.aggregate(entries, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["b"]))
    return files.groupBy(*by).agg(F.sha2(whole, 256).alias("fingerprint"), F.count("*").alias("n_files"))


# Offset and prime of the 64-bit hash, as halves of 32 bits; the prime is 2 ** 40 + 0x1B3.
FNV_OFFSET = (0xCBF29CE4, 0x84222325)
FNV_LOW, FNV_SHIFT = 0x1B3, 8
HALF = (1 << 32) - 1


def fnv1a_64(column: str | Column, signed: bool = False) -> Column:
    """FNV-1a hash of bytes in 16 hex digits; ``signed`` prints it as a signed 64-bit integer.

    The product modulo 2 ** 64 is made of two halves of 32 bits, none of whose parts
    leaves 64 bits. Bytes are read off the hex form, so a value takes some 30 times its size in its task.
    """
    data = F.col(column) if isinstance(column, str) else column
    n = F.octet_length(data)
    # Positions from 1; an empty value has none.
    at = F.filter(F.sequence(F.lit(0), n), lambda i: i > 0)
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    both = lambda hi, lo: F.struct(hi.alias("hi"), lo.alias("lo"))

    def step(h: Column, i: Column) -> Column:
        x = h["lo"].bitwiseXOR(byte(i))
        low = x * FNV_LOW
        high = h["hi"] * FNV_LOW + F.shiftright(low, 32) + F.shiftleft(x, FNV_SHIFT)
        return both(high.bitwiseAND(F.lit(HALF)), low.bitwiseAND(F.lit(HALF)))

    start = both(*[F.lit(v).cast("long") for v in FNV_OFFSET])
    digits = lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))

    def text(h: Column) -> Column:
        plain = F.concat(digits(h["hi"]), digits(h["lo"]))
        if not signed:
            return plain
        lo = (F.lit(HALF + 1) - h["lo"]).bitwiseAND(F.lit(HALF))
        hi = (F.lit(HALF + 1) - h["hi"] - F.when(lo == 0, 0).otherwise(1)).bitwiseAND(F.lit(HALF))
        size = F.concat(F.lit("-"), F.ltrim(F.concat(digits(hi), digits(lo)), F.lit("0")))
        return F.when(h["hi"] > HALF // 2, F.when(F.length(size) < 16, F.lpad(size, 16, "0")).otherwise(size)).otherwise(plain)

    return F.when(data.isNotNull(), F.aggregate(at, start, step, text))


def manifest_checks(
    manifests: DataFrame, id: str, components: Sequence[str], classes: Sequence[str], thresholds: Sequence[str], actual: str | None = None
) -> DataFrame:
    """Faults of many model manifests, a row each: ``id, check, detail``; a valid one has none.

    A manifest has ``components`` (name, sha256) in order, ``classes`` in order, ``thresholds`` by name and
    ``bundle_sha256``; ``actual`` names a column with the digests of the component files, in the same order.
    Names and order have to be those given, digests 64 lowercase hex digits and those of the files,
    thresholds between 0 and 1, and the bundle's digest that of the components' own.
    No row meets another: nothing is shuffled.
    """
    want = F.array(*map(F.lit, components))
    names, digests = F.col("components.name"), F.col("components.sha256")
    digest = lambda c: F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))
    listed = F.coalesce(names == want, F.lit(False))
    sound = listed & F.forall(digests, digest)
    fault = lambda bad, check, detail: F.when(bad, F.struct(F.lit(check).alias("check"), detail.cast("string").alias("detail")))
    at = range(len(components))
    found = [
        fault(~listed, "components", F.array_join(F.coalesce(names, F.array().cast("array<string>")), ",", "")),
        *[fault(listed & ~digest(F.get(digests, F.lit(k))), "sha256", F.lit(components[k])) for k in at],
        fault(~F.coalesce(F.col("classes") == F.array(*map(F.lit, classes)), F.lit(False)), "classes", F.array_join(F.coalesce("classes", F.array().cast("array<string>")), ",", "")),
        *[fault(~F.coalesce(F.col("thresholds")[t].between(0, 1), F.lit(False)), "thresholds", F.lit(t)) for t in thresholds],
        fault(~digest(F.col("bundle_sha256")), "bundle_sha256", F.lit("no digest")),
        fault(sound & digest(F.col("bundle_sha256")) & (F.col("bundle_sha256") != bundle_sha256(names, F.when(sound, digests))), "bundle_sha256", F.lit("not that of the components")),
    ]
    if actual is not None:
        found += [fault(listed & digest(F.get(digests, F.lit(k))) & ~F.coalesce(F.get(actual, F.lit(k)) == F.get(digests, F.lit(k)), F.lit(False)), "file", F.lit(components[k])) for k in at]
    return manifests.select(id, F.inline(F.array_compact(F.array(*found))))


def completeness(
    expected: Mapping[str, DataFrame], present: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], values: Mapping[str, Sequence[str]], tolerance: float = 1e-6
) -> DataFrame:
    """Whether written tables hold all of their sources: a row per expected table.

    ``table, expected_rows, rows, missing_keys, extra_keys, repeated_keys, off_values, status``; a key value is off if it differs by
    more than the tolerance or only one side has it. Both sides of a table are summed up per key
    before they meet. A table that was not written has no rows.
    """
    out = []
    for name, source in expected.items():
        key, own = list(keys[name]), list(values.get(name, ()))
        written = present.get(name)
        written = source.limit(0) if written is None else written

        def side(df: DataFrame, mark: str, key=key, own=own) -> DataFrame:
            # Of a key that repeats, the least values stand for it; the repetition is counted.
            return df.groupBy(*key).agg(F.count("*").alias(f"n_{mark}"), *[F.min(F.col(c).cast("double")).alias(f"{mark}_{c}") for c in own])

        a, b = side(source, "a"), side(written, "b").withColumnsRenamed({k: f"_{k}" for k in key})
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
        j = a.join(b, on, "full")
        na, nb = (F.coalesce(f"n_{m}", F.lit(0)) for m in "ab")
        off = [~F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance, F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))) for c in own]
        both = (na > 0) & (nb > 0)
        wide = j.agg(
            F.coalesce(F.sum(na), F.lit(0)).alias("expected_rows"), F.coalesce(F.sum(nb), F.lit(0)).alias("rows"), F.count_if(nb == 0).alias("missing_keys"), F.count_if(na == 0).alias("extra_keys"),
            F.count_if(both & (nb > na)).alias("repeated_keys"), sum((F.count_if(both & o) for o in off), F.lit(0)).cast("long").alias("off_values"),
        )
        fine = (F.col("expected_rows") == F.col("rows")) & (F.greatest("missing_keys", "extra_keys", "repeated_keys", "off_values") == 0)
        out.append(wide.select(F.lit(name).alias("table"), "*", F.when(fine, "PASS").otherwise("FAIL").alias("status")))
    return reduce(DataFrame.unionByName, out)


def manifest_faults(spark, manifest: Mapping, components: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Faults of a model manifest, a row each: ``check, detail``; none for a valid one."""
    found: list[tuple[str, str]] = []

    def need(ok: bool, check: str, detail: str) -> None:
        if not ok:
            found.append((check, detail))

    listed = manifest.get("components")
    need(isinstance(listed, list) and all(isinstance(c, dict) for c in listed), "components", "must be a list of objects")
    if isinstance(listed, list) and all(isinstance(c, dict) for c in listed):
        need([c.get("name") for c in listed] == list(components), "components", "names or order differ")
        for c in listed:
            s = c.get("sha256")
            need(isinstance(s, str) and len(s) == 64 and set(s) <= set("0123456789abcdef"), "sha256", f"{c.get('name')}: {s!r}")
    need(manifest.get("classes") == list(classes), "classes", "names or order differ")
    for k, v in (manifest.get("thresholds") or {}).items():
        number = isinstance(v, (int, float)) and not isinstance(v, bool)
        need(number and 0 <= v <= 1, "thresholds", f"{k}: {v!r}")
    need(bool(manifest.get("thresholds")), "thresholds", "missing")
    return spark.createDataFrame(found, "check string, detail string")


def count_lines(df: DataFrame, content: str) -> DataFrame:
    """Adds ``n_lines``: newlines of a binary column less one (a header)."""
    lines = F.pandas_udf(lambda s: pd.Series([None if b is None else b.count(b"\n") - 1 for b in s], dtype="Int64"), "long")
    return df.withColumn("n_lines", lines(content))
