"""URL filter: expand, join on short hash prefixes, confirm full digests, apply precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.session import broadcast_if_small, materialize

#: Hex digits of the digest that the equi-join compares first.
PREFIX_HEX = 8


def url_parts(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    has = F.instr(url, "://") > 0
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def filter_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Judge every row's URL by the longest rule that fits it.

    ``rules`` has ``host``, ``path`` (starting with ``/``) and ``verdict``. A rule fits its
    host and all subdomains where the URL's path starts with the rule's path. Of the rules
    that fit, the longest ``host + path`` wins; of equally long ones the one that blocks.

    Distinct (host, path) pairs are expanded into those host suffixes that some rule has, times path
    prefixes of the lengths that the rules of this host have, joined with the rules on the first hex
    digits of a SHA-256, confirmed on the full digest, and reduced to the winner by an aggregate
    that combines before its shuffle. Verdicts of pairs with more than a ten-thousandth of all rows
    are broadcast to these; rows without a host meet nothing. Returns the ``keep`` columns, ``host``,
    ``path``, ``rule`` and ``verdict`` (``default`` where no rule fits: null and odd URLs, an
    empty rule table).
    """
    host, path = url_parts(url)
    judged = pages.select(*keep, host.alias("host"), path.alias("path"))
    usable = rules.where("host is not null and path is not null and verdict is not null")
    r = materialize(
        usable.select(
            F.substring(_digest(F.col("host"), F.col("path")), 1, PREFIX_HEX).alias("short"),
            _digest(F.col("host"), F.col("path")).alias("digest"),
            F.concat("host", "path").alias("rule"),
            F.col("verdict").alias("says"),
            F.col("host").alias("suffix"),
            F.length("path").alias("path_len"),
            F.size(F.split("host", r"\.")).alias("n_labels"),
        ).distinct()
    )
    # Numbers of labels in rules take few values, whatever the URLs look like.
    labels = sorted(x[0] for x in r.select("n_labels").distinct().collect())
    dots = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))
    suffixes = F.array(*[F.when(dots >= k - 1, F.substring_index("host", ".", -k)) for k in labels])
    suffixes = F.array_compact(suffixes) if labels else F.array().cast("array<string>")
    pairs = judged.where("host != ''").groupBy("host", "path").agg(F.count("*").alias("n_rows"))
    lengths = r.groupBy("suffix").agg(F.collect_set("path_len").alias("lengths"))
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    expanded = (
        pairs.select("host", "path", "n_rows", F.explode(suffixes).alias("suffix"))
        .join(broadcast_if_small(materialize(lengths)), "suffix")
        .select("host", "path", "n_rows", "suffix", F.explode(fitting).alias("path_len"))
        .select("host", "path", "n_rows", _digest(F.col("suffix"), F.expr("substring(path, 1, path_len)")).alias("own"))
        .withColumn("short", F.substring("own", 1, PREFIX_HEX))
    )
    fits = expanded.join(broadcast_if_small(r.select("short", "digest", "rule", "says")), "short").where("own = digest")
    rank = F.struct(F.length("rule"), (F.col("says") == "block"), F.col("rule"), F.col("says"))
    best = fits.groupBy("host", "path", "n_rows").agg(F.max(rank).alias("best"))
    best = materialize(best.select("host", "path", "n_rows", F.col("best.rule").alias("rule"), F.col("best.says").alias("says")))
    # No more than ten thousand pairs have a ten-thousandth of all rows.
    total = best.agg(F.sum("n_rows")).first()[0] or 0
    hot = F.col("n_rows") > max(200, total // 10_000)
    often = judged.where("host != ''").join(F.broadcast(best.where(hot).drop("n_rows")), ["host", "path"], "left")
    seldom = often.where("says is null").drop("rule", "says").join(best.where(~hot).drop("n_rows"), ["host", "path"], "left")
    none = judged.where("host = ''").select("*", *[F.lit(None).cast("string").alias(c) for c in ("rule", "says")])
    out = often.where("says is not null").unionByName(seldom).unionByName(none)
    return out.select(*keep, "host", "path", "rule", F.coalesce("says", F.lit(default)).alias("verdict"))
