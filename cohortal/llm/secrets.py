"""Secret scan with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.llm.bitfilter import marked
from cohortal.llm.jaccard import join_sized
from cohortal.llm.text import packed, small_batches, unpacked
from cohortal.session import materialize

ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Formats with a fixed shape that issuers of credentials document in public, each with a part that all of them have.
OTHERS = (
    ("jwt", "eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("pem", "-----BEGIN", re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]{20,}-----END (?:[A-Z]+ )?PRIVATE KEY-----")),
    ("bearer", "earer", re.compile(r"[Bb]earer\x20+([A-Za-z0-9+/_.=-]{16,})", re.A)),
    ("forge", "gh", re.compile(r"gh[pousr]_[A-Za-z0-9_]{16,}")),
    ("chat", "xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{16,}")),
)
KINDS = ("assign", "access", "hex", *(k for k, _, _ in OTHERS))
#: Values that documentation uses where a credential would stand.
PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|test|\.\.\.|(.)\1{7}")
def find(text: str | None) -> list[tuple[str, int, int, str]]:
    """Spans (kind, start, end, credential) by start, then kind as listed; end exclusive."""
    text, found = text or "", []
    if "=" in text or ":" in text:
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    for kind, mark, pattern in OTHERS:
        if mark in text:
            found += [(kind, *m.span(), m[m.lastindex or 0]) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def credential_hash(value: str) -> str:
    return xxhash.xxh3_128_hexdigest(value.encode("utf-8", "surrogatepass"))


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


SCAN = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "candidates array<struct<kind:string,start:int,end:int,hash:string,strong:boolean>>"
)


def scan_texts(docs: DataFrame, keep: dict[str, str], text: str = "text") -> DataFrame:
    """Spans of every whole text, with counts of the base kinds. No shuffle."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(SCAN)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "candidates"]
        for texts in batches:
            rows = []
            for t in texts:
                found = find(t)
                base = [x for x in found if x[0] in KINDS[:3]]
                n = Counter(x[0] for x in base)
                candidates = [
                    {
                        "kind": k,
                        "start": a,
                        "end": b,
                        "hash": credential_hash(v),
                        "strong": len(v) >= 12 and entropy(v) >= 2.5 and not PLACEHOLDER.search(v),
                    }
                    for k, a, b, v in found
                ]
                sha = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((n["assign"], n["access"], n["hex"], sha, joined(found), candidates))
            yield pd.DataFrame(rows, columns=names)

    columns = [F.col(c).alias(name) for name, c in keep.items()]
    hashed = F.xxhash64(text).alias("text_hash")
    return docs.select(*columns, hashed, scan(F.col(text)).alias("s")).select(*keep, "text_hash", "s.*")


def secret_scan(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    owner: str = "source",
    repository: str | None = None,
    widely_owners: int = 3,
    widely_repositories: int = 10,
    own_spans: bool = False,
) -> DataFrame:
    """Find secrets and tell widely copied examples from owner-specific credentials.

    Every candidate value is hashed; over the whole corpus each hash is counted by distinct
    ``repository`` (by default the document itself) and distinct ``owner``. A value that
    ``widely_owners`` owners or ``widely_repositories`` repositories of two owners or more
    share is an example (``copied``). A value of few owners that is long and random enough
    and has no placeholder wording is ``live``. The rest is ``weak``.

    One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    live_spans, n_live, n_copied, n_weak, text_hash``. Spans are kind:start:end in code points.
    With ``own_spans`` there is also a column of that name: the spans of live and weak values.

    Only hashes, never values or texts, are shuffled, and only rows with candidates. Distinct
    repositories and owners are reduced map-side first, so that a value which a third of all
    documents share costs a row per task. Null texts are empty; null owners count as one owner; a
    null id is a repository of its own kind. Repeated rows get a result each.
    """
    repo = repository or id
    found = materialize(scan_texts(docs, {"doc_id": id, "owner": owner, "repository": repo}, text))
    each = found.where(F.size("candidates") > 0).select(
        F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col("repository").cast("string"), F.lit("")).alias("repository"),
        F.explode(F.array_distinct(F.transform("candidates", lambda c: c["hash"]))).alias("hash"),
    )
    owners = each.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("n_owners"))
    repos = each.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("n_repositories"))
    spread = owners.join(repos, "hash").select(
        "hash",
        (
            (F.col("n_owners") >= widely_owners)
            | ((F.col("n_repositories") >= widely_repositories) & (F.col("n_owners") >= 2))
        ).alias("widely"),
    )
    # Rows of equal id and equal candidates get equal verdicts, so that one row of each is judged.
    key = F.xxhash64("spans", F.to_json("candidates"))
    found = found.withColumn("key", key)
    with_some = found.where(F.size("candidates") > 0)
    one = with_some.select("doc_id", "key", "candidates").dropDuplicates(["doc_id", "key"])
    named = one.select("doc_id", "key", F.explode("candidates").alias("c")).select("doc_id", "key", "c.*")
    # A value that a third of all rows share has its verdict brought to the tasks that hold these rows.
    named = materialize(named)
    sizes = named.groupBy("hash").agg(F.count("*").alias("n_rows"))
    sized = materialize(spread.join(sizes, "hash"))
    judged = join_sized(named, sized.select("hash", "widely", "n_rows"), "hash", "n_rows", named.count()).withColumn(
        "is", F.when(F.col("widely"), "copied").when(F.col("strong"), "live").otherwise("weak")
    )
    span = F.concat_ws(":", "kind", "start", "end")
    places = lambda which: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("start", "end", span.alias("span"))))), lambda p: p["span"]), ","
    )
    own = ["own_spans"] if own_spans else []
    verdicts = judged.groupBy("doc_id", "key").agg(
        F.count_if(F.col("is") == "live").alias("n_live"),
        F.count_if(F.col("is") == "copied").alias("n_copied"),
        F.count_if(F.col("is") == "weak").alias("n_weak"),
        places(F.col("is") == "live").alias("live_spans"),
        *[places(F.col("is") != "copied").alias(c) for c in own],
    )
    right = verdicts.withColumnRenamed("doc_id", "v_id").withColumnRenamed("key", "v_key")
    on = F.col("doc_id").eqNullSafe(F.col("v_id")) & (F.col("key") == F.col("v_key"))
    base = ["doc_id", "text_hash", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rated = with_some.join(right, on, "left").select(
        *base, F.coalesce("live_spans", F.lit("")).alias("live_spans"), zero("n_live"), zero("n_copied"), zero("n_weak"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in own],
    )
    none = found.where(F.size("candidates") == 0).select(
        *base,
        F.lit("").alias("live_spans"),
        *[F.lit(0).cast("long").alias(c) for c in ("n_live", "n_copied", "n_weak")],
        *[F.lit("").alias(c) for c in own],
    )
    return none.unionByName(rated)


def mask(text: str | None, live_spans: str | None) -> str | None:
    """The text with every live span replaced by a marker of its kind."""
    if not text or not live_spans:
        return text
    out, at = [], 0
    for span in live_spans.split(","):
        kind, a, b = span.split(":")
        a, b = int(a), int(b)
        if b <= at:
            continue
        out.append(text[at : max(a, at)])
        if a >= at:
            out.append(f"<{kind}>")
        at = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """All rows of ``docs``, their live and weak credentials replaced by markers; copied examples stay.

    Ownership alone decides: a short or simple value of few owners goes too. Only rows that may
    have such spans, by a filter of fixed size over their text hashes, are shuffled with their
    texts. ``n_chars`` follows the text where there is such a column. Null and empty texts and
    columns of any name stay as they are; repeated rows are masked alike; an empty table stays empty.
    """
    found = secret_scan(docs, text=text, id=id, own_spans=True, **options).where("own_spans != ''")
    live = materialize(found.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "own_spans").distinct())
    rows = marked(packed(docs, row_id=F.col(id), row_hash=F.xxhash64(text)), "row_hash", live, "own_hash")
    on = F.col("row_id").eqNullSafe(F.col("own_id")) & (F.col("row_hash") == F.col("own_hash"))
    some = rows.where("maybe").join(live, on, "left")
    masked = F.pandas_udf(lambda t, s: pd.Series([mask(a, b) for a, b in zip(t, s, strict=True)], dtype=object), "string")
    hit = some.where("own_spans is not null").withColumn("masked", masked(F.col("row")[text], "own_spans"))
    changed = {text: F.col("masked")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("masked").cast(dict(docs.dtypes)["n_chars"])
    kept = rows.where("not maybe").select("row").unionByName(some.where("own_spans is null").select("row"))
    return unpacked(kept, docs.columns).unionByName(unpacked(hit, docs.columns, **changed))
