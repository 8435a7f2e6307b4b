"""Main text of web pages by a site style tree."""

from __future__ import annotations

import re
from collections.abc import Iterator, Set
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.llm.text import small_batches
from cohortal.llm.urls import url_parts
from cohortal.session import materialize

# Elements by role, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An opening tag of the left closes an open element of the right.
CLOSES = {
    "p": {"p"}, "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"},
    "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"option"},
}
#: Other block elements close an open paragraph only.
BLOCKED = {"p"}
#: Closing an element stops at these: a stray end tag does not close what lies around.
SCOPE = frozenset("html body article main section div table td th ul ol blockquote".split())
#: Elements that never hold main text, and words of class, id or role that mark such parts.
BOILER_TAGS = frozenset(
    "nav footer aside form script style noscript template iframe button select textarea dialog svg head title menu "
    "object canvas audio video map".split()
)
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert newsletter subscribe subscription sidebar aside menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist reply replies "
    "respond disqus share sharing social related recommended widget widgets popup modal overlay login signin signup "
    "search searchbox pagination pager skip copyright legal disclaimer".split()
)
MAIN_WORDS = frozenset("articlebody main".split())

TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>)""", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-zA-Z]+")
MAIN, BOILER, NEUTRAL = "main", "boiler", ""
#: Containers that say nothing themselves: without a name, they are told apart by the kinds of their children.
PLAIN = frozenset("div section span td center font".split())


def describe(tag: str, attributes: str) -> tuple[str, str]:
    """Label of an element for its path, and what its tag and names say about it."""
    words: list[str] = []
    main = tag in ("article", "main")
    if attributes and "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            found = [w.lower() for w in NAME.findall(m[2] or m[3] or m[4] or "")]
            if m[1].lower() in ("role", "itemprop"):
                main = main or bool(MAIN_WORDS.intersection(found))
            words += found
    label = tag + ("." + ".".join(words) if words else "")
    if tag in BOILER_TAGS:
        return label, BOILER
    if main and not {"comment", "comments", "reply", "ad", "ads", "sponsored"}.intersection(words):
        return label, MAIN
    return label, BOILER if BOILER_WORDS.intersection(words) else NEUTRAL


@dataclass
class Page:
    """A page as lists: nodes in the order of their opening tags (0 is the root) and text blocks.

    Of a node: the number of its parent (always less than its own), its label, role in force
    and the labels of its element children in turn, repeats once. A block is the text between
    two block-level tags: (node, raw text).
    """

    parent: list[int] = field(default_factory=lambda: [0])
    label: list[str] = field(default_factory=lambda: [""])
    role: list[str] = field(default_factory=lambda: [NEUTRAL])
    children: list[list[str]] = field(default_factory=lambda: [[]])
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def paths(self) -> list[int]:
        """A number per node for the labels from the root down to it.

        Each is a hash of the parent's number and the own label, so the cost does not depend on
        the depth. Unnamed plain containers add the kinds of their children to the label.
        """
        out = [0]
        for i in range(1, len(self.label)):
            label = self.label[i]
            if label in PLAIN and self.children[i]:
                label += "(" + " ".join(sorted({c.split(".", 1)[0] for c in self.children[i]})) + ")"
            out.append(digest(label, out[self.parent[i]]))
        return out

    def main_blocks(self) -> list[tuple[int, str]]:
        """Blocks of the main container; without one, all that nothing marks as something else."""
        roles = [self.role[i] for i, _ in self.blocks]
        wanted = MAIN if MAIN in roles else NEUTRAL
        return [b for b, role in zip(self.blocks, roles, strict=True) if role == wanted]


def parse(html: str | None, names: bool = True) -> Page:
    """Nodes and text blocks of a page, in one pass over it.

    A node's role is that of the nearest container that has one, ``boiler`` first. Without
    ``names`` there are no roles and no names in labels: what remains are bare tags.
    """
    html = html or ""
    page = Page()
    # Open elements: tag and node.
    stack: list[tuple[str, int]] = [("", 0)]
    parts: list[str] = []
    known: dict[tuple[str, str], tuple[str, str]] = {}

    def end_block() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            if text and not text.isspace():
                page.blocks.append((stack[-1][1], text))

    at, n = 0, len(html)
    tags_end = html.rfind(">") + 1  # no tag ends beyond
    while at < n:
        m = TAG.search(html, at, tags_end) if at < tags_end else None
        if m is None:
            if "<!--" in html[max(at, tags_end) :]:  # a comment that never ends
                parts.append(html[at : html.index("<!--", max(at, tags_end))])
            else:
                parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if at == tags_end and m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            continue
        tag = tag.lower()
        closing = m[1] == "/"
        if tag == "br":
            parts.append(" ")
            continue
        attributes = m[3]
        if tag in INLINE and (closing or not attributes or "class" not in attributes and "id" not in attributes):
            if closing and len(stack) > 1 and stack[-1][0] == tag:  # an inline element with a name
                end_block()
                stack.pop()
            continue
        if tag in INLINE and describe(tag, attributes)[1] != BOILER:
            continue
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    end_block()
                    del stack[depth:]
                    break
                if stack[depth][0] in SCOPE and tag not in SCOPE:
                    break
            else:
                end_block()
            continue
        if tag in ("script", "style"):  # nothing that is seen, so no break either
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else n
            continue
        end_block()
        if tag in VOID:
            page.children[stack[-1][1]].append(tag)
            continue
        if tag not in INLINE:
            shut = CLOSES.get(tag, BLOCKED)
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in shut:
                    del stack[depth:]
                    break
                if stack[depth][0] in SCOPE and stack[depth][0] not in shut:
                    break
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else n
            continue
        if attributes.endswith("/") and tag not in INLINE and tag in ("svg", "path", "iframe"):
            continue
        key = (tag, attributes)
        if key not in known:
            known[key] = describe(tag, attributes) if names else (tag, NEUTRAL)
        label, says = known[key]
        up = stack[-1][1]
        role = page.role[up]
        if role != BOILER and names:
            if tag == "header" and role != MAIN:
                role = BOILER
            elif says == BOILER or says == MAIN:
                role = says
        siblings = page.children[up]
        if not siblings or siblings[-1] != label:
            siblings.append(label)
        stack.append((tag, len(page.label)))
        page.parent.append(up), page.label.append(label), page.role.append(role), page.children.append([])
    end_block()
    return page


def text_of(raw: str) -> str:
    """Character references decoded, white space runs as one space, trimmed."""
    return " ".join((unescape(raw) if "&" in raw else raw).split())


def digest(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed) >> 1


def main_text(html: str | None, low: Set[int] = frozenset(), names: bool = True) -> str:
    """Blocks of the main part in page order, joined by one space.

    Where a page has a main container, that is its text, else all that no name or tag marks as
    something else. ``low`` are what the site's style tree rates low: paths (all below them
    goes too), and single blocks, by the hash of path and text. They go inside a main
    container as well.
    """
    page = parse(html, names)
    gone: list[bool] = []
    paths: list[int] = []
    if low:
        paths = page.paths()
        for i, p in enumerate(paths):
            gone.append(p in low or i > 0 and gone[page.parent[i]])
    kept = []
    for node, raw in page.main_blocks():
        text = text_of(raw)
        if text and not (low and (gone[node] or digest(text, paths[node]) in low)):
            kept.append(text)
    return " ".join(kept)


#: What a page says about one of its paths: the path above, whether it is in a main container, styles and text blocks.
OWN = pa.list_(
    pa.struct(
        [("path", pa.int64()), ("up", pa.int64()), ("main", pa.bool_()), ("s", pa.list_(pa.int64())), ("c", pa.list_(pa.int64()))]
    )
)


def own_features(page: Page) -> list[tuple]:
    """Rows of ``OWN`` for a page: each path once, without branches that names rule out."""
    at: dict[int, tuple] = {}
    paths = page.paths()
    for i, p in enumerate(paths):
        if page.role[i] != BOILER:
            own = at.setdefault(p, (paths[page.parent[i]], page.role[i] == MAIN, set(), set()))
            own[2].add(digest("|".join(page.children[i])))
    for i, raw in page.blocks:
        if page.role[i] != BOILER:
            text = text_of(raw)
            if text:
                at[paths[i]][3].add(digest(text, paths[i]))
    return sorted((p, up, main, sorted(s), sorted(c)) for p, (up, main, s, c) in at.items())


def page_features(pages: DataFrame, host: str = "host", html: str = "html", names: bool = True) -> DataFrame:
    """``host, page, own``: a row per host and distinct main text, with what its page says about paths.

    Pages of a host with the same main text are one page, so that mirrors weigh once. Rows are
    combined within a batch and then by an aggregate.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, list] = {}
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parse(html, names)
                own = own_features(page)
                text = digest("\n".join(text_of(raw) for _, raw in page.main_blocks()))
                seen[name, text] = min(own, seen.get((name, text), own))
            keys = ("path", "up", "main", "s", "c")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in seen], pa.string()),
                    pa.array([k[1] for k in seen], pa.int64()),
                    pa.array([[dict(zip(keys, o, strict=True)) for o in own] for own in seen.values()], OWN),
                ],
                names=["host", "page", "own"],
            )

    rows = pages.select(F.col(host).alias("host"), F.col(html).alias("html")).mapInArrow(
        features, "host string, page long, own array<struct<path:long,up:long,main:boolean,s:array<long>,c:array<long>>>"
    )
    return rows.groupBy("host", "page").agg(F.min("own").alias("own"))


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key, path and feature the number ``n`` of pages: kind ``m`` (the path itself), ``s`` (style) or ``c`` (text block)."""
    at = rows.select(*keys, F.explode("own").alias("o")).select(*keys, "o.*")
    of = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("feature")))
    there = F.array(F.struct(F.lit("m").alias("kind"), F.lit(0).cast("long").alias("feature")))
    each = at.select(*keys, "path", "up", "main", F.explode(F.concat(there, of("s"), of("c"))).alias("f"))
    return each.select(*keys, "path", "up", "main", "f.*").groupBy(*keys, "path", "up", "main", "kind", "feature").agg(F.count("*").alias("n"))


def losses(each: DataFrame, *keys: str) -> DataFrame:
    """Per key and path the counts behind both entropies.

    ``c_n`` text blocks on pages, and ``c_lost``: how many of them repetition takes away. Blocks
    that are on n pages each have the normalised entropy ``1 - sum(n ln n) / (N ln N)``, N
    being all of them; ``c_lost`` is N times what is missing from 1. Likewise ``s_lost`` for
    the ``n_pages`` styles. Sums only, combined before the shuffle.
    """
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))
    nodes = each.groupBy(*keys, "path", "up", "main").agg(
        of("m", F.col("n")).alias("n_pages"),
        of("s", F.col("n") * F.ln("n")).alias("s_log"),
        of("s", F.lit(1)).alias("n_styles"),
        of("c", F.col("n") * F.ln("n")).alias("c_log"),
        of("c", F.col("n")).alias("c_n"),
    )
    lost = lambda log, n: F.when(F.col(n) > 1, F.col(log) / F.ln(n)).otherwise(0.0)
    return nodes.select(
        *keys, "path", "up", "main", "n_pages", "c_n", lost("c_log", "c_n").alias("c_lost"), lost("s_log", "n_pages").alias("s_lost")
    )


def style_tree(rows: DataFrame, prior: float = 8.0, hosts_prior: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """The merged trees of all hosts from ``page_features``: their nodes, and their counted features.

    Elements of all pages of a host that have the same path are one node. Per node:
    ``node_importance`` (entropy of the styles) and ``content_importance`` (entropy of the
    text blocks, each weighed by its pages; null without own text), both between 0 (all pages
    alike) and 1, and drawn towards 1 as by ``prior`` pages that repeat nothing, so that a few
    pages say little. Content is also rated in the merged tree of all hosts, in which a main
    text counts once: the product of both ratings is the node's. What the corpus says counts
    by the square of ``h / (h + hosts_prior)`` for a path that h hosts have.
    """
    each = materialize(counted(rows, "host"))
    site = losses(each, "host")
    once = rows.groupBy("page").agg(F.min("own").alias("own"))
    corpus = losses(counted(once)).where("c_n > 1").groupBy("path").agg(F.sum("c_lost").alias("lost"), F.sum("c_n").alias("all_n"))
    hosts = each.where("kind = 'm'").groupBy("path").agg(F.count_distinct("host").alias("h"))
    weight = F.pow(F.col("h") / (F.col("h") + hosts_prior), F.lit(2.0))
    everywhere = corpus.join(hosts, "path").select("path", (F.col("lost") / (F.col("all_n") + prior) * weight).alias("corpus_lost"))
    nodes = site.join(everywhere, "path", "left").select(
        "host",
        "path",
        "up",
        "main",
        "n_pages",
        "c_n",
        (1 - F.col("s_lost") / (F.col("n_pages") + prior)).alias("node_importance"),
        F.when(
            F.col("c_n") > 0, (1 - F.col("c_lost") / (F.col("c_n") + prior)) * (1 - F.coalesce("corpus_lost", F.lit(0.0)))
        ).alias("content_importance"),
    )
    return materialize(nodes), each


def low_branches(nodes: DataFrame, plain: float = 0.7, inside: float = 0.3, decay: float = 0.9) -> DataFrame:
    """``host, low``: a row per path of low composite importance.

    From the leaves up, a node's composite importance is its own (presentation) weighed by
    ``1 - decay ** children``, and the mean of its children's, of which its own text is one,
    each weighed by its pages. It is low below ``plain``, in main containers below ``inside``,
    and only if no rated node in it is high. One group per host holds a row of numbers per
    distinct path, not its pages; paths on one page only can be neither repeated nor low in
    their site and stay outside, unless the corpus rates them low.
    """

    def rate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        known = {r.path: r for r in pdf.itertuples()}
        below: dict[int, list[int]] = {p: [] for p in known}
        for r in known.values():
            if r.up in below and r.up != r.path:
                below[r.up].append(r.path)
        order = [p for p, r in known.items() if r.up not in known or r.up == p]
        for p in order:  # grows while it is read: parents first
            order += below[p]
        rated: dict[int, float | None] = {}
        high: set[int] = set()
        for p in reversed(order):
            r = known[p]
            values = [(rated[c], known[c].n_pages) for c in below[p] if rated[c] is not None]
            k = len(below[p])
            if not pd.isna(r.content_importance):
                values.append((r.content_importance, r.n_pages))
            total = sum(n for _, n in values)
            mean = sum(v * n for v, n in values) / total if total else None
            rated[p] = None if mean is None else (1 - decay**k) * r.node_importance + decay**k * mean
            bound = inside if r.main else plain
            own_high = not pd.isna(r.content_importance) and r.content_importance >= bound
            if own_high or any(c in high for c in below[p]):
                high.add(p)
        low = [p for p, v in rated.items() if v is not None and p not in high and v < (inside if known[p].main else plain)]
        return pd.DataFrame({"host": [key[0]] * len(low), "low": sorted(low)}).astype({"low": "int64", "host": object})

    shared = nodes.where((F.col("n_pages") > 1) | (F.col("content_importance") < plain))
    return shared.groupBy("host").applyInPandas(rate, "host string, low long")


def repeated_blocks(each: DataFrame, nodes: DataFrame, threshold: float = 0.3, prior: float = 8.0) -> DataFrame:
    """``host, low``: text blocks that, taken alone, are of low importance among the pages of their path.

    A block on n of m pages has the importance ``1 - ln n / ln m``, drawn towards 1 by ``prior`` pages.
    """
    pages = nodes.where("n_pages > 1").select(F.col("host").alias("k_host"), F.col("path").alias("k_path"), F.col("n_pages").alias("m"))
    some = each.where("kind = 'c' and n > 1")
    # Pages without a host form one site: null hosts meet.
    both = some.join(pages, F.col("host").eqNullSafe(F.col("k_host")) & (F.col("path") == F.col("k_path")))
    lost = F.ln("n") / F.ln("m") * F.col("m") / (F.col("m") + prior)
    return both.where(1 - lost < threshold).select("host", F.col("feature").alias("low"))


def low_by_page(pages: DataFrame, low: DataFrame, names: bool) -> DataFrame:
    """``low_host, low_key, low``: per host and hash of a page's html those low branches and blocks that it has."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for html in batch.column(2).to_pylist():
                own = own_features(parse(html, names))
                found.append([x for p, _, _, _, c in own for x in (p, *c)])
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "key", "has"])

    has = pages.select("site_host", "site_key", "site_html").mapInArrow(entries, "host string, key long, has array<long>")
    has = has.select("host", "key", F.explode("has").alias("has")).distinct()
    rated = low.select(F.col("host").alias("r_host"), F.col("low").alias("r_low")).distinct()
    hits = has.join(rated, F.col("host").eqNullSafe(F.col("r_host")) & (F.col("has") == F.col("r_low")))
    return hits.groupBy(F.col("host").alias("low_host"), F.col("key").alias("low_key")).agg(F.collect_list("has").alias("low"))


def extract(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    keep: tuple[str, ...] = ("page_id", "url"),
    names: bool = True,
    max_broadcast: int = 4 << 20,
) -> DataFrame:
    """Main text of every page: the ``keep`` columns, ``text`` and ``n_chars``.

    The host's style tree rates branches (see ``style_tree`` and ``low_branches``); each page is
    then read again, and its branches of low importance, menus, adverts and the like are
    left out (see ``main_text``). Pages are never gathered by host. Low branches and blocks
    whose measured size is at most ``max_broadcast`` bytes go to all tasks at once; larger ones are joined
    to the pages that have them, with the same result. With ``names=False`` the tree decides alone, on bare tags.

    Null or empty html gives an empty text. Pages without a host form one site. A site of
    few pages is judged by tags, names and what the corpus says about its paths; pages of one
    main text count as one, so that mirrored pages keep theirs. Repeated rows and null keys
    stay; an empty table gives an empty result; other columns are not read.
    """
    small_batches(pages.sparkSession)
    host = url_parts(url)[0]
    raw = F.col(html)
    sited = pages.select(
        *keep, host.alias("site_host"), F.xxhash64(F.coalesce(raw, F.lit(""))).alias("site_key"), raw.alias("site_html")
    )
    rows = materialize(page_features(sited, "site_host", "site_html", names))
    nodes, each = style_tree(rows)
    low = materialize(low_branches(nodes).unionByName(repeated_blocks(each, nodes)))
    size = low.agg(F.sum(F.coalesce(F.octet_length("host"), F.lit(0)) + 8)).first()[0] or 0
    if size <= max_broadcast:
        by_host: dict[str | None, set[int]] = {}
        for r in low.collect():
            by_host.setdefault(r.host, set()).add(r.low)

        @F.pandas_udf("string")
        def read(html: pd.Series, host: pd.Series) -> pd.Series:
            none: set[int] = set()
            found = [main_text(h, by_host.get(None if pd.isna(s) else s, none), names) for h, s in zip(html, host, strict=True)]
            return pd.Series(found, dtype=object)

        out = sited.select(*keep, read("site_html", "site_host").alias("text"))
    else:

        @F.pandas_udf("string")
        def read_listed(html: pd.Series, low: pd.Series) -> pd.Series:
            found = [main_text(h, set() if x is None else set(x.tolist()), names) for h, x in zip(html, low, strict=True)]
            return pd.Series(found, dtype=object)

        own = low_by_page(sited, low, names)
        on = F.col("site_host").eqNullSafe(F.col("low_host")) & (F.col("site_key") == F.col("low_key"))
        out = sited.join(own, on, "left").select(*keep, read_listed("site_html", "low").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
