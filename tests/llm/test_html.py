import math
import random
import time
from collections import Counter, defaultdict

import pytest

from cohortal.llm import html as H

CASES = [
    (None, ""),
    ("", ""),
    ("plain  a < b &amp; c", "plain a < b & c"),
    ("<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><article><h1>T</h1><p>One <b>two</b>\n three<br>four<p>Five</article><footer>f</footer>", "T One two three four Five"),
    ("<div class='ad'>x</div><p>Main</p><div id=cookie-notice>c</div><aside>s</aside><form>q<input></form>", "Main"),
    ("<article>A<script>var t='</p>';if(a<b){}</script>B<!-- <p>no</p> -->C</article>", "ABC"),
    ("<article><p>kept</p><section class='comments'><p>nice!</p></section><div class=share>s</div></article><article class='comment'>no</article>", "kept"),
    ("<main><div class=post-body><p>a</p><ul><li>x<li>y</ul></div></main><p>outside</p>", "a x y"),
    ("<p>&#233;&eacute;&nbsp;&amp;amp; &zqx;</p>", "éé &amp; &zqx;"),
    ("<article><p>a <a href='x>y'>link</a></p>", "a link"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ("<script>never closed <p>x</p>", ""),
    ("<p>one</div></span></p>two", "one two"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_main_text(page, text):
    assert H.main_text(page) == text


def test_long_and_broken_pages():
    assert H.main_text("<p>" + "x " * 200_000 + "</p>").count("x") == 200_000
    assert H.main_text("<" * 5_000 + "p>" + "<div>" * 2_000 + "deep").endswith("deep")
    assert H.main_text("<p title='" + '"' * 3_000 + ">t") in ("t", "<p title='" + '"' * 3_000 + ">t")


def test_site_tree_removes_what_a_host_repeats(spark):
    def page(k):
        return f"<body><div class=brand><p>Same slogan everywhere</p></div><div class=story><p>Story {k} with its own words</p><p>More of {k}</p></div></body>"

    rows = [(k, f"http://h.org/{k}", page(k)) for k in range(12)]
    rows += [(100 + k, "http://lone.org/", page(k)) for k in range(2)] + [(200, None, None), (201, "x", ""), (None, "http://h.org/z", page(50))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "Story 3 with its own words More of 3" and got[3].n_chars == len(got[3].text)
    assert got[None].text.startswith("Story 50")
    assert got[100].text.startswith("Same slogan")  # too few pages of that host to tell
    assert got[200].text == "" and got[200].n_chars == 0 and got[201].text == ""
    assert H.extract(pages.limit(0)).count() == 0


def test_repeated_articles_stay(spark):
    rows = [(k, f"http://h.org/{k}", "<nav>n</nav><article><h1>Same</h1><p>The same article on every page</p></article>") for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in H.extract(pages).collect()} == {"Same The same article on every page"}


@pytest.mark.parametrize(
    "body",
    ["<div id=content><p>Mirrored words</p></div>", "<article><div class='entry-content'><p>Mirrored words</p></div></article>"],
)
def test_mirrored_pages_keep_their_text(spark, body):
    rows = [(k, url, f"<body><nav>n{k}</nav>{body}</body>") for k in range(5) for url in (f"http://h.org/{k}", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r.text for r in H.extract(pages).collect()] == ["Mirrored words"] * 10


def test_repeated_blocks_go_inside_an_article(spark):
    def page(k):
        return (
            f"<article><h1>Title {k}</h1><p>Words of {k}</p><p>Share this page</p><ul><li>All rights are ours</ul>"
            f"<p>More on {k}</p></article>"
        )

    rows = [(k, f"http://h.org/{k}", page(k)) for k in range(20)] + [(100 + k, None, page(k)) for k in range(20)]
    rows += [(200 + k, "http://h.org/m", page(3)) for k in range(30)]  # mirrors of one page
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert len(got) == 70
    assert got[7] == got[107] == "Title 7 Words of 7 More on 7"
    assert {got[200 + k] for k in range(30)} == {"Title 3 Words of 3 More on 3"}


def test_a_branch_with_own_words_stays(spark):
    tags = "h1 h2 h3 h4 h5 h6 p pre blockquote dl ol ul".split()
    rows = [(k, "http://h.org/", "<body>" + "".join(f"<{t}>{t} {k}</{t}>" for t in tags) + f"own {k}</body>") for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.extract(pages).collect()}[4] == " ".join([f"{t} 4" for t in tags] + ["own 4"])


def test_importance_by_hand(spark):
    rows = [(f"<div><p>{'same' if k < 2 else k}</p></div>", "h") for k in range(4)]
    paths = H.parse(rows[0][0]).paths()
    pages = H.page_features(spark.createDataFrame([*rows, rows[0]], "html string, host string"))  # a mirror weighs nothing
    # Three distinct main texts remain: "same", "2" and "3".
    assert {r.page for r in pages.collect()} == {H.digest(t) for t in ("same", "2", "3")}
    nodes, _ = H.style_tree(pages, prior=1.0)
    tree = {r.path: r for r in nodes.collect()}
    assert tree[paths[2]].content_importance == 1 and tree[paths[2]].c_n == 3
    # Three equal styles (children "p") of three pages, and one page that repeats nothing.
    assert tree[paths[1]].node_importance == pytest.approx(1 - 3 / 4) and tree[paths[1]].content_importance is None


def plain_tree(rows, names=True, prior=8.0, plain=0.7, inside=0.3, decay=0.9):
    """Texts of (host, html) rows by a second style tree, in plain loops over whole pages."""
    entropy_lost = lambda counts: sum(n * math.log(n) for n in counts.values()) / math.log(t) if (t := sum(counts.values())) > 1 else 0.0
    parsed = [(host, H.parse(html, names)) for host, html in rows]
    main = lambda page: tuple(H.text_of(raw) for _, raw in page.main_blocks())
    first, corpus_first = {}, {}
    for host, page in parsed:
        own = H.own_features(page)
        first[host, main(page)] = min(own, first.get((host, main(page)), own))
    for (_, text), own in first.items():
        corpus_first[text] = min(own, corpus_first.get(text, own))
    content, styles, count, up, inner, hosts, corpus = (defaultdict(Counter), defaultdict(Counter), Counter(), {}, {}, defaultdict(set), defaultdict(Counter))
    for (host, _), own in first.items():
        for p, parent, is_main, s, c in own:
            count[host, p] += 1
            up[host, p], inner[host, p] = parent, is_main
            if host is not None:
                hosts[p].add(host)
            styles[host, p].update(s)
            content[host, p].update(c)
    for own in corpus_first.values():
        for p, _, _, _, c in own:
            corpus[p].update(c)
    leaf = {}
    for (host, p), c in content.items():
        if c:
            h = len(hosts[p])
            every = entropy_lost(corpus[p]) / (sum(corpus[p].values()) + prior) * (h / (h + 4)) ** 2
            leaf[host, p] = (1 - entropy_lost(c) / (sum(c.values()) + prior)) * (1 - every)
    known = {k for k in count if count[k] > 1 or leaf.get(k, 1) < plain}
    bound = lambda k: inside if inner[k] else plain

    def rate(k):
        below = [c for c in known if c[0] == k[0] and up[c] == k[1] and c != k]
        rated = [(*rate(c), count[c]) for c in below]
        values = [(v, n) for v, _, n in rated if v is not None] + ([(leaf[k], count[k])] if k in leaf else [])
        high = any(x for _, x, _ in rated) or leaf.get(k, -1) >= bound(k)
        if not values:
            return None, high
        own = 1 - entropy_lost(styles[k]) / (count[k] + prior)
        mean = sum(v * n for v, n in values) / sum(n for _, n in values)
        return (1 - decay ** len(below)) * own + decay ** len(below) * mean, high

    low = {k for k in known if (r := rate(k))[0] is not None and not r[1] and r[0] < bound(k)}
    for (host, p), c in content.items():
        m = count[host, p]
        low |= {(host, f) for f, n in c.items() if n > 1 and 1 - math.log(n) / math.log(m) * m / (m + prior) < 0.3}
    return [H.main_text(html, {p for h, p in low if h == host}, names) for host, html in rows]


def random_site(rng, host, n):
    shapes = [rng.choice(["box", "q7", "z"]), rng.choice(["menu", "k1", ""]), rng.choice(["article", "div class=w"])]
    line = [f"{host} slogan", "Share this", "Our shop", "Call us"]
    words = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 9)))
    for _ in range(n):
        tag = shapes[2].split()[0]
        yield (
            f"<body><div class={shapes[0]}><p>{rng.choice(line)}</p></div><div><ul>" + "".join(f"<li>{x}" for x in line[: rng.randrange(1, 5)]) + "</ul></div>"
            f"<{shapes[2]}><h1>{words()}</h1><p>{words()}</p>{'<p>Read more</p>' if rng.random() < 0.9 else ''}<div><p>{words()}</div></{tag}>"
            f"{f'<div>{rng.choice(line)}</div>' if rng.random() < 0.7 else ''}</body>"
        )


@pytest.mark.parametrize("names", [True, False])
def test_a_plain_second_tree_agrees(spark, names):
    rng = random.Random(17)
    rows = [(host, html) for host, n in (("a.org", 40), ("b.org", 25), ("c.org", 3), (None, 12), ("d.org", 1)) for html in random_site(rng, host, n)]
    rows += [rows[0]] * 6 + [("a.org", None), ("a.org", "")]
    want = plain_tree(rows, names)
    url = lambda host: None if host is None else f"http://{host}/"
    # url_parts gives no host as an empty one: both are one site.
    pages = spark.createDataFrame([(k, url(h), x) for k, (h, x) in enumerate(rows)], "page_id long, url string, html string")
    want_by = dict(enumerate(plain_tree([("" if h is None else h, x) for h, x in rows], names)))
    assert len(want) == len(want_by)
    for limit in (200_000, 0):
        got = {r.page_id: r.text for r in H.extract(pages, names=names, max_broadcast=limit).collect()}
        assert got == want_by
    assert sum(H.main_text(x, names=names) != want_by[k] for k, (_, x) in enumerate(rows)) > 40


def test_names_that_say_nothing(spark):
    rng = random.Random(3)
    words = lambda k: " ".join(f"w{rng.randrange(5000)}" for _ in range(k))
    adverts = [f"Buy {words(3)}" for _ in range(6)]
    rows = []
    for k in range(120):
        own = f"<h1>{words(4)}</h1>" + "".join(f"<p>{words(12)}</p>" for _ in range(4))
        links = "".join(f"<li><a href=x>{x}</a></li>" for x in ("Home", "News", "Sport", "Shop")[: 2 + k % 3])
        html = f"<body><div class=xa><ul>{links}</ul></div><div class=xb>{rng.choice(adverts)}</div><div class=xc>{own}</div><div class=xd>All for site</div></body>"
        rows.append((k, f"http://h{k % 2}.org/{k}", html, H.text_of(H.re.sub("<[^>]*>", " ", own))))
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert all(got[k] == want for k, _, _, want in rows)


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "deep", "<a " * 60_000, "<p '" * 30_000 + ">t", "<!-- " * 30_000, "<li" * 30_000 + ">t", "<b class=x>" * 20_000 + "t"])
def test_time_grows_with_the_page(page):
    start = time.perf_counter()
    H.main_text(page, {1})
    H.own_features(H.parse(page))
    assert time.perf_counter() - start < 5
