"""One value in a third of all rows: a credential, a URL, a URL without a host."""

import random
from collections import Counter


from cohortal.llm import secrets, urls
from tests.llm.helpers import documents

KEY = "1c383cd30b7c298ab50293adfecb7b18bb"


def test_a_credential_in_a_third_of_all_documents(spark):
    rng = random.Random(2)
    rows = []
    for k in range(3_000):
        own = "".join(rng.choice("0123456789abcdef") for _ in range(34))
        value = [KEY, own, ""][k % 3]
        rows.append((k if k % 9 else 7, f"document {k // 30 if k % 3 == 0 else k} token = {value} end" if value else f"plain {k}", f"src{k % 2}"))
    got = secrets.secret_scan(documents(spark, rows)).collect()
    assert len(got) == 3_000
    # Two owners and a thousand repositories share the value: it is an example.
    copied, live = Counter(), Counter()
    for r in got:
        copied[r.n_copied] += 1
        live[r.n_live] += 1
    assert copied[0] == 2_000 and sum(n for k, n in copied.items() if k) == 1_000
    assert sum(n for k, n in live.items() if k) == 1_000
    plan = secrets.secret_scan(documents(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan.lower()


def test_urls_that_a_third_of_all_pages_share(spark):
    rows = []
    for k in range(3_000):
        url = ["http://www.example.com/de/x", f"https://h{k}.net/{k}", None if k % 2 else "no scheme"][k % 3]
        rows.append((k, url))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/de/", "block"), ("net", "/1", "block"), ("net", "/10", "allow"), ("net", "/100", "block"), ("org", "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, rules, keep=("page_id",)).collect()}
    assert len(got) == 3_000
    for k in range(3_000):
        if k % 3 == 0:
            want = ("www.example.com", "/de/x", "example.com/de/", "block")
        elif k % 3 == 2:
            want = ("", "", None, "allow")
        else:
            rule = next((f"net/{p}" for p in ("100", "10", "1") if str(k).startswith(p)), None)
            want = (f"h{k}.net", f"/{k}", rule, "allow" if rule in (None, "net/10") else "block")
        assert got[k] == want
    assert urls.filter_urls(pages.union(pages), rules, keep=("page_id",)).count() == 6_000
    # A page without a host takes no part in a join.
    plan = urls.filter_urls(pages.where("page_id % 3 = 2"), rules, keep=("page_id",))
    assert plan.where("verdict = 'allow' and rule is null").count() == 1_000


def test_lengths_of_other_hosts_cost_nothing(spark):
    rules = spark.createDataFrame([("net", "/" + "a" * n, "block") for n in range(1, 200)] + [("com", "/b", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.com/b" + "c" * 300), (2, "http://y.net/aab")], "page_id long, url string")
    got = {r.page_id: r.rule for r in urls.filter_urls(pages, rules, keep=("page_id",)).collect()}
    assert got == {1: "com/b", 2: "net/aa"}
