import random

import pytest

from nimbusvec.llm import urls
from nimbusvec.llm.queries import OP9_SQL, URL_RULES, op9_url_filter
from tests.helpers import same, sql

PAGES = "page_id long, url string, host string, rule string, path string"
URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/x", "http://example.com", "http://example.com/en", "http://www.example.com/en/1", "http://a.www.example.com/en/1?x://y/z", "https://m.example.net/fr/1#q", "http://net/es/", "http://xnet/es/",
    "http://exämple.COM/ÉN/", "ftp://com/", "http://com./", "x://y://z.com/en/", "http://example.com?en/", "http://example.com#/en/", "http://example.com:80/en/", "http://..com//", "http://example.com/en/\n/x",
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


def check(spark, addresses, rules):
    pages = spark.createDataFrame([(i, u, "mine", "mine", "mine") for i, u in enumerate(addresses)], PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, urls.rules_table(spark, rules)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(addresses)}


def test_odd_urls(spark):
    check(spark, URLS * 2, URL_RULES)


@pytest.mark.parametrize("seed", range(3))
def test_random_rules(spark, seed):
    rng = random.Random(seed)
    hosts = ["com", "a.com", "b.a.com", "net", "c.net", ""]
    paths = ["", "/", "/x", "/x/", "/x/y/", "/z"]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((rng.choice(hosts), rng.choice(paths)) for _ in range(14))}.values())
    check(spark, [f"http://{rng.choice(hosts)}{rng.choice(['', '.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', 'y/z'])}" for _ in range(200)], rules)


def test_short_prefix_collisions_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(urls, "SHORT", 1)
    check(spark, URLS, URL_RULES)


def test_more_lengths_than_are_listed(spark, monkeypatch):
    monkeypatch.setattr(urls, "LENGTHS", 2)
    check(spark, URLS * 2, [*URL_RULES, ("block", "com", "/long/er/"), ("allow", "z.com", "/en/x")])


def test_a_host_of_most_rows_and_long_ones(spark):
    check(spark, [f"http://h{i}.example.com/en/{'p/' * i}" for i in range(60)] + ["http://a.com/"] * 1500 + [None] * 500 + ["http://" + "l." * 3000 + "com/" + "x/" * 5000], URL_RULES)


def test_repeated_page_ids(spark):
    page = spark.createDataFrame([(1, "http://example.com/en/", "", "", "")] * 2 + [(1, "http://a.com/", "", "", "")], PAGES)
    assert sorted(r.verdict for r in urls.filter_urls(page, urls.rules_table(spark, URL_RULES)).collect()) == ["allow", "block", "block"]


def test_empty_tables_and_two_verdicts(spark):
    assert urls.filter_urls(spark.createDataFrame([], PAGES), urls.rules_table(spark, URL_RULES)).collect() == []
    page = spark.createDataFrame([(None, "http://a.com/", "", "", "")], PAGES)
    assert urls.filter_urls(page, urls.rules_table(spark, [])).first().verdict == "allow"
    both = urls.rules_table(spark, [("allow", "com", "/"), ("block", "com", "/")])
    assert urls.filter_urls(page, both).first().verdict == "block"


def test_query_matches_its_sql(spark):
    same(op9_url_filter(spark, "/root/testdata/sf0.001").toPandas(), sql(OP9_SQL))
