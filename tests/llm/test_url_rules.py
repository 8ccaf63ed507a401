"""The registered URL filter keeps to the rules of its contract."""

import pytest

from fathom.llm.queries import QUERIES

#: As the contract lists them.
CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
URLS = {
    "com/en/": ["http://com/en/", "https://a.b.COM/en/x?q#f", "http://a.example.com/en/6"],
    "example.com/en/7": ["http://example.com/en/7", "http://www.Example.com/en/75"],
    "net/de/": ["http://net/de/", "http://x.net/de/8", "http://notexample.net/de/8", "http://example.net/de/7"],
    "example.net/de/8": ["http://example.net/de/8", "http://a.b.EXAMPLE.net/de/81?x=1"],
    "org/es/": ["http://org/es/", "http://example.org/es/7"],
}


@pytest.mark.parametrize("words", [0, 30])
def test_every_rule_has_the_verdict_of_the_contract(spark, tmp_path, words):
    """Without trees, as no URL has a bad label, and with trees."""
    said = dict(reversed(rule.split(" ")) for rule in CONTRACT.split(", "))
    assert set(said) == set(URLS)
    rows = [(url, rule) for rule, urls in URLS.items() for url in urls]
    rows += [(f"http://spam.site{k}.tld/{k}", None) for k in range(words)] + [(f"http://site{k}.tld/{k}", None) for k in range(30)]
    rows += [("http://spam.x.net/de/1", "net/de/"), ("http://spam.com/en/1", "com/en/")] if words else []
    pages = spark.createDataFrame([(k, url) for k, (url, _) in enumerate(rows)], "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in QUERIES["op10_url_filter"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, (url, rule) in enumerate(rows):
        assert got[k][0] == rule, url
        assert rule is None or got[k][1] == said[rule], url
