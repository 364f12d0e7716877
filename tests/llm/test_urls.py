import pytest

from orderlens.llm.urls import RULES, Rule, filter_urls

CANONICAL = '<html><head><LINK href="{}" data-x=1 rel="canonical"></head>'
REFRESH = "<meta content='0; url={}' http-equiv=refresh>"


def judged(spark, pages, redirects=None, rules=RULES):
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, key string")
    moves = spark.createDataFrame(redirects, "url string, target string") if redirects else None
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, rules, moves).collect()}


def test_rules(spark):
    got = judged(spark, [
        (1, "HTTP://A.Example.ORG/es/x?q#f", None), (2, "http://example.org/en/12", ""), (3, "http://example.org/en/2", ""), (4, "https://x.com/fr/a", ""),
        (5, "https://notcom/fr/a", ""), (6, "ftp://com/de/?a://b", ""), (7, "nothing", ""), (8, None, None), (9, "http://example.org", ""), (10, "http://org?x=/es/", ""),
        (11, "a://b://org/", "")])
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("example.org", "/en/2", "org/", "allow"),
        4: ("x.com", "/fr/a", "com/fr/", "allow"), 5: ("notcom", "/fr/a", None, "allow"), 6: ("com", "/de/", "com/de/", "block"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("example.org", "", None, "allow"), 10: ("org", "", None, "allow"), 11: ("b:", "//org/", None, "allow")}


def test_aliases_inherit_blocks(spark):
    """A chain and a hub; an explicit allow of a page, and of any alias, comes first."""
    chain = [(i, f"http://site{i}.net/a", CANONICAL.format(f"http://site{i + 1}.net/a")) for i in range(20)]
    pages = [*chain, (20, "http://site20.net/a", REFRESH.format("https://m.shop.com/de/1")),
             (30, "http://u.net/1", CANONICAL.format("//v.com/de/2")), (31, "http://u.net/2#top", CANONICAL.format("http://v.com/de/2")), (32, "http://u.net/2", None),
             (33, "http://w.com/fr/1", CANONICAL.format("http://v.com/de/9")), (34, "http://w.net/1", CANONICAL.format("http://v.com/de/9")),
             (35, "http://v.com/de/9", None), (40, "http://free.net/x", CANONICAL.format("/y")), (41, "http://free.net/y", ""), (42, "http://U.net/2", "")]
    got = {k: v[3] for k, v in judged(spark, pages).items()}
    assert all(got[i] == "block" for i in (*range(21), 30, 31, 32, 42, 35))
    assert got[33] == "allow" and got[34] == "allow"  # a rule allows an alias of 34 explicitly
    assert got[40] == got[41] == "allow"
    moved = judged(spark, pages, [("http://free.net/y", "http://u.net/1"), (None, "x"), ("http://free.net/q", None)])
    assert moved[40][3] == moved[41][3] == "block"


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.com/de/", None)] * 3 + [(None, None, None)], "page_id long, url string, html string")
    assert sorted(str(r.verdict) for r in filter_urls(df).collect()) == ["allow", "block", "block", "block"]
    assert filter_urls(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        filter_urls(df, [Rule("block", f"h{i}", "/") for i in range(1001)])
