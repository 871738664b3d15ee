"""URL filters against every rule tried on every URL."""

import re

import pytest
from pyspark.sql import functions as F

from slicelake.llm import urls as U

URLS = [
    "http://A.B.Example.NET/en/1?x=1#y", "https://example.net", "https://example.net/EN/1", "http://net/", "http://net?x", "http://notnet/en/", "http://example.com/de/2", "http://m.example.com/de", "http://x.example.com:80/de/", "https://o.org/fr/#a/b", "https://o.org/fr?/fr/",
    "no scheme/net/", "://net/", "", None, "http://ads-track.example.com/en/1", "http://x.casino-win.org/q", "http://org/popup/", "http://org/x?affiliate_id=3", "HTTP://EXAMPLE.COM/DE/1", "http://ex\u00e4mple.\u00c4org/fr/x", "http://a://net/b", "http://example.net.evil.com/en/", "http://x/\n/y", "http://org/" + "a/" * 50_000,
]
MORE = [("allow", "||ads-*/en/"), ("block", "|http://org/x|"), ("block", "*o.org*"), ("block", "a^b"), ("block", "en"), ("block", "q|")]


def plain(url, rules, patterns):
    """(host, path, rule, verdict) without any index."""
    host, path = U.parts_of(url)
    fit = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[2], max(fit)[3]
    hits = {v for v, p in patterns if url is not None and re.search(U.pattern_rule(p)[0], U.lowered(url))}
    return host, path, None, "allow" if "allow" in hits or not hits else "block"


@pytest.mark.parametrize("most", [1000, 0])
def test_against_every_rule(spark, most):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({x: F.lit("clash") for x in ("html", "token", "host", "rule", "salt", "regex")})
    patterns = U.PATTERNS + MORE
    got = U.filter_urls(pages, U.rule_table(spark, U.RULES, patterns), most)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(i, *plain(u, U.RULES, patterns)) for i, u in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert U.filter_urls(pages.limit(0), U.rule_table(spark, U.RULES, patterns), most).count() == 0
    assert U.filter_urls(pages, U.rule_table(spark, [], [(None, "net")]), most).where("verdict = 'allow' and rule is null").count() == len(rows)


def test_patterns():
    fits = lambda p, u: bool(re.search(U.pattern_rule(p)[0], u))
    assert fits("||ads.", "http://ads.x/") and fits("||ads.", "http://y.ads.x/") and not fits("||ads.", "http://loads.x/") and not fits("||ads.", "http://x/?http://ads.y")
    assert fits("^ads^", "http://x/ads") and fits("^ads^", "http://x/ads?") and not fits("^ads^", "http://x/ads.html")
    assert fits("|http://a", "http://a") and not fits("|ttp", "http://a") and fits("a|", "http://a") and not fits("a|", "http://a\n")
    assert U.pattern_rule("||ads-track.*/en")[1] == ["ads", "track"] and U.pattern_rule("ads*x-y|")[1] == ["y"] and U.pattern_rule("abc")[1] == []
    assert U.host_rule("example.net", "/en")[1] == ["example", "net"] and U.host_rule("net", "")[1] == [] and U.host_rule("net", "/En/")[1] == ["net", "en"]


def test_index_holds_each_rule_under_its_rarest_token(spark):
    urls = spark.createDataFrame([("http://example.net/en/",), ("http://x.net/",), ("http://example.org/net",)], "url string")
    index = {r.rule: r.token for r in U.rarest_token_index(U.rule_table(spark, [("block", "example.net", "/en/"), ("block", "x.net", "/"), ("block", "net", "/zz/")], [("block", "example*net"), ("block", "||example.net^")]), urls).collect()}
    assert index == {"example.net/en/": "en", "x.net/": "x", "net/zz/": "zz", "example*net": "", "||example.net^": "example"}
