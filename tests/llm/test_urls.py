"""URL filters against a plain loop over all rules."""

import re

import pytest

from sedgewren.llm import urls

URLS = [
    None, "", "no scheme", "http://", "://x.net/", "https://a.net", "https://A.NET/", "https://example.net/en/", "https://example.net/en",
    "https://w.example.net/en/1", "https://notexample.net/en/1", "https://example.com/de/x?y#z", "https://example.com/de", "https://b.example.com/DE/x",
    "https://e.org/fr/", "https://org/fr/a", "https://eorg/fr/a", "https://x.com/fr/?u=http://a.net/en/", "https://spam-farm.com/a", "https://my.spam-farm.co/",
    "https://spam-farmer.com/", "https://x.com/casino/b", "https://x.com/casinos/b", "https://casino-1.x.com/", "https://x.com/education?casino", "https://x.com/a?s=1&sort=2",
    "https://x.com/login", "https://x.com/login1", "https://x.com\n.net/a", "https://exİ.net/en/", "https://x.net?a/b", "https://x.net#a", "https://user:pw@h.net:80/p",
]


def brute(url):
    if url is None:
        return "", "", None, "allow", None
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = []
    for action, rule in urls.SITE_RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), rule, action))
    if fits:
        return host, path, max(fits)[1], max(fits)[2], None
    found = [(a, r) for a, r in urls.PATTERN_RULES if re.search(urls.pattern_rule(a, r).regex, url)]
    found.sort(key=lambda x: x[0] != "allow")
    return host, path, None, found[0][0] if found else "allow", found[0][1] if found else None


def test_against_all_rules(spark):
    data = [(i, u, "old", 1, "t") for i, u in enumerate([*URLS, URLS[7], URLS[7]])]
    df = spark.createDataFrame(data, "page_id long, url string, Host string, url_key int, token string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.matched_pattern) for r in urls.url_filter(df).collect()}
    assert got == {i: brute(u) for i, u, *_ in data}
    kept = urls.url_filter(df)
    assert "url_key" in kept.columns and "token" in kept.columns and [c.lower() for c in kept.columns].count("host") == 1


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "https://a.net/")], "page_id long, url string")
    assert [r.verdict for r in urls.url_filter(df, site_rules=(), pattern_rules=(("block", "/x/"),)).collect()] == ["allow"]
    assert urls.url_filter(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", [r for _, r in urls.SITE_RULES])
def test_tokens_of_rules_are_in_every_fitting_url(text):
    rule = urls.site_rule("block", text)
    url = "https://sub." + text + "more"
    assert set(rule.tokens) <= set(re.split("[^a-z0-9]+", url.lower()))


def test_letters_that_fold_to_ascii(spark):
    """Kelvin sign and dotted capital I are not letters of a token: expressions and tokens ignore case in A-Z only."""
    rows = [(0, "https://x.example/loginK"), (1, "https://x.example/casinoİ"), (2, "https://x.example/CaSiNo/"), (3, "https://x.example/" + "a/" * 50_000 + "login")]
    got = {r.page_id: r for r in urls.url_filter(spark.createDataFrame(rows, "page_id int, url string")).collect()}
    assert [got[i].matched_pattern for i in range(4)] == ["/login^", "^casino^", "^casino^", "/login^"]


def test_url_column_named_like_a_result(spark):
    got = urls.url_filter(spark.createDataFrame([("https://a.net/x",)], "host string"), url_col="host")
    assert got.columns == ["host", "path", "rule", "verdict", "matched_pattern"] and got.first().host == "a.net"


def test_rules_of_equal_length(spark):
    """Of two fitting rules of one length the first listed decides."""
    df = spark.createDataFrame([("http://a.b/",)], "url string")
    for first, second in (("allow", "block"), ("block", "allow")):
        assert urls.url_filter(df, site_rules=[(first, "a.b/"), (second, "a.b/")], pattern_rules=[]).first().verdict == first
