import re

from postlens.llm import url_filter as U
from postlens.llm.queries import HOST_RULES
from tests.llm.helpers import assert_oracle

URLS = [None, "", "no scheme", "http://", "http://COM/", "https://Example.COM/en/1", "https://www.example.com/en/",
        "https://a.www.example.com/en/x?y=/es/", "http://x.net/es/1", "http://x.net/ES/1", "http://net/fr/", "http://net",
        "http://xnet/es/", "http://a@example.com/en/", "http://example.com:80/en/", "http://x.org/casino/1",
        "http://adult-x.example.org/", "http://x.com?/en/", "x://y://z.net/es/", "http://x.org/ads/1#f", "http://x.com/adserver",
        "http://EXAMPLE.com/en", "http://ünïcode.net/es/ü", "http://x.net/es/\nb"]


def brute(url, rules):
    host, path, rest = U.split_url(url)
    if url is None or "://" not in url:
        return "", "", None, "allow"
    fits = [r for r in rules if re.search(U.to_regex(r.pattern), host + rest)]
    own = sorted((r for r in fits if r.tier == 0), key=lambda r: -len(r.name))
    if own:
        return host, path, own[0].name, own[0].verdict
    return host, path, None, "block" if fits else "allow"


def test_oracle(spark, sf_small):
    assert_oracle(spark, sf_small, "op1_url_filter")


def test_against_every_rule(spark):
    rules = [*HOST_RULES, *U.DEFAULT_PATTERNS]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, rules).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(URLS)}


def test_contract_rules():
    for url, rule in [("http://a.com/x", "com/"), ("http://www.example.com/en/1", "www.example.com/en/"),
                      ("http://m.example.com/en/1", "example.com/en/"), ("http://a.net/de/", None), ("http://b.net/fr/x", "net/fr/"),
                      ("http://a.com", None)]:
        assert brute(url, HOST_RULES)[2] == rule


def test_rules_go_in_passes_and_are_filed_under_their_rarest_token(spark, monkeypatch):
    index, always = U.build_index([*HOST_RULES, U.Rule("x*", "x*", "block", 1)], {"com": 9, "example": 5, "en": 7, "www": 1, "net": 8, "es": 2, "fr": 3})
    assert index == {"com": [0], "example": [1], "www": [2], "es": [3], "fr": [4]} and always == [5]
    monkeypatch.setattr(U, "MOST_RULES_A_PASS", 2)
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    rules = [*HOST_RULES, *U.DEFAULT_PATTERNS]
    got = {r.page_id: r.rule for r in U.judge(df, rules).collect()}
    assert got == {i: brute(u, rules)[2] for i, u in enumerate(URLS)}


def test_safe_tokens_are_whole():
    assert U.safe_tokens("||ads.net/en") == ["ads", "net"]      # /en also fits /english
    assert U.safe_tokens("casino") == []
    assert U.safe_tokens("/a*b/c/") == ["c"]


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string"), list(HOST_RULES)).collect() == []
