import re

import pytest

from sieveline.llm import urls

ROWS = [
    "http://a.example.net/en/x", "http://example.net/en", "http://example.net/en/", "https://notexample.net/en/", "http://x.net", "http://x.net/", "http://X.NET/A",
    "http://a.example.com/de/1?x=/de/", "http://example.org/fr/1", "ftp://org/fr/", "http://a.org/FR/", None, "", "no scheme", "http://", "http://?q", "a://b://c.net/x",
    "http://casino.example.com/", "http://mycasino.example.com/", "http://casino-win.example.com/", "http://free-bets.example.com/", "http://free.example.com/free/free",
    "http://x.com/a?porn", "http://x.com/porn", "http://x.com/a/porn1", "http://x.com/PORN", "http://ex.com/free_win", "http://a.net:80/x", "http://É.net/ä",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest, re.S)[0]
        path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(d + p, said) for said, d, p in urls.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    if fits:
        rule, said = max(fits, key=lambda f: len(f[0]))
        return host, path, rule, said
    text = (host + path).lower()

    def found(terms):
        return [t for t in terms if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", text)]

    return host, path, None, "block" if found(urls.STRICT) or len(found(urls.SOFT)) >= urls.SOFT_HITS else "allow"


def test_rules_and_vocabulary(spark):
    pages = spark.createDataFrame([(i, u, "clash", "r") for i, u in enumerate(ROWS)], "page_id long, url string, host string, rule string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert found == {i: brute(u) for i, u in enumerate(ROWS)}


@pytest.mark.parametrize(("text", "want"), [("a-porn-b", (1, 0)), ("free free", (0, 1)), ("freewin", (0, 0)), ("", (0, 0)), ("win.free", (0, 2))])
def test_hits(text, want):
    assert urls.hits(urls.automaton(urls.STRICT, urls.SOFT), text) == want


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
