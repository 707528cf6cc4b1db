import pytest

from tagloom.llm.oracles import oracle_sql
from tagloom.llm.queries import URL_RULES, op10_url_filter
from tagloom.llm.urlfilter import judge_urls

RULES = [*URL_RULES, ("block", "a.example.net", "/en/x"), ("allow", "a.example.net", "/en/"), ("block", "", "/any/"), ("allow", "same.org", "/"), ("block", "same.org", "/"), ("block", "p.org", "/b/c"), ("allow", "p.org", "/b/cd/")]
URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://EXAMPLE.NET/en/1?x#y", "http://b.example.net/en", "http://b.example.net/en/", "http://a.example.net/en/xyz", "http://a.example.net/en/y",
    "http://notexample.net/en/", "http://x.org/any/1", "http://same.org/q", "http://p.org/b/cd/e", "http://p.org/b/c", "http://p.org/b/cde", "http://fr.org/fr/?a", "http://x.com?q=/a", "ftp://Ä.NET/x", "a://b://c/d", "http://example.com/de/\n2", "http://user@net:80/",
    "http://" + "a." * 5_000 + "example.net/en/" + "x/" * 50_000 + "?" + "q" * 200_000, "http://" + "b" * 100_000 + ".net/",
]


def by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h.split(".")) if h else 0, len(p), v == "block", h + p, v) for v, h, p in RULES if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("limit", [100, 0])
def test_trie_and_join_against_all_rules(spark, limit):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] * 2, "page_id long, url string, verdict string")
    found = judge_urls(df, RULES, max_trie_rules=limit).collect()
    assert len(found) == 2 * len(URLS)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == by_hand(URLS[r.page_id]), URLS[r.page_id]


def test_query_against_sql(spark, small, duck):
    got = {tuple(r) for r in op10_url_filter(spark, small).collect()}
    assert got == set(duck.execute(f"select page_id, host, path, rule, verdict from ({oracle_sql()['op10_url_filter']})").fetchall())


def test_no_rows_or_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(df, RULES).count() == 0
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert judge_urls(df, [], default="block").first().verdict == "block"
