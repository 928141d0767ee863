import random

from strandloom.llm.url_filter import RULES, Trie, filter_urls, filter_urls_by_join

URLS = [
    "http://a.example.com/en/1?x#y", "https://www.example.com/en/", "https://WWW.Example.COM/en/x", "http://example.com/en", "http://example.com", "http://example.com?/en/", "http://x.net/fr/1", "http://x.net/de/1",
    "net/fr/", None, "", "://", "http://com/", "http://example.com:80/en/", "a://b://c.com/", "http://notexample.com/en/2", "http://example.com./en/", "http://deep.www.example.com/en/#z", "x\n://net/es/\ny",
]


def brute(url, rules, default):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(h.count("."), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_both_paths_match_brute_force(spark):
    rng = random.Random(3)
    some = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
    path = lambda: "".join("/" + rng.choice(["x", "xy", "y", ""]) for _ in range(rng.randrange(3)))
    more = [(some(), path(), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = URLS + [f"http://{some()}{path()}" for _ in range(200)]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    for rules in (RULES, more, []):
        want = [(k, *brute(u, rules, "allow")) for k, u in enumerate(urls)]
        for f in (filter_urls, filter_urls_by_join):
            if f is filter_urls_by_join and not rules:
                continue
            out = f(pages, rules)
            assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
            assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in out.collect()) == want


def test_empty_table_and_default(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(pages, RULES).collect() == []
    assert Trie([]).match("a", "/") is None
    one = spark.createDataFrame([(1, None)], "page_id long, url string")
    assert tuple(filter_urls(one, RULES, "block").collect()[0])[2:] == ("", "", None, "block")
