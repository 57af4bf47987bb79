"""Url rules against a plain reading of every rule for every url."""

import random

from tidemark.llm import queries, urlfilter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:n], rest[n:]
    m = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:m]


def plain(url, rules, default="allow"):
    host, path = parts(url)
    fits = [
        (len(h + p), len(h), v, h + p)
        for h, p, v in rules
        if h and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(n, u, "old", "x") for n, u in enumerate(urls)], "page_id int, url string, host string, digest string")
    book = spark.createDataFrame(rules, "host string, path string, verdict string")
    out = urlfilter.judge(pages, book)
    assert out.columns == ["page_id", "url", "digest", "host", "path", "rule", "verdict"]
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}


def test_random_urls_and_rules(spark):
    rng = random.Random(1)
    label, step = ["a", "b", "com", "net", "É", ""], ["/", "/en", "/en/", "/e", "/en/x/", "", "/?", "/en?y", "/#"]
    urls = [None, "", "no scheme", "://", "http://", "http://?q", "HTTP://A.Com/EN/", "x://a.com/en/://b.net/", "a\n://a.com/\n/en/"]
    urls.append("http://a.com" + "/en" * 30_000)
    for _ in range(400):
        urls.append("h://" + ".".join(rng.choices(label, k=rng.randint(1, 4))) + "".join(rng.choices(step, k=rng.randint(0, 3))))
    urls += urls[:50]
    rules = [(".".join(rng.choices(label[:4], k=rng.randint(1, 3))), "".join(rng.choices(step[:6], k=rng.randint(0, 2))), rng.choice(["allow", "block"])) for _ in range(60)]
    rules = [*rules, rules[0], ("", "/", "block")]
    got = judged(spark, urls, rules)
    assert got == {n: plain(u, rules) for n, u in enumerate(urls)}


def test_no_rules_and_no_pages(spark):
    assert judged(spark, ["http://a.com/x"], []) == {0: ("a.com", "/x", None, "allow")}
    assert judged(spark, [], [("com", "/", "block")]) == {}


def test_rules_of_the_query(spark):
    urls = ["http://example.com/en/1", "http://WWW.example.com/en/", "http://m.example.com/fr/", "http://x.net/es/2", "http://net/fr", "http://example.com", "http://org/"]
    assert [judged(spark, urls, list(queries.RULES))[n][2:] for n in range(7)] == [
        ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("com/", "allow"), ("net/es/", "block"),
        (None, "allow"), (None, "allow"), (None, "allow"),
    ]
