"""Verdicts against a plain loop over all rules."""

import random

from treeline.llm import urlfilter

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "a.net", "/es"),
    ("allow", "b.a.net", "/e"),
    ("block", "org", ""),
    ("allow", "x.org", "/p/q/r"),
    ("allow", "org", ""),
    ("block", "", "/everywhere/"),
]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, h, p in RULES:
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h + p), h.count(".") + bool(h), verdict == "block")
            best = max(best or (rank, h + p, verdict), (rank, h + p, verdict))
    return (host, path, best and best[1], best[2] if best else "allow")


def test_longest_rule_wins(spark):
    rng = random.Random(2)
    hosts = ["com", "Example.COM", "www.example.com", "net", "a.net", "b.a.net", "c.b.a.net", "org", "x.org", "y", ""]
    paths = ["", "/", "/en/", "/en", "/es/1", "/e", "/p/q/r", "/p/q", "/everywhere/x", "//", "/es"]
    urls = [f"{rng.choice(['http://', 'x', ''])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=/en/', '#f', '?'])}" for _ in range(800)]
    urls += [None, "", "http://", "http://é.com/ü", "http://" + "a." * 3000 + "com/" + "s/" * 3000, "a://b://com/"]
    rows = [(i, u, "own") for i, u in enumerate(urls)] + [(0, urls[0], "own"), (None, "http://com/", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    for bound in (urlfilter.TRIE_BYTES, 1):
        judged = urlfilter.judge_urls(pages, RULES, bound=bound)
        got = [((r.host, r.path, r.rule, r.verdict), r.url) for r in judged.collect()]
        assert len(got) == len(rows)
        assert all(a == brute(u) for a, u in got)


def test_empty_table(spark):
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
