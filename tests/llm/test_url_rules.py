"""URL parsing by hand, mined rules against counting every token set."""

import random
from collections import Counter
from itertools import combinations
from math import ceil

import pytest
from pyspark.sql import functions as F

from devident.llm.queries.url_rules import HOST_RULES, SQL, query
from devident.llm.url_rules import HostRule, Mining, filter_urls, host, judge, mine, path, tokens
from tests.oracle_check import connect, difference


def parsed(rows, urls):
    c = F.col("url")
    return {r.url: (r.h, r.p, r.t) for r in rows("url string", [(u,) for u in urls]).select("url", host(c).alias("h"), path(c).alias("p"), tokens(c).alias("t")).collect()}


def test_parts_of_a_url(rows):
    got = parsed(rows, ["http://A.Éx.NET/En/1?x#y", "a://b", "no scheme/x", "://h?q://z/w", "s://h#/p", "x://a:8/b?c=/d", "", None, "a://b://c/d"])
    assert {u: v[:2] for u, v in got.items()} == {
        "http://A.Éx.NET/En/1?x#y": ("a.Éx.net", "/En/1"), "a://b": ("b", ""), "no scheme/x": ("", ""), "://h?q://z/w": ("h", ""),
        "s://h#/p": ("h", ""), "x://a:8/b?c=/d": ("a:8", "/b"), "": ("", ""), None: ("", ""), "a://b://c/d": ("b:", "//c/d"),
    }
    long_url = "http://h/" + "é" * 1_000_000 + "/" * 1000 + "?" + "&".join(f"k{i % 7}" for i in range(1000))
    got = parsed(rows, ["http://e.d.c.b.a/12x3//y/z/w/u.html?b=1&a&a=2&=3#f", None, long_url])
    assert set(got["http://e.d.c.b.a/12x3//y/z/w/u.html?b=1&a&a=2&=3#f"][2]) == {
        "h1=a", "h2=b", "h3=c", "h4=d", "p1=#x#", "p2=y", "p3=z", "x=html", "q=a", "q=b", "f"}
    assert got[None][2] == [] and set(got[long_url][2]) == {"h1=h", "p1=" + "é" * 61, "q=k0", "q=k1", "q=k2", "q=k3"}


def test_host_rules(rows):
    rules = (*HOST_RULES, HostRule("allow", "b.net", "/x"))
    cases = {
        "http://x.net/": ("net/", "block"), "http://x.net": (None, "allow"), "http://net/a": ("net/", "block"), "http://a.xnet/": (None, "allow"),
        "http://m.Example.net/en/1": ("example.net/en/", "allow"), "http://example.net/en": ("net/", "block"),
        "http://notexample.net/en/1": ("net/", "block"), "http://a.org/fr/": ("org/fr/", "allow"), "http://example.com/de/x": ("example.com/de/", "block"),
        "http://b.net/xy": ("b.net/x", "allow"), None: (None, "allow"), "": (None, "allow"),
    }
    got = filter_urls(rows("url string, host int, verdict int, tokens int", [(u, 1, 2, 3) for u in cases]), rules, Mining(support=1.0)).collect()
    assert {r.url: (r.rule, r.verdict) for r in got} == cases and got[0].tokens == 3


def counted(urls, mining):
    """Rules by counting every token set of every labelled URL."""
    urls = sorted({(u, t, l) for u, t, l in urls if l is not None and t})
    sets, labelled, marked = Counter(), Counter(), Counter()
    for _, toks, label in urls:
        labelled[label] += 1
        for k in range(1, mining.tokens + 1):
            for s in combinations(sorted(toks), k):
                sets[s] += 1
                marked[s, label] += 1
    least = ceil(mining.support * len(urls))
    rules = {
        (s, label): n / sets[s] for (s, label), n in marked.items()
        if n >= least and n / sets[s] >= mining.confidence and n / sets[s] > labelled[label] / len(urls)
    }
    return {
        (s, label): (c, marked[s, label]) for (s, label), c in rules.items()
        if not any(rules.get((p, label), -1) >= c for k in range(1, len(s)) for p in combinations(s, k))
    }


def urls_of(rng, n):
    make = lambda: f"http://{rng.choice(['', 'www.'])}s{rng.choice('ab')}.{rng.choice(['com', 'net'])}/{rng.choice('xyz')}/{rng.randrange(99)}{rng.choice(['', '.html'])}{rng.choice(['', '?u=1', '#t'])}"
    return [make() for _ in range(n)]


@pytest.mark.parametrize("seed", [3, 4])
def test_rules_against_counting(rows, seed):
    rng, mining = random.Random(seed), Mining(support=0.04, confidence=0.6, tokens=3)
    urls = urls_of(rng, 160) * 2
    data = [(u, rng.choice(["good", "bad"]) if "/z/" in u else "bad" if ("sa" in u) == (".net" in u) else "good") for u in urls] + [(None, "bad"), (urls[0], None)]
    found = mine(rows("url string, label string", data), mining)
    toks = {u: v[2] for u, v in parsed(rows, {u for u, _ in data}).items()}
    expected = counted([(u, tuple(toks[u]), label) for u, label in data], mining)
    got = {(tuple(r.tokens), r.label): (r.confidence, r.support) for r in found.collect()}
    assert got == expected and len(got) > 5
    for r in judge(rows("url string, confidence int", [(u, 1) for u in urls_of(rng, 60)] + [(None, 1)]), found).collect():
        mine_ = set(parsed(rows, [r.url])[r.url][2])
        fit = [(-c, -n, len(s), list(s), label) for (s, label), (c, n) in expected.items() if set(s) <= mine_]
        best = min(fit, default=None)
        assert (r.confidence, r.mined_rule, r.mined_verdict) == ((-best[0], " ".join(best[3]), best[4]) if best else (None, None, None))


def test_nothing_labelled_empty_and_sample(rows):
    assert mine(rows("url string, label string", [])).count() == 0
    assert filter_urls(rows("url string, page_id long", []), HOST_RULES).count() == 0
    got = filter_urls(rows("url string, page_id long", [("http://a.com/x", 1), ("http://a.com/x", 1), (None, None)]), HOST_RULES).collect()
    assert len(got) == 3 and all(r.verdict == "allow" and r.mined_rule is None for r in got)
    many = [(f"http://s{'ab'[i % 2]}.com/{i}-{'x' * (i % 9)}", "ab"[i % 2]) for i in range(4000)]
    found = {(tuple(r.tokens), r.label): r.support for r in mine(rows("url string, label string", many), Mining(sample=500)).collect()}
    assert 100 < found[("h2=sa",), "a"] < 400 and found[("h2=sb",), "b"] > 100


def test_query_like_sql(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert difference(query(spark, sf_dir), connect(sf_dir), SQL) is None
