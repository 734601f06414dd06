"""URL rules against a plain reading of them, and the cascade against sets."""

import random
import re

import numpy as np
import pytest

from sheetlake.llm import url_filter


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain(url, rules, hosts):
    host, path = split(url)
    within = lambda h: h and (host == h or host.endswith("." + h))
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if v in ("allow", "block") and within(h) and path.startswith(p)]
    if fit:
        best = max(fit)
        return host, path, best[3], best[4]
    return host, path, None, "block" if any(map(within, hosts)) else "allow"


def check(spark, urls, rules, hosts, **how):
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, key int")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    h = spark.createDataFrame([(x,) for x in hosts], "host string")
    got = {x["page_id"]: tuple(x)[1:] for x in url_filter.judge(pages, r, h, **how).collect()}
    assert got == {i: plain(u, rules, [x for x in hosts if x]) for i, u in enumerate(urls)}
    return got


ODD = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "http://x.COM/a", "ftp://a.b://com/", "http://example.com/en/1", "http://www.example.com/en/1", "http://m.www.example.com/en/", "http://wwwexample.com/en/",
    "http://a.net/es/?x#y", "http://a.net/es", "http://a.net?/es/", "http://a.net#/fr/", "http://net/fr/x", "http://ÄB.net/fr/é", "http://a..net/fr/", "http://.net/fr/", "http://a.net./fr/", "http://x\ny.com/\nz", "http://user@a.com:80/en/", "http://" + "a." * 5000 + "com/" + "p" * 50000,
]


def test_rules_of_the_query_on_odd_urls(spark):
    check(spark, ODD + ODD, list(url_filter.RULES), ["pills.example.com", None, "", "a.net"])


def test_random_lists_with_several_parts_and_passes(spark):
    rng = random.Random(4)
    label = lambda: rng.choice("abcdefgh") * rng.randint(1, 2)
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 3)))
    path = lambda: "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 3)))
    rules = [(host(), rng.choice(["", path(), path()]), rng.choice(["allow", "block"])) for _ in range(300)]
    rules += [("a.b", "x", "block"), (None, "/", "block"), ("a", None, "block"), ("", "/", "allow"), ("a", "/", "perhaps")]
    hosts = [host() for _ in range(150)]
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(3000)]
    fine = [(h, p or "", v) for h, p, v in rules if h]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {x["page_id"]: tuple(x)[1:] for x in url_filter.judge(pages, r, spark.createDataFrame([(x,) for x in hosts], "host string"), part_keys=40, most_bytes=200).collect()}
    assert got == {i: plain(u, [f for f in fine if f[1][:1] in ("", "/")], hosts) for i, u in enumerate(urls)}


def test_empty_tables_and_lists(spark):
    check(spark, [], list(url_filter.RULES), ["a.com"])
    check(spark, ["http://a.com/"], [], [])
    assert url_filter.judge_pages(spark.createDataFrame([], "page_id long, url string")).collect() == []


@pytest.mark.parametrize("n_listed, n_others", [(0, 50), (1, 0), (50, 5000), (3000, 200), (2000, 60000)])
def test_cascade_is_exact_on_its_universe(n_listed, n_others):
    rng = np.random.default_rng(n_listed)
    keys = rng.integers(0, 2**63, (n_listed + n_others, 2)).astype(np.uint64)
    listed, others = keys[:n_listed], keys[n_listed:]
    first = url_filter.Bloom.of(listed, 1, 0.3)
    made = url_filter.Cascade.from_bytes(url_filter.Cascade.extended(first, listed, others[first.passes(others)]).to_bytes())
    assert made.holds(listed).all() and not made.holds(others).any()


def test_a_cascade_that_cannot_end_is_refused():
    same = np.array([[1, 2]], np.uint64)
    with pytest.raises(ValueError):
        url_filter.Cascade.extended(url_filter.Bloom.of(same, 1, 0.5), same, same)
