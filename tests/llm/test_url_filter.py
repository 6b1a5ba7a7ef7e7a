from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from recordlake.llm import url_filter

SCHEMA = "page_id bigint, url string, rule string"


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[1] if best else None, best[2] if best else "allow"


URLS = [None, "", "no scheme", "http://", "HTTP://Example.NET/en/x?a=/en/", "https://a.example.net", "https://a.example.net/", "https://myexample.net/en/", "http://example.com/de/", "http://example.com/deep", "http://x.example.com/de/#y", "http://a.org/fr/1", "http://org/fr/", "://net/", "a://b://c/d", "http://net?x", "http://É.net/ü", "http://a..net/", "http://.net/\n/x"]


def test_contract_rules(spark):
    pages = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[4], "x"), (4, URLS[4], "x"), (4, URLS[4], "x")]
    got = Counter(tuple(r) for r in url_filter.op1_url_filter(spark.createDataFrame(pages, SCHEMA)).collect())
    assert got == Counter((i, *brute(u, url_filter.RULES)) for i, u, _ in pages)
    assert url_filter.op1_url_filter(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("max_bytes", [64 << 20, 12])
def test_long_lists_by_one_cascade_and_by_several(spark, max_bytes):
    r = random.Random(2)
    hosts = [".".join(r.choice("abcd") for _ in range(r.randrange(1, 4))) for _ in range(300)]
    rules = list({(h, p): (h, p, r.choice(["block", "allow"])) for h in hosts[:60] for p in (r.choice(["/", "/x/", "/x/y"]),)}.values())
    pages = [(i, f"http://{h}{r.choice(['', '/', '/x/', '/x/y', '/x/yz?q'])}", "") for i, h in enumerate(hosts)]
    got = {x.page_id: tuple(x)[1:] for x in url_filter.judge_urls(spark.createDataFrame(pages, SCHEMA), spark.createDataFrame(rules, "host string, path string, action string"), max_bytes=max_bytes).collect()}
    assert got == {i: brute(u, rules) for i, u, _ in pages}


def test_no_rules(spark):
    rules = spark.createDataFrame([], "host string, path string, action string")
    assert {r.verdict for r in url_filter.judge_urls(spark.createDataFrame([(1, "http://a/", ""), (2, None, "")], SCHEMA), rules).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(5000).selectExpr("cast(id as string) as key")
    listed = keys.where("key % 37 = 0")
    levels = url_filter.build_cascade(listed, keys)
    hashed = url_filter._hashed(keys).toPandas()
    got = url_filter.passes(levels, hashed["h1"].to_numpy().view(np.uint64), hashed["h2"].to_numpy().view(np.uint64))
    assert (got == (hashed["key"].astype(int) % 37 == 0)).all()


def test_rules_of_very_many_lengths_and_long_urls(spark):
    rules = [("a.b", "/" + "x" * n, "block" if n % 2 else "allow") for n in range(0, 600, 2)] + [("b", "/" + "x" * 299, "block")]
    pages = [(n, f"http://w.a.b/{'x' * n}?q", "") for n in (0, 1, 298, 299, 300, 5000)] + [(9000, "http://" + "a." * 12 + "b/" + "x" * 100_000, ""), (9001, "http://c/" + "y" * 100_000, "")]
    got = {x.page_id: tuple(x)[1:] for x in url_filter.judge_urls(spark.createDataFrame(pages, SCHEMA), spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    assert got == {i: brute(u, rules) for i, u, _ in pages}


def test_keys_that_share_their_hashes_are_told_apart_by_others(spark, monkeypatch):
    real, tried = url_filter.hashes, []

    def weak(key, salt):
        tried.append(salt)
        return real(key, salt) if salt else (url_filter.F.lit(7).cast("bigint"), url_filter.F.lit(7).cast("bigint"))

    monkeypatch.setattr(url_filter, "hashes", weak)
    monkeypatch.setattr(url_filter, "ROUNDS", 3)
    pages = [(i, u, "x") for i, u in enumerate(URLS)]
    got = {r.page_id: tuple(r)[1:] for r in url_filter.op1_url_filter(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got == {i: brute(u, url_filter.RULES) for i, u, _ in pages} and set(tried) == {0, 1}
