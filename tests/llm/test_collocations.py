from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from recordlake.llm.collocations import collocations

SCHEMA = "doc_id bigint, text string, lang string, block int, word string"


def rows() -> list[tuple]:
    rng = random.Random(3)
    words = ["the", "of", "New", "York", "city", "é", "a-b", "x1", "#"]
    out = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", " new york city "]) for _ in range(rng.randrange(40))), ["en", None, "fr"][i % 3], 1, "w") for i in range(120)]
    return [*out, *out[:4], (None, "new york, new york", "en", 1, None), (5, None, "en", None, None), (6, "a a a a a a a a", "rep", None, None), (7, ".,;:!?", "none", None, None)]


def brute(docs: list[tuple], least: int, longest: int, top: int) -> set[tuple]:
    f, n = {}, Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        c = {g: a for g, a in c.items() if a >= least}
        rows_ = []
        for g, a in c.items():
            inside = any(len(q) > len(g) and b >= a and any(q[i : i + len(g)] == g for i in range(len(q))) for q, b in c.items())
            if len(g) < 2 or inside:
                continue
            score, k = min((1000 * a * n[lang] // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            rows_.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return out


@pytest.mark.parametrize(("least", "longest", "top", "block_words"), [(4, 5, 2000, 4_000_000), (3, 5, 10, 50), (2, 2, 2000, 200), (5, 3, 2000, 1)])
def test_equals_brute_force(spark, least, longest, top, block_words):
    docs = rows()
    got = collocations(spark.createDataFrame(docs, SCHEMA).repartition(3), least, longest, top, block_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) > 10
    assert set(got) == brute(docs, least, longest, top)


def test_nothing_frequent_and_empty(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, "one two", "en", 0, None), (2, None, None, 0, None)], SCHEMA)).count() == 0


def test_very_long_text_of_one_phrase(spark):
    docs = [(1, "ab cd " * 200_000, "en", 0, None)]
    got = [tuple(r) for r in collocations(spark.createDataFrame(docs, SCHEMA)).collect()]
    assert set(got) == brute(docs, 100, 5, 2000)
    assert all(r[6] == 400_000 for r in got)


def test_products_beyond_64_bits(spark):
    """Scores are computed as whole numbers of up to 38 digits."""
    row = spark.sql("select cast(1000 * cast(a as decimal(38,0)) * cast(n as decimal(38,0)) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0))) as bigint) s from values (123456789012, 9876543210987, 1234567890123, 98765432109) t(a, n, l, r)").first()
    assert row.s == 1000 * 123456789012 * 9876543210987 // (1234567890123 * 98765432109)
