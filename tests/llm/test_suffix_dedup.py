from __future__ import annotations

import random
from collections import Counter

import pytest

from recordlake.llm import suffix_dedup as sd

from . import brute


def cases():
    r = random.Random(6)
    vocab = ["the ", "of ", "é", "ß ", "ing", "\n", "an ", "日本", "x" * 9, "\x00", "tion "]
    say = lambda n: "".join(r.choice(vocab) for _ in range(n))
    parts = [say(40) for _ in range(12)]
    docs = []
    for i in range(120):
        docs.append((r.randrange(1000), "".join(r.choice([say(r.randrange(1, 30)), r.choice(parts), r.choice(parts)[r.randrange(0, 30) :]]) for _ in range(r.randrange(0, 6)))))
    docs += [(2000, parts[0] + parts[0]), (2001, "a" * 300), (2002, "a" * 49), (2003, "a" * 50), (2004, "a" * 400 + "b"), (None, "a" * 300), (2005, None), (2006, ""), (7, parts[1]), (7, parts[1]), (7, parts[1] + "tail")]
    return docs


@pytest.mark.parametrize("stretch", [1 << 18, 500])
def test_equal_to_brute_force(spark, stretch, monkeypatch):
    monkeypatch.setattr(sd, "STRETCH", stretch)
    docs = cases()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, n_bytes int").repartition(5)
    want = Counter(brute.repeats(docs))
    assert sum(x[2] > 0 for x in want) > 30
    assert Counter(map(tuple, sd.op3_suffix_dedup(d).collect())) == want
    assert sd.op3_suffix_dedup(d.limit(0)).count() == 0


def test_long_texts_are_cut_into_segments_without_loss():
    r = random.Random(1)
    text = bytes(r.randrange(97, 105) for _ in range(5000))
    old, sd.SEGMENT = sd.SEGMENT, 700
    try:
        windows = {shift + a + j for _, _, starts, data, shift in sd.stretches([text]) for _, _, first, last in [sd.anchored(data, starts)] for a, b in zip(first, last) for j in range(b - a + 1)}
    finally:
        sd.SEGMENT = old
    assert windows == set(range(len(text) - 49))
