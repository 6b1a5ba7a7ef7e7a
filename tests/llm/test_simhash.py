from __future__ import annotations

import random
from collections import Counter

import numpy as np

from recordlake.llm import simhash

from . import brute


def test_equal_to_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["É", "ß", "The"]
    base = [" ".join(r.choice(vocab) for _ in range(r.randrange(60, 200))) for _ in range(12)]
    docs = [(i, t) for i, t in enumerate(base)]
    for i in range(120):
        w = r.choice(base).split()
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        docs.append((1000 - i, "  ".join(w)))
    docs += [(50, None), (49, ""), (48, " \n "), (None, base[0]), (60, "one"), (61, "ONE"), (62, "one two"), (1000, base[3]), (1000, base[3])]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, fp string").repartition(5)
    assert Counter(map(tuple, simhash.op4_simhash(d).collect())) == Counter(brute.near_groups(docs))
    assert simhash.op4_simhash(d.limit(0)).count() == 0


def test_bit_sliced_distances():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**64, 50, dtype=np.uint64)
    b = np.concatenate([r.integers(0, 2**64, 80, dtype=np.uint64), a ^ np.uint64(7), a ^ np.uint64(0x8001_0000_0001_0001)])
    for radius in (0, 1, 2, 3, 5, 9):
        want = np.array([[(int(x) ^ int(y)).bit_count() <= radius for y in b] for x in a])
        assert (simhash.within(a, b, radius) == want).all()


def test_large_buckets_lose_no_link(spark, monkeypatch):
    r = np.random.default_rng(3)
    center = int(r.integers(0, 2**62))
    fps = sorted({center ^ (1 << int(r.integers(0, 62))) ^ (1 << int(r.integers(0, 62))) ^ (1 << int(r.integers(0, 62))) for _ in range(400)} | {int(x) for x in r.integers(0, 2**62, 300)})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp bigint")

    def parts(edges):
        return {(x.node, x.root) for x in simhash.components(edges).collect()}

    monkeypatch.setattr(simhash, "BLOCK", 64)
    want = simhash.within(np.array(fps, np.uint64), np.array(fps, np.uint64), 3)
    pairs = [(fps[i], fps[j]) for i, j in zip(*np.nonzero(want)) if i > j]
    expected = parts(spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert parts(simhash.links(nodes, len(fps))) == expected
    monkeypatch.setattr(simhash, "BUCKET", 0)
    assert parts(simhash.links(nodes, 1 << 40)) == expected


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 100)] + [(500, i) for i in range(501, 700)] + [(900, 901), (901, 900), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {i: 500 for i in range(501, 700)} | {901: 900}


def test_components_by_one_task_and_by_stars(spark, monkeypatch):
    r = random.Random(7)
    edges = [(r.randrange(-(1 << 63), 1 << 63) if r.random() < 0.1 else r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1300)] + [(5, 5)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        new = dict(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    want = {(x, y) for x, y in label.items() if x != y}
    table = spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)
    assert {tuple(x) for x in simhash.components(table).collect()} == want
    monkeypatch.setattr(simhash, "SMALL_LINKS", 10)
    assert {tuple(x) for x in simhash.components(table).collect()} == want
    assert simhash.components(table.limit(0)).count() == 0
