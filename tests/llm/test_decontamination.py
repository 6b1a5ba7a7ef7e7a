from __future__ import annotations

import random
import tracemalloc

import numpy as np

from recordlake.llm import decontamination as dc

from . import brute


def cases():
    r = random.Random(3)
    vocab = ["the", "of", "and", "ä", "ing", "42", "nd", "re"]
    say = lambda n: " ".join(r.choice(vocab) + r.choice(["", "", ",", "."]) for _ in range(n))
    bench = [(i, say(r.randrange(0, 25))) for i in range(30)] + [(3, say(12)), (None, say(12)), (40, None), (41, ""), (42, "Rare Phrase")]
    docs = [(i, say(r.randrange(0, 300))) for i in range(60)]
    docs += [(100 + i, f"{say(30)} {(bench[i][1] or '').upper()} {say(5)}\n{bench[i][1]}") for i in range(20)]
    docs += [(None, bench[1][1]), (200, None), (201, ""), (202, "a rare... phrase!"), (5, docs[5][1])]
    return docs, bench


def test_equal_to_brute_force(spark):
    docs, bench = cases()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, n_words int").repartition(3)
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(brute.decontaminate(docs, bench), key=key)
    assert sorted((tuple(r) for r in dc.op10_decontamination(d, b).collect()), key=key) == want
    blocks = dc.decontaminate(d, b, block_bytes=300).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(r) for r in blocks.collect()), key=key) == want
    assert dc.op10_decontamination(d.limit(0), b).count() == 0
    assert not dc.op10_decontamination(d, b.limit(0)).where("contaminated").count()


def test_clean_text_has_no_window_left_where_spans_were(spark):
    d = spark.createDataFrame([(1, "before ONE two, three four five six seven eight nine ten after"), (2, "untouched text")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    got = {r.doc_id: r.clean_text for r in dc.decontaminate(d, b, clean=True).collect()}
    assert got == {1: "before  after", 2: "untouched text"}


def test_fm_index_on_random_sequences():
    r = np.random.default_rng(2)
    for _ in range(20):
        values = np.append(r.integers(1, 5, 200), 0)
        index = dc.FMIndex(values, 5)
        patterns = r.integers(1, 5, (30, 4))
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi):
            want = [i for i in range(len(values) - 3) if (values[i : i + 4] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_words_of_a_shard_are_not_held_as_objects():
    docs = dc.pd.DataFrame({"text": [" ".join(f"w{i}x{k}" for k in range(200)) for i in range(500)]})
    p = dc.phrases([(1, "one two three four five six seven eight nine ten")])
    tracemalloc.start()
    words, _, _ = dc._search(docs, p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words == [200] * 500 and peak < 45 * sum(words)
