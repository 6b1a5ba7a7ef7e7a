from __future__ import annotations

import random

from pyspark.sql import functions as F

from recordlake.operators import lexicon, search


def fnv(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def bits(tokens) -> list[int]:
    words = [0] * 4
    for t in tokens:
        for s in range(4):
            p = fnv(f"{s}:{t}") % 256
            words[p >> 6] |= 1 << (p & 63)
    return [w - (1 << 64) if w >> 63 else w for w in words]


def test_signatures_and_no_false_negative(spark):
    rng = random.Random(2)
    vocab = [f"{a}{b}" for a in ("the", "o'clock", "x_1", "don’t", "a-b", "zz") for b in ("", "s", "er", "9")]
    values = [(i % 40, rng.choice([None, "", "É", *([" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 12)))] * 4)])) for i in range(120)]
    table = spark.createDataFrame(values, "id bigint, value string")
    own = {}
    for i, v in values:
        own.setdefault(i, set()).update(search.query_tokens(v or ""))
    signed = search.signatures(table)
    assert {r.id: [r.w0, r.w1, r.w2, r.w3] for r in signed.collect()} == {i: bits(t) for i, t in own.items()}
    signed = signed.withColumn("at", F.col("id") * 10).cache()
    for query in ("The", "don't zz9", "a-bs X_1ER thes"):
        wanted = search.query_tokens(query)
        passed = {r.id for r in search.candidates(signed, query).collect()}
        assert {i for i, t in own.items() if set(wanted) <= t} <= passed
        texts = {i: "\n".join((v or "").lower() for j, v in values if j == i) for i in passed}
        assert {r.id for r in search.search(signed, table, query).collect()} == {i for i in passed if all(w in texts[i] for w in wanted)}
    assert search.search(signed, table, "ab").count() == 0 and search.search(signed, table, " ").count() == 0
    phrase = [r.id for r in search.search(signed, table, "the zz", exact=True).collect()]
    assert sorted(phrase) == sorted(i for i in own if any("the zz" in (v or "") for j, v in values if j == i))
    assert search.skipped(signed, "the").first().records == 40 and search.skipped(signed.limit(0), "the").first().skipped is None


def test_signatures_take_one_pass_and_a_row_per_text(spark, monkeypatch):
    words = ["the", "l’été", "don’t", "x" * 3000, "it's", "a-b_c", "ab", "Ünder"]
    table = spark.createDataFrame([(i % 7, " ".join(words[i % 5 :] + [f"w{i}"])) for i in range(600)] + [(None, "the")], "id bigint, value string").coalesce(1)
    own = {}
    for r in table.collect():
        own.setdefault(r.id, set()).update(search.query_tokens(r.value))
    monkeypatch.setattr(search, "MEMO", 3)
    assert {r.id: [r.w0, r.w1, r.w2, r.w3] for r in search.signatures(table).collect()} == {i: bits(t) for i, t in own.items()}
    plan = search.skipped(search.signatures(table), "the")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan


def test_lexicon_contexts(spark):
    rules = [("age", "underage"), ("age", "minor"), ("harm", "knife fight"), ("harm", "fight"), ("both", "minor")]
    denied = {"age": (r"(?:no|not|never)\s+(?:\w+\s+){0,2}", r"\s*leagues?\b"), "harm": (None, r"\s+club")}
    cases = {
        1: ("Title", "never an underage cast", []),
        2: ("Title", "never here. But underage", [("age", "text", "underage")]),
        3: ("A Minor", "minor", [("age", "title", "Minor"), ("both", "title", "Minor")]),
        4: ("minor leagues", "no minor; a minor", [("age", "text", "minor"), ("both", "title", "minor")]),
        5: ("knife fight club", "a Knife Fight.", [("harm", "text", "Knife Fight")]),
        6: ("minors, underaged, knife-fight", None, [("harm", "title", "fight")]),
        7: (None, "", []),
        8: ("İİ minor", "é" * 100_000 + " fight", [("age", "title", "minor"), ("both", "title", "minor"), ("harm", "text", "fight")]),
    }
    records = spark.createDataFrame([(i, t, x) for i, (t, x, _) in cases.items()], "id int, title string, text string")
    got = {}
    for r in lexicon.review_signals(records, ["title", "text"], rules, denied).collect():
        got.setdefault(r.id, []).append((r.rule, r.field, r.matched))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(w) for i, (*_, w) in cases.items() if w}


def test_flags_and_clues(spark):
    rules = [("a", "one"), ("b", "two"), ("c", "three"), ("d", "four"), ("e", "five"), ("f", "six"), ("f", "seven")]
    places = [("sea", "shore"), ("sea", "beach"), ("town", "town")]
    t = spark.createDataFrame([("six five four three two one", "town beach"), ("Seven, one", "shoreline"), ("", ""), (None, None)], "x string, y string")
    flags = lexicon.context_flags(F.col("x"), rules, {"g": ("f", ("a", "b"))})
    own = t.select(flags.alias("f"), lexicon.clues(F.col("x"), F.col("y"), rules, places).alias("c")).collect()
    assert [r.c.traits for r in own] == [["a", "b", "c", "d", "e"], ["a", "f"], [], []]
    assert [r.c.place for r in own] == ["sea", None, None, None]
    assert [r.f.g for r in own] == [True, True, False, False] and own[1].f.b is False
