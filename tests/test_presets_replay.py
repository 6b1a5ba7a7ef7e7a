from __future__ import annotations

import json

import pytest

from recordlake.functions import leaves
from recordlake.operators import presets
from recordlake.streaming import replay

ROWS = [
    ("franchise", "stars", "stars", None, "Star Saga", "strong"),
    ("franchise", "stars", "stars", None, "saga", "contextual"),
    ("group", "crew", "stars", None, "night crew", "strong"),
    ("character", "ada", "stars", "female", "Ada Vex", "strong"),
    ("character", "ada", "stars", "female", "Ada", "contextual"),
    ("character", "bo", "stars", "male", "Bo Lane", "strong"),
    ("character", "cy", "stars", "unknown", "Cy-7", "strong"),
    ("character", "zed", "other", "male", "Zed", "strong"),
    ("variant", "v", None, None, "gender swap", "strong"),
    ("theme", "gore", None, None, "gore", "strong"),
]


def decided(spark, titles, mode="all", name="stars", **keep):
    rows = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    got = {r.id: r for r in presets.decide(presets.matches(rows, spark.createDataFrame(ROWS, presets.CATALOGUE), name), mode, **keep).where("matched").collect()}
    return [(got[i].hide, got[i].reason, got[i].characters) if i in got else None for i in range(len(titles))]


def test_presets(spark):
    titles = ["StarSaga: a tale", "saga of ada", "Star Saga with ADA", "The Nightcrew", "night-crew reunion", "Bo Laney", "Bó Lane!", "Zed", "Ada", "", None]
    assert decided(spark, titles) == [
        (True, "any name", ""), None, (True, "any name", "ada"), None, (True, "any name", ""), None, (True, "any name", "bo"), None, None, None, None,
    ]
    titles = ["Bo Lane", "Ada Vex", "Ada Vex and Bo Lane", "Cy-7", "Bo Lane gender-swap", "night crew", "Star Saga"]
    assert [d[:2] for d in decided(spark, titles, "keep-female")] == [
        (True, "one character"), (False, "kept"), (False, "kept"), (False, "not one known character"), (False, "variant"), (False, "not one known character"), (False, "not one known character"),
    ]
    assert [d[0] for d in decided(spark, titles[:2], "custom", keep_genders=("male",))] == [False, True]
    assert [d[1] for d in decided(spark, titles[:3], "all", keep_characters=("bo",))] == ["kept", "any name", "kept"]
    assert decided(spark, ["Gore tale", "gory"], name="gore") == [(True, "theme", ""), None]
    with pytest.raises(ValueError, match="unknown mode"):
        decided(spark, ["x"], "odd")


def test_leaves(spark):
    deep = 7
    for _ in range(60):
        deep = {"d": deep}
    docs = [(1, json.dumps(deep)), (2, '{"a": {"b": 1, "c": [1, {"z": 2, "y": "é"}], "e": {}}, "n": null, "t": true, "s": "x y"}'), (3, "[1]"), (4, None), (5, "{broken"), (6, '{"d":' * 5000 + "1" + "}" * 5000)]
    rows = spark.createDataFrame(docs, "id int, j string")
    got = {}
    for r in leaves.flatten(rows, "id", "j").collect():
        got.setdefault(r.id, []).append((r.path, r.value))
    long = got.pop(6, [])
    assert got == {1: [(".".join(["d"] * 60), "7")], 2: [("a.b", "1"), ("a.c", '[1,{"y":"é","z":2}]'), ("n", None), ("t", "true"), ("s", "x y")]}
    assert long in ([], [(".".join(["d"] * 5000), "1")])  # as deep as the parser goes
    assert leaves.register(spark) == ["rl_leaves", "rl_consensus"]
    assert spark.sql("SELECT path, value FROM rl_leaves('{\"a\":{\"b\":\"c\"}}')").collect() == [("a.b", "c")]
    assert spark.sql("SELECT g, rl_consensus(x) AS x FROM VALUES (1, 'a '), (1, 'a'), (1, NULL), (2, 'a'), (2, 'b'), (3, ' ') AS t(g, x) GROUP BY g ORDER BY g").collect() == [(1, "a"), (2, None), (3, None)]


def test_replay_with_a_budget(spark, tmp_path):
    lines = [(f"f{i // 10}", i % 10, i % 3, "ab"[i % 2], None if i % 7 == 0 else i // 6) for i in range(40)]
    entries = spark.createDataFrame(lines, "file string, line bigint, entity_id bigint, path string, k bigint").repartition(3)
    whole = replay.replay(spark, entries, str(tmp_path / "one"), 10_000)
    want = {tuple(r) for r in replay.values(spark, str(tmp_path / "one")).collect()}
    known, writes = {}, 0
    for _, _, e, p, k in lines:
        if k is not None and known.get((e, p)) != k:
            known[e, p], writes = k, writes + 1
    assert want == {(*key, k) for key, k in known.items()} and whole == {"lines": 40, "writes": writes, "left": False}

    out, runs = str(tmp_path / "small"), []
    while not runs or runs[-1]["left"]:
        runs.append(replay.replay(spark, entries, out, 9))
        if len(runs) == 2:
            # Killed before its receipts were written: the run is done again.
            import shutil

            shutil.rmtree(tmp_path / "small" / "receipts" / "batch=2")
            assert replay.replay(spark, entries, out, 9) == runs[-1]
    assert {tuple(r) for r in replay.values(spark, out).collect()} == want
    assert all(r["writes"] == 9 for r in runs[:-1]) and sum(r["writes"] for r in runs) == writes and sum(r["lines"] for r in runs) == 40
    assert replay.replay(spark, entries, out, 9) == {"lines": 0, "writes": 0, "left": False}
    stuck = replay.replay(spark, entries, str(tmp_path / "none"), 0)
    assert stuck["writes"] == 0 and stuck["left"]
