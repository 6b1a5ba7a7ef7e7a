from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recordlake.llm import chat_tools, queries

CALLS = "conv bigint, turn bigint, id string, name string, arguments string, depends_on array<string>"
RESULTS = "conv bigint, turn bigint, id string, content string"
TALK = "conv_id bigint, turn bigint, role string, text string, id string, level string"


def canonical(value):
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def link(spark, calls, results, schemas):
    c = spark.createDataFrame(calls, CALLS).withColumn("arguments", F.try_parse_json("arguments")).repartition(3)
    return chat_tools.link_tool_calls(c, spark.createDataFrame(results, RESULTS), spark.createDataFrame(schemas, chat_tools.SCHEMAS)).collect()


def test_linking_order_schema_and_json(spark):
    calls = [
        (1, 0, "a", "search", '{"q": "x", "n": {"z": [1, 2.50, null], "b": true}}', None),
        (1, 1, "b", "search", "{}", ["a"]),
        (1, 2, "c", "search", '{"q": 3, "n": {}, "x": 1}', ["b", "a", None]),
        (1, 3, "a", "search", '{"q": "again"}', None),
        (1, 4, "d", "nope", None, ["zz", "a"]),
        (1, 5, "e", "search", '{"q": "z"}', ["f"]),
        (1, 6, "f", "search", '{"q": "z"}', ["e"]),
        (1, 7, "g", "search", '{"q": "z"}', ["f", "a"]),
        (2, 0, "a", "search", '{"q": "other"}', []),
        (2, 1, None, "search", '{"q": "no id"}', None),
        (None, 1, "a", "search", '{"q": "no conversation"}', ["b"]),
        (3, 1, "t", "search", '{"q": "tie 1"}', None),
        (3, 1, "t", "search", '{"q": "tie 2"}', None),
        (3, 2, "u", "search", '{"q": "twice"}', ["t"]),
        (3, 2, "u", "search", '{"q": "twice"}', ["t"]),
    ]
    results = [(1, 1, "a", 'ok "é"'), (1, 9, "a", "late"), (1, 2, "b", None), (3, 0, "a", "elsewhere"), (1, 1, None, "x"), (3, 3, "u", "y"), (3, 3, "u", "z"), (3, 3, "u", "y")]
    got = link(spark, calls, results, [("search", ["q"], {"q": "string", "n": "object"})])
    assert len(got) == len(calls)
    by = {(r.conv, r.id, r.turn): r for r in got}
    assert [by[1, x, t].level for t, x in enumerate("abc")] == [0, 1, 2]
    assert by[1, "a", 0].problems == "" and by[1, "a", 0].n_results == 2 and by[1, "a", 0].result_turn == 1
    assert by[1, "a", 0].json == canonical({"arguments": {"q": "x", "n": {"z": [1, 2.5, None], "b": True}}, "id": "a", "name": "search", "result": 'ok "é"'})
    assert by[1, "b", 1].problems == "missing: q" and by[1, "b", 1].result_turn == 2
    assert by[1, "c", 2].problems == "unknown: x; type: q; no result"
    assert (by[1, "a", 3].problems, by[1, "a", 3].level, by[1, "a", 3].n_results) == ("duplicate id; no result", None, 0)
    assert (by[1, "d", 4].problems, by[1, "d", 4].level) == ("unknown tool; unresolved: zz; no result", 1)
    assert all((by[1, x, t].problems, by[1, x, t].level) == ("cycle; no result", None) for t, x in ((5, "e"), (6, "f"), (7, "g")))
    assert by[2, None, 1].problems == "no id; no result" and by[None, "a", 1].problems == "no id; no result"
    ties = [r for r in got if r.conv == 3 and r.id == "t"]
    assert sorted(r.problems for r in ties) == ["duplicate id; no result", "no result"]
    twins = [r for r in got if r.conv == 3 and r.id == "u"]
    assert len(twins) == 2 and len(set(twins)) == 1 and twins[0].level == 1 and twins[0].n_results == 3


def test_types_and_arguments_that_are_no_object(spark):
    values = {"string": '"s"', "integer": "3", "number": "2.5", "boolean": "true", "object": '{"a":1}', "array": "[1]", "null": "null"}
    calls = [(1, i, f"{want}-{own}", want, f'{{"x":{value}}}', None) for i, (want, (own, value)) in enumerate((w, v) for w in values for v in values.items())]
    calls += [(2, 0, "list", "string", "[1]", None), (2, 1, "none", "string", None, None), (2, 2, "text", "string", '"x"', None)]
    got = {r.id: r.problems.split("; ")[0] for r in link(spark, calls, [], [(t, ["x"], {"x": t}) for t in values])}
    for want in values:
        for own in values:
            fits = want == own or (want, own) == ("number", "integer")
            assert got[f"{want}-{own}"] == ("no result" if fits else "type: x"), (want, own)
    assert (got["list"], got["none"], got["text"]) == ("arguments: no object", "missing: x", "arguments: no object")


def brute_levels(edges):
    needs: dict = {}
    for c, i, n in edges:
        needs.setdefault((c, i), set()).add((c, n))
    level = {x: 0 for v in needs.values() for x in v if x not in needs}
    while True:
        ready = [k for k, v in needs.items() if k not in level and all(x in level for x in v)]
        if not ready:
            return {k: level.get(k) for k in needs}
        level.update({k: max(level[x] for x in needs[k]) + 1 for k in ready})


def test_levels_equal_brute_force_at_any_depth(spark):
    r = random.Random(3)
    edges = [(1, f"c{i}", f"c{i - 1}") for i in range(1, 12_000)]  # one long chain
    edges += [(2, f"d{i}", f"d{r.randrange(max(0, i - 9), i)}") for i in range(1, 60) for _ in range(2)]
    edges += [(3, "x", "y"), (3, "y", "z"), (3, "z", "x"), (3, "tail", "x"), (3, "fork", "tail"), (3, "fork", "free"), (3, "after", "fork"), (3, "self", "self"), (3, "e", "c"), (1, "x", "c7"), (1, "x", "c9000")]
    got = chat_tools.levels(spark.createDataFrame(edges, "conv bigint, id string, needs string"))
    assert {(x.conv, x.id): x.level for x in got.collect()} == brute_levels(edges)


@pytest.mark.parametrize("bound", [10_000, 0])
def test_every_turn_once(spark, monkeypatch, bound):
    monkeypatch.setattr(chat_tools, "TOOLS", bound)
    call, result = '{"id":"k","name":"reply","arguments":{"style":"s","prompt":"p"}}', '{"tool_call_id":"k","content":{"y":1,"x":[2]}}'
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "there"), (1, 2, "user", None), (1, 3, "system", "rules"), (1, 4, "assistant", "to no one"), (None, 0, "user", "lost"), (2, None, "user", "lost"), (3, 0, None, None), (5, 0, "user", "{no json"), (5, 1, "assistant", '{"a":1,"a":2}')]
    rows += [(4, 0, "assistant", call), (4, 5, "tool", result), (4, 6, "tool", '{"tool_call_id":"zz"}'), (1, 0, "user", "hi"), (6, 0, "user", "long " * 50_000)]
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], TALK)
    got = Counter((x.kind, x.conv_id, x.call_id, x.turn, x.problems, x.json) for x in chat_tools.op9_tool_calls(d).collect())
    reply = lambda i, p, *a: canonical({"arguments": {"prompt": p} if p else {}, "id": i, "name": "reply"} | ({"result": a[0]} if a else {}))
    want = Counter(
        {
            ("call", 1, "1:0", 0, "", reply("1:0", "hi", "there")): 2,
            ("result", 1, "1:0", 1, "", canonical({"content": "there", "tool_call_id": "1:0"})): 1,
            ("call", 1, "1:2", 2, "missing: prompt; no result", reply("1:2", None)): 1,
            ("message", 1, None, 3, "", canonical({"content": "rules", "role": "system"})): 1,
            ("message", 1, None, 4, "", canonical({"content": "to no one", "role": "assistant"})): 1,
            ("call", None, None, 0, "no id; no result", canonical({"arguments": {"prompt": "lost"}, "name": "reply"})): 1,
            ("call", 2, None, None, "no id; no result", canonical({"arguments": {"prompt": "lost"}, "name": "reply"})): 1,
            ("message", 3, None, 0, "", "{}"): 1,
            ("call", 5, "5:0", 0, "", reply("5:0", "{no json", '{"a":1,"a":2}')): 1,
            ("result", 5, "5:0", 1, "", canonical({"content": '{"a":1,"a":2}', "tool_call_id": "5:0"})): 1,
            ("call", 4, "k", 0, "", canonical({"arguments": {"prompt": "p", "style": "s"}, "id": "k", "name": "reply", "result": '{"x":[2],"y":1}'})): 1,
            ("result", 4, "k", 5, "", canonical({"content": '{"x":[2],"y":1}', "tool_call_id": "k"})): 1,
            ("result", 4, "zz", 6, "no call", '{"tool_call_id":"zz"}'): 1,
            ("call", 6, "6:0", 0, "no result", reply("6:0", "long " * 50_000)): 1,
        }
    )
    assert got == want
    assert chat_tools.op9_tool_calls(d.limit(0)).count() == 0


def test_joins_are_hashed_and_nothing_leaves_the_engine(spark):
    d = spark.createDataFrame([(1, 0, "user", "hi", "x", "y")], TALK)
    plan = chat_tools.op9_tool_calls(d)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and not any(x in plan for x in ("SortMergeJoin", "SortAggregate", "Python", "Pandas", "Arrow"))


def test_chains_of_orders(spark):
    assert "tool_chains" in queries.QUERIES and "tool_chains" in queries.SQL


def test_lists_of_calls_and_whole_numbers(spark):
    call = lambda i, n: f'{{"id":"{i}","name":"f","arguments":{{"n":{n}}}}}'
    numbers = ["12345678901234567890", "1.0", "1e2", "-3", "2.5", "1e-1", "12345678901234567890.5", '"7"', "123456789012345678901234567890123456789012"]
    rows = [(1, 0, "assistant", "[" + ",".join(call(f"c{i}", n) for i, n in enumerate(numbers)) + "]")]
    rows += [(1, 1, "tool", '[{"tool_call_id":"c0","content":"a"},{"tool_call_id":"c1","content":{"k":1}}]'), (1, 2, "assistant", "[" + call("c90", 1) + ',{"id":"no name"}]'), (1, 3, "assistant", "[]"), (1, 4, "assistant", "[not json")]
    schemas = spark.createDataFrame([("f", ["n"], {"n": "integer"})], chat_tools.SCHEMAS)
    got = chat_tools.format_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), schemas).collect()
    calls = {r.call_id: r for r in got if r.kind == "call"}
    assert sorted(calls) == [f"c{i}" for i in range(len(numbers))]
    assert {i for i, r in calls.items() if "type: n" in r.problems} == {"c4", "c5", "c6", "c7"}
    assert [calls[f"c{i}"].result_turn for i in range(3)] == [1, 1, None]
    assert sorted(r.turn for r in got if r.kind == "result") == [1, 1] and sorted(r.turn for r in got if r.kind == "message") == [2, 3, 4]


def test_calls_with_needs_are_parsed_once(spark):
    text = ['{"id":"a","name":"ship","arguments":{"where":{}}}', '{"id":"b","name":"ship","depends_on":["a"],"arguments":{"where":1.50}}']
    talk = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(text)], "conv_id bigint, turn bigint, role string, text string")
    got = chat_tools.format_turns(talk, spark.createDataFrame([queries.CHAIN_TOOL], chat_tools.SCHEMAS))
    assert sorted((r.call_id, r.level) for r in got.collect()) == [("a", 0), ("b", 1)]
    assert "try_parse_json" not in got._jdf.queryExecution().logical().toString() and "parsejson" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
