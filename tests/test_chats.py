from __future__ import annotations

import json

from pyspark.sql import functions as F

from recordlake.sources import chats


def short(rows):
    return [(m["role"], m["text"]) for m in rows]


def test_best_list():
    two, three = [{"text": "a"}, {"mes": "b"}], [{"content": "a"}, {"content": ["b", {"text": "c"}]}, {"value": {"content": "d"}}]
    assert chats.best_list({"x": two, "y": {"z": three}}) == three
    assert chats.best_list({"first": two, "second": [{"body": "q"}, {"body": "r"}]}) == two  # of equal ones the first
    mixed = [{"text": "a"}, {"text": "b"}, {"text": "c"}, "no message", 5]
    assert chats.best_list({"list": mixed, "other": three}) == three  # 9 against 12
    assert chats.best_list({"history": mixed, "other": two + [{"text": ""}]}) == mixed  # a usual key: 12
    assert chats.best_list([{"text": "alone"}]) == [] and chats.best_list("x") == [] and chats.best_list(None) == []
    deep = two
    for _ in range(9):
        deep = {"d": deep}
    assert chats.best_list(deep) == []


def test_json_roles_and_repeats():
    items = [
        {"role": "AI", "content": " hello "},
        {"role": "ai", "content": "hello"},
        {"is_user": False, "role": "user", "content": "x"},
        {"name": "Ada", "message": {"text": "y"}},
        {"name": "me", "message": "z", "swipe_id": 2},
        {"sender": "ooc", "text": "note", "created_at": 7},
        {"text": "[OOC: stop]"},
        {"text": None},
        "text",
    ]
    rows = chats.from_json(json.dumps({"a": {"messages": items}}), "ada")
    assert short(rows) == [("character", "hello"), ("character", "hello"), ("character", "x"), ("character", "y"), ("user", "z"), ("system", "note"), ("unknown", "[OOC: stop]")]
    assert [m["regen"] for m in rows] == [False, True, False, False, True, False, False]
    assert [m["ooc"] for m in rows] == [False] * 5 + [True, True] and rows[5]["at"] == "7"


def test_html():
    nodes = "".join(f'<li data-message-id="{i}" class="mes {c}" data-role="{r}"><i class=speaker>{r}</i><br><div class="markdown">{t} &amp; <b>more</b></div></li>' for i, (r, t, c) in enumerate([("user", "hi", ""), ("bot", "yo", "swiped"), ("user", "hi", "")]))
    assert short(chats.from_html(f"<ul>{nodes}</ul><img src=x><p>unclosed", "")) == [("user", "hi & more"), ("character", "yo & more")]
    assert chats.from_html(nodes, "")[1]["regen"]
    page = '<script id="__NEXT_DATA__">{"p": {"chat": [{"role": "user", "text": "<b>1"}, {"text": "2"}]}}</script><div class="message">a</div><div class="message">b</div>'
    assert short(chats.from_html(page, "")) == [("user", "<b>1"), ("unknown", "2")]
    assert short(chats.from_html(page.replace("{", "{{"), "")) == [("unknown", "a"), ("unknown", "b")]
    assert chats.from_html("<p>no chat</p>", "") == [] and chats.from_html('<div class="mes">one</div>', "") == []


def test_text_and_forms(spark):
    talk = "intro\r\n**You**: hi\nmore\n\nAda Bot : (ooc) brb\nempty:\nstranger: http://x"
    assert short(chats.from_text(talk, "ada bot")) == [("user", "hi\nmore"), ("character", "(ooc) brb"), ("unknown", "http://x")]
    assert short(chats.from_text("one\nblock\n\n \n\ntwo", "")) == [("unknown", "one\nblock"), ("unknown", "two")]
    rows = [(1, talk), (2, ' {"items": [{"text": "a"}, {"text": "b"}]}'), (3, "<div class=message>x</div><div class=message>y</div>"), (4, None), (5, ""), (6, "[broken"), (7, "[" * 100_000), (8, "just words")]
    own = spark.createDataFrame(rows, "id int, text string").withColumns({"form": chats.form_of(F.col("text")), "bot": F.lit(None).cast("string")})
    got = {}
    for r in chats.messages(own).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.text)
    assert got == {1: ["hi\nmore", "(ooc) brb", "http://x"], 2: ["a", "b"], 3: ["x", "y"]}


def test_exports_are_parsed_in_slices(spark, monkeypatch):
    monkeypatch.setattr(chats, "ROWS", 2)
    own = spark.createDataFrame([(i if i else None, "text", f"A: x{i}\nB: y" if i % 3 else None, "a") for i in range(7)] + [(None, "text", "A: z\nB: y", "a")], "id bigint, form string, text string, bot string").coalesce(1)
    got = sorted((r.id or 0, r.pos, r.role, r.text) for r in chats.messages(own).collect())
    assert got == sorted((i, *x) for i in (0, 1, 2, 4, 5) for x in ((0, "character", f"x{i}" if i else "z"), (1, "unknown", "y")))
