from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from recordlake.functions import cleaning, roles
from recordlake.functions.sql import register
from recordlake.operators import audit, guards, history, reviews
from recordlake.sources import uploads

ROWS = "entity_id string, source string, at string, path string, value string"


def observe(spark, rows):
    got = history.observe(spark.createDataFrame(rows, ROWS), ("personality",), ("num_messages",))
    return sorted((r.entity_id, r.at, r.source, r.path, r.kind, r["from"], r["to"]) for r in got.collect())


def test_observation_changes(spark):
    rows = [("a", "x", "1", "name", "Old"), ("a", "x", "1", "personality", "text"), ("a", "x", "1", "num_messages", "1")]
    rows += [("a", "y", "2", "name", "Old"), ("a", "y", "2", "title", "seen first here")]  # the same value from another source is no change
    rows += [("a", "x", "3", "name", None), ("a", "x", "3", "num_messages", "9")]  # a null, an omitted text field, a volatile one
    rows += [("a", "y", "4", "name", "New"), ("a", "x", "5", "name", "New")]
    assert observe(spark, rows) == [
        ("a", "2", "y", "title", "value", None, "seen first here"),
        ("a", "3", "x", "name", "hidden-or-empty", "Old", None),
        ("a", "3", "x", "personality", "hidden-or-missing", "text", None),
        ("a", "4", "y", "name", "value", "Old", "New"),
    ]
    assert observe(spark, rows[:3]) == [] and observe(spark, []) == []


def test_snapshots_versions_and_imports(spark):
    snaps = spark.createDataFrame([("b", 1, 1, "A", None, [1, 2]), ("b", 2, 2, "A", "c", [2, 1]), ("b", 3, 3, "B", None, [2, 1])], "entity_id string, at int, pos int, title string, cover string, entries array<int>")
    changes = history.snapshot_changes(snaps, ["title", "cover"], ["entries"]).collect()
    assert sorted((r.at, r.field, r["to"] if r.field != "entries" else r["to"][:2]) for r in changes) == [(2, "cover", "c"), (2, "entries", "2:"), (3, "cover", None), (3, "title", "B")]
    assert [r.at for r in history.versions(snaps, "cover", ["title"]).orderBy("at").collect()] == [1, 2, 3]
    assert [r.at for r in history.versions(snaps, "cover", []).orderBy("at").collect()] == [1, 2]  # the cover is carried forward
    known = spark.createDataFrame([("a", "p", "kept"), ("a", "q", None)], "entity_id string, path string, value string")
    late = spark.createDataFrame([("a", 1, "p", "old"), ("a", 1, "q", "older"), ("a", 2, "q", "newer"), ("a", 3, "q", None), ("b", 1, "p", "new")], "entity_id string, at int, path string, value string")
    got = {(r.entity_id, r.path): (r.value, r.filled) for r in history.import_snapshots(known, late).collect()}
    assert got == {("a", "p"): ("kept", False), ("a", "q"): ("newer", True), ("b", "p"): ("new", True)}


def test_submission_classes(spark):
    rows = spark.createDataFrame([(1, ["bad"], True, True, "x"), (2, [], False, None, "x"), (3, [], True, True, "x"), (4, [], True, False, "y"), (5, [], True, None, "x"), (6, [], True, None, " ")], "id int, problems array<string>, found boolean, dup boolean, name string")
    fields = reviews.differing({"name": (F.col("name"), F.lit("x"))})
    got = [r.c for r in rows.orderBy("id").select(reviews.classify(F.col("problems"), F.col("found"), F.col("dup"), fields).alias("c")).collect()]
    assert got == ["problem", "new", "exact_duplicate", "changed", "known", "known"]
    labels = spark.createDataFrame([([" A", "b", "B", ""],)], "l array<string>").select(reviews.label_set(F.col("l")).alias("l"))
    assert labels.head().l == ["a", "b"]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).head().x
    assert value(cleaning.comma_list(F.lit(" a, B,,b ,A, c"))) == ["a", "B", "c"] and value(cleaning.comma_list(F.lit(None).cast("string"))) == []
    assert [value(cleaning.language_code(F.lit(x))) for x in ("English", "pt_BR", "", " DE ")] == ["en", "pt", "", "de"]
    assert [value(cleaning.meaningful_deep(F.lit(x))) for x in ('{"a":[null,{"b":""}]}', '{"a":{"b":0}}', '{"a":false}', "[]", "no json", '{"a":" x"}')] == [False, True, True, False, False, True]
    assert [value(cleaning.guarded_int(F.lit(x), 0, 9)) for x in ("7.9", "-3", "99", "x", None, "NaN")] == [7, 0, 9, None, None, None]
    now = F.expr("TIMESTAMP '2024-03-01 12:00:00'")
    ages = ("2024-03-01 11:00:00", "2024-02-28 12:00:00", "2023-12-01 12:00:00")
    assert [value(cleaning.age_text(F.expr(f"TIMESTAMP '{x}'"), now)) for x in ages] == ["1 hours", "2 days", "3.0 months"]
    assert value(cleaning.age_text(F.expr("TIMESTAMP '2024-03-01 11:59:00'"), now)) == "1 hours" and value(cleaning.age_text(F.expr("TIMESTAMP '2025-01-01 00:00:00'"), now)) == "1 hours"
    assert value(cleaning.age_text(F.expr("TIMESTAMP '2024-01-01 12:00:01'"), now)) == "59 days" and value(cleaning.age_text(F.lit(None).cast("timestamp"), now)) == "Unknown"
    assert str(value(cleaning.latest_slot(now, (0, 2, 4), 2, 17))) == "2024-03-01 02:17:00"
    assert register(spark) == register(spark) and spark.sql("SELECT rl_canonical('A--b') AS x").head().x == "a b"


def test_title_roles(spark):
    cases = {
        "Your dom boss | sub users": ("dominant", "submissive"),
        "dom bot or sub bot": (None, None),
        "Dominant character, submissive user": ("dominant", "submissive"),
        "the bot is a dominant": ("dominant", None),
        "You are the sub": (None, "submissive"),
        "you're an domme": (None, "dominant"),
        "{{ user }} as sub": (None, "submissive"),
        "for a dominant user": (None, "dominant"),
        "your super submissive wife": ("submissive", None),
        "your submissive side": (None, None),
        "dom, bot": (None, None),
        "(dom) bot (sub bot)": ("submissive", None),
        "ＤＯＭ ｂｏｔ": ("dominant", None),
        "subway bots and kingdom users": (None, None),
        "dom!bot": ("dominant", None),
        "": (None, None),
        None: (None, None),
    }
    titles = spark.createDataFrame([(t,) for t in cases], "title string")
    assert {r.title: (r.bot, r.user) for r in titles.select("title", *(c.alias(side) for side, c in roles.title_roles(F.col("title")).items())).collect()} == cases


def test_scripts_images(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).head().x
    foreign = {"plain text": False, "naïve": True, "×÷": False, "Ω": False, "Ωω": True, "日本": True, "한국": True, "привет": True, "ไทย": True, "": False}
    assert {t: value(cleaning.may_need_translation(F.lit(t))) for t in foreign} == foreign
    assert value(cleaning.may_need_translation(F.lit("plain"), F.array(F.lit("Non-English"))))
    pick = lambda *urls: value(cleaning.image_reference(*(F.lit(u) for u in urls)))
    assert pick(None, " ", "JavaScript:x", "data:,", "file:/a", "blob:b", " ftp://x ") == "ftp://x"
    assert pick("x" * 2049, "x" * 2048) == "x" * 2048 and pick("data:") == ""


def test_hysteresis_and_budget(spark):
    runs = spark.createDataFrame([(i, v) for i, v in enumerate([3, 9, 6, 4, 6, 9])], "run int, n int")
    assert [r.paused for r in guards.hysteresis(runs, "run", "n", 8, 5).orderBy("run").collect()] == [False, True, True, False, False, True]
    assert [r.budget for r in guards.adaptive_budget(runs, "run", F.col("n") > 4, 10, 5, 22).orderBy("run").collect()] == [10, 10, 15, 20, 20, 22]
    assert guards.hysteresis(runs.limit(0), "run", "n", 8, 5).count() == 0


def test_uploads_plain_and_compressed(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'{"snapshots":[{"record":{"k":1}},{"k":2,"data":{"k":7}}]}')
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(b'[{"snapshot":{"bot":{"k":3}}}]'))
    (tmp_path / "c.bin").write_bytes(b"\x1f\x8bbroken")
    (tmp_path / "d.json").write_bytes(b'{"id":"x","k":4}')
    (tmp_path / "e.json").write_bytes(b'{"k":5}')
    (tmp_path / "f.json").write_bytes(b'{"snapshots":[{"k":8}],"records":{"a":{"savedCopy":{"k":6}}},"bots":"no list"}')
    rows = uploads.contained(uploads.read_uploads(spark, str(tmp_path)))
    assert sorted(r.k for r in rows.select(F.try_variant_get("payload", "$.k", "int").alias("k")).collect()) == [1, 2, 3, 4, 6]


def test_outcomes_and_export_pages(spark):
    runs = spark.createDataFrame([(1, 5, 0), (2, 6, 1)], "at int, pages int, errors int")
    outcomes = spark.createDataFrame([(1, 50, True), (2, None, False)], "at int, pages int, partial boolean")
    got = audit.with_outcome(runs, outcomes, "at", ("pages", "partial")).orderBy("at").collect()
    assert [(r.pages, r.errors, r.partial) for r in got] == [(5, 0, None), (6, 1, False)]
    late = outcomes.unionByName(spark.createDataFrame([(9, 1, True)], outcomes.schema))
    assert [r.partial for r in audit.with_outcome(runs, late, "at", ("pages", "partial")).collect()] == [None, None]
    rows = spark.createDataFrame([(i, i % 3) for i in range(7)], "id int, n int")
    assert [(r.page, r.id) for r in audit.export_pages(rows, "id", "n", 3).orderBy("page", F.desc("n"), "id").collect()] == [(0, 2), (0, 5), (0, 1), (1, 4), (1, 0), (1, 3), (2, 6)]
    for bad in [(3, 1), (8, -1), (9, None), (None, 1)]:
        with pytest.raises(Exception, match="(?i)key|value"):
            audit.export_pages(rows.unionByName(spark.createDataFrame([bad], rows.schema)), "id", "n", 3).collect()
