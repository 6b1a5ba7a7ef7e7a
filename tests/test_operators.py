"""Operators on small inputs with results worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlake.functions import leaves, text, values
from recordlake.operators import audit, browse, conversations, names, rules, scans, tags, temporal


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def events(spark, *items):
    return spark.createDataFrame([(1, i, i, *x) for i, x in enumerate(items)], "entity_id bigint, pos bigint, at bigint, status string, source string")


def test_two_rules_of_restoration_differ(spark):
    e = events(spark, ("deleted", "api"), ("public", "listing"), ("public", "api"))
    assert temporal.restorations(e, verified=True).count() == 0
    assert rows(temporal.activity(e), "type", "pos") == [("deleted", 0), ("new", 1), ("restore-candidate", 1), ("restored", 2)]


def test_a_first_public_event_that_is_a_candidate_too_is_public(spark):
    both = [("new", 4), ("restore-candidate", 4)]
    own = spark.createDataFrame([(i, 4, at, kind) for i, pair in ((1, both), (2, both[::-1])) for kind, at in pair], "entity_id bigint, pos bigint, at bigint, type string").coalesce(1)
    assert rows(temporal.status_as_of(own, F.lit(5))) == [(1, "public"), (2, "public")]


def test_candidates_only_stay_when_newest(spark):
    e = events(spark, ("deleted", "api"), ("public", "listing"), ("public", "api"), ("deleted", "api"), ("public", "listing"), ("public", "listing"))
    assert rows(temporal.activity_dedup(temporal.activity(e)).where("type = 'restore-candidate'"), "pos") == [(5,)]


def test_changes_ignore_nulls_and_baseline(spark):
    obs = spark.createDataFrame([(1, 1, 1, "a", 5), (1, 2, 2, "a", None), (1, 3, 3, "a", 5), (1, 4, 4, "a", 6), (1, 5, 5, "b", 1)], "entity_id bigint, pos bigint, at bigint, path string, k bigint")
    change = temporal.changes(obs)
    assert rows(change, "path", "pos", "from", "to") == [("a", 4, 5, 6)]
    known = temporal.last_known(obs)
    assert rows(known, "path", "k") == [("a", 6), ("b", 1)]
    assert rows(temporal.version_as_of(known, change, F.lit(3)), "path", "k") == [("a", 5), ("b", 1)]


def test_equal_times_are_undone_by_the_last(spark):
    known = spark.createDataFrame([(1, "a", 9)], "entity_id bigint, path string, k bigint")
    change = spark.createDataFrame([(1, "a", 1, 7, 3, 4), (1, "a", 2, 7, 4, 9)], "entity_id bigint, path string, pos bigint, at bigint, from bigint, to bigint")
    assert rows(temporal.version_as_of(known, change, F.lit(5)), "k") == [(4,)]


def test_deletion_needs_two_days_since_success(spark):
    checks = spark.createDataFrame([(1, 1, 1, "deleted", 1), (1, 2, 2, "deleted", 1), (2, 3, 3, "deleted", 1), (2, 4, 4, "deleted", 2), (3, 5, 5, "deleted", 1), (3, 6, 6, "public", 2), (3, 7, 7, "deleted", 3)], "entity_id bigint, pos bigint, at bigint, status string, day int")
    assert rows(temporal.deletion_confirmed(checks)) == [(2, 2)]


def test_cooldown_counts_from_the_last_counted(spark):
    e = spark.sql("SELECT 1L AS entity_id, CAST(m AS BIGINT) AS pos, timestamp_seconds(m * 60) AS at FROM VALUES (0), (20), (29), (35), (50), (66) AS t(m)")
    assert rows(temporal.cooldown(e), "pos") == [(0,), (35,), (66,)]


def test_tags(spark):
    labels = spark.createDataFrame([(1, 1, 1, "Romance"), (1, 1, 2, " romance "), (1, 1, 3, "Fantasy"), (2, 1, 1, "FANTASY"), (2, 1, 2, "romance"), (3, 2, None, None), (4, 2, 1, " ")], "entity_id bigint, owner_id bigint, pos int, label string")
    own = tags.entity_tags(labels)
    assert rows(tags.pairs(own)) == [("fantasy", "romance", 2)]
    assert rows(tags.coverage(labels, own)) == [(4, 2, 2, 4, 2, 0)]
    assert rows(tags.frequency(own)) == [("fantasy", 2, 1), ("romance", 2, 1)]


def test_repeated_titles_filter_after_limit(spark):
    titles = spark.createDataFrame([(i, t) for i, t in enumerate(["same", "same", "once", "abc", "abc"])], "id int, title string")
    assert rows(names.repeated_titles(titles, 4, 1)) == [("same", 2)]
    assert rows(names.category_counts(titles, "title", {"s": "s", "none": "zz"})) == [("none", 0), ("s", 2)]


def test_venn_repair_and_existence(spark):
    ids = lambda x: spark.createDataFrame([(c,) for c in x], "id string")
    assert rows(audit.venn({"a": ids("abcd"), "b": ids("abeg"), "c": ids("acef")})) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1)]
    assert rows(audit.repair_plan(ids("ab"), ids("bc"))) == [("a", "report"), ("c", "add")]
    checked = spark.createDataFrame([("a", True), ("b", False), ("b", False)], "id string, found boolean")
    assert rows(audit.existence(ids("abz"), checked)) == [("exists", 1), ("missing", 1), ("unchecked", 1)]


def test_growth_keeps_or_clamps_losses(spark):
    runs = spark.createDataFrame([(0, 100), (86400, 150), (2 * 86400, 120)], "run_at bigint, total bigint")
    assert rows(audit.growth(runs, (24, 720))) == [(24, -30, 24.0, True), (720, 20, 48.0, False)]
    assert rows(audit.growth(runs, (24,), clamp=True), "net") == [(0,)]
    assert rows(audit.added_since_previous(runs), "added") == [(0,), (50,), (None,)]


def test_quotas_take_turns_and_fill(spark):
    own = spark.createDataFrame([(i, "new" if i < 50 else "retry" if i < 53 else "old", i) for i in range(60)], "id int, cohort string, priority int")
    got = [r.cohort for r in audit.quota_selection(own, {"new": 0.45, "retry": 0.45, "old": 0.1}, 20).collect()]
    assert got.count("old") == 2 and got.count("retry") == 3 and len(got) == 20


def test_exclusion_wins(spark):
    own = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, None)], "id int, tags array<string>")
    match = lambda *a: rows(own.where(browse.tag_match(F.col("tags"), *a)), "id")
    assert match(("a", "b"), (), True) == [(1,)]
    assert match(("a", "b"), (), False) == [(1,), (2,)]
    assert match(("a",), ("b",), False) == [(2,)]
    assert match((), ("b",), True) == [(2,), (3,)]


def test_rules_and_decisions(spark):
    titles = spark.createDataFrame([(1, "A Good Dog!"), (2, "good dogs"), (3, "no good dog"), (4, None)], "id bigint, title string")
    table = spark.createDataFrame([("r", 1, "good"), ("r", 2, "dog"), ("r", None, "no good")], "rule_id string, grp int, phrase string")
    assert rows(rules.rule_signals(titles, table)) == [(1, "r")]
    signals = spark.createDataFrame([(1, "r", "f"), (2, "r", "f"), (3, "r", "g")], "id bigint, rule_id string, fingerprint string")
    decisions = spark.createDataFrame([(1, "r", "f", "reject", 1), (1, "r", "f", "approve", 2), (2, "r", "f", "reject", 1), (3, "r", "f", "reject", 1)], "id bigint, rule_id string, fingerprint string, decision string, pos int")
    assert rows(rules.reviewed(signals, decisions)) == [(1, "r", "reviewed"), (3, "r", "rule-candidate")]


def test_conversations(spark):
    m = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "user", "hi"), (1, 2, "assistant", "hi"), (2, 0, "user", None), (2, 1, "user", None)], "conv_id bigint, turn bigint, role string, text string")
    assert rows(conversations.repeated(m), "conv_id", "turn", "regen") == [(1, 0, False), (1, 1, True), (1, 2, False), (2, 0, False), (2, 1, True)]
    long = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    want = sorted({*range(25), *range(275, 300), *(i for k in range(90) if (i := int(25 + (k + 1) * 250 / 91)) < 275)})
    assert [r[0] for r in rows(conversations.sample(long, 140, 25, 90_000), "turn")] and sorted(r.turn for r in conversations.sample(long, 140, 25, 90_000).collect()) == want
    merged = spark.createDataFrame([(1, "x"), (1, " x"), (1, None), (2, "x"), (2, "y"), (3, "")], "key int, value string")
    assert rows(conversations.consensus(merged, "key", "value")) == [(1, "x"), (2, None), (3, None)]


def test_scans(spark):
    prior = spark.createDataFrame([(1, "a"), (2, "b")], "id int, shard string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, shard string")
    once = scans.upsert(prior, new, "id")
    assert rows(once) == rows(scans.upsert(once, new, "id")) == [(1, "a"), (2, "c"), (3, "d")]
    docs = spark.createDataFrame([(1, '{"a": {"b": 1, "c": [1, 2]}, "d": "x", "e": {}}')], "id int, j string")
    assert rows(leaves.flatten(docs, "id", "j"), "path", "value") == [("a.b", "1"), ("a.c", "[1,2]"), ("d", "x")]


def test_text_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c).head()[0]
    x = F.col("x")
    assert one(text.norm_label(x), "  Ａ   b\tC ") == "ａ b c"
    assert one(text.canonical(x), "It's -- A_Test!") == "it s a test"
    assert one(text.preset_norm(x), "camelCase Words") == "camel case words"
    assert one(text.fnv1a32(x), "romance") == 1939300242 and one(text.fnv1a32(x), "") == 2166136261
    assert one(text.tokens(x), "Don’t go to the the o-k") == ["don't", "the", "o-k"]
    assert one(text.truncate(x, 5), "abcdefg") == "abcd…"
    assert one(text.json_digest(x), '{"b":1, "a":2}') == one(text.json_digest(x), '{"a":2,"b":1}')
    folded = text.normalize_dictionary(spark.createDataFrame([("Straße",), ("STRASSE",), ("ﬁ",), (None,)], "x string"), "x", "y")
    assert rows(folded, "y") == [("fi",), ("strasse",), ("strasse",), (None,)]


def test_values(spark):
    d = spark.sql("SELECT * FROM VALUES ('1700000000'), ('1700000000123'), ('2023-11-14T22:13:20Z'), ('12'), ('nope'), (NULL) AS t(x)")
    now = F.expr("TIMESTAMP '2024-01-01 00:00:00'")
    assert [r[0] for r in d.select(values.any_time(F.col("x"), now)).collect()] == [1700000000000, 1700000000123, 1700000000000, None, None, None]
    u = spark.createDataFrame([("https://a.b/c",), ("http://a.b",), ("https://u@a.b",), (None,)], "x string")
    assert [r[0] for r in u.select(values.safe_https(F.col("x"))).collect()] == [True, False, False, False]
    m = spark.createDataFrame([(" ",), ("0",), (None,)], "x string")
    assert [r[0] for r in m.select(values.meaningful(F.col("x"))).collect()] == [False, True, False]


def test_entity_of_two_owners_counts_once_by_its_first_listing(spark):
    rows = [(1, 7, 0, "Romance"), (1, 7, 1, "ｆａｎｔａｓｙ"), (1, 9, 0, "Drama"), (2, 9, 0, "romance"), (2, 9, 1, " Fantasy"), (2, 9, 2, "fantasy "), (3, 9, 0, None), (4, 9, 0, "  ")]
    labels = spark.createDataFrame(rows, "entity_id int, owner_id int, pos int, label string")
    own = tags.entity_tags(labels)
    assert sorted(map(tuple, own.collect())) == [(1, 7, "fantasy", "ｆａｎｔａｓｙ"), (1, 7, "romance", "Romance"), (2, 9, "fantasy", " Fantasy"), (2, 9, "romance", "romance")]
    assert tuple(tags.coverage(labels, own).head()) == (4, 2, 2, 4, 2, 0)


def test_ordered_distinct_keeps_rows_without_a_key(spark):
    from recordlake.operators import scans

    rows = spark.createDataFrame([("a", 3), (None, 4), ("a", 1), (None, 2)], "k string, pos int")
    assert sorted(map(tuple, scans.ordered_distinct(rows, "k", ["pos"]).collect()), key=str) == [("a", 1), (None, 2), (None, 4)]


def test_ranking_and_scan_without_one_order_of_all(spark):
    from recordlake.operators import audit, scans

    rows = spark.createDataFrame([("x", 5, 1), ("x", 9, 2), ("x", 5, 0), ("x", None, 3), (None, 1, 4)], "l string, v int, id int")
    assert {r.id: r["rank"] for r in scans.ranking(rows, "l", "v", "id").collect()} == {2: 1, 0: 2, 1: 3, 3: 4, 4: 1}
    for fresh, want in (({0, 1, 6}, 4), ({3}, 2), (set(), 2), ({0, 2, 4, 6, 8}, 9)):
        scan = spark.range(100).selectExpr("id as nth", f"floor(id / 10) in ({','.join(map(str, fresh)) or -1}) as is_new")
        assert audit.scan_until_known(scan, 10, 3).agg({"page": "max"}).head()[0] == want
