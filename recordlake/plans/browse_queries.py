"""Queries of browse, search, rules, conversations, scans and row-level cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlake.functions import text as tx
from recordlake.functions import leaves, values
from recordlake.operators import browse, conversations, presets, rules, scans
from recordlake.operators.browse import FilterSpec

from . import views
from .registry import Tables, query
from .tag_queries import TITLES, _tags, _titles


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' AND n_chars >= 1500 AND source <> 'src0' AND contains(lower(concat_ws(' ', source, text)), 'the ')")
def browse_filtered(t: Tables) -> DataFrame:
    spec = FilterSpec(query="the ", query_columns=("source", "text"), equal=(("lang", "en"),), not_equal=(("source", "src0"),), at_least=(("n_chars", 1500),))
    return t.documents.where(spec.predicate()).select("doc_id", "source")


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 100 OFFSET 200")
def browse_page(t: Tables) -> DataFrame:
    own = t.documents.where(FilterSpec(equal=(("lang", "en"),)).predicate()).select("doc_id", "n_chars")
    return browse.page(own, [F.desc("n_chars"), F.col("doc_id")], 3, 100)


@query("SELECT event_id FROM events WHERE event_id < 9000 ORDER BY event_id DESC LIMIT 250")
def keyset_page(t: Tables) -> DataFrame:
    return scans.keyset_page(t.events, "event_id", 9000, 250).select("event_id")


@query(f"WITH {views.LABELS}, s AS (SELECT entity_id, list(tag) AS tags FROM tags GROUP BY 1) SELECT entity_id, len(list_filter(tags, lambda x: x IN ('brand#7', 'brand#3'))) = 2 AS all_match, list_has_any(tags, ['brand#7', 'brand#3']) AS any_match FROM s WHERE list_has_any(tags, ['brand#7', 'brand#3']) AND NOT list_has_any(tags, ['brand#1', 'brand #2'])")
def tag_any_all_none(t: Tables) -> DataFrame:
    sets = _tags(t).groupBy("entity_id").agg(F.collect_list("tag").alias("tags"))
    both = ("brand#7", "brand#3")
    kept = sets.where(browse.tag_match(F.col("tags"), both, ("brand#1", "brand #2"), match_all=False))
    return kept.select("entity_id", browse.tag_match(F.col("tags"), both, (), True).alias("all_match"), browse.tag_match(F.col("tags"), both, (), False).alias("any_match"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'the')")
def text_search_and(t: Tables) -> DataFrame:
    return t.documents.where(browse.search(t.documents, "text", tokens=("tion", "the"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'apache license')")
def text_search_phrase(t: Tables) -> DataFrame:
    return t.documents.where(browse.search(t.documents, "text", phrase="apache license")).select("doc_id")


@query("SELECT token, count(*) AS n FROM (SELECT DISTINCT doc_id, replace(unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_''’-]{2,}')), '’', '''') AS token FROM documents) GROUP BY 1 ORDER BY n DESC, token LIMIT 200")
def tokens_top(t: Tables) -> DataFrame:
    own = t.documents.select(F.explode(tx.tokens(F.col("text"))).alias("token"))
    return own.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(200)


@query("SELECT doc_id, CASE WHEN at_ > 0 THEN substr(text, greatest(1, at_ - 77), 220) ELSE substr(text, 1, 220) END AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'license') AS at_ FROM documents)")
def snippet(t: Tables) -> DataFrame:
    return browse.with_snippet(t.documents, "text", "license").select("doc_id", "snippet")


RULES = (("r1", 1, "licensed"), ("r1", 1, "released"), ("r1", 2, "license"), ("r1", None, "gnu"), ("r2", 1, "public license"), ("r3", 1, "the"), ("r3", None, "of"))
RULE_ROWS = ", ".join(f"('{r}', {g if g else 'NULL'}, '{p}')" for r, g, p in RULES)
SIGNALS = TITLES + f", rules(rule_id, grp, phrase) AS (VALUES {RULE_ROWS}), norm AS (SELECT doc_id AS id, ' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t, title FROM titles), hit AS (SELECT id, title, rule_id, grp FROM norm, rules WHERE contains(t, ' ' || phrase || ' ')), need AS (SELECT rule_id, count(DISTINCT grp) AS needed FROM rules GROUP BY 1), sig AS (SELECT id, any_value(title) AS title, h.rule_id FROM hit h JOIN need USING (rule_id) GROUP BY id, h.rule_id, needed HAVING count(DISTINCT grp) = needed AND count(*) FILTER (grp IS NULL) = 0) "


def _rule_table(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(RULES), "rule_id string, grp int, phrase string")


def _id_titles(t: Tables) -> DataFrame:
    return _titles(t).withColumnRenamed("doc_id", "id")


@query(SIGNALS + "SELECT id, rule_id FROM sig")
def rule_signals(t: Tables) -> DataFrame:
    return rules.rule_signals(_id_titles(t), _rule_table(t))


@query(SIGNALS + "SELECT id, rule_id, CASE WHEN id % 10 = 0 THEN 'reviewed' ELSE 'rule-candidate' END AS kind FROM sig WHERE id % 10 <> 1")
def rule_signals_reviewed(t: Tables) -> DataFrame:
    titles = _id_titles(t)
    signals = rules.rule_signals(titles, _rule_table(t)).join(titles, "id").select("id", "rule_id", rules.fingerprint(F.col("title")).alias("fingerprint"))
    digit = F.col("id") % 10
    decisions = signals.where(digit < 3).select("id", "rule_id", F.when(digit == 2, "stale").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(digit == 0, "approve").otherwise("reject").alias("decision"), F.lit(1).alias("pos"))
    return rules.reviewed(signals, decisions)


PHRASES = ("license", "apache license", "the", "cc by", "never there")


@query(TITLES + f", p(phrase) AS (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in PHRASES)}) SELECT phrase AS phrase_id, count(*) AS n FROM titles, p WHERE contains(' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || phrase || ' ') GROUP BY 1")
def phrase_mentions(t: Tables) -> DataFrame:
    phrases = t.spark.createDataFrame([(p, p) for p in PHRASES], "phrase_id string, phrase string")
    return rules.mentions(_id_titles(t), phrases).groupBy("phrase_id").agg(F.count(F.lit(1)).alias("n"))


@query(TITLES + "SELECT suffix, n FROM (SELECT suffix, count(*) AS n FROM (SELECT DISTINCT doc_id, lower(regexp_extract(title, '(?i)licensed[ :,-]+([a-z]+(?: [a-z]+){0,3})', 1)) AS suffix FROM titles) WHERE length(suffix) BETWEEN 5 AND 48 AND suffix NOT IN ('under') GROUP BY 1) WHERE n >= 1 ORDER BY n DESC, suffix LIMIT 200")
def suffix_candidates(t: Tables) -> DataFrame:
    return rules.suffix_candidates(_id_titles(t), "licensed", 1, ("under",), 200)


# A franchise of rings: ring and rod are its names, plates a group, gizmo and widget characters, of which widget needs a strong name beside it.
PRESET = (
    ("franchise", "f", "f", None, "Ring", "strong"),
    ("franchise", "f", "f", None, "red", "contextual"),
    ("group", "plates", "f", None, "cold plate", "strong"),
    ("group", "plates", "f", None, "hot plate", "contextual"),
    ("character", "gizmo", "f", "female", "gizmo", "strong"),
    ("character", "widget", "f", "male", "widget", "contextual"),
    ("character", "gear", "f", "unknown", "blue gear", "strong"),
    ("character", "other", "g", "male", "bolt", "strong"),
    ("variant", "v", None, None, "gender bent", "strong"),
    ("theme", "t", None, None, "large anvil", "strong"),
)
PRESET_SQL = """t AS (SELECT p_partkey AS id, ' ' || p_name || CASE WHEN p_size % 3 = 0 THEN ' ring' WHEN p_size % 3 = 1 THEN ' gizmo' ELSE '' END || CASE WHEN p_size > 40 THEN ' gender bent' ELSE '' END || ' ' AS x FROM part),
h AS (SELECT id, contains(x, ' ring ') AS strong, contains(x, ' cold plate ') AS grp, contains(x, ' gizmo ') AS gizmo, contains(x, ' ring ') AND contains(x, ' widget ') AS widget, contains(x, ' blue gear ') AS gear, contains(x, ' gender bent ') AS variant FROM t),
e AS (SELECT *, gizmo::INT + widget::INT + gear::INT AS n, array_to_string(list_filter([CASE WHEN gear THEN 'gear' END, CASE WHEN gizmo THEN 'gizmo' END, CASE WHEN widget THEN 'widget' END], lambda y: y IS NOT NULL), ',') AS characters FROM h WHERE strong OR grp OR gizmo OR gear)"""


def _preset(t: Tables) -> DataFrame:
    more = F.when(F.col("p_size") % 3 == 0, "Ring").when(F.col("p_size") % 3 == 1, "— Gizmó").otherwise("")
    title = F.concat(F.initcap("p_name"), more, F.when(F.col("p_size") > 40, " (Gender-Bent)").otherwise(""))
    titles = t.part.select(F.col("p_partkey").alias("id"), title.alias("title"))
    return presets.matches(titles, t.spark.createDataFrame(list(PRESET), presets.CATALOGUE), "f")


@query(f"""WITH {PRESET_SQL} SELECT id, CASE WHEN gizmo THEN 'kept' WHEN variant THEN 'variant' WHEN n <> 1 OR NOT widget THEN 'not one known character' ELSE 'one character' END AS reason,
characters, CASE WHEN NOT variant AND n = 1 THEN CASE WHEN gizmo THEN 'female' WHEN widget THEN 'male' ELSE 'unknown' END ELSE 'unknown' END AS gender, NOT gizmo AND NOT variant AND n = 1 AND widget AS hide FROM e""")
def preset_decision(t: Tables) -> DataFrame:
    """Titles that the franchise's names, groups or characters stand in, for a reader who keeps female characters."""
    return presets.decide(_preset(t), "keep-female").where("matched").select("id", "reason", "characters", "gender", "hide")


@query(f"WITH {PRESET_SQL} SELECT CASE WHEN widget THEN 'kept' ELSE 'any name' END AS reason, count(*) AS n FROM e GROUP BY 1")
def preset_reasons(t: Tables) -> DataFrame:
    """With everything hidden but one kept character."""
    return presets.decide(_preset(t), "all", keep_characters=("widget",)).where("matched").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, sha256('{\"k\":' || json_extract_string(props, '$.k') || '}') AS digest, count(*) AS n FROM events GROUP BY 1, 2")
def canonical_json_digest(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", tx.json_digest(F.col("props")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_by_hash(t: Tables) -> DataFrame:
    return scans.dedupe_by_hash(t.documents, "text", "doc_id")


@query("SELECT user_id, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY 1")
def journal_replay_latest(t: Tables) -> DataFrame:
    return scans.journal_latest(t.events, "user_id", "props", ["ts", "event_id"])


@query("SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents")
def ranking_positions(t: Tables) -> DataFrame:
    return scans.ranking(t.documents.select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id").drop("n_chars")


@query("WITH a AS (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents), b AS (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents WHERE lang <> 'es') SELECT a.source, a.doc_id, a.rank AS old, b.rank AS new FROM a LEFT JOIN b ON a.source = b.source AND a.doc_id = b.doc_id WHERE b.rank IS NULL OR a.rank <> b.rank")
def ranking_changed(t: Tables) -> DataFrame:
    own = t.documents.select("source", "doc_id", "n_chars", "lang")
    rank = lambda rows: scans.ranking(rows, "source", "n_chars", "doc_id").select("source", "doc_id", "rank")
    return scans.ranking_changes(rank(own), rank(own.where("lang <> 'es'")), ["source", "doc_id"])


@query(r"SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, count(*) FILTER (role = 'system') AS systems, count(*) FILTER (regexp_matches(text, '^\s*(\(\(|\[ooc|ooc:)')) AS ooc, arg_min(role, turn) AS first_role FROM conversations GROUP BY 1")
def conversation_summary(t: Tables) -> DataFrame:
    return conversations.summary(t.conversations)


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), c AS (SELECT * FROM x WHERE n <= 5 OR i < 2 OR i >= n - 2 OR (i < n - 2 AND floor(2 + greatest(1, n - 4) / 2.0) = i)), s AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT conv_id, turn, role FROM s WHERE before < 900")
def conversation_sample(t: Tables) -> DataFrame:
    return conversations.sample(t.conversations, 5, 2, 900).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, coalesce(role = lag(role) OVER w AND text IS NOT DISTINCT FROM lag(text) OVER w, false) AS regen FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def regen_flags(t: Tables) -> DataFrame:
    return conversations.repeated(t.conversations).select("conv_id", "turn", "regen")


@query("SELECT n_chars, CASE WHEN count(DISTINCT nullif(trim(lang), '')) = 1 THEN min(nullif(trim(lang), '')) END AS lang FROM documents GROUP BY 1")
def consensus_merge(t: Tables) -> DataFrame:
    return conversations.consensus(t.documents, "n_chars", "lang")


@query("SELECT doc_id, concat_ws(',', CASE WHEN quality IS NOT NULL THEN 'quality' END, CASE WHEN n_chars > 1000 THEN 'text' END) AS available, concat_ws(',', CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN n_chars <= 1000 THEN 'text' END) AS missing FROM documents LEFT JOIN labels USING (doc_id)")
def readiness(t: Tables) -> DataFrame:
    have, lack = conversations.readiness({"quality": F.col("quality").isNotNull(), "text": F.col("n_chars") > 1000})
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", have.alias("available"), lack.alias("missing"))


@query("SELECT doc_id FROM documents WHERE n_chars < 400 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_plan(t: Tables) -> DataFrame:
    return scans.delete_plan(t.documents, "doc_id", t.labels.select("doc_id"), F.col("n_chars") < 400)


@query("SELECT doc_id, CASE WHEN lang IN ('de', 'es') THEN 'new' ELSE 'old' END AS shard FROM documents WHERE lang <> 'en'")
def locator_upsert(t: Tables) -> DataFrame:
    shard = lambda langs, name: t.documents.where(F.col("lang").isin(*langs)).select("doc_id", F.lit(name).alias("shard"))
    return scans.upsert(shard(("fr", "de"), "old"), shard(("de", "es"), "new"), "doc_id")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS surfaces FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1")
def surface_accumulate(t: Tables) -> DataFrame:
    return scans.accumulate_surfaces(t.events, "user_id", "event_type", "event_id")


@query("SELECT event_type AS tag, count(DISTINCT user_id) AS entities FROM events GROUP BY 1")
def membership_from_changes(t: Tables) -> DataFrame:
    changes = t.events.select("user_id", F.to_json(F.array("event_type")).alias("to"), F.lit("[broken").alias("from"))
    member = changes.select("user_id", F.explode(F.array("from", "to")).alias("v")).select("user_id", F.explode(F.from_json("v", "array<string>")).alias("tag"))
    return member.distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("entities"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def hidden_filter(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.where("quality = 0").select("doc_id"), "doc_id", "left_anti")


@query("SELECT user_id, min(event_id) AS pos, max(CASE WHEN event_type = 'error' THEN event_id END) AS last_checked FROM events GROUP BY 1 ORDER BY last_checked NULLS FIRST, pos LIMIT 50")
def queue_rotation(t: Tables) -> DataFrame:
    own = t.events.groupBy("user_id").agg(F.min("event_id").alias("pos"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("last_checked"))
    return own.orderBy(F.asc_nulls_first("last_checked"), "pos").limit(50)


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def variant_flatten(t: Tables) -> DataFrame:
    return leaves.flatten(t.events, "event_id", "props")


@query("SELECT o_orderkey, repeat('d.', 20) || p AS path, v AS value FROM (SELECT o_orderkey, unnest([{'p': 'status', 'v': o_orderstatus}, {'p': 'n.total', 'v': CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)}, {'p': 'list', 'v': '[{\"a\":1,\"b\":\"é\"},null]'}, {'p': 'none', 'v': NULL}], recursive := true) FROM orders)")
def nested_leaves(t: Tables) -> DataFrame:
    """Objects 21 levels deep, by the table function in SQL; lists stay whole, empty objects have no leaves."""
    leaves.register(t.spark)
    inner = F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('","n":{"total":'), F.floor("o_totalprice").cast("string"), F.lit(',"e":{}},"list":[{"b":"é","a":1},null],"none":null}'))
    made = t.orders.select("o_orderkey", F.concat(F.repeat(F.lit('{"d":'), F.lit(20)), inner, F.repeat(F.lit("}"), F.lit(20))).alias("text"))
    return t.spark.sql("SELECT o_orderkey, l.path, l.value FROM {made}, LATERAL rl_leaves(text) l", made=made)


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS status FROM orders GROUP BY 1")
def consensus_function(t: Tables) -> DataFrame:
    """The aggregate function in SQL."""
    leaves.register(t.spark)
    return t.spark.sql("SELECT o_custkey, rl_consensus(o_orderstatus) AS status FROM {orders} GROUP BY o_custkey", orders=t.orders)


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_matches(url, '^https://[^/?#@]+([/?#].*)?$') AND length(url) <= 2048 AS safe FROM pages")
def url_parts(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select("page_id", F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, r"\?([^#]*)", 1).alias("query"), values.safe_https(url).alias("safe"))


@query("WITH m AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents), u AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN h ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) END AS id FROM m) SELECT doc_id, regexp_matches(id, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') AS valid, substr(replace(id, '-', ''), 1, 2) AS prefix FROM u")
def id_validation(t: Tables) -> DataFrame:
    h = F.md5(F.col("doc_id").cast("string"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    own = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, h).otherwise(F.concat_ws("-", *parts)).alias("id"))
    return own.select("doc_id", values.is_uuid(F.col("id")).alias("valid"), tx.id_prefix(F.col("id")).alias("prefix"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000 WHEN 1 THEN epoch_us(ts) // 1000 END AS ms FROM events")
def timestamp_coerce(t: Tables) -> DataFrame:
    at, kind = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    raw = F.when(kind == 0, F.unix_seconds(at).cast("string")).when(kind == 1, F.unix_millis(at).cast("string")).otherwise("not a time")
    return t.events.select("event_id", values.any_time(raw, F.expr("TIMESTAMP '2024-02-01 00:00:00'")).alias("ms"))


@query("SELECT doc_id, min(turn) AS parent_turn FROM documents JOIN conversations ON conv_id = doc_id GROUP BY 1")
def locator_join(t: Tables) -> DataFrame:
    own = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.min("turn").alias("parent_turn"))
    return t.documents.select("doc_id").join(own, "doc_id")


@query("SELECT doc_id, 500 > (doc_id % 7) * 100 + n_chars % 100 AS more FROM documents")
def has_more_pages(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scans.has_more(F.lit(500), F.col("doc_id") % 7 + 1, F.lit(100), F.col("n_chars") % 100).alias("more"))


@query("SELECT doc_id, CASE WHEN length(text) > 320 THEN substr(text, 1, 319) || '…' ELSE text END AS short FROM documents")
def truncated_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.truncate(F.col("text"), 320).alias("short"))


@query("WITH u AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, event_type FROM events) SELECT user_id, event_id FROM u WHERE b IS NULL OR b <> event_type")
def tail_duplicates(t: Tables) -> DataFrame:
    from recordlake.operators.temporal import drop_tail_duplicates

    own = t.events.withColumnsRenamed({"ts": "at", "event_id": "pos"})
    return drop_tail_duplicates(own, ("user_id",), ("event_type",)).select("user_id", F.col("pos").alias("event_id"))


@query("SELECT lang, CAST(row_number() OVER (ORDER BY count(*) DESC, lang) AS INTEGER) AS rank, count(*) AS n FROM documents GROUP BY 1")
def language_facets(t: Tables) -> DataFrame:
    counts = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("lang", F.row_number().over(Window.orderBy(F.desc("n"), "lang")).alias("rank"), "n")
