"""Queries of observation history, versions, imports, submissions and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlake.functions import cleaning
from recordlake.operators import audit, history, reviews, temporal

from . import views
from .registry import Tables, query
from .temporal_queries import ACTIVITY, W

# Documents of observations: what a source told of an entity on one day, a path per event type; small values are there but empty.
DOCS = f"""{views.OBS}, rows_ AS (SELECT entity_id, source, day AS d_at, 'fields.' || path AS path, CASE WHEN max(value) >= 20 THEN max(k) END AS value FROM obs GROUP BY ALL)"""
OBSERVE = f"""WITH {DOCS},
docs AS (SELECT *, lead(d_at) OVER (PARTITION BY entity_id, source ORDER BY d_at) AS next_at, min((d_at, source)) OVER (PARTITION BY entity_id) = (d_at, source) AS created FROM (SELECT DISTINCT entity_id, source, d_at FROM rows_)),
own AS (SELECT r.*, d.next_at, d.created,
  last_value(value IGNORE NULLS) OVER (PARTITION BY r.entity_id, path ORDER BY r.d_at, r.source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known,
  lead(r.d_at) OVER p AS path_at, lead(value) OVER p AS path_value
  FROM rows_ r JOIN docs d ON r.entity_id = d.entity_id AND r.source = d.source AND r.d_at = d.d_at WHERE path <> 'fields.error' WINDOW p AS (PARTITION BY r.entity_id, r.source, path ORDER BY r.d_at)),
ev AS (
  SELECT entity_id, source, d_at, path, 'value' AS kind, known AS "from", value AS "to" FROM own WHERE value IS NOT NULL AND NOT created AND known IS DISTINCT FROM value
  UNION ALL SELECT entity_id, source, next_at, path, CASE WHEN path_at = next_at THEN 'hidden-or-empty' ELSE 'hidden-or-missing' END, value, NULL FROM own
    WHERE value IS NOT NULL AND next_at IS NOT NULL AND ((path_at = next_at AND path_value IS NULL) OR (path_at IS DISTINCT FROM next_at AND path IN ('fields.view', 'fields.click'))))
"""


def observation_documents(t: Tables) -> DataFrame:
    own = views.observations(t).withColumn("path", F.concat(F.lit("fields."), "path"))
    return own.groupBy("entity_id", "source", F.col("day").alias("at"), "path").agg(F.when(F.max("value") >= 20, F.max("k")).alias("value"))


def _events(t: Tables) -> DataFrame:
    return history.observe(observation_documents(t), ("view", "click"), ("error",))


@query(OBSERVE + 'SELECT entity_id, source, CAST(d_at AS VARCHAR) AS "at", path, kind, "from", "to" FROM ev')
def observe_events(t: Tables) -> DataFrame:
    return _events(t).withColumn("at", F.col("at").cast("string"))


@query(OBSERVE + "SELECT path, kind, count(*) AS n, count(DISTINCT entity_id) AS entities FROM ev GROUP BY 1, 2")
def observe_kinds(t: Tables) -> DataFrame:
    return _events(t).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("entities"))


LABELS = """l AS (
  SELECT c_custkey AS entity_id, 0 AS rank, 0 AS pos, c_mktsegment AS label FROM customer
  UNION ALL SELECT o_custkey, 1, o_orderkey, lower(o_orderpriority) FROM orders
  UNION ALL SELECT o_custkey, 2, o_orderkey, ' ' || o_orderpriority || '  x ' FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_custkey, 3, o_orderkey, o_orderpriority FROM orders)"""


@query(f"WITH {LABELS} SELECT entity_id, lower(trim(regexp_replace(label, '\\s+', ' ', 'g'))) AS key, arg_min(trim(regexp_replace(label, '\\s+', ' ', 'g')), (rank, pos, label)) AS label FROM l GROUP BY 1, 2")
def ever_tags(t: Tables) -> DataFrame:
    made = lambda rank, pos, label, rows, who: rows.select(F.col(who).alias("entity_id"), F.lit(rank).alias("rank"), pos.cast("bigint").alias("pos"), label.alias("label"))
    priority, key = F.col("o_orderpriority"), F.col("o_orderkey")
    rows = made(0, F.lit(0), F.col("c_mktsegment"), t.customer, "c_custkey")
    rows = rows.unionByName(made(1, key, F.lower(priority), t.orders, "o_custkey"))
    rows = rows.unionByName(made(2, key, F.concat(F.lit(" "), priority, F.lit("  x ")), t.orders.where("o_orderstatus = 'F'"), "o_custkey"))
    return history.ever_labels(rows.unionByName(made(3, key, priority, t.orders, "o_custkey")))


# Metric transitions of the path `view`, as the path `fields.view`, beside the field changes of the days.
METRICS = """, metrics AS (SELECT entity_id, d_at, 'fields.view' AS path, before AS "from", value AS "to" FROM (SELECT *, lag(value) OVER (PARTITION BY entity_id ORDER BY d_at, source) AS before FROM rows_ WHERE path = 'fields.view' AND value IS NOT NULL) WHERE before IS NOT NULL AND before <> value),
both_ AS (SELECT entity_id, d_at, path, "from", "to" FROM ev WHERE kind = 'value' UNION ALL SELECT * FROM metrics)"""


@query(OBSERVE + METRICS + ' SELECT path, count(*) AS n FROM (SELECT * FROM both_ WHERE path <> \'fields.view\' UNION ALL SELECT DISTINCT * FROM both_ WHERE path = \'fields.view\') GROUP BY 1')
def change_union(t: Tables) -> DataFrame:
    fields = _events(t).where("kind = 'value'").select("entity_id", "at", "path", "from", "to")
    order = Window.partitionBy("entity_id").orderBy("at", "source")
    own = observation_documents(t).where("path = 'fields.view' and value is not null").withColumn("from", F.lag("value").over(order)).where("from is not null and from <> value")
    metrics = own.select("entity_id", "at", "path", "from", F.col("value").alias("to"))
    return history.merge_changes(fields, metrics, "fields.view").groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(W + "SELECT entity_id, path, epoch_us(ts) AS us, min(pos) AS pos FROM (SELECT * FROM changes WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' UNION ALL SELECT * FROM changes WHERE strftime(ts, '%Y-%m') = '2024-01') GROUP BY ALL")
def hot_and_history(t: Tables) -> DataFrame:
    own = temporal.changes(views.observations(t)).select("entity_id", "path", F.unix_micros("at").alias("us"), "pos")
    hot = own.where(F.col("us") >= F.unix_micros(F.expr("TIMESTAMP '2024-01-24 00:00:00'")))
    month = own.where(F.date_format(F.timestamp_micros("us"), "yyyy-MM") == "2024-01")
    return history.union_once([hot, month], ["entity_id", "path", "us"])


@query(f"WITH {views.OBS}, {ACTIVITY}, s AS (SELECT entity_id, arg_max(type, (ts, pos)) FILTER (type <> 'restore-candidate') AS state, max((ts, pos)) FILTER (type <> 'restore-candidate') AS state_at, max((ts, pos)) FILTER (type = 'restore-candidate') AS c FROM act GROUP BY 1) SELECT entity_id, epoch_us(c[1]) // 1000 AS candidate_ms FROM s WHERE state = 'deleted' AND c > state_at")
def restore_candidates(t: Tables) -> DataFrame:
    own = history.unresolved_candidates(temporal.activity(views.observations(t)))
    return own.select("entity_id", F.unix_millis("candidate_at").alias("candidate_ms"))


SNAPSHOTS = """snap AS (SELECT o_custkey AS entity_id, o_orderdate AS d_at, o_orderkey AS pos, o_orderstatus AS status, o_orderpriority AS priority, coalesce(e.n, 0) || ':' || left(sha256('[' || coalesce(e.j, '') || ']'), 12) AS entries
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS j FROM (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem) GROUP BY 1) e ON l_orderkey = o_orderkey)"""


def _snapshots(t: Tables) -> DataFrame:
    entries = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("entries"))
    own = t.orders.join(entries, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return own.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.coalesce("entries", F.array().cast("array<bigint>")).alias("entries"))


@query(f"""WITH {SNAPSHOTS}, b AS (SELECT *, row_number() OVER w AS nth, lag(status) OVER w AS s, lag(priority) OVER w AS p, lag(entries) OVER w AS e FROM snap WINDOW w AS (PARTITION BY entity_id ORDER BY d_at, pos))
SELECT entity_id, pos, 'status' AS field, s AS "from", status AS "to" FROM b WHERE nth > 1 AND s <> status
UNION ALL SELECT entity_id, pos, 'priority', p, priority FROM b WHERE nth > 1 AND p <> priority
UNION ALL SELECT entity_id, pos, 'entries', e, entries FROM b WHERE nth > 1 AND e <> entries""")
def snapshot_diff(t: Tables) -> DataFrame:
    return history.snapshot_changes(_snapshots(t), ["status", "priority"], ["entries"]).drop("at")


@query(f"""WITH {SNAPSHOTS}, c AS (SELECT *, last_value(CASE WHEN priority <> '1-URGENT' THEN priority END IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY d_at, pos ROWS UNBOUNDED PRECEDING) AS cover FROM snap),
d AS (SELECT *, sha256(CASE WHEN cover IS NULL THEN '{{' ELSE '{{"cover":"' || cover || '",' END || '"status":"' || status || '"}}') AS digest FROM c)
SELECT entity_id, pos, digest FROM (SELECT *, lag(digest) OVER (PARTITION BY entity_id ORDER BY d_at, pos) AS before FROM d) WHERE digest IS DISTINCT FROM before""")
def version_history(t: Tables) -> DataFrame:
    own = _snapshots(t).withColumn("cover", F.when(F.col("priority") != "1-URGENT", F.col("priority")))
    return history.versions(own, "cover", ["status"]).drop("at")


@query(f"WITH {views.OBS} SELECT DISTINCT entity_id FROM obs WHERE entity_id NOT IN (SELECT entity_id FROM obs WHERE day = DATE '2024-01-30') AND NOT EXISTS (SELECT 1 FROM obs WHERE day = DATE '2024-01-30' AND path = 'error' AND value > 1000000)")
def disappearance_complete(t: Tables) -> DataFrame:
    obs = views.observations(t)
    day = obs.where("day = '2024-01-30'")
    return history.disappeared(obs.select("entity_id").distinct(), day.select("entity_id"), day.where("path = 'error' and value > 1000000"))


@query(f"WITH {views.OBS} SELECT DISTINCT entity_id FROM obs WHERE entity_id NOT IN (SELECT entity_id FROM obs WHERE day = DATE '2024-01-30') AND NOT EXISTS (SELECT 1 FROM obs WHERE day = DATE '2024-01-30' AND path = 'error')")
def disappearance_failed(t: Tables) -> DataFrame:
    obs = views.observations(t)
    day = obs.where("day = '2024-01-30'")
    return history.disappeared(obs.select("entity_id").distinct(), day.select("entity_id"), day.where("path = 'error'"))


IMPORT = f"""WITH {DOCS}, known AS (SELECT entity_id, path, arg_max(value, (d_at, source)) AS value FROM rows_ WHERE source = 'api' AND value IS NOT NULL GROUP BY 1, 2),
late AS (SELECT entity_id, path, arg_max(value, (d_at, value)) AS incoming FROM rows_ WHERE source = 'listing' AND value IS NOT NULL GROUP BY 1, 2)"""


@query(IMPORT + " SELECT coalesce(k.entity_id, l.entity_id) AS entity_id, coalesce(k.path, l.path) AS path, coalesce(value, incoming) AS value, value IS NULL AS filled FROM known k FULL JOIN late l ON k.entity_id = l.entity_id AND k.path = l.path")
def late_import(t: Tables) -> DataFrame:
    docs = observation_documents(t)
    known = docs.where("source = 'api' and value is not null").groupBy("entity_id", "path").agg(F.max_by("value", F.struct("at", "source")).alias("value"))
    return history.import_snapshots(known, docs.where("source = 'listing'").select("entity_id", "at", "path", "value"))


@query(f"WITH {DOCS} SELECT entity_id, CAST(min(d_at) AS VARCHAR) AS first_seen, CAST(max(d_at) AS VARCHAR) AS last_seen FROM rows_ GROUP BY 1")
def import_span(t: Tables) -> DataFrame:
    docs = observation_documents(t)
    own = history.seen_span(docs.where("source = 'api'"), docs.where("source = 'listing'"))
    return own.select("entity_id", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"))


# Submissions are documents; records exist for those with labels; known hashes are those of good quality.
SUBMITTED = """s AS (SELECT d.doc_id AS id, n_chars < 200 AS bad, l.doc_id IS NOT NULL AS found, quality = 1 AND lang = 'en' AS dup,
  concat_ws(',', CASE WHEN source <> 'src1' THEN 'source' END, CASE WHEN lang <> 'en' AND toxic = 1 THEN 'tags' END) AS fields, coalesce(toxic = 1, false) AS gone
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT id, CASE WHEN bad THEN 'problem' WHEN NOT found THEN 'new' WHEN coalesce(dup, false) THEN 'exact_duplicate' WHEN fields <> '' THEN 'changed' ELSE 'known' END AS classification, fields, gone AS unavailable FROM s)"""


def _classified(t: Tables) -> DataFrame:
    own = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")
    problems = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "too_short")))
    incoming = F.array(F.concat(F.lit(" "), F.upper("lang")), F.col("lang"), F.lit("x"))
    existing = F.when(F.col("toxic") == 1, F.array(F.lit("X"), F.lit("en"))).otherwise(F.array(F.lit("x"), F.col("lang")))
    fields = reviews.differing({"source": (F.col("source"), F.lit("src1")), "tags": (F.to_json(reviews.label_set(incoming)), F.to_json(reviews.label_set(existing)))})
    kind = reviews.classify(problems, F.col("quality").isNotNull(), (F.col("quality") == 1) & (F.col("lang") == "en"), fields)
    gone = reviews.ever_unavailable(F.lit(None).cast("string"), F.lit("public"), F.array(F.when(F.col("toxic") == 1, " Deleted"), F.lit("public")), ("deleted", "missing"))
    return own.select(F.col("doc_id").alias("id"), kind.alias("classification"), F.array_join(fields, ",").alias("fields"), gone.alias("unavailable"))


@query(f"WITH {SUBMITTED} SELECT id, classification, CASE WHEN classification = 'changed' THEN fields ELSE '' END AS fields, unavailable FROM c")
def submission_classes(t: Tables) -> DataFrame:
    return _classified(t).withColumn("fields", F.when(F.col("classification") == "changed", F.col("fields")).otherwise(""))


@query(f"WITH {SUBMITTED} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (classification = '{k}') AS {k}" for k in reviews.CLASSES) + ", count(*) FILTER (unavailable) AS unavailable, count(*) FILTER (classification NOT IN ('problem', 'exact_duplicate')) AS safe FROM c")
def submission_breakdown(t: Tables) -> DataFrame:
    return reviews.breakdown(_classified(t))


@query(f"WITH {SUBMITTED} SELECT id FROM c WHERE unavailable")
def unavailable_history(t: Tables) -> DataFrame:
    return _classified(t).where("unavailable").select("id")


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS kind, left(arg_max(props, event_id), 5) AS note FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def annotations_valid(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), F.col("props").alias("note"), F.lit("http://no").alias("evidence"), F.col("event_id").alias("pos"))
    return reviews.valid_annotations(rows, ("click", "view"), 5).select("id", "kind", "note")


@query("SELECT d.doc_id AS id, CASE WHEN c.conv_id IS NOT NULL THEN 'draft' WHEN quality IS NOT NULL THEN 'published' END AS kind FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) c ON c.conv_id = d.doc_id")
def decision_overlay(t: Tables) -> DataFrame:
    ids = lambda rows, c, kind: rows.select(F.col(c).alias("id"), F.lit(kind).alias("kind")).distinct()
    return reviews.overlay(t.documents.select(F.col("doc_id").alias("id")), ids(t.labels, "doc_id", "published"), ids(t.conversations, "conv_id", "draft"))


@query("SELECT c_custkey AS id, CAST(tried AS VARCHAR) AS tried_at FROM customer LEFT JOIN (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS tried FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE tried IS NULL OR DATE '2001-12-31' - tried >= 14 ORDER BY tried NULLS FIRST, c_custkey LIMIT 50")
def enrichment_due(t: Tables) -> DataFrame:
    prior = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.to_date(F.max("o_orderdate")).alias("tried_at"))
    own = reviews.due_lookups(t.customer.select(F.col("c_custkey").alias("id")), prior, F.expr("DATE '2001-12-31'"), 14, 50)
    return own.withColumn("tried_at", F.col("tried_at").cast("string"))


@query("SELECT doc_id AS id, arg_min(source, (priority, source)) AS source, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals FROM (SELECT doc_id, 'labels' AS source, 1 AS priority, 'toxic=' || toxic AS signal FROM labels UNION ALL SELECT doc_id, 'documents', 0, lang FROM documents UNION ALL SELECT conv_id, 'talk', 2, role FROM conversations) GROUP BY 1")
def signals_by_priority(t: Tables) -> DataFrame:
    made = lambda rows, key, source, priority, signal: rows.select(F.col(key).alias("id"), F.lit(source).alias("source"), F.lit(priority).alias("priority"), signal.alias("signal"))
    rows = made(t.labels, "doc_id", "labels", 1, F.concat(F.lit("toxic="), F.col("toxic").cast("string")))
    rows = rows.unionByName(made(t.documents, "doc_id", "documents", 0, F.col("lang"))).unionByName(made(t.conversations, "conv_id", "talk", 2, F.col("role")))
    return reviews.sources_by_priority(rows)


@query("SELECT id, coalesce(lang, 'UNKNOWN') AS state FROM (SELECT DISTINCT conv_id AS id FROM conversations ORDER BY 1 LIMIT 250) LEFT JOIN documents ON doc_id = id")
def batch_lookup(t: Tables) -> DataFrame:
    return reviews.batch_lookup(t.conversations.select(F.col("conv_id").alias("id")), t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("state")), 250)


@query("SELECT d.doc_id, d.n_chars FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 1 AND n_chars >= 300 ORDER BY n_chars DESC, d.doc_id LIMIT 100")
def live_with_index(t: Tables) -> DataFrame:
    index = t.labels.where("quality = 1").select("doc_id")
    return t.documents.where("n_chars >= 300").join(index, "doc_id", "left_semi").orderBy(F.desc("n_chars"), "doc_id").limit(100).select("doc_id", "n_chars")


COUNTS = "n AS (SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents WHERE lang = 'en') AS public, (SELECT count(*) FROM labels WHERE toxic = 1) AS deleted)"


@query(f"WITH {COUNTS} SELECT *, greatest(0, total - public - deleted) AS gap, greatest(0, public + deleted - total) AS surplus FROM n")
def reconciliation(t: Tables) -> DataFrame:
    total = t.documents.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("lang") == "en").alias("public"))
    own = total.crossJoin(t.labels.agg(F.count_if(F.col("toxic") == 1).alias("deleted")))  # single rows
    return own.withColumns(reviews.reconcile(F.col("total"), F.col("public"), F.col("deleted")))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT user_id) FROM events) AS entities, (SELECT max(c_custkey) FROM customer WHERE c_acctbal > 1e9) AS books, coalesce((SELECT max(c_custkey) FROM customer WHERE c_acctbal > 1e9), (SELECT count(*) FROM customer)) AS owners")
def snapshot_card(t: Tables) -> DataFrame:
    parts = t.documents.agg(F.count(F.lit(1)).alias("documents")).crossJoin(t.events.agg(F.count_distinct("user_id").alias("entities")))  # single rows
    own = t.customer.agg(F.max(F.when(F.col("c_acctbal") > 1e9, F.col("c_custkey"))).alias("books"), F.count(F.lit(1)).alias("n"))
    return parts.crossJoin(own).select("documents", "entities", "books", F.coalesce("books", "n").alias("owners"))


@query("SELECT key, CAST(sum(value) AS BIGINT) AS total FROM (SELECT 'k' AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events UNION ALL SELECT event_type, 1 FROM events) GROUP BY 1")
def stat_merge(t: Tables) -> DataFrame:
    maps = t.events.select(F.map_from_arrays(F.array(F.lit("k"), F.col("event_type")), F.array(F.get_json_object("props", "$.k").cast("bigint"), F.lit(1).cast("bigint"))).alias("stats"))
    return reviews.merge_stats(maps, "stats")


@query("SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(c, '') AS children FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY -l_quantity, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def parent_details(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    order = [-F.coalesce("l_quantity", F.lit(0)), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")]
    return reviews.children_of(t.orders.select("o_orderkey"), lines, "o_orderkey", order, ["l_partkey"])


@query("SELECT coalesce(grp, 'Other') AS grp, label, n FROM (SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1) LEFT JOIN (VALUES ('first', 'Brand#1'), ('first', 'Brand#2'), ('second', 'Brand#3')) x(grp, label) USING (label)")
def tags_by_taxonomy(t: Tables) -> DataFrame:
    taxonomy = t.spark.createDataFrame([("first", "Brand#1"), ("first", "Brand#2"), ("second", "Brand#3")], "grp string, label string")
    return reviews.grouped_by_taxonomy(t.part.groupBy(F.col("p_brand").alias("label")).agg(F.count(F.lit(1)).alias("n")), taxonomy)


@query("SELECT CAST((row_number() OVER (ORDER BY views DESC, user_id) - 1) // 20 AS BIGINT) AS page, user_id, views FROM (SELECT user_id, CAST(count(*) AS BIGINT) AS views FROM events WHERE event_type = 'view' GROUP BY 1)")
def paged_export_check(t: Tables) -> DataFrame:
    """Views of each user in pages of 20; a repeated user or a negative number would stop it."""
    views_of = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.count(F.lit(1)).alias("views"))
    return audit.export_pages(views_of, "user_id", "views", 20)


@query(f"""WITH {views.OBS}, {views.RUNS}, outcome AS (SELECT CAST(epoch(CAST(day AS TIMESTAMP)) AS BIGINT) AS run_at, count(*) FILTER (path = 'purchase') AS pages, bool_or(path = 'error') AS partial FROM obs GROUP BY 1),
latest AS (SELECT * FROM outcome ORDER BY run_at DESC LIMIT 1)
SELECT r.run_at, coalesce(l.pages, r.pages) AS pages, r.errors, l.partial FROM runs r LEFT JOIN latest l ON l.run_at = r.run_at""")
def run_outcomes(t: Tables) -> DataFrame:
    """The newest outcome, told by the purchases of its day, in place of what its run says."""
    obs = views.observations(t)
    told = obs.groupBy(F.unix_timestamp(F.col("day").cast("timestamp")).alias("run_at")).agg(F.count_if(F.col("path") == "purchase").alias("pages"), F.bool_or(F.col("path") == "error").alias("partial"))
    return audit.with_outcome(views.runs(t), told, "run_at", ("pages", "partial")).select("run_at", "pages", "errors", "partial")


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'empty' WHEN event_id % 3 = 0 THEN 'volatile-only' WHEN event_id % 3 = 1 THEN 'content' ELSE 'empty' END AS state FROM events")
def payload_states(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.col("props")).when(kind == 1, F.replace("props", F.lit('"k"'), F.lit('"name"'))).otherwise(" {} ")
    return t.events.select("event_id", cleaning.payload_state(raw, ("k",)).alias("state"))
