"""Queries of row-level cleaning: urls, aliases, categories, languages, lists, times, roles, page filters and nested tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlake.functions import cleaning, roles
from recordlake.operators import guards
from recordlake.operators.history import leaf

from . import views
from .registry import Tables, query

NOW = "TIMESTAMP '2024-02-01 00:00:00'"


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN true WHEN event_type = 'click' THEN true ELSE false END AS deep FROM events")
def meaningful_nested(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    raw = F.when(kind == "view", F.col("props")).when(kind == "click", F.lit('{"a":{"b":[null,{"c":0}]}}')).when(kind == "error", F.lit('{"name":{"b":["",null,{"c":" "}]}}')).when(kind == "signup", F.lit("[]"))
    return t.events.select("event_id", cleaning.meaningful_deep(raw).alias("deep"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://cdn.test/avatars/' || page_id || '.png?w=1' WHEN page_id % 3 = 1 THEN 'https://x.test/' || page_id ELSE url END AS avatar FROM pages")
def asset_urls(t: Tables) -> DataFrame:
    kind = F.col("page_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit(" /avatars/"), "page_id", F.lit(".png"))).when(kind == 1, F.concat(F.lit("//x.test/"), "page_id")).otherwise(F.col("url"))
    return t.pages.select("page_id", cleaning.asset_url(raw, "https://cdn.test/", "avatars", "?w=1").alias("avatar"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus END AS name, o_orderpriority AS title FROM orders")
def aliased_fields(t: Tables) -> DataFrame:
    own = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.lit("  ")).otherwise(F.col("o_orderstatus")).alias("label"), F.col("o_orderpriority").alias("headline"))
    return own.select("o_orderkey", *(c.alias(n) for n, c in cleaning.aliased({"name": ("label", "headline"), "title": ("headline", "label")}).items()))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'reach' WHEN 'click' THEN 'reach' WHEN 'error' THEN 'state' ELSE 'other' END AS category FROM events")
def change_categories(t: Tables) -> DataFrame:
    leaf = F.substring_index(F.concat(F.lit("fields.last."), "event_type"), ".", -1)
    return t.events.select("event_id", cleaning.category_of(leaf, {"reach": ("view", "click"), "state": ("error",)}).alias("category"))


@query("SELECT doc_id, lang AS code, length(trim(coalesce(text, ''))) >= 2 AND (regexp_matches(coalesce(text, ''), '[À-ÖØ-öø-žͰ-Ͽ一-鿿]') OR source = 'src3') AS translate FROM documents")
def languages(t: Tables) -> DataFrame:
    """Source 3 stands for owners that tag their texts as foreign."""
    names = F.create_map(*(F.lit(x) for x in ("en", " English", "de", "Deutsch", "fr", "fr_CA", "es", "ES-mx")))
    tags = F.array(F.lit("new"), F.when(F.col("source") == "src3", "Non-English"))
    return t.documents.select("doc_id", cleaning.language_code(F.try_element_at(names, F.col("lang"))).alias("code"), cleaning.may_need_translation(F.col("text"), tags).alias("translate"))


@query("SELECT p_partkey, p_name || '|' || p_brand AS items FROM part")
def comma_lists(t: Tables) -> DataFrame:
    raw = F.concat(F.lit(" "), "p_name", F.lit(",,"), "p_brand", F.lit(" , "), F.upper("p_name"), F.lit(","))
    return t.part.select("p_partkey", F.array_join(cleaning.comma_list(raw), "|").alias("items"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, NULL FROM events WHERE event_type = 'error'")
def first_valid_time(t: Tables) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    bad = F.when(F.col("event_type") == "view", "soon").when(F.col("event_type") == "click", "12").otherwise(F.lit(None))
    good = F.when(F.col("event_type") != "error", at)
    return t.events.select("event_id", cleaning.first_time(F.expr(NOW), bad, F.lit("99999999999999"), good).alias("ms"))


@query(f"SELECT count(*) FILTER (ts >= {NOW} - INTERVAL 7 DAYS) AS d7, count(*) FILTER (ts >= {NOW} - INTERVAL 30 DAYS) AS d30, count(*) FILTER (ts >= {NOW} - INTERVAL 1 DAY) AS d1 FROM events")
def period_counts(t: Tables) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    count = lambda p: F.count_if(cleaning.within_period(at, F.expr(NOW), p))
    return t.events.agg(count("7d").alias("d7"), count("30d").alias("d30"), count("1d").alias("d1"))


@query(f"SELECT o_orderkey, CASE WHEN d < 1 THEN greatest(1, CAST(floor(d * 24) AS BIGINT)) || ' hours' WHEN d < 60 THEN CAST(floor(d) AS BIGINT) || ' days' ELSE printf('%.1f months', d / 30.44) END AS age FROM (SELECT o_orderkey, greatest(0.0::DOUBLE, (epoch_us({NOW}) - epoch_us(o_orderdate)) / 86400000000) AS d FROM orders)")
def age_texts(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", cleaning.age_text(F.col("o_orderdate").cast("timestamp"), F.expr(NOW)).alias("age"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(least(40, greatest(5, floor(l_quantity))) AS BIGINT) AS quantity FROM lineitem")
def guarded_numbers(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", cleaning.guarded_int(F.concat(F.lit(""), "l_quantity"), 5, 40).alias("quantity"))


@query("SELECT event_id, left(event_type, 3) || ',' || left(CAST(event_id AS VARCHAR), 3) AS items FROM events")
def bounded_lists(t: Tables) -> DataFrame:
    own = F.array("event_type", F.col("event_id").cast("string"), F.lit("third"))
    return t.events.select("event_id", F.array_join(cleaning.bounded_list(own, 2, 3), ",").alias("items"))


@query("SELECT event_id, event_type IN ('view', 'click') AS listing_only FROM events")
def listing_only(t: Tables) -> DataFrame:
    m = F.map_from_arrays(F.array(F.col("event_type"), F.lit("id")), F.array(F.lit(1), F.lit(2)))
    return t.events.select("event_id", cleaning.only_keys(m, ("id", "view", "click")).alias("listing_only"))


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN '' ELSE 'Source: ' || source || chr(10) END || 'Language: ' || lang || chr(10) || left('Size: ' || n_chars, 8) AS shown FROM documents")
def public_texts(t: Tables) -> DataFrame:
    sections = {"Source": F.when(F.col("source") != "src1", F.col("source")).otherwise(" "), "Language": F.concat(F.lit(" "), "lang"), "Size": F.left(F.col("n_chars").cast("string"), F.lit(2))}
    return t.documents.select("doc_id", cleaning.public_text(sections, 20_000).alias("shown"))


@query("SELECT doc_id, CASE WHEN toxic IS NOT NULL THEN CASE WHEN toxic = 1 THEN 'shared' ELSE 'private' END WHEN lang = 'en' THEN 'unknown' ELSE 'private' END AS visibility FROM documents LEFT JOIN labels USING (doc_id)")
def visibility(t: Tables) -> DataFrame:
    own = t.documents.join(t.labels, "doc_id", "left")
    return own.select("doc_id", cleaning.latest_flag([F.lit(None).cast("boolean"), F.col("toxic") == 1], F.when(F.col("lang") != "en", "private")).alias("visibility"))


# Titles are made of a part's columns: its size chooses the wording and the role, its key the second role.
TITLED = """titled AS (SELECT p_partkey, p_size % 8 AS kind, CASE WHEN p_size % 3 = 0 THEN 'submissive' ELSE 'dominant' END AS one, CASE WHEN p_partkey % 2 = 0 THEN 'submissive' ELSE 'dominant' END AS two FROM part)"""


@query(f"""WITH {TITLED} SELECT p_partkey, CASE WHEN kind IN (0, 2, 5) THEN one WHEN kind = 3 THEN two WHEN kind = 4 AND one = two THEN one END AS bot,
CASE WHEN kind IN (1, 3, 7) THEN one END AS "user" FROM titled""")
def title_roles(t: Tables) -> DataFrame:
    one, two = F.col("p_size") % 3 == 0, F.col("p_partkey") % 2 == 0
    short = lambda sub: F.when(sub, "Sub").otherwise("DOM")
    long = lambda sub: F.when(sub, "submissive").otherwise("Dominant")
    wide = F.translate(short(one), "SubDOM", "ＳｕｂＤＯＭ")
    wordings = [
        F.concat(F.col("p_name"), F.lit(" | "), short(one), F.lit(" bot")),
        F.concat(F.col("p_name"), F.lit(": you are a "), long(one), F.lit("!")),
        F.concat(F.lit("Your very "), long(one), F.lit(" boss, "), F.col("p_name")),
        F.concat(short(one), F.lit(" users — "), F.col("p_name"), F.lit(" and a "), long(two), F.lit(" character")),
        F.concat(short(one), F.lit(" AI or "), short(two), F.lit("-bot")),
        F.concat(wide, F.lit(" bot of "), F.col("p_name")),
        F.concat(short(one), F.lit(", bot ("), F.col("p_name"), F.lit(") your "), long(one), F.lit(" side")),
        F.concat(F.lit("{{ User }} as the "), long(one), F.lit(" "), F.col("p_name")),
    ]
    title = F.lit("")
    for i, w in enumerate(wordings):
        title = F.when(F.col("p_size") % 8 == i, w).otherwise(title)
    titles = t.part.select("p_partkey", title.alias("title"))
    return titles.select("p_partkey", *(c.alias(side) for side, c in roles.title_roles(F.col("title")).items()))


@query("SELECT event_id, strftime(max(s), '%Y-%m-%d %H:%M') AS slot FROM events, (SELECT CAST(range AS TIMESTAMP) + INTERVAL 137 MINUTES AS s FROM range(DATE '2023-12-01', DATE '2024-03-01', INTERVAL 1 DAY)) WHERE isodow(s) IN (1, 3, 5) AND s <= ts GROUP BY 1")
def schedule_slots(t: Tables) -> DataFrame:
    slot = cleaning.latest_slot(F.col("ts").cast("timestamp"), (0, 2, 4), 2, 17)
    return t.events.select("event_id", F.date_format(slot, "yyyy-MM-dd HH:mm").alias("slot"))


@query(f"WITH {views.OBS}, {views.RUNS} SELECT run_at, pages < 0.8 * (SELECT max(pages) FROM runs) AND errors < 30 AND count_source = 'search' AS safe FROM runs")
def quota_safe(t: Tables) -> DataFrame:
    runs = views.runs(t)
    limits = runs.agg((F.max("pages") * 0.8).alias("limit"))
    own = runs.crossJoin(F.broadcast(limits))  # one row
    at = F.timestamp_seconds("run_at")
    return own.select("run_at", guards.quota_safe(at, at, F.col("count_source") == "search", {"pages": (F.col("pages"), F.col("limit")), "errors": (F.col("errors"), F.lit(30))}).alias("safe"))


@query(f"""WITH RECURSIVE {views.OBS}, {views.RUNS}, n AS (SELECT row_number() OVER (ORDER BY run_at) AS i, run_at, errors FROM runs),
s AS (SELECT i, run_at, errors, errors >= 8 AS paused FROM n WHERE i = 1 UNION ALL SELECT n.i, n.run_at, n.errors, n.errors >= CASE WHEN s.paused THEN 5 ELSE 8 END FROM s JOIN n ON n.i = s.i + 1)
SELECT run_at, errors, paused FROM s""")
def hysteresis(t: Tables) -> DataFrame:
    return guards.hysteresis(views.runs(t), "run_at", "errors", 8, 5)


@query(f"""WITH RECURSIVE {views.OBS}, {views.RUNS}, n AS (SELECT row_number() OVER (ORDER BY run_at) AS i, run_at, errors FROM runs),
s AS (SELECT i, run_at, 100 AS budget, errors FROM n WHERE i = 1 UNION ALL SELECT n.i, n.run_at, CASE WHEN s.errors = 0 THEN least(400, s.budget + 50) ELSE s.budget END, n.errors FROM s JOIN n ON n.i = s.i + 1)
SELECT run_at, CAST(budget AS BIGINT) AS budget FROM s""")
def adaptive_budget(t: Tables) -> DataFrame:
    return guards.adaptive_budget(views.runs(t), "run_at", F.col("errors") == 0, 100, 50, 400)


@query("SELECT event_type, count(*) >= 100 AND event_type <> 'view' AS start FROM events GROUP BY 1")
def catch_up(t: Tables) -> DataFrame:
    own = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return own.select("event_type", guards.catch_up(F.col("n"), F.col("event_type") == "view", 100).alias("start"))


@query(f"SELECT event_id FROM events WHERE ts >= {NOW} - INTERVAL 10 DAYS OR event_type = 'purchase'")
def retained(t: Tables) -> DataFrame:
    return guards.retained(t.events, F.col("ts").cast("timestamp"), F.expr(NOW), 10, F.col("event_type") == "purchase").select("event_id")


@query(f"WITH {views.OBS}, {views.RUNS}, f AS (SELECT min(run_at) AS stop FROM runs WHERE errors > 20) SELECT run_at FROM runs, f WHERE stop IS NULL OR run_at <= stop")
def circuit_breaker(t: Tables) -> DataFrame:
    return guards.until_tripped(views.runs(t), "run_at", F.col("errors") > 20).select("run_at")


@query("""SELECT 'ids' AS name, count(*) AS expected, count(DISTINCT doc_id) AS indexed, count(*) = count(DISTINCT doc_id) AS complete FROM documents
UNION ALL SELECT 'labels', e, i, e = i FROM (SELECT count(*) AS e FROM documents), (SELECT count(*) AS i FROM labels)""")
def index_complete(t: Tables) -> DataFrame:
    """All documents have an id of their own; only some have labels."""
    own = lambda name, index: guards.completeness(t.documents, index).select(F.lit(name).alias("name"), "*")
    return own("ids", t.documents.select("doc_id").distinct()).unionByName(own("labels", t.labels))


@query("SELECT c_mktsegment AS bucket, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS keys FROM customer GROUP BY 1, c_nationkey")
def keyed_shards(t: Tables) -> DataFrame:
    shard = t.customer.groupBy(F.col("c_mktsegment").alias("bucket"), "c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey"), F.col("c_acctbal")))).alias("m"))
    return shard.select("bucket", F.size("m").cast("bigint").alias("n"), F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: k.cast("string")), ",").alias("keys"))


@query("SELECT c_nationkey AS owner, CAST(count(*) AS BIGINT) AS entities, min(c_custkey) AS first_id FROM customer GROUP BY 1")
def nested_maps(t: Tables) -> DataFrame:
    record = F.to_json(F.struct(F.map_from_arrays(F.array(F.col("c_nationkey").cast("string")), F.array(F.map_from_arrays(F.array(F.col("c_custkey").cast("string")), F.array("c_name")))).alias("owners")))
    parsed = t.customer.select(F.from_json(record, "owners map<string,map<string,string>>").alias("r"))
    rows = parsed.select(F.explode("r.owners").alias("owner", "bots")).select("owner", F.explode("bots").alias("id", "name"))
    return rows.groupBy(F.col("owner").cast("int").alias("owner")).agg(F.count(F.lit(1)).alias("entities"), F.min(F.col("id").cast("bigint")).alias("first_id"))


@query("SELECT o_orderkey, coalesce(bool_or(l_returnflag = 'R' AND l_quantity > 40), false) AS saved FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nested_exists(t: Tables) -> DataFrame:
    groups = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list("l_quantity").alias("fields"))
    meters = groups.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "fields")).alias("meters"))
    own = t.orders.select("o_orderkey").join(meters, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    found = F.exists("meters", lambda m: (m["l_returnflag"] == "R") & F.exists(m["fields"], lambda q: q > 40))
    return own.select("o_orderkey", F.coalesce(found, F.lit(False)).alias("saved"))


@query("SELECT event_id, event_type AS leaf FROM events")
def path_leaves(t: Tables) -> DataFrame:
    """Paths of one to three steps."""
    path = F.concat(F.when(F.col("value") > 50, "fields.").otherwise(""), F.when(F.col("props").contains("1"), "a-b.").otherwise(""), "event_type")
    return t.events.select("event_id", leaf(path).alias("leaf"))


@query(f"WITH {views.OBS} SELECT pos FROM obs WHERE path IN ('view', 'click') AND source = 'api' AND day >= DATE '2024-01-10' AND contains(lower(path || ' ' || source), 'c')")
def changes_page(t: Tables) -> DataFrame:
    from recordlake.operators.browse import FilterSpec

    own = views.observations(t).withColumn("category", cleaning.category_of(F.col("path"), {"reach": ("view", "click")}))
    spec = FilterSpec(query="C", query_columns=("path", "source"), equal=(("category", "reach"), ("source", "api")), at_least=(("day", "2024-01-10"),))
    return own.where(spec.predicate()).select("pos")


@query("SELECT doc_id, lang, source, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS size, left(text, 79) || CASE WHEN length(text) > 80 THEN '…' ELSE substr(text, 80, 1) END AS line FROM documents")
def compact_summary(t: Tables) -> DataFrame:
    from recordlake.functions.text import truncate

    return t.documents.select("doc_id", "lang", "source", F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("size"), truncate(F.col("text"), 80).alias("line"))


@query("SELECT p_partkey, p_brand AS brand, CASE WHEN p_size >= 25 THEN p_type ELSE p_name END AS title FROM part")
def best_fields(t: Tables) -> DataFrame:
    blank = F.when(F.col("p_size") >= 25, F.col("p_type")).otherwise(F.lit(" "))
    sources = {"brand": (F.lit(None).cast("string"), F.col("p_brand")), "title": (blank, F.col("p_name"))}
    from recordlake.functions.values import first_meaningful

    return t.part.select("p_partkey", *(first_meaningful(*columns).alias(name) for name, columns in sources.items()))


@query("SELECT s_suppkey, s_acctbal BETWEEN 0 AND 5000 AND s_nationkey < 20 AS valid FROM supplier")
def coverage_valid(t: Tables) -> DataFrame:
    own = {"indexed": F.col("s_acctbal"), "total": F.lit(5000), "nations": F.col("s_nationkey")}
    return t.supplier.select("s_suppkey", guards.coverage_valid(own["indexed"], own["total"], own["nations"] < 20).alias("valid"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'ftp://img.test/' || page_id WHEN url IS NOT NULL AND trim(url) <> '' AND length(url) <= 2048 AND NOT regexp_matches(lower(url), '^(javascript|data|file|blob):') THEN trim(url) ELSE 'img/' || page_id END AS image FROM pages")
def image_choice(t: Tables) -> DataFrame:
    """Any scheme but the refused ones will do, and relative references too."""
    candidates = (F.lit(" DATA:image/png;base64,AA"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" ftp://img.test/"), "page_id")), F.repeat(F.lit("x"), F.lit(2049)), F.col("url"), F.concat(F.lit("img/"), "page_id"))
    return t.pages.select("page_id", cleaning.image_reference(*candidates).alias("image"))


@query("SELECT p_partkey, lower(trim(p_name)) AS label, 'brand ' || substr(p_brand, 7) AS canonical, contains(' brand ' || substr(p_brand, 7) || ' ', ' 7 ') AS seven FROM part")
def registered_functions(t: Tables) -> DataFrame:
    from recordlake.functions.sql import register

    register(t.spark)
    own = F.expr("rl_canonical(p_brand)")
    return t.part.select("p_partkey", F.expr("rl_norm_label(p_name)").alias("label"), own.alias("canonical"), F.expr("rl_phrase_in(rl_canonical(p_brand), '7')").alias("seven"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_type AS shape FROM events")
def upload_containers(t: Tables) -> DataFrame:
    """Errors hold two containers, of which the earlier key counts, and a scalar under a still earlier one, which doesn't hide it."""
    from recordlake.sources.uploads import contained

    row = F.concat(F.lit('{"record":{"savedCopy":'), "props", F.lit("}}"))
    shapes = {"view": ('{"savedCopies":[', "]}"), "click": ('{"bots":{"a":', "}}"), "signup": ("[", "]"), "purchase": ('{"id":1,"snapshot":', "}"), "error": ('{"snapshots":[', '],"bots":[{"k":-1}],"savedCopies":7}')}
    text = F.lit("not json")
    for kind, (before, after) in shapes.items():
        text = F.when(F.col("event_type") == kind, F.concat(F.lit(before), row, F.lit(after))).otherwise(text)
    rows = contained(t.events.select("event_id", F.col("event_type").alias("shape"), text.alias("text")))
    return rows.select("event_id", F.try_variant_get("payload", "$.k", "bigint").alias("k"), "shape")
