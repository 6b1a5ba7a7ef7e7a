"""Queries of audits, growth, usage and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlake.operators import audit

from . import views
from .registry import Tables, query

SETS = "d AS (SELECT doc_id AS id FROM documents WHERE lang <> 'es'), i AS (SELECT DISTINCT doc_id AS id FROM labels), s AS (SELECT doc_id AS id FROM documents WHERE n_chars > 2000)"
NOW = "DATE '2024-01-31'"


def _sets(t: Tables) -> dict[str, DataFrame]:
    docs = t.documents.select(F.col("doc_id").alias("id"), "n_chars", "lang")
    return {"discovered": docs.where("lang <> 'es'").select("id"), "indexed": t.labels.select(F.col("doc_id").alias("id")).distinct(), "stored": docs.where("n_chars > 2000").select("id")}


@query(f"WITH {SETS} SELECT mask, count(*) AS n FROM (SELECT id, CAST(bit_or(b) AS INTEGER) AS mask FROM (SELECT id, 1 AS b FROM d UNION ALL SELECT id, 2 FROM i UNION ALL SELECT id, 4 FROM s) GROUP BY 1) GROUP BY 1")
def three_way_audit(t: Tables) -> DataFrame:
    return audit.venn(_sets(t))


@query(f"WITH {SETS} SELECT CASE WHEN toxic IS NULL THEN 'unchecked' WHEN toxic = 0 THEN 'exists' ELSE 'missing' END AS state, count(*) AS n FROM d LEFT JOIN labels ON doc_id = id GROUP BY 1")
def existence_classes(t: Tables) -> DataFrame:
    return audit.existence(_sets(t)["discovered"], t.labels.select(F.col("doc_id").alias("id"), (F.col("toxic") == 0).alias("found")))


@query(f"WITH {SETS} SELECT id, 'add' AS action FROM s WHERE id NOT IN (SELECT id FROM i) UNION ALL SELECT id, 'report' FROM i WHERE id NOT IN (SELECT id FROM s)")
def repair_plan(t: Tables) -> DataFrame:
    sets = _sets(t)
    return audit.repair_plan(sets["indexed"], sets["stored"])


MASK = "CAST((n_chars > 2000)::INT + 2 * (lang = 'en')::INT + 4 * (doc_id % 3 = 0)::INT AS INTEGER)"


def _masks(t: Tables) -> DataFrame:
    from recordlake.functions.values import mask

    return t.documents.select(F.col("doc_id").alias("id"), mask(F.col("n_chars") > 2000, F.col("lang") == "en", F.col("doc_id") % 3 == 0).alias("mask"))


@query(f"SELECT doc_id AS id, {MASK} AS expected, coalesce(quality, 0) AS stored FROM documents LEFT JOIN labels USING (doc_id) WHERE {MASK} <> coalesce(quality, 0)")
def mask_drift(t: Tables) -> DataFrame:
    return audit.mask_drift(_masks(t), t.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("mask")))


@query(f"SELECT {MASK} AS mask, count(*) AS n FROM documents GROUP BY 1")
def presence_mask(t: Tables) -> DataFrame:
    return _masks(t).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id AS id FROM documents WHERE {MASK} & 7 = 7")
def mask_everything(t: Tables) -> DataFrame:
    return _masks(t).where(F.col("mask").bitwiseAND(F.lit(7)) == 7).select("id")


@query("SELECT count(*) AS records, count(*) FILTER (text IS NULL OR trim(text) = '') AS empty_text, count(*) FILTER (n_chars <> length(text)) AS wrong_size, count(*) FILTER (quality IS NULL) AS unlabelled, CASE WHEN count(*) FILTER (text IS NULL OR trim(text) = '') + count(*) FILTER (n_chars <> length(text)) = 0 THEN 'healthy' ELSE 'needs-attention' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)")
def index_health(t: Tables) -> DataFrame:
    own = t.documents.select("doc_id", "text", "n_chars").join(t.labels, "doc_id", "left")
    empty, wrong = F.col("text").isNull() | (F.trim("text") == ""), F.col("n_chars") != F.length("text")
    out = own.agg(F.count(F.lit(1)).alias("records"), F.count_if(empty).alias("empty_text"), F.count_if(wrong).alias("wrong_size"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))
    return out.withColumn("verdict", F.when(F.col("empty_text") + F.col("wrong_size") == 0, "healthy").otherwise("needs-attention"))


@query("WITH c AS (SELECT unnest(['view', 'click', 'purchase', 'refund']) AS category UNION ALL SELECT 'other'), n AS (SELECT CASE WHEN event_type IN ('view', 'click', 'purchase', 'refund') THEN event_type ELSE 'other' END AS category, count(*) AS n FROM events GROUP BY 1) SELECT category, coalesce(n, 0) AS n FROM c LEFT JOIN n USING (category)")
def status_counts(t: Tables) -> DataFrame:
    return audit.zero_filled_counts(t.events, "event_type", ("view", "click", "purchase", "refund"))


@query(f"WITH {views.OBS}, l AS (SELECT entity_id, max(day) FILTER (status = 'public') AS seen FROM obs GROUP BY 1) SELECT count(*) FILTER (date_diff('day', seen, {NOW}) >= 3) AS days_3, count(*) FILTER (date_diff('day', seen, {NOW}) >= 9) AS days_9, count(*) FILTER (seen IS NULL) AS never FROM l")
def status_audit(t: Tables) -> DataFrame:
    last = views.observations(t).groupBy("entity_id").agg(F.max(F.when(F.col("status") == "public", F.col("day"))).alias("seen"))
    return audit.age_bands(last, "seen", F.expr(NOW), (3, 9))


@query("WITH r AS (SELECT doc_id AS id, n_chars > 8000 AS large, lang <> 'en' AS foreign_lang, quality = 0 AS poor, n_chars FROM documents LEFT JOIN labels USING (doc_id)) SELECT id, array_to_string(list_filter([CASE WHEN large THEN 'large' END, CASE WHEN foreign_lang THEN 'foreign' END, CASE WHEN poor THEN 'poor' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r WHERE large OR foreign_lang OR coalesce(poor, false) ORDER BY CASE WHEN poor THEN 0 ELSE 1 END, CASE WHEN large THEN 0 ELSE 1 END, n_chars, id LIMIT 200")
def repair_queue(t: Tables) -> DataFrame:
    own = t.documents.join(t.labels, "doc_id", "left").select(F.col("doc_id").alias("id"), "n_chars", "lang", "quality")
    rules = {"large": F.col("n_chars") > 8000, "foreign": F.col("lang") != "en", "poor": F.col("quality") == 0}
    return audit.repair_queue(own, rules, ("poor", "large"), "n_chars", 200)


@query(f"WITH {views.OBS}, c AS (SELECT entity_id, count(*) FILTER (path = 'error') AS n, arg_max(path, (ts, pos)) AS latest FROM obs WHERE day >= DATE '2024-01-29' GROUP BY 1) SELECT CASE WHEN latest = 'error' AND n < 2 THEN 'awaiting-confirmation' WHEN latest = 'signup' THEN 'empty-response' WHEN latest <> 'error' THEN 'api-error' ELSE 'confirmed' END AS category, count(*) AS n FROM c GROUP BY 1")
def review_categories(t: Tables) -> DataFrame:
    own = views.observations(t).where("day >= '2024-01-29'").groupBy("entity_id").agg(F.count_if(F.col("path") == "error").alias("n"), F.max_by("path", F.struct("at", "pos")).alias("latest"))
    latest = F.col("latest")
    label = F.when((latest == "error") & (F.col("n") < 2), "awaiting-confirmation").when(latest == "signup", "empty-response").when(latest != "error", "api-error").otherwise("confirmed")
    return own.groupBy(label.alias("category")).agg(F.count(F.lit(1)).alias("n"))


R = f"WITH {views.OBS}, {views.RUNS}"


def _growth(clamp: str, where: str) -> str:
    return f"""{R}, own AS (SELECT * FROM runs {where}), e AS (SELECT max(run_at) AS end_at, arg_max(total, run_at) AS end_total FROM own),
g AS (SELECT hours, end_at, end_total, coalesce(max((run_at, total)) FILTER (run_at <= end_at - hours * 3600), min((run_at, total))) AS b FROM own, e, (SELECT unnest([24, 168, 720]) AS hours) WHERE run_at < end_at GROUP BY 1, 2, 3)
SELECT CAST(hours AS INTEGER) AS hours, CAST({clamp} AS BIGINT) AS net, round((end_at - b[1]) / 3600.0, 2)::DOUBLE AS span_hours, b[1] <= end_at - hours * 3600 AS complete FROM g"""


@query(_growth("end_total - b[2]", "WHERE count_source <> 'carried-forward'"))
def growth_windows(t: Tables) -> DataFrame:
    return audit.growth(views.runs(t).where("count_source <> 'carried-forward'"), (24, 168, 720))


@query(_growth("greatest(0, end_total - b[2])", ""))
def growth_clamped(t: Tables) -> DataFrame:
    return audit.growth(views.runs(t), (24, 168, 720), clamp=True)


@query(R + " SELECT run_at, greatest(0, total - lag(total) OVER (ORDER BY run_at)) * CASE WHEN lag(total) OVER (ORDER BY run_at) IS NULL THEN NULL ELSE 1 END AS added FROM runs")
def added_since_previous(t: Tables) -> DataFrame:
    return audit.added_since_previous(views.runs(t))


@query(R + " SELECT run_at, last_value(CASE WHEN count_source <> 'carried-forward' THEN total END IGNORE NULLS) OVER (ORDER BY run_at ROWS UNBOUNDED PRECEDING) AS total FROM runs")
def carry_forward_public(t: Tables) -> DataFrame:
    return audit.carry_forward(views.runs(t), "total", F.col("count_source") != "carried-forward")


@query(R + " SELECT run_at, CASE WHEN errors > 75 THEN 'partial' WHEN pages < 330 AND NOT (count_source = 'carried-forward') THEN 'partial' ELSE 'success' END AS status, CASE WHEN count_source = 'carried-forward' THEN 'results-exhausted' WHEN pages >= 330 THEN 'page-budget-met' ELSE 'partial' END AS completion FROM runs")
def run_status(t: Tables) -> DataFrame:
    end, budget = F.col("count_source") == "carried-forward", F.lit(330)
    errors = F.when(F.col("errors") > 75, 1).otherwise(0)
    return views.runs(t).select("run_at", audit.run_status(budget, F.col("pages"), errors, end).alias("status"), audit.completion(budget, F.col("pages"), end).alias("completion"))


@query(R + " SELECT max(run_at) FILTER (errors <= 65) AS last_clean, max(run_at) FILTER (pages >= 340) AS last_full, arg_max(total, run_at) FILTER (count_source = 'carried-forward') AS carried_total FROM runs")
def last_qualifying_run(t: Tables) -> DataFrame:
    at = F.col("run_at")
    return views.runs(t).agg(F.max(F.when(F.col("errors") <= 65, at)).alias("last_clean"), F.max(F.when(F.col("pages") >= 340, at)).alias("last_full"), F.max_by("total", F.when(F.col("count_source") == "carried-forward", at)).alias("carried_total"))


@query(R + ", s AS (SELECT run_at, pages, lag(run_at) OVER (ORDER BY run_at) AS prev, lag(pages) OVER (ORDER BY run_at) AS prev_pages FROM runs) SELECT run_at, prev IS NULL OR run_at - prev >= 3600 * greatest(CASE WHEN pages > 340 THEN 36 ELSE 12 END, CASE WHEN prev_pages > 340 THEN 36 ELSE 12 END) AS allowed FROM s")
def cooldown_state(t: Tables) -> DataFrame:
    w = Window.orderBy("run_at")
    tier = lambda c: F.when(c > 340, 36).otherwise(12)
    own = views.runs(t).withColumns({"prev": F.lag("run_at").over(w), "prev_pages": F.lag("pages").over(w)})
    return own.select("run_at", (F.col("prev").isNull() | (F.col("run_at") - F.col("prev") >= 3600 * F.greatest(tier(F.col("pages")), tier(F.col("prev_pages"))))).alias("allowed"))


@query("SELECT CASE WHEN l_returnflag IN ('R') THEN 'b' WHEN l_returnflag IN ('N') THEN 'free' ELSE 'a' END AS class, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS amount FROM lineitem GROUP BY 1")
def usage_rollup(t: Tables) -> DataFrame:
    return audit.class_rollup(t.lineitem.select("l_returnflag", F.col("l_quantity").cast("bigint").alias("q")), "l_returnflag", "q", {"b": ("R",), "free": ("N",)}, "a")


@query("WITH l AS (SELECT o_custkey, arg_max(CAST(o_totalprice * 100 AS BIGINT), (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1) SELECT count(*) AS buckets, CAST(sum(v) AS BIGINT) AS total FROM l")
def latest_sample_sum(t: Tables) -> DataFrame:
    own = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("v"))
    return audit.latest_sum(own, "o_custkey", ("o_orderdate", "o_orderkey"), "v")


@query("SELECT l_partkey AS id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS views FROM lineitem GROUP BY 1")
def weighted_views(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("views"))


@query("WITH v AS (SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS views FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT p_partkey AS id, coalesce(views, 0) AS views, p_size FROM part LEFT JOIN v ON l_partkey = p_partkey WHERE p_size >= 10 AND coalesce(views, 0) < 200 ORDER BY views, p_size DESC, id LIMIT 500")
def cold_ranking(t: Tables) -> DataFrame:
    seen = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("id")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("views"))
    own = t.part.select(F.col("p_partkey").alias("id"), "p_size").where("p_size >= 10").join(seen, "id", "left").withColumn("views", F.coalesce("views", F.lit(0)))
    return own.where("views < 200").orderBy("views", F.desc("p_size"), "id").limit(500)


@query("SELECT o_orderkey, CAST(CASE WHEN day(o_orderdate) >= 28 THEN make_date(year(o_orderdate), month(o_orderdate), 28) ELSE make_date(year(o_orderdate), month(o_orderdate), 28) - INTERVAL 1 MONTH END AS DATE)::VARCHAR AS period FROM orders")
def billing_period(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", audit.billing_start(F.to_date("o_orderdate"), 28).cast("string").alias("period"))


COHORTS = "CASE WHEN doc_id % 10 < 4 THEN 'new' WHEN doc_id % 10 < 8 THEN 'retry' ELSE 'old' END"


@query(f"WITH r AS (SELECT doc_id AS id, {COHORTS} AS cohort, n_chars AS priority, row_number() OVER (PARTITION BY {COHORTS} ORDER BY n_chars, doc_id) AS nth FROM documents) SELECT id, cohort FROM r ORDER BY CASE WHEN nth > CASE cohort WHEN 'old' THEN 10 ELSE 45 END THEN 1 ELSE 0 END, priority, id LIMIT 100")
def quota_selection(t: Tables) -> DataFrame:
    ten = F.col("doc_id") % 10
    own = t.documents.select(F.col("doc_id").alias("id"), F.when(ten < 4, "new").when(ten < 8, "retry").otherwise("old").alias("cohort"), F.col("n_chars").alias("priority"))
    return audit.quota_selection(own, {"new": 0.45, "retry": 0.45, "old": 0.1}, 100)


@query(f"WITH {views.OBS} SELECT entity_id, min(pos) AS pos FROM obs GROUP BY 1 ORDER BY pos DESC LIMIT 100")
def priority_queue_tail(t: Tables) -> DataFrame:
    return views.observations(t).groupBy("entity_id").agg(F.min("pos").alias("pos")).orderBy(F.desc("pos")).limit(100)


@query("SELECT event_id AS id FROM events WHERE ((event_id - 9900) % (SELECT count(*) FROM events) + (SELECT count(*) FROM events)) % (SELECT count(*) FROM events) < 250")
def ring_cursor_slice(t: Tables) -> DataFrame:
    events = t.events.select(F.col("event_id").alias("id"), F.col("event_id").alias("nth"))
    return audit.ring_slice(events, 9900, 250, events.count()).select("id")


@query("WITH x AS (SELECT (SELECT max(event_id) FROM events) - event_id AS nth, user_id % 40 = 0 AS is_new FROM events), p AS (SELECT nth // 25 AS page, count(*) FILTER (is_new) AS fresh FROM x GROUP BY 1), o AS (SELECT *, page - coalesce(last_value(CASE WHEN fresh > 0 THEN page END IGNORE NULLS) OVER (ORDER BY page ROWS UNBOUNDED PRECEDING), -1) AS run FROM p), s AS (SELECT min(page) AS stop FROM o WHERE run >= 3) SELECT page, fresh FROM o, s WHERE stop IS NULL OR page <= stop")
def scan_until_overlap(t: Tables) -> DataFrame:
    top = t.events.agg(F.max("event_id").alias("top"))
    rows = t.events.crossJoin(F.broadcast(top)).select((F.col("top") - F.col("event_id")).alias("nth"), (F.col("user_id") % 40 == 0).alias("is_new"))
    return audit.scan_until_known(rows, 25, 3)


@query("SELECT o_custkey AS owner_id, count(*) AS entities, count(*) FILTER (o_orderstatus = 'F') AS closed, CAST(min(o_orderdate) AS DATE)::VARCHAR AS first_seen, CAST(max(o_orderdate) AS DATE)::VARCHAR AS last_seen FROM orders GROUP BY 1")
def owner_profile(t: Tables) -> DataFrame:
    day = lambda c: F.to_date(c).cast("string")
    return t.orders.groupBy(F.col("o_custkey").alias("owner_id")).agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"), day(F.min("o_orderdate")).alias("first_seen"), day(F.max("o_orderdate")).alias("last_seen"))


@query("SELECT o_custkey AS owner_id, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY month DESC) <= 18")
def owner_month_captures(t: Tables) -> DataFrame:
    months = t.orders.groupBy(F.col("o_custkey").alias("owner_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("month")))
    return months.withColumn("nth", nth).where("nth <= 18").drop("nth")
