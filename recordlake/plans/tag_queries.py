"""Queries of tags and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.functions.text import fnv1a32, normalize_dictionary
from recordlake.operators import names, tags

from . import views
from .registry import Tables, query

W = f"WITH {views.LABELS} "
TAG_A, TAG_B = "brand#7", "brand #12"


def _tags(t: Tables, *keep: str) -> DataFrame:
    return tags.entity_tags(views.labels(t), views.label_dictionary(t), keep)


def _dated(t: Tables) -> DataFrame:
    return _tags(t, "day")


@query(W + "SELECT tag, count(*) AS uses, count(DISTINCT owner_id) AS owners FROM tags GROUP BY tag")
def tag_frequency(t: Tables) -> DataFrame:
    return tags.frequency(_tags(t))


SHARED = "WITH l AS (SELECT l_partkey AS entity_id, l_suppkey AS owner_id, lower(trim(regexp_replace(l_returnflag || l_linestatus, 'F$', ' Shipped'))) AS tag FROM lineitem), tags AS (SELECT DISTINCT entity_id, owner_id, tag FROM l QUALIFY owner_id = min(owner_id) OVER (PARTITION BY entity_id)) "


def _shared(t: Tables) -> DataFrame:
    """Parts as entities that are listed under every supplier who ships them: only the first listing counts."""
    label = F.regexp_replace(F.concat("l_returnflag", "l_linestatus"), "F$", "  Shipped")
    own = t.lineitem.select(F.col("l_partkey").alias("entity_id"), F.col("l_suppkey").alias("owner_id"), F.col("l_linenumber").alias("pos"), label.alias("label"))
    return tags.entity_tags(own)


@query(SHARED + "SELECT tag, count(*) AS uses, count(DISTINCT owner_id) AS owners FROM tags GROUP BY tag")
def tag_frequency_shared(t: Tables) -> DataFrame:
    return tags.frequency(_shared(t))


@query(SHARED + "SELECT owner_id, count(DISTINCT tag) AS tags, count(DISTINCT entity_id) AS entities FROM tags GROUP BY 1")
def tag_owner_count(t: Tables) -> DataFrame:
    return _shared(t).groupBy("owner_id").agg(F.count_distinct("tag").alias("tags"), F.count_distinct("entity_id").alias("entities"))


@query(W + "SELECT trim(label) AS label, count(*) AS uses FROM labels0 WHERE label IS NOT NULL GROUP BY 1 ORDER BY uses DESC, lower(trim(label)), label LIMIT 1000")
def tag_frequency_raw(t: Tables) -> DataFrame:
    raw = views.labels(t).where("label is not null").groupBy(F.trim("label").alias("label")).agg(F.count(F.lit(1)).alias("uses"))
    return raw.orderBy(F.desc("uses"), F.lower("label"), "label").limit(1000)


@query(W + "SELECT tag, count(*) AS uses FROM tags GROUP BY tag ORDER BY uses, tag LIMIT 80")
def tag_rare(t: Tables) -> DataFrame:
    return tags.frequency(_tags(t)).select("tag", "uses").orderBy("uses", "tag").limit(80)


@query(W + ", u AS (SELECT tag, count(*) AS n FROM tags GROUP BY tag) SELECT (SELECT count(DISTINCT entity_id) FROM labels0) AS indexed, (SELECT count(DISTINCT owner_id) FROM labels0) AS owners, (SELECT count(DISTINCT entity_id) FROM tags) AS tagged, (SELECT CAST(sum(n) AS BIGINT) FROM u) AS assignments, (SELECT count(*) FROM u) AS distinct_tags, (SELECT count(*) FROM u WHERE n = 1) AS one_use")
def tag_coverage(t: Tables) -> DataFrame:
    return tags.coverage(views.labels(t), _tags(t))


PAIRS = ", pairs AS (SELECT x.tag AS a, y.tag AS b, count(*) AS n FROM tags x JOIN tags y ON x.entity_id = y.entity_id AND x.tag < y.tag GROUP BY 1, 2) "


@query(W + PAIRS + "SELECT * FROM pairs")
def tag_pairs(t: Tables) -> DataFrame:
    return tags.pairs(_tags(t))


@query(W + PAIRS + "SELECT * FROM pairs ORDER BY n DESC, a, b LIMIT 75")
def tag_pairs_top75(t: Tables) -> DataFrame:
    return tags.pairs(_tags(t)).orderBy(F.desc("n"), "a", "b").limit(75)


@query(W + PAIRS + f"SELECT CASE WHEN a = '{TAG_A}' THEN b ELSE a END AS tag, n FROM pairs WHERE a = '{TAG_A}' OR b = '{TAG_A}' ORDER BY n DESC, tag LIMIT 12")
def tag_related(t: Tables) -> DataFrame:
    return tags.related(tags.pairs(_tags(t)), TAG_A, 12)


@query(W + "SELECT tag, owner_id, count(*) AS n, CAST(row_number() OVER (PARTITION BY tag ORDER BY count(*) DESC, owner_id) AS INTEGER) AS rank FROM tags GROUP BY tag, owner_id QUALIFY rank <= 15")
def tag_top_owners(t: Tables) -> DataFrame:
    return tags.top_owners(_tags(t), 15)


@query(W + f", h AS (SELECT entity_id, bool_or(tag = '{TAG_A}') AS a, bool_or(tag = '{TAG_B}') AS b FROM tags GROUP BY 1), c AS (SELECT count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only FROM h) SELECT *, round(n_both / (n_both + a_only + b_only)::DOUBLE, 6) AS overlap FROM c")
def tag_compare(t: Tables) -> DataFrame:
    return tags.compare(_tags(t), TAG_A, TAG_B)


DAILY = ", daily AS (SELECT day, tag, count(*) AS uses FROM tags WHERE day IN (SELECT DISTINCT day FROM tags ORDER BY day DESC LIMIT 90) GROUP BY 1, 2) "


@query(W + DAILY + "SELECT CAST(day AS VARCHAR) AS day, tag, uses FROM daily")
def tag_daily_history(t: Tables) -> DataFrame:
    return tags.daily_counts(_dated(t), 90).withColumn("day", F.col("day").cast("string"))


@query(W + DAILY + "SELECT tag, CAST(coalesce(sum(uses) FILTER (day = (SELECT max(day) FROM daily)), 0) - coalesce(sum(uses) FILTER (day = (SELECT min(day) FROM daily)), 0) AS BIGINT) AS delta FROM daily GROUP BY tag")
def tag_trend_delta(t: Tables) -> DataFrame:
    return tags.trend(tags.daily_counts(_dated(t), 90))


@query(W + ", newest AS (SELECT owner_id, max((day, entity_id)) AS n FROM tags GROUP BY 1), now AS (SELECT t.owner_id, t.tag FROM tags t JOIN newest n ON t.owner_id = n.owner_id AND (t.day, t.entity_id) = n.n) SELECT owner_id, tag, CAST(max(day) AS VARCHAR) AS last_used FROM tags t WHERE NOT EXISTS (SELECT 1 FROM now w WHERE w.owner_id = t.owner_id AND w.tag = t.tag) GROUP BY 1, 2")
def former_tags(t: Tables) -> DataFrame:
    return tags.former_tags(_dated(t)).withColumn("last_used", F.col("last_used").cast("string"))


@query(W + "SELECT DISTINCT tag, first_value(label) OVER (PARTITION BY tag ORDER BY entity_id, label) AS label FROM tags")
def tag_universe(t: Tables) -> DataFrame:
    return _tags(t).groupBy("tag").agg(F.min_by("label", F.struct("entity_id", "label")).alias("label"))


@query("SELECT lower(trim(p_name)) AS name, count(*) AS uses, arg_min(p_name, p_partkey) AS label FROM part GROUP BY 1")
def name_frequency(t: Tables) -> DataFrame:
    return names.name_frequency(t.part.select(F.col("p_partkey").alias("order_key"), F.col("p_name").alias("name")))


@query("SELECT count(*) AS distinct_names, count(*) FILTER (n = 1) AS one_use, CAST(sum(n) AS BIGINT) AS named FROM (SELECT lower(trim(p_name)) AS name, count(*) AS n FROM part GROUP BY 1)")
def name_one_use(t: Tables) -> DataFrame:
    own = names.name_frequency(t.part.select(F.col("p_partkey").alias("order_key"), F.col("p_name").alias("name")))
    return own.agg(F.count(F.lit(1)).alias("distinct_names"), F.count_if(F.col("uses") == 1).alias("one_use"), F.sum("uses").alias("named"))


TITLES = r"""WITH titles AS (SELECT doc_id, trim(regexp_replace(text, '[\t\n\x0b\f\r ]+', ' ', 'g')) AS title FROM documents) """


def _titles(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.trim(F.regexp_replace("text", r"[\t\n\x0B\f\r ]+", " ")).alias("title"))


@query(TITLES + "SELECT title, uses FROM (SELECT title, count(*) AS uses FROM titles WHERE length(title) >= 4 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100) WHERE uses >= 2")
def title_repeated(t: Tables) -> DataFrame:
    return names.repeated_titles(_titles(t), 4, 100)


CATEGORIES = (("short", "^.{0,120}$"), ("numeric", "[0-9]"), ("dash", "-"), ("license", "[Ll]icense"), ("shouting", "!!"), ("listing", "[|]"), ("never", "zzzzqq"))


@query(TITLES + " UNION ALL ".join(f"SELECT '{n}' AS category, count(*) FILTER (regexp_matches(title, '{p}')) AS n FROM titles" for n, p in CATEGORIES))
def title_categories(t: Tables) -> DataFrame:
    return names.category_counts(_titles(t), "title", dict(CATEGORIES))


@query(W + "SELECT label, count(*) AS uses FROM (SELECT entity_id, tag, arg_min(trim(label), (pos, label)) AS label FROM (SELECT *, lower(trim(label)) AS tag FROM labels0 WHERE label IS NOT NULL) GROUP BY 1, 2) GROUP BY label ORDER BY uses DESC, label LIMIT 40")
def display_tag_counter(t: Tables) -> DataFrame:
    own = views.labels(t).where("label is not null")
    per = own.groupBy("entity_id", F.lower(F.trim("label")).alias("tag")).agg(F.min_by(F.trim("label"), F.struct("pos", "label")).alias("label"))
    return per.groupBy("label").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "label").limit(40)


FNV = "list_reduce(list_prepend(2166136261::UBIGINT, [('0x' || substr(hex(p_name), i, 2))::UBIGINT for i in range(1, 2 * strlen(p_name), 2)]), lambda h, b: (xor(h, b) * 16777619::UBIGINT) & 4294967295::UBIGINT)"


@query(f"WITH b AS (SELECT {FNV} & 15 AS bucket, count(*) AS n FROM part GROUP BY 1) SELECT CAST(r.i AS BIGINT) AS bucket, coalesce(n, 0) AS n FROM range(16) r(i) LEFT JOIN b ON b.bucket = r.i")
def hash_bucket_counts(t: Tables) -> DataFrame:
    return names.bucket_counts(t.part, fnv1a32(F.col("p_name")), 16)


@query("SELECT p_partkey, lower(trim(p_name)) AS name FROM part")
def label_normalized(t: Tables) -> DataFrame:
    return normalize_dictionary(t.part.select("p_partkey", "p_name"), "p_name", "name").select("p_partkey", "name")
