"""Stand-ins that map the star-schema tables to the archive's concepts, in Spark and as SQL common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables

# Entities are orders, owners customers, labels brands written in three ways.
LABELS = r"""labels0 AS (
  SELECT o_orderkey AS entity_id, o_custkey AS owner_id, CAST(o_orderdate AS DATE) AS day, l_linenumber AS pos,
    CASE l_linenumber % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN '  ' || p_brand || ' ' ELSE replace(p_brand, '#', '  #') END AS label
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey),
tags AS (
  SELECT entity_id, owner_id, day, tag, arg_min(label, (pos, label)) AS label FROM (
    SELECT *, lower(trim(regexp_replace(label, '\s+', ' ', 'g'))) AS tag FROM labels0 WHERE label IS NOT NULL)
  GROUP BY ALL)"""


def label_dictionary(t: Tables) -> DataFrame:
    """Tags of all labels, from the few brands that they are made of."""
    from recordlake.operators.tags import dictionary

    brand = F.col("p_brand")
    ways = F.array(F.upper(brand), F.concat(F.lit("  "), brand, F.lit(" ")), F.replace(brand, F.lit("#"), F.lit("  #")))
    return dictionary(t.part.select(F.explode(ways).alias("label")))


def labels(t: Tables) -> DataFrame:
    brand, line = F.col("p_brand"), F.col("l_linenumber") % 3
    label = F.when(line == 0, F.upper(brand)).when(line == 1, F.concat(F.lit("  "), brand, F.lit(" "))).otherwise(F.replace(brand, F.lit("#"), F.lit("  #")))
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("entity_id"), F.col("o_custkey").alias("owner_id"), F.to_date("o_orderdate").alias("day"), F.col("l_linenumber").alias("pos"), label.alias("label"))


# Observations are events: entity user, path event type, value k; metrics k and value; runs are days.
OBS = """obs AS (
  SELECT user_id AS entity_id, event_id AS pos, ts, event_type AS path, value,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS day,
    CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'public' END AS status,
    CASE WHEN event_id % 2 = 0 THEN 'api' ELSE 'listing' END AS source
  FROM events)"""


def observations(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        F.col("user_id").alias("entity_id"),
        F.col("event_id").alias("pos"),
        F.col("ts").cast("timestamp").alias("at"),
        F.col("event_type").alias("path"),
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.to_date("ts").alias("day"),
        F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "public").alias("status"),
        F.when(F.col("event_id") % 2 == 0, "api").otherwise("listing").alias("source"),
    )


# Runs are days of events; totals grow, every seventh day repeats the total of the day before.
RUNS = """days AS (SELECT day, count(*) AS n, count(*) FILTER (path = 'error') AS errors FROM obs GROUP BY day),
runs AS (
  SELECT CAST(epoch(CAST(day AS TIMESTAMP)) AS BIGINT) AS run_at, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total, CAST(n AS BIGINT) AS pages, CAST(errors AS BIGINT) AS errors,
    CASE WHEN day(day) % 7 = 0 THEN 'carried-forward' ELSE 'search' END AS count_source
  FROM days)"""


def runs(t: Tables) -> DataFrame:
    """One row per day, so a few rows however large the events are."""
    from pyspark.sql import Window

    days = observations(t).groupBy("day").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("path") == "error").alias("errors"))
    return days.select(
        F.unix_timestamp(F.col("day").cast("timestamp")).alias("run_at"),
        F.sum("pages").over(Window.orderBy("day")).alias("total"),
        "pages",
        "errors",
        F.when(F.dayofmonth("day") % 7 == 0, "carried-forward").otherwise("search").alias("count_source"),
    )
