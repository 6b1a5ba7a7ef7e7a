"""Queries of contracts, the catalogue and its publication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.operators import catalogue, contracts
from recordlake.operators.contracts import Constraint
from recordlake.session import shared_dir
from recordlake.sources import families

from .registry import Tables, query

CONTRACT = [
    Constraint("orders", "o_orderkey", "o_orderkey", "unique"),
    Constraint("conversations", "turn", "conv_id", "unique"),
    Constraint("lineitem", "l_linenumber", "l_orderkey", "reference", target="orders.o_orderkey"),
    Constraint("documents", "doc_id", "doc_id", "reference", target="labels.doc_id"),
    Constraint("documents", "doc_id", "lang", "enum", ("en", "de", "fr")),
    Constraint("pages", "page_id", "url", "pattern", (r"https://[a-z0-9.-]+(/.*)?",)),
    Constraint("part", "p_partkey", "p_name", "max_length", ("14",)),
    Constraint("events", "event_id", "props", "required"),
]


@query("""SELECT 'orders.o_orderkey unique' AS "constraint", CAST(o_orderkey AS VARCHAR) AS key, count(*) || ' rows' AS value FROM orders GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT 'conversations.conv_id unique', CAST(conv_id AS VARCHAR), count(*) || ' rows' FROM conversations GROUP BY conv_id HAVING count(*) > 1
UNION ALL SELECT 'lineitem.l_orderkey reference', CAST(l_linenumber AS VARCHAR), CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'documents.doc_id reference', CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'documents.lang enum', CAST(doc_id AS VARCHAR), lang FROM documents WHERE lang NOT IN ('en', 'de', 'fr')
UNION ALL SELECT 'pages.url pattern', CAST(page_id AS VARCHAR), url FROM pages WHERE NOT regexp_full_match(url, 'https://[a-z0-9.-]+(/.*)?')
UNION ALL SELECT 'part.p_name max_length', CAST(p_partkey AS VARCHAR), length(p_name) || ' characters' FROM part WHERE length(p_name) > 14
UNION ALL SELECT 'events.props required', CAST(event_id AS VARCHAR), props FROM events WHERE props IS NULL OR trim(props) = ''""")
def contract_violations(t: Tables) -> DataFrame:
    return contracts.violations({c.table: getattr(t, c.table) for c in CONTRACT} | {"labels": t.labels}, CONTRACT)


# Records are orders, names their priorities, tags the brands of their lines; a status of their own stands for one that nobody knows.
RECORDS = """rec AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'deleted' WHEN 'O' THEN 'public' ELSE 'archived' END AS status, o_orderpriority AS name, o_orderdate AS since FROM orders),
used AS (SELECT l_orderkey AS id, trim(p_brand) AS tag FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)"""


def _records(t: Tables) -> DataFrame:
    brands = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    brands = brands.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.concat(F.lit(" "), "p_brand")).alias("tags"))
    state = F.when(F.col("o_orderstatus") == "F", "deleted").when(F.col("o_orderstatus") == "O", "public").otherwise("archived")
    orders = t.orders.select(F.col("o_orderkey").alias("id"), state.alias("status"), F.col("o_orderpriority").alias("name"), F.lit(None).cast("string").alias("title"), F.to_date("o_orderdate").alias("since"))
    return orders.join(brands, "id", "left")


def _summaries(t: Tables) -> DataFrame:
    return catalogue.summaries(_records(t), 16)


@query(f"WITH {RECORDS} SELECT 'total' AS kind, 'records' AS name, count(*) AS n FROM rec UNION ALL SELECT 'status', status, count(*) FROM rec GROUP BY 2 UNION ALL SELECT 'tag', tag, count(*) FROM used GROUP BY 2")
def materialized_catalog(t: Tables) -> DataFrame:
    """The counts of the one pass but for the shards, which SQL can't hash alike."""
    return catalogue.counts(_summaries(t)).where("kind <> 'shard'")


@query(f"WITH {RECORDS} SELECT count(*) AS tracked, count(*) FILTER (status = 'public') AS public, count(*) FILTER (status = 'deleted') AS deleted, 0::BIGINT AS restricted, 0::BIGINT AS missing, 0::BIGINT AS unknown, count(*) FILTER (status = 'archived') AS count_gap, count(*) FILTER (status = 'archived') AS unreconciled, 0::BIGINT AS beyond FROM rec")
def catalog_reconciliation(t: Tables) -> DataFrame:
    return catalogue.reconciliation(catalogue.counts(_summaries(t)))


@query(f"WITH {RECORDS} SELECT tag, count(*) AS n FROM used GROUP BY 1 ORDER BY n DESC, lower(tag) LIMIT 1000")
def catalog_top_tags(t: Tables) -> DataFrame:
    return catalogue.top_tags(catalogue.counts(_summaries(t)))


@query(f"WITH {RECORDS} SELECT id, CAST(CAST(since AS DATE) AS VARCHAR) AS since, name, sha256(id || '|' || CAST(since AS DATE) || '|' || name) AS revision FROM rec WHERE status = 'deleted'")
def deleted_index(t: Tables) -> DataFrame:
    """All deleted records with the revision of their entry."""
    return catalogue.deleted_index(_records(t)).withColumn("since", F.col("since").cast("string"))


@query(f"WITH {RECORDS} SELECT status, count(*) AS n, min(id) AS first_id FROM rec GROUP BY 1")
def published_families(t: Tables) -> DataFrame:
    """Summaries and deleted index as one version, read back behind its manifest; what a killed write left of another version isn't seen."""
    root = f"{shared_dir(t.spark).rstrip('/')}/families-{uuid.uuid4().hex}"
    rows = _summaries(t)
    index = catalogue.deleted_index(_records(t)).withColumn("year", F.year("since"))
    families.publish_families({"records": (rows, "shard"), "deleted": (index, "year")}, root)
    rows.limit(3).write.partitionBy("shard").parquet(f"{root}/version=killed/records")
    own = families.read_family(t.spark, root, "records")
    return own.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
