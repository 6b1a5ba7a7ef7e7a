"""Query that runs a streaming fold to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlake.session import shared_dir
from recordlake.streaming import fold, observe, replay

from . import views
from .history_queries import OBSERVE, observation_documents
from .registry import Tables, query
from .temporal_queries import W


def _shared(t: Tables) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/fold-{uuid.uuid4().hex}"


@query(W + "SELECT entity_id, path, k FROM known")
def stream_fold_parity(t: Tables) -> DataFrame:
    """Events as a file stream, folded into the last known state; the same rows as the batch query `last_known`."""
    schema = t.events.schema
    files = f"{t.sf_dir}/events.parquet"
    one_file = not t.spark.read.format("binaryFile").load(files).where("path like '%events.parquet/%'").head(1)
    source = t.spark.readStream.schema(schema)
    stream = source.option("pathGlobFilter", "events.parquet").parquet(t.sf_dir) if one_file else source.parquet(files)
    own = stream.select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("pos"), F.col("ts").alias("at"), F.col("event_type").alias("path"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    root = _shared(t)
    fold.merge_last_known(t.spark, own, f"{root}/table", f"{root}/state")
    return fold.read_merged(t.spark, f"{root}/table").select("entity_id", "path", "k")


#: Documents wait for others of the same time and for earlier ones; the tables at hand span 30 days and come in no order.
LATENESS = "60 DAYS"
#: Batches that the documents are dealt out to.
BATCHES = 3

#: Status: a document with an error tells of a deletion, `api` verifies; metrics: the leaf `error`.
STREAMED = OBSERVE + """, doc AS (SELECT entity_id, source, d_at, bool_or(path = 'fields.error' AND value IS NOT NULL) AS gone FROM rows_ GROUP BY ALL),
turns AS (SELECT *, row_number() OVER w = 1 AS first, CASE WHEN gone THEN 'deleted' WHEN source = 'api' OR row_number() OVER w = 1 THEN 'public' END AS sets FROM doc WINDOW w AS (PARTITION BY entity_id ORDER BY d_at, source)),
before AS (SELECT *, last_value(sets IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY d_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM turns),
statuses AS (SELECT entity_id, source, d_at, 'status' AS path, CASE WHEN gone THEN CASE WHEN was IS DISTINCT FROM 'deleted' THEN 'deleted' END WHEN was = 'deleted' THEN CASE WHEN source = 'api' THEN 'restored' ELSE 'restore-candidate' END WHEN first THEN 'new' END AS kind, was AS "from" FROM before),
metric AS (SELECT entity_id, source, d_at, path, lag(value) OVER (PARTITION BY entity_id, path ORDER BY d_at, source) AS was, value FROM rows_ WHERE path = 'fields.error' AND value IS NOT NULL),
all_ AS (SELECT entity_id, source, d_at, path, kind, CAST("from" AS VARCHAR) AS "from", CAST("to" AS VARCHAR) AS "to" FROM ev
  UNION ALL SELECT entity_id, source, d_at, path, 'metric', CAST(was AS VARCHAR), CAST(value AS VARCHAR) FROM metric WHERE was IS DISTINCT FROM value
  UNION ALL SELECT entity_id, source, d_at, path, kind, "from", CASE kind WHEN 'deleted' THEN 'deleted' WHEN 'restore-candidate' THEN NULL ELSE 'public' END FROM statuses WHERE kind IS NOT NULL)
"""


def _observed(t: Tables) -> DataFrame:
    """Events of the documents as a stream, dealt out to batches by a hash, the parts of a document too."""
    root = _shared(t)
    rows = observation_documents(t).select("entity_id", "source", F.col("at").cast("timestamp").alias("at"), "path", F.col("value").cast("string").alias("value"))
    schema = rows.schema
    # One pass over the events; each batch has a file for each task of a shuffle.
    files = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(BATCHES * files, F.xxhash64(*rows.columns)).write.parquet(f"{root}/in")
    observe.closing_row(t.spark.read.schema(schema).parquet(f"{root}/in"), LATENESS).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    own = observe.ObservationFold(("view", "click"), ("error",), ("error",), "error", "api")
    return observe.fold_files(t.spark, stream, own, LATENESS, f"{root}/events", f"{root}/state")


@query(STREAMED + 'SELECT entity_id, source, CAST(d_at AS VARCHAR) AS "at", path, kind, "from", "to" FROM all_')
def stream_observe_events(t: Tables) -> DataFrame:
    """The observation fold over shuffled batches: the events of `observe_events` row by row, and those of metrics and status."""
    return _observed(t).withColumn("at", F.date_format("at", "yyyy-MM-dd"))


@query(W + "SELECT entity_id, path, k FROM known")
def replay_parity(t: Tables) -> DataFrame:
    """Events as journals, a file a week, replayed with a budget of half their number until nothing is left; the same values as `last_known`."""
    week = F.date_format(F.date_trunc("week", F.col("at")), "yyyy-MM-dd")
    order = Window.partitionBy("file").orderBy("at", "pos")
    entries = views.observations(t).select("entity_id", "path", "k", "at", "pos", week.alias("file"))
    root = _shared(t)
    entries.withColumn("line", F.row_number().over(order).cast("bigint")).drop("at", "pos").write.parquet(f"{root}/journal")
    journal = t.spark.read.parquet(f"{root}/journal")
    budget = journal.count() // 2
    while replay.replay(t.spark, journal, root, budget)["left"]:
        pass
    return replay.values(t.spark, root)
