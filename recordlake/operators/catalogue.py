"""The site catalogue of all records in one pass: shards, counts and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.functions.text import truncate

STATUSES = ("public", "deleted", "restricted", "missing", "unknown")
TOP_TAGS = 1000


def summaries(records: DataFrame, shards: int) -> DataFrame:
    """shard, id, status, name, title (cut to 320 characters) and tags of records with an id; other statuses than the known ones stay as they are."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    return records.where("id is not null").select(
        F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(shards)).cast("int").alias("shard"), "id", F.coalesce("status", F.lit("unknown")).alias("status"), clean(F.col("name")).alias("name"), truncate(clean(F.col("title")), 320).alias("title"), tags.alias("tags")
    )


def counts(summary: DataFrame) -> DataFrame:
    """kind, name, n: records by shard and by status, uses by tag, and all records, by one aggregation over what each record adds."""
    one = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"))
    adds = F.concat(F.array(one("total", F.lit("records")), one("shard", F.col("shard")), one("status", F.col("status"))), F.transform("tags", lambda t: one("tag", t)))
    return summary.select(F.inline(adds)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def reconciliation(counted: DataFrame) -> DataFrame:
    """One row: tracked, each known status, and count_gap, the records of no known status, split into what is unreconciled and what is beyond."""
    n = lambda kind, name: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("name") == name), F.col("n"))), F.lit(0)).alias(name)
    row = counted.where("kind in ('total', 'status')").agg(n("total", "records").alias("tracked"), *(n("status", s) for s in STATUSES))
    gap = F.col("tracked") - sum((F.col(s) for s in STATUSES[1:]), F.col(STATUSES[0]))
    return row.withColumn("count_gap", gap).withColumns({"unreconciled": F.greatest(F.lit(0), "count_gap"), "beyond": F.greatest(F.lit(0), -F.col("count_gap"))})


def top_tags(counted: DataFrame, top: int = TOP_TAGS) -> DataFrame:
    """The most used tags; of equal ones by their lower-cased name."""
    return counted.where("kind = 'tag'").select(F.col("name").alias("tag"), "n").orderBy(F.desc("n"), F.lower("tag"), "tag").limit(top)


def deleted_index(records: DataFrame) -> DataFrame:
    """id, since, name, revision of deleted records: the revision is a hash of all that the index shows."""
    own = records.where("status = 'deleted'").select("id", "since", "name")
    return own.withColumn("revision", F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.coalesce(F.col("since").cast("string"), F.lit("")), F.coalesce("name", F.lit(""))), 256))
