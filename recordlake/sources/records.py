"""Record files: one JSON document per file, landed as text with its parse state, and keys of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.functions.text import id_prefix


def read_records(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """file, raw, readable, doc (canonical JSON, null if unreadable). Unreadable files stay as rows, so they can be counted."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    own = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    doc = F.to_json(F.try_parse_json("raw"))
    return own.withColumn("doc", doc).withColumn("readable", F.col("doc").isNotNull())


def read_counters(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("files"), F.count_if("readable").alias("readable"), F.count_if(~F.col("readable")).alias("unreadable"))


def scan_keys(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """key, id, canonical: file names of a store, and whether each lies in the folder of its id's prefix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    parts = F.split("path", "/")
    own = files.select(F.col("path").alias("key"), F.replace(F.element_at(parts, -1), F.lit(suffix), F.lit("")).alias("id"), F.element_at(parts, -2).alias("folder"))
    return own.select("key", "id", (F.col("key").endswith(suffix) & (F.col("folder") == id_prefix(F.col("id")))).alias("canonical"))


def best_location(ids: DataFrame, direct: DataFrame, sharded: DataFrame) -> DataFrame:
    """id, doc of each id: its own file, or the one in its shard only if it has none."""
    both = ids.join(direct.withColumnRenamed("doc", "direct"), "id", "left").join(sharded.withColumnRenamed("doc", "sharded"), "id", "left")
    return both.select("id", F.coalesce("direct", "sharded").alias("doc"), F.when(F.col("direct").isNotNull(), "direct").when(F.col("sharded").isNotNull(), "sharded").alias("origin"))


def distinct_media(files: DataFrame) -> DataFrame:
    """sha, first path, size and number of copies of binary files (path, content)."""
    own = files.select("path", F.sha2("content", 256).alias("sha"), F.length("content").alias("size"))
    return own.groupBy("sha").agg(F.min("path").alias("path"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"))
