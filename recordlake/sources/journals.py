"""Append-only JSONL journals: reading with bad lines left out, appending, and the last entry per id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """file, line, id: blank lines, lines that aren't JSON objects and objects without an id are left out."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    doc = F.try_parse_json("line")
    own = lines.where(F.trim("line").startswith("{")).withColumn("id", F.try_variant_get(doc, "$.id", "string"))
    return own.where("id is not null and trim(id) <> ''")


def append_journal(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, gzipped, added to what is there."""
    rows.write.mode("append").option("compression", "gzip").json(path)


def pending(entries: DataFrame, order: list[str]) -> DataFrame:
    """id, fingerprint of each id's last entry."""
    own = entries.withColumn("fingerprint", F.sha2(F.to_json(F.try_parse_json("line")), 256))
    return own.groupBy("id").agg(F.max_by("fingerprint", F.struct(*order)).alias("fingerprint"))
