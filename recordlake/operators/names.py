"""Name and title statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.operators.rules import small

from recordlake.functions.text import norm_label

PLACEHOLDERS = ("unknown", "unnamed", "untitled")


def name_frequency(rows: DataFrame) -> DataFrame:
    """name, uses and the first label, of rows (order_key, name); placeholders and blanks don't count."""
    own = rows.withColumn("norm", norm_label(F.col("name"))).where((F.col("norm") != "") & ~F.col("norm").isin(*PLACEHOLDERS))
    return own.groupBy(F.col("norm").alias("name")).agg(F.count(F.lit(1)).alias("uses"), F.min_by("name", "order_key").alias("label"))


def repeated_titles(titles: DataFrame, min_length: int, top: int) -> DataFrame:
    """title, uses of the most frequent titles, of those the repeated ones: the limit comes before the filter.

    Titles may be long, so they are counted by two hashes; only what may be among the first is looked up, once a task.
    """
    own = titles.where(F.length("title") >= min_length).select("title", F.xxhash64("title").alias("a"), F.xxhash64(F.lit(1), "title").alias("b"))
    counts = own.groupBy("a", "b").agg(F.count(F.lit(1)).alias("uses")).where("uses >= 2")
    last = counts.orderBy(F.desc("uses")).limit(top).agg(F.min("uses").alias("last"))
    first = counts.join(F.broadcast(last), F.col("uses") >= F.col("last")).drop("last")  # one row
    named = own.join(small(first), ["a", "b"]).groupBy("a", "b", "uses").agg(F.any_value("title").alias("title"))
    return named.select("title", "uses").orderBy(F.desc("uses"), "title").limit(top)


def category_counts(rows: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """category, n for each pattern, overlapping, with zero rows; one pass over the rows."""
    one = rows.agg(*(F.count_if(F.col(column).rlike(p)).alias(n) for n, p in patterns.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("category"), F.col(n).alias("n")) for n in patterns))))


def bucket_counts(rows: DataFrame, hashed: Column, buckets: int) -> DataFrame:
    """Rows per hash bucket, empty buckets too. `buckets` is a power of two."""
    counts = rows.groupBy(hashed.bitwiseAND(F.lit(buckets - 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return rows.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
