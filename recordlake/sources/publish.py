"""Sinks: tables written only when their content changed, immutable snapshots behind a pointer, and fail-closed reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(rows: DataFrame) -> str:
    """A hash of the rows that doesn't depend on their order; one number per row is aggregated, nothing is collected."""
    columns = sorted(rows.columns)
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    sums = rows.select(F.xxhash64(row).alias("a"), F.xxhash64(F.lit(7), row).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b"))
    names = ",".join(columns)
    return sums.select(F.sha2(F.concat_ws("/", F.lit(names), "n", F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))), 256)).head()[0]


def published(spark: SparkSession, root: str) -> str | None:
    """Hash of the snapshot that the pointer names."""
    try:
        rows = spark.read.json(f"{root}/pointer").select("at", "hash").orderBy(F.desc("at")).head(1)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return rows[0]["hash"] if rows else None


def publish(rows: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> bool:
    """Writes `rows` as an immutable snapshot, then moves the pointer; false, with nothing written, if they are published already.

    A failed write leaves the pointer at the old snapshot.
    """
    spark = rows.sparkSession
    new = content_hash(rows)
    if published(spark, root) == new:
        return False
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{root}/snapshot={new}")
    spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("at"), F.lit(new).alias("hash")).coalesce(1).write.mode("append").json(f"{root}/pointer")
    return True


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The published snapshot; an error if there is none."""
    current = published(spark, root)
    if current is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.parquet(f"{root}/snapshot={current}")


def require_shards(rows: DataFrame, shard: str, expected: int) -> DataFrame:
    """`rows`, or an error unless every shard from 0 to `expected` - 1 is there."""
    found, low, high = rows.agg(F.count_distinct(shard), F.min(shard), F.max(shard)).head()
    if (found, low, high) != (expected, 0, expected - 1):
        raise ValueError(f"{found} of {expected} shards are there, from {low} to {high}")
    return rows


def read_checked_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV whose header must be the schema's names in their order; broken rows raise an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def write_sorted_csv(rows: DataFrame, path: str, key: str) -> None:
    """Sorted CSV parts with a header; read in the order of their names they are sorted as a whole."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("header", True).csv(path)
