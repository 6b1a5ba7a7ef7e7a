"""Replay of journals into the table of last-known values, with a budget of writes a run.

A run takes the longest beginning of what is unread, in the order of files and lines, that changes no more values than the budget
allows; lines that change nothing cost nothing. The rest stays unread for the next run. What was read is told by receipts, one row a
file with its last line, written after the values: a run that is killed between the two is done again and changes nothing twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VALUES = "entity_id bigint, path string, k bigint, file string, line bigint, batch bigint"
RECEIPTS = "file string, upto bigint, batch bigint"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def values(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """entity_id, path, k: the last value of each key, as of the batches that have receipts, or of those below `before`."""
    before = _next(spark, out) if before is None else before
    rows = _table(spark, f"{out}/values", VALUES).where(F.col("batch") < before)
    return rows.groupBy("entity_id", "path").agg(F.max_by("k", F.struct("file", "line")).alias("k"))


def _next(spark: SparkSession, out: str) -> int:
    return (_table(spark, f"{out}/receipts", RECEIPTS).agg(F.max("batch")).head()[0] or 0) + 1


def unread(spark: SparkSession, entries: DataFrame, out: str) -> DataFrame:
    """Entries (file, line, ...) behind the last line that a receipt names."""
    done = _table(spark, f"{out}/receipts", RECEIPTS).groupBy("file").agg(F.max("upto").alias("upto"))
    return entries.join(done, "file", "left").where("upto is null or line > upto").drop("upto")


def _marked(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Entries with `writes`: 1 where the value isn't what was known of its key at that place of the journal."""
    seen = known.select("entity_id", "path", F.col("k").alias("known"))
    order = Window.partitionBy("entity_id", "path").orderBy("file", "line")
    own = entries.join(seen, ["entity_id", "path"], "left").withColumn("told", F.last("k", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    changes = F.col("k").isNotNull() & ~F.col("k").eqNullSafe(F.coalesce("told", "known"))
    return own.withColumn("writes", changes.cast("bigint")).drop("told", "known")


def replay(spark: SparkSession, entries: DataFrame, out: str, budget: int) -> dict:
    """One run over entries (file, line, entity_id, path, k); lines of a file are numbered, null values tell nothing.

    Returns the lines read, the values written and whether something is left.
    """
    batch = _next(spark, out)
    marked = _marked(unread(spark, entries, out), values(spark, out, batch))
    # Files are few beside their lines: their sums tell in which one the budget ends, and only lines up to there are summed one by one.
    files = marked.groupBy("file").agg(F.sum("writes").alias("own"))
    begun = files.withColumn("before", F.sum("own").over(Window.orderBy("file")) - F.col("own")).where(F.col("before") <= budget)
    inside = marked.join(begun, "file").withColumn("nth", F.col("before") + F.sum("writes").over(Window.partitionBy("file").orderBy("line")))
    taken = inside.where(F.col("nth") <= budget)
    newest = taken.where("k is not null").groupBy("entity_id", "path").agg(F.max_by(F.struct("k", "file", "line"), F.struct("file", "line")).alias("n"))
    newest.select("entity_id", "path", "n.*").write.mode("overwrite").parquet(f"{out}/values/batch={batch}")
    read = taken.groupBy("file").agg(F.max("line").alias("upto"), F.sum("writes").alias("writes"), F.count(F.lit(1)).alias("lines"))
    read.write.mode("overwrite").parquet(f"{out}/receipts/batch={batch}")
    told = spark.read.parquet(f"{out}/receipts/batch={batch}").agg(F.sum("lines").alias("lines"), F.sum("writes").alias("writes")).head()
    return {"lines": told.lines or 0, "writes": told.writes or 0, "left": bool(unread(spark, entries, out).head(1))}
