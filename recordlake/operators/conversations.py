"""Conversation logs: summaries, down-sampling, repeated messages, consensus and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(messages: DataFrame) -> DataFrame:
    role = lambda r: F.count_if(F.col("role") == r)
    ooc = F.col("text").rlike(r"^\s*(\(\(|\[ooc|ooc:)")
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), role("user").alias("users"), role("assistant").alias("assistants"), role("system").alias("systems"), F.count_if(ooc).alias("ooc"), F.min_by("role", "turn").alias("first_role"))


def sample(messages: DataFrame, size: int, edge: int, max_chars: int) -> DataFrame:
    """Of each conversation all turns, or the first and last `edge` and evenly spaced ones between, until `max_chars` are taken."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    own = messages.withColumns({"i": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("conv_id"))})
    slots = size - 2 * edge
    span = F.greatest(F.lit(1), F.col("n") - 2 * edge)
    # Turn i is chosen if some slot k has floor(edge + (k + 1) * span / (slots + 1)) = i.
    k = F.ceil((F.col("i") - edge) * (slots + 1) / span) - 1
    hit = (k >= 0) & (k < slots) & (F.floor(edge + (k + 1) * span / (slots + 1)) == F.col("i")) & (F.col("i") < F.col("n") - edge)
    chosen = own.where((F.col("n") <= size) | (F.col("i") < edge) | (F.col("i") >= F.col("n") - edge) | hit)
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chosen.withColumn("before", before).where(F.col("before") < max_chars).drop("before", "i", "n")


def repeated(messages: DataFrame) -> DataFrame:
    """Messages with `regen`: the same role and text as the one before."""
    before = F.lag(F.struct("role", "text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return messages.withColumn("regen", F.coalesce(before.eqNullSafe(F.struct("role", "text")), F.lit(False)))


def consensus(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The value of a key if all meaningful values of it are the same, else null."""
    own = F.nullif(F.trim(F.col(value)), F.lit(""))
    return rows.groupBy(key).agg(F.when(F.count_distinct(own) == 1, F.min(own)).alias(value))


def readiness(fields: dict[str, Column]) -> tuple[Column, Column]:
    """Names of the fields that hold something, and of those that don't."""
    part = lambda want: F.array_join(F.array_compact(F.array(*(F.when(c == F.lit(want), F.lit(n)) for n, c in fields.items()))), ",")
    return part(True), part(False)
