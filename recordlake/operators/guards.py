"""Guards of runs: quotas, hysteresis, budgets, catch-up, retention, circuit breakers, completeness.

Runs are one row per run; folds over them are in order and hold one run's state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quota_safe(checked: Column, now: Column, allowed: Column, values: dict[str, tuple[Column, Column]]) -> Column:
    """A reading at most a day old, reading allowed, and each value below its limit; what is missing isn't safe."""
    age = F.unix_seconds(now) - F.unix_seconds(checked)
    out = age.between(0, 86_400) & allowed
    for value, limit in values.values():
        out &= value < limit
    return F.coalesce(out, F.lit(False))


def hysteresis(runs: DataFrame, order: str, value: str, pause: int, resume: int) -> DataFrame:
    """order, value, paused: pauses at `pause`, and once paused goes on until the value is below `resume`.

    The last value outside of what lies between the two bounds decides. Runs are one row a run, so one window takes them all.
    """
    if resume > pause:
        raise ValueError("it can't resume above where it pauses")
    told = F.when(F.col(value) >= pause, F.lit(True)).when(F.col(value) < resume, F.lit(False))
    so_far = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.select(order, value, F.coalesce(F.last(told, ignorenulls=True).over(so_far), F.lit(False)).alias("paused"))


def adaptive_budget(runs: DataFrame, order: str, clean: Column, base: int, growth: int, most: int) -> DataFrame:
    """order, budget of each run: grows after a clean run, up to `most`."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    grown = F.coalesce(F.count_if(clean).over(before), F.lit(0)) * growth
    return runs.select(order, F.least(F.lit(most), base + grown).cast("bigint").alias("budget"))


def catch_up(pending: Column, running: Column, least: int) -> Column:
    return (pending >= least) & ~running


def retained(rows: DataFrame, at: Column, now: Column, days: int, pinned: Column) -> DataFrame:
    """Rows that haven't expired, or are pinned."""
    return rows.where((at >= now - F.expr(f"INTERVAL {days} DAYS")) | F.coalesce(pinned, F.lit(False)))


def until_tripped(runs: DataFrame, order: str, trip: Column) -> DataFrame:
    """Runs up to the first that trips the breaker."""
    stop = runs.agg(F.min(F.when(trip, F.col(order))).alias("stop"))
    return runs.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col(order) <= F.col("stop"))).drop("stop")  # one row


def completeness(expected: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: rows expected, rows indexed, and whether the index is complete."""
    both = expected.agg(F.count(F.lit(1)).alias("expected")).crossJoin(indexed.agg(F.count(F.lit(1)).alias("indexed")))  # single rows
    return both.withColumn("complete", F.col("expected") == F.col("indexed"))


def coverage_valid(indexed: Column, total: Column, also: Column) -> Column:
    """Whether a report's numbers hold together: none below zero, no part above its whole."""
    return F.coalesce((indexed >= 0) & (indexed <= total) & also, F.lit(False))
