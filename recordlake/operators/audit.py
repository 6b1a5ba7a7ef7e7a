"""Set reconciliation, health and status audits, repair planning, usage and growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def venn(sets: dict[str, DataFrame]) -> DataFrame:
    """mask, n: ids per region of the sets; bit i stands for the i-th set. One aggregation, no joins."""
    tagged = None
    for i, ids in enumerate(sets.values()):
        part = ids.select(ids.columns[0]).toDF("id").where("id is not null").withColumn("bit", F.lit(1 << i))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("id").agg(F.bit_or("bit").alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


def existence(wanted: DataFrame, checked: DataFrame) -> DataFrame:
    """state, n: wanted ids (id) by whether a check (id, found) says they exist; unchecked if none does."""
    state = F.when(F.col("found").isNull(), "unchecked").when(F.col("found"), "exists").otherwise("missing")
    best = checked.groupBy("id").agg(F.max("found").alias("found"))
    return wanted.join(best, "id", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def repair_plan(indexed: DataFrame, stored: DataFrame) -> DataFrame:
    """id, action: stored but not indexed ids to add, indexed but not stored ids to report. Nothing is deleted."""
    add = stored.join(indexed, "id", "left_anti").select("id", F.lit("add").alias("action"))
    return add.unionByName(indexed.join(stored, "id", "left_anti").select("id", F.lit("report").alias("action")))


def mask_drift(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids whose stored mask isn't the expected one; a missing mask is 0."""
    both = expected.join(stored.withColumnRenamed("mask", "stored"), "id", "left")
    return both.select("id", F.col("mask").alias("expected"), F.coalesce("stored", F.lit(0)).alias("stored")).where("expected <> stored")


def zero_filled_counts(rows: DataFrame, column: str, categories: tuple[str, ...], other: str = "other") -> DataFrame:
    """category, n for fixed categories; values outside them count as `other`."""
    value = F.coalesce(F.col(column), F.lit(other))
    named = F.when(value.isin(*categories), value).otherwise(other)
    counts = rows.groupBy(named.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.createDataFrame([(c,) for c in (*categories, other)], "category string")
    return every.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def age_bands(rows: DataFrame, seen: str, now: Column, bands: tuple[int, ...]) -> DataFrame:
    """One row: rows seen at least so many days ago, and rows never seen."""
    age = F.datediff(now, F.col(seen))
    return rows.agg(*(F.count_if(age >= b).alias(f"days_{b}") for b in bands), F.count_if(F.col(seen).isNull()).alias("never"))


def repair_queue(rows: DataFrame, rules: dict[str, Column], urgent: tuple[str, ...], by: str, limit: int) -> DataFrame:
    """Rows that some rule names, most urgent first: reasons joined, of which `urgent` ones lead in their order."""
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    own = rows.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    order = [F.when(F.array_contains("reasons", u), 0).otherwise(1) for u in urgent]
    return own.orderBy(*order, by, "id").limit(limit).select("id", F.array_join("reasons", ",").alias("reasons"))


def growth(runs: DataFrame, hours: tuple[int, ...], clamp: bool = False) -> DataFrame:
    """hours, net, span_hours, complete: growth of total over each window up to the newest run.

    The base is the last earlier run at or before the window's start, else the first run, which makes it incomplete.
    `clamp` keeps shrinking totals at 0. Runs are few; each window is one aggregate over them.
    """
    newest = runs.agg(F.max(F.struct("run_at", "total")).alias("n")).select("n.run_at", "n.total").toDF("end_at", "end_total")
    windows = runs.sparkSession.createDataFrame([(h,) for h in hours], "hours int")
    own = runs.crossJoin(F.broadcast(newest)).where("run_at < end_at").crossJoin(F.broadcast(windows))  # one row, and the windows
    base = F.coalesce(
        F.max(F.when(F.col("run_at") <= F.col("end_at") - F.col("hours") * 3600, F.struct("run_at", "total"))),
        F.min(F.struct("run_at", "total")),
    )
    got = own.groupBy("hours", "end_at", "end_total").agg(base.alias("b"))
    net = F.col("end_total") - F.col("b.total")
    span = (F.col("end_at") - F.col("b.run_at")) / 3600
    return got.select("hours", (F.greatest(net, F.lit(0)) if clamp else net).alias("net"), F.round(span, 2).alias("span_hours"), (F.col("b.run_at") <= F.col("end_at") - F.col("hours") * 3600).alias("complete"))


def added_since_previous(runs: DataFrame) -> DataFrame:
    """Null for the first run, else the growth, at least 0."""
    added = F.col("total") - F.lag("total").over(Window.orderBy("run_at"))
    return runs.select("run_at", F.when(added.isNotNull(), F.greatest(added, F.lit(0))).alias("added"))


def carry_forward(runs: DataFrame, column: str, valid: Column) -> DataFrame:
    """`column` of the run, or of the newest earlier run where it is valid."""
    value = F.last(F.when(valid, F.col(column)), ignorenulls=True).over(Window.orderBy("run_at").rowsBetween(Window.unboundedPreceding, 0))
    return runs.select("run_at", value.alias(column))


def run_status(budget: Column, pages: Column, errors: Column, natural_end: Column) -> Column:
    return F.when(errors > 0, "partial").when((budget > 0) & (pages < budget) & ~natural_end, "partial").otherwise("success")


def completion(budget: Column, pages: Column, natural_end: Column) -> Column:
    return F.when(budget <= 0, "not-run").when(natural_end, "results-exhausted").when(pages >= budget, "page-budget-met").otherwise("partial")


def billing_start(day: Column, day_of_month: int) -> Column:
    """Start of the billing period that holds the day."""
    this = F.make_date(F.year(day), F.month(day), F.lit(day_of_month))
    return F.when(day >= this, this).otherwise(F.add_months(this, -1))


def class_rollup(rows: DataFrame, action: str, amount: str, classes: dict[str, tuple[str, ...]], default: str) -> DataFrame:
    """Sum per class of action; actions of no class count as the default one."""
    label = F.lit(default)
    for name, actions in classes.items():
        label = F.when(F.col(action).isin(*actions), F.lit(name)).otherwise(label)
    return rows.groupBy(label.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"))


def latest_sum(samples: DataFrame, bucket: str, at: tuple[str, ...], value: str) -> DataFrame:
    """Sum over buckets of each bucket's newest value."""
    newest = samples.groupBy(bucket).agg(F.max_by(value, F.struct(*at)).alias("v"))
    return newest.agg(F.count(F.lit(1)).alias("buckets"), F.sum("v").alias("total"))


def quota_selection(rows: DataFrame, cohorts: dict[str, float], size: int) -> DataFrame:
    """`size` ids: of each cohort its share first (at least one), in order of `priority`, then the rest by priority.

    Only the first `size` of each cohort can be chosen, so all else is cut off by a limit per cohort before the last ranking.
    """
    first = Window.partitionBy("cohort").orderBy("priority", "id")
    ranked = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= size)
    share = F.lit(0)
    for name, part in cohorts.items():
        share = F.when(F.col("cohort") == name, max(1, int(size * part))).otherwise(share)
    ranked = ranked.withColumn("late", (F.col("nth") > share).cast("int"))
    return ranked.orderBy("late", "priority", "id").limit(size).select("id", "cohort")


def ring_slice(ids: DataFrame, cursor: int, budget: int, total: int) -> DataFrame:
    """The `budget` ids from the cursor on, around the end, of rows (nth from 0, id)."""
    return ids.where(F.pmod(F.col("nth") - F.lit(cursor), F.lit(total)) < budget)


def scan_until_known(rows: DataFrame, page: int, streak: int) -> DataFrame:
    """Pages of a newest-first scan (nth from 0, is_new), up to the `streak`-th page in a row without anything new."""
    pages = rows.groupBy(F.floor(F.col("nth") / page).alias("page")).agg(F.count_if("is_new").alias("fresh"))
    # The scan stops `streak` pages behind the first page with something new that no other such page follows in time;
    # the page before the first counts as one. Pages are only matched with their near neighbours, so none are put in one order.
    seen = pages.where("fresh > 0").select("page").unionByName(rows.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("page")))
    followed = seen.select(F.explode(F.sequence(F.col("page") - streak, F.col("page") - 1)).alias("page"))
    stop = seen.join(followed, "page", "left_anti").agg((F.min("page") + streak).alias("stop"))
    return pages.crossJoin(F.broadcast(stop)).where("page <= stop").select("page", "fresh")  # one row


def with_outcome(runs: DataFrame, outcomes: DataFrame, at: str, fields: tuple[str, ...]) -> DataFrame:
    """Runs whose fields are taken from the newest outcome, where that has a run's very time and the field is given; others stay as they are."""
    newest = outcomes.orderBy(F.desc(at)).limit(1).select(F.col(at).alias("__at"), *(F.col(f).alias(f"__{f}") for f in fields))
    both = runs.join(F.broadcast(newest), F.col(at) == F.col("__at"), "left")  # one row
    told = {f: F.coalesce(f"__{f}", f) if f in runs.columns else F.col(f"__{f}") for f in fields}
    return both.withColumns(told).drop("__at", *(f"__{f}" for f in fields))


def export_pages(rows: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """page (from 0), key and value of an export in pages of `size` rows, the greatest value first, then the least key.

    An error, and no page, where a key is missing or repeated or a value is negative: such an export would be incomplete.
    """
    from recordlake.operators.scans import ranking

    problem = F.when(F.col(key).isNull(), "a row without a key").when(F.col("__n") > 1, F.concat(F.lit("repeated key "), F.col(key).cast("string"))).when(F.coalesce(F.col(value), F.lit(-1)) < 0, F.concat(F.lit("bad value of "), F.col(key).cast("string")))
    once = rows.groupBy(key).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("__n"))
    checked = once.withColumn(value, F.when(problem.isNull(), F.col(value)).otherwise(F.raise_error(problem).cast(once.schema[value].dataType))).drop("__n")
    ranked = ranking(checked.withColumn("__all", F.lit(0)), "__all", value, key)
    return ranked.select(F.floor((F.col("rank") - 1) / size).alias("page"), key, value)
