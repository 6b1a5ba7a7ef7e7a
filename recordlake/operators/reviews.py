"""Submissions against existing records, review overlays, catalogue arithmetic and page joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("problem", "new", "exact_duplicate", "changed", "known")


def label_set(labels: Column) -> Column:
    """Labels for comparison: trimmed, lower case, without repeats, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(labels, lambda x: F.lower(F.trim(x))), lambda x: x != "")))


def differing(fields: dict[str, tuple[Column, Column]]) -> Column:
    """Names, in order, of fields whose incoming value is meaningful and isn't the existing one."""
    tests = [F.when(new.isNotNull() & (F.trim(new.cast("string")) != "") & ~new.eqNullSafe(old), F.lit(name)) for name, (new, old) in sorted(fields.items())]
    return F.array_compact(F.array(*tests))


def classify(problems: Column, exists: Column, duplicate: Column, differences: Column) -> Column:
    """problem, new, exact_duplicate, changed or known; the first that holds."""
    return F.when(F.size(problems) > 0, "problem").when(~exists, "new").when(F.coalesce(duplicate, F.lit(False)), "exact_duplicate").when(F.size(differences) > 0, "changed").otherwise("known")


def breakdown(classified: DataFrame) -> DataFrame:
    """One row of counts: total, each class, those with an unavailable history, those safe to import."""
    counts = [F.count_if(F.col("classification") == c).alias(c) for c in CLASSES]
    return classified.agg(F.count(F.lit(1)).alias("total"), *counts, F.count_if("unavailable").alias("unavailable"), F.count_if(~F.col("classification").isin("problem", "exact_duplicate")).alias("safe"))


def ever_unavailable(observed: Column, current: Column, history: Column, states: tuple[str, ...]) -> Column:
    gone = lambda x: F.coalesce(F.lower(F.trim(x)).isin(*states), F.lit(False))
    return gone(observed) | gone(current) | F.coalesce(F.exists(history, gone), F.lit(False))


def valid_annotations(rows: DataFrame, kinds: tuple[str, ...], note_size: int) -> DataFrame:
    """id, kind, note, evidence: the last valid row of each id; notes are cut, evidence that isn't safe https is left out."""
    from recordlake.functions.values import safe_https

    own = rows.where(F.col("id").isNotNull() & F.col("kind").isin(*kinds))
    own = own.withColumns({"note": F.left("note", F.lit(note_size)), "evidence": F.when(safe_https(F.col("evidence")), F.col("evidence"))})
    return own.groupBy("id").agg(F.max_by(F.struct("kind", "note", "evidence"), "pos").alias("r")).select("id", "r.*")


def overlay(cases: DataFrame, published: DataFrame, drafts: DataFrame) -> DataFrame:
    """Cases with their decision: a draft's before a published one's. Decisions of ids that are no case are left out."""
    return cases.join(published.withColumnRenamed("kind", "p"), "id", "left").join(drafts.withColumnRenamed("kind", "d"), "id", "left").withColumn("kind", F.coalesce("d", "p")).drop("d", "p")


def due_lookups(cases: DataFrame, prior: DataFrame, now: Column, retry_days: int, budget: int) -> DataFrame:
    """The `budget` cases to look up: never tried ones first, then those tried at least `retry_days` ago, the oldest first."""
    own = cases.join(prior, "id", "left").where(F.col("tried_at").isNull() | (F.datediff(now, F.col("tried_at")) >= retry_days))
    return own.orderBy(F.asc_nulls_first("tried_at"), "id").limit(budget).select("id", "tried_at")


def sources_by_priority(rows: DataFrame) -> DataFrame:
    """id, source, signals: all signals of an id, and the source of least priority number."""
    own = rows.groupBy("id").agg(F.min_by("source", F.struct("priority", "source")).alias("source"), F.array_sort(F.collect_set("signal")).alias("s"))
    return own.select("id", "source", F.array_join("s", ",").alias("signals"))


def batch_lookup(ids: DataFrame, records: DataFrame, most: int) -> DataFrame:
    """State of the asked ids, at most `most`, each once; UNKNOWN for those without a record."""
    asked = ids.where("id is not null").distinct().orderBy("id").limit(most)
    return asked.join(records, "id", "left").select("id", F.coalesce("state", F.lit("UNKNOWN")).alias("state"))


def reconcile(total: Column, public: Column, deleted: Column) -> dict[str, Column]:
    """What the total lacks or has too much of, never below zero."""
    return {"gap": F.greatest(F.lit(0), total - public - deleted), "surplus": F.greatest(F.lit(0), public + deleted - total)}


def merge_stats(rows: DataFrame, column: str) -> DataFrame:
    """key, total of maps of counters, summed by key."""
    return rows.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def children_of(parents: DataFrame, children: DataFrame, key: str, order: list[Column], fields: list[str]) -> DataFrame:
    """Parents with the number of their children and the first field of each, in a stable order; none gives an empty list."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    own = children.withColumn("nth", nth).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("nth", *fields))).alias("rows"))
    names = F.array_join(F.transform("rows", lambda r: r[fields[0]].cast("string")), ",")
    return parents.join(own, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(names, F.lit("")).alias("children"))


def grouped_by_taxonomy(counts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """grp, label, n with the taxonomy's group of each label, `Other` for those without one."""
    from recordlake.operators.rules import small

    return counts.join(small(taxonomy), "label", "left").select(F.coalesce("grp", F.lit("Other")).alias("grp"), "label", "n")
