"""Observation history: changes against what all sources knew, ever-seen labels, merged change streams, versions, late imports.

Observations are documents, one row per leaf path: entity_id, source, at, path, value (null: there but empty). A source's
document of one time is all its rows of that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leaf(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def observe(rows: DataFrame, text_leaves: tuple[str, ...], volatile: tuple[str, ...]) -> DataFrame:
    """entity_id, source, at, path, kind, from, to of each change; documents are folded in order of (at, source).

    value: differs from the last value that any source gave; an entity's first document is a baseline. hidden-or-empty: the
    source's document before had a value, this one has the path without. hidden-or-missing: it lacks the path, which is
    one of `text_leaves`. Volatile leaves never change, and nothing erases what was known.
    """
    at = F.struct("at", "source")
    documents = rows.select("entity_id", "source", "at").distinct()
    next_at = F.lead("at").over(Window.partitionBy("entity_id", "source").orderBy("at"))
    documents = documents.withColumns({"next_at": next_at, "created": F.min(at).over(Window.partitionBy("entity_id")) == at})
    per_path = Window.partitionBy("entity_id", "path").orderBy("at", "source").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.where(~leaf(F.col("path")).isin(*volatile)).join(documents, ["entity_id", "source", "at"])
    own = own.withColumn("known", F.last("value", ignorenulls=True).over(per_path))
    moved = own.where("value is not null and not created").where(~F.col("value").eqNullSafe(F.col("known")))
    moved = moved.select("entity_id", "source", "at", "path", F.lit("value").alias("kind"), F.col("known").alias("from"), F.col("value").alias("to"))
    here = Window.partitionBy("entity_id", "source", "path").orderBy("at")
    after = own.withColumns({"path_at": F.lead("at").over(here), "path_value": F.lead("value").over(here)}).where("value is not null and next_at is not null")
    there = F.coalesce(F.col("path_at") == F.col("next_at"), F.lit(False))
    kind = F.when(there & F.col("path_value").isNull(), "hidden-or-empty").when(~there & leaf(F.col("path")).isin(*text_leaves), "hidden-or-missing")
    hidden = after.select("entity_id", "source", F.col("next_at").alias("at"), "path", kind.alias("kind"), F.col("value").alias("from"), F.lit(None).cast(rows.schema["value"].dataType).alias("to"))
    return moved.unionByName(hidden.where("kind is not null"))


def ever_labels(rows: DataFrame) -> DataFrame:
    """entity_id, key, label: labels that any source ever gave, without regard to case; the first by (rank of source, pos) names it."""
    text = F.trim(F.regexp_replace("label", r"\s+", " "))
    own = rows.select("entity_id", "rank", "pos", text.alias("label")).where("label <> ''")
    return own.groupBy("entity_id", F.lower("label").alias("key")).agg(F.min_by("label", F.struct("rank", "pos", "label")).alias("label"))


def union_once(parts: list[DataFrame], signature: list[str]) -> DataFrame:
    """Rows of all parts, one per signature: of several the one of the earliest part."""
    all_ = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        all_ = all_.unionByName(p.withColumn("part", F.lit(i)))
    rest = [c for c in parts[0].columns if c not in signature]
    kept = all_.groupBy(*signature).agg(F.min_by(F.struct(*rest, F.lit(0).alias("_")), "part").alias("r"))
    return kept.select(*(F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in parts[0].columns))


def merge_changes(fields: DataFrame, metrics: DataFrame, metric_path: str) -> DataFrame:
    """Field changes and metric transitions (entity_id, at, path, from, to); rows of the metric's path count once by what they say, others all stay."""
    both = fields.unionByName(metrics)
    own = F.col("path") == metric_path
    return both.where(~own).unionByName(both.where(own).dropDuplicates(["entity_id", "at", "from", "to"]))


def unresolved_candidates(activity: DataFrame) -> DataFrame:
    """entity_id, candidate_at of entities whose newest lifecycle event is a deletion with a restore candidate behind it."""
    at = F.struct("at", "pos")
    candidate = F.col("type") == "restore-candidate"
    own = activity.groupBy("entity_id").agg(F.max_by("type", F.when(~candidate, at)).alias("state"), F.max(F.when(~candidate, at)).alias("state_at"), F.max(F.when(candidate, at)).alias("c"))
    return own.where("state = 'deleted' and c > state_at").select("entity_id", F.col("c.at").alias("candidate_at"))


def snapshot_changes(rows: DataFrame, fields: list[str], lists: list[str]) -> DataFrame:
    """entity_id, at, field, from, to of what differs from the entity's snapshot before, which the first has not.

    A list is told by its size and the first 12 digits of the SHA-256 of its JSON.
    """
    order = Window.partitionBy("entity_id").orderBy("at", "pos")
    told = {f: F.col(f).cast("string") for f in fields}
    told |= {f: F.concat_ws(":", F.size(f).cast("string"), F.left(F.sha2(F.to_json(f), 256), F.lit(12))) for f in lists}
    own = rows.select("entity_id", "at", "pos", *(c.alias(f) for f, c in told.items()))
    own = own.withColumns({"nth": F.row_number().over(order), **{f"{f}_before": F.lag(f).over(order) for f in told}}).where("nth > 1")
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_before").alias("from"), F.col(f).alias("to")) for f in told))
    return own.select("entity_id", "at", "pos", F.inline(pairs)).where("not (from <=> to)")


def versions(rows: DataFrame, carried: str, fields: list[str]) -> DataFrame:
    """entity_id, at, pos, digest of snapshots that differ from the one before; an empty `carried` field keeps its last value."""
    order = Window.partitionBy("entity_id").orderBy("at", "pos")
    own = rows.withColumn(carried, F.last(carried, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("digest", F.sha2(F.to_json(F.struct(*sorted([carried, *fields]))), 256))
    own = own.withColumn("before", F.lag("digest").over(order)).where("not (digest <=> before)")
    return own.select("entity_id", "at", "pos", "digest")


def disappeared(known: DataFrame, seen: DataFrame, errors: DataFrame) -> DataFrame:
    """Known entities that a complete pass didn't see; none at all if the pass had errors."""
    failed = errors.limit(1).select(F.lit(True).alias("failed"))
    return known.join(seen, "entity_id", "left_anti").join(F.broadcast(failed), how="left_anti")  # one row at most


def import_snapshots(known: DataFrame, imported: DataFrame) -> DataFrame:
    """entity_id, path, value, filled: what is known, with gaps filled from imports (entity_id, at, path, value), newest first.

    Imports never overwrite, and empty values fill nothing.
    """
    newest = imported.where("value is not null").groupBy("entity_id", "path").agg(F.max_by("value", F.struct("at", "value")).alias("incoming"))
    both = known.join(newest, ["entity_id", "path"], "full")
    return both.select("entity_id", "path", F.coalesce("value", "incoming").alias("value"), F.col("value").isNull().alias("filled"))


def seen_span(known: DataFrame, imported: DataFrame) -> DataFrame:
    """entity_id, first_seen, last_seen over records and imports; unreadable times count for nothing."""
    times = known.select("entity_id", "at").unionByName(imported.select("entity_id", "at"))
    return times.groupBy("entity_id").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
