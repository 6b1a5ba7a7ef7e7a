"""Tag analytics over entities with labels: frequency, pairs, owners, trends, former tags.

Input rows: entity_id, owner_id, pos, label (null for an entity without labels). An entity counts once per tag, also if
several owners list it: its first owner's listing counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlake.functions.text import collapse, normalize_dictionary
from recordlake.operators.rules import small


def dictionary(labels: DataFrame) -> DataFrame:
    """label, tag of each distinct label: compatibility form, case folded, white space collapsed. Each is folded once."""
    own = normalize_dictionary(labels.where("label is not null").select("label").distinct(), "label", "tag")
    return own.select("label", collapse(F.col("tag")).alias("tag"))


def entity_tags(labels: DataFrame, known: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct entity_id, owner_id, tag with the first label that gave it, of each entity's first owner.

    `known` names the tag of every label, as `dictionary` does; it is made from the labels themselves if it isn't given. `keep`:
    columns that an entity determines. Window and grouping share the shuffle by entity.
    """
    known = dictionary(labels) if known is None else known
    first = labels.withColumn("first_owner", F.min("owner_id").over(Window.partitionBy("entity_id"))).where(F.col("owner_id").eqNullSafe(F.col("first_owner")))
    tagged = first.where("label is not null").join(small(known), "label").where("tag <> ''")
    return tagged.groupBy("entity_id", "owner_id", *keep, "tag").agg(F.min_by("label", F.struct("pos", "label")).alias("label"))


def frequency(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("owner_id").alias("owners"))


def coverage(labels: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: entities, tagged entities, assignments, owners, distinct tags, tags used once."""
    indexed = labels.agg(F.count_distinct("entity_id").alias("indexed"), F.count_distinct("owner_id").alias("owners"))
    used = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    counts = used.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("assignments"), F.count(F.lit(1)).alias("distinct_tags"), F.count_if(F.col("n") == 1).alias("one_use"))
    tagged = tags.agg(F.count_distinct("entity_id").alias("tagged"))
    return indexed.crossJoin(tagged).crossJoin(counts)  # single rows


def pairs(tags: DataFrame) -> DataFrame:
    """Unordered pairs of tags on one entity with their number of entities. Pairs come from each entity's own
    sorted tags, so tags aren't joined with themselves."""
    sets = tags.groupBy("entity_id").agg(F.array_sort(F.collect_set("tag")).alias("t"))
    made = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice(F.col("t"), i + 2, F.size("t")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(made).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def related(pair_counts: DataFrame, tag: str, limit: int) -> DataFrame:
    both = pair_counts.where((F.col("a") == tag) | (F.col("b") == tag))
    other = F.when(F.col("a") == tag, F.col("b")).otherwise(F.col("a"))
    return both.select(other.alias("tag"), "n").orderBy(F.desc("n"), "tag").limit(limit)


def top_owners(tags: DataFrame, per_tag: int) -> DataFrame:
    """Of each tag its owners with most entities."""
    counts = tags.groupBy("tag", "owner_id").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("tag").orderBy(F.desc("n"), "owner_id")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_tag)


def compare(tags: DataFrame, a: str, b: str) -> DataFrame:
    """One row: entities of a, of b, of both, of only one, and both over union."""
    has = tags.groupBy("entity_id").agg(F.bool_or(F.col("tag") == a).alias("a"), F.bool_or(F.col("tag") == b).alias("b"))
    count = lambda c: F.count_if(c)
    out = has.agg(count(F.col("a")).alias("n_a"), count(F.col("b")).alias("n_b"), count(F.col("a") & F.col("b")).alias("n_both"), count(F.col("a") & ~F.col("b")).alias("a_only"), count(F.col("b") & ~F.col("a")).alias("b_only"))
    union = F.col("n_both") + F.col("a_only") + F.col("b_only")
    return out.withColumn("overlap", F.round(F.when(union > 0, F.col("n_both") / union), 6))


def daily_counts(dated: DataFrame, keep: int) -> DataFrame:
    """tag, day, uses of the newest `keep` days. Days are aggregated before they are ranked."""
    counts = dated.groupBy("day", "tag").agg(F.count(F.lit(1)).alias("uses"))
    days = counts.select("day").distinct().orderBy(F.desc("day")).limit(keep)
    return counts.join(F.broadcast(days), "day", "left_semi")


def trend(daily: DataFrame) -> DataFrame:
    """Uses on the last day less uses on the first day of the window; a missing day counts 0."""
    ends = daily.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    both = daily.crossJoin(F.broadcast(ends))  # one row
    use = lambda end: F.coalesce(F.sum(F.when(F.col("day") == F.col(end), F.col("uses"))), F.lit(0))
    return both.groupBy("tag").agg((use("last") - use("first")).alias("delta"))


def former_tags(dated: DataFrame) -> DataFrame:
    """Tags an owner once used but not on the newest entity: owner_id, tag, last_used."""
    newest = dated.groupBy("owner_id").agg(F.max(F.struct("day", "entity_id")).alias("n")).select("owner_id", F.col("n.entity_id").alias("entity_id"))
    now = dated.join(newest, ["owner_id", "entity_id"], "left_semi").select("owner_id", "tag")
    return dated.groupBy("owner_id", "tag").agg(F.max("day").alias("last_used")).join(now, ["owner_id", "tag"], "left_anti")
