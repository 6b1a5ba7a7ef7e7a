"""Scans and merges of record sources: ranking, keyset pages, journals, locators, surfaces, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking(rows: DataFrame, listing: str, value: str, tie: str) -> DataFrame:
    """rank (from 1) of each row in its listing: the greatest value first, then the least `tie`.

    Listings are few and long, so only their histograms of values are summed up in order; rows are numbered among those of
    one value.
    """
    counts = rows.groupBy(listing, value).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(listing).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(listing).alias("__l"), F.col(value).alias("__v"), F.coalesce(before, F.lit(0)).alias("__before"))
    both = rows.join(counts, F.col(listing).eqNullSafe(F.col("__l")) & F.col(value).eqNullSafe(F.col("__v")))
    nth = F.row_number().over(Window.partitionBy(listing, value).orderBy(tie))
    return both.withColumn("rank", (F.col("__before") + nth).cast("int")).drop("__l", "__v", "__before")


def ranking_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose rank is new or moved; a row that left has no rank."""
    both = before.withColumnRenamed("rank", "old").join(after.withColumnRenamed("rank", "new"), keys, "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def keyset_page(rows: DataFrame, key: str, cursor: object, size: int) -> DataFrame:
    """The next `size` rows with a key below the cursor, the greatest first."""
    return rows.where(F.col(key) < cursor).orderBy(F.desc(key)).limit(size)


def ordered_distinct(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First place of each key; rows without a key all stay."""
    named = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("o")).select(key, "o.*")
    return named.unionByName(rows.where(F.col(key).isNull()).select(key, *order))


def journal_latest(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Last value of each key in journal order: replaying rows twice changes nothing."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def accumulate_surfaces(rows: DataFrame, key: str, surface: str, order: str) -> DataFrame:
    """Surfaces that showed each key, in order of first sight."""
    first = rows.groupBy(key, surface).agg(F.min(order).alias("first"))
    seen = F.array_sort(F.collect_list(F.struct("first", surface)))
    return first.groupBy(key).agg(F.array_join(F.transform(seen, lambda x: x[surface]), ",").alias("surfaces"))


def upsert(prior: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of both, incoming ones in place of prior ones with their key. Idempotent."""
    return incoming.unionByName(prior.join(incoming.select(key), key, "left_anti"))


def has_more(found: Column, page: Column, size: Column, received: Column) -> Column:
    return found > (page - 1) * size + received


def delete_plan(rows: DataFrame, key: str, protected: DataFrame, allowed: Column) -> DataFrame:
    """Keys that may be deleted: allowed and not protected. Only a plan; nothing is deleted."""
    return rows.where(allowed).join(protected, key, "left_anti").select(key)


def dedupe_by_hash(rows: DataFrame, text: str, key: str) -> DataFrame:
    """sha, first key and number of rows of each distinct text."""
    return rows.groupBy(F.sha2(F.col(text), 256).alias("sha")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
