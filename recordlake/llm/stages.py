"""Stages of the pipeline. Each takes (spark, docs, sf_dir); all but the last return the columns of documents.

Null texts count as empty. Rows without a doc_id can't be named by a decision about documents: near-duplicates
and suffix dedup let them pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .decontamination import decontaminate
from .near_sets import near_sets
from .packing import pack, pieces
from .quality import quality
from .suffix_dedup import remove_repeats


def _with_text(docs: DataFrame, changed: DataFrame, carry: tuple[str, ...], text) -> DataFrame:  # noqa: ANN001
    """The columns of `docs` from a result that carried them along, with a new text and its n_chars."""
    names = {c: F.col(f"carry_{i}") for i, c in enumerate(carry)} | {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in docs.columns:
        names["n_chars"] = F.length(text).cast("bigint")
    return changed.select(*(names[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of those kept, the lines that failed a rule are removed."""
    carry = _others(docs)
    own = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)))
    return _with_text(docs, quality(own).where("kept"), carry, F.col("clean_text"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose five-word shingles are similar by 0.8 or more are one group, as are groups that share a document.

    Of each group the row with the least doc_id, and of its texts the least hash of the row, stays once; equal rows stay once.
    """
    # Rows travel as a whole in one column, so that no column of theirs can clash with a helper's.
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.col("doc_id"), F.col("text"), F.xxhash64(*columns).alias("row_hash"), F.struct(*columns).alias("row"))
    rows = near_sets(keyed.drop("row"), ("row_hash",)).where("doc_id is not null").withColumnRenamed("carry_0", "row_hash")
    least = rows.groupBy("component").agg(F.min(F.struct("doc_id", "row_hash")).alias("least")).select("least.*")
    # The list of those that stay grows with the corpus, so it is never broadcast; hashed, as texts need no sort for this.
    kept = keyed.drop("text").join(least.hint("shuffle_hash"), ["doc_id", "row_hash"], "left_semi")
    twice = rows.groupBy("doc_id", "row_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if twice.join(least, ["doc_id", "row_hash"], "left_semi").head(1):
        kept = kept.dropDuplicates(["doc_id", "row_hash"])
    return kept.select("row.*").unionByName(docs.where("doc_id is null")).select(*columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has too are cut out of the text; halves of characters go with them."""
    carry = _others(docs)
    removed = remove_repeats(docs, carry)
    text = F.try_validate_utf8(F.col("kept").cast("string"))
    changed = removed.withColumn("text", F.coalesce(text, F.make_valid_utf8(F.col("kept").cast("string"))))
    return _with_text(docs, changed, carry, F.when(text.isNotNull(), text).otherwise(F.replace("text", F.lit("�"), F.lit(""))))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark windows and what stands between them are cut out of the text."""
    carry = _others(docs)
    cleaned = decontaminate(docs, table(spark, sf_dir, "benchmark"), clean=True, carry=carry)
    return _with_text(docs, cleaned, carry, F.col("clean_text"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts with their sequence and place."""
    return pack(cut(pieces(docs)))
