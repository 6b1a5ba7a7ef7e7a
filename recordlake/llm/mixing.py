"""Mixing of sources to target weights by Efraimidis-Spirakis sampling without replacement.

Every document draws an exponential key, `-ln(u) / w` for its quality weight w, where u comes from its id and text, so
reruns agree. Of a source all complete epochs are taken first; what is left of its budget goes to the documents with the
least keys, whose sizes are summed up in that order. The document at the border gives the words that are still missing.

No source is sorted as a whole: the logarithms of its keys fall into bins, so narrow that each holds some BIN_ROWS rows
whatever the weights (the logarithm of an exponential variable has a density of at most 1/e). Sums by bin show the one bin
in which the budget ends, and only that bin is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, documents, drop

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
CAP = 3
BIN_ROWS = 50_000
SYMBOLS = "[#$%&*|<>{}\\\\]+"
_BLANKS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`: runs of blanks between words are one more than that."""
    bare = F.trim(text, F.lit(_BLANKS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"[{SPACE}]+"))).cast("bigint")


def quality_weight(text: Column, size: Column) -> Column:
    """0.0125 to 1: less for symbols among the characters, a quarter where words average under 3 or over 12 characters."""
    chars = F.length(text)
    symbols = chars - F.length(F.regexp_replace(text, SYMBOLS, ""))
    mean = F.length(F.regexp_replace(text, f"[{SPACE}]+", "")) / size
    clean = F.greatest(F.lit(0.05), 1 - 10 * symbols / chars)
    return F.when(size > 0, clean * F.when((mean >= 3) & (mean <= 12), 1.0).otherwise(0.25)).otherwise(1.0)


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 over the id and the text's MD5."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def weighted_sources(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, n and weight, by the source's rank in code point order with null last; a written table.

    Sources are ranked within ranges of their names, and ranges by their counts, so many sources need no single task.
    """
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = (F.col("source").isNull(), F.col("source"))
    ranged = cut(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    before = counts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    ranked = ranged.join(before, "part").withColumn("rank", rank)
    out = cut(ranked.select("source", "source_size", "n", F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int")).alias("weight")))
    drop(ranged)
    return out


def water_level(sources: DataFrame, budget: float, cap: int) -> float:
    """Words per weight, so that all sources together take the budget though none takes more than `cap` times its size.

    Each round caps the sources that the level of the round before puts above their cap, until none is added.
    """
    capped, level = -1, 0.0
    while True:
        above = F.col("weight") * F.lit(level) > cap * F.col("source_size") if capped >= 0 else F.lit(False)
        row = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, cap * F.col("source_size"))).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if row.n == capped or not row.weight:
            return level if row.weight else math.inf
        capped, level = row.n, (budget - (row.full or 0)) / row.weight


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """doc_id, source, size, quality, source_size, target and taken for each row of `docs`, whose sources take `share` of all words.

    Null text and texts without words have size 0 and give nothing. Null is a source of its own, the last. Equal rows of one
    id count each; among them the first ones are taken first. An empty table gives no rows. Other columns are left out.
    """
    d = documents(docs, ("source",))
    d = d.select("doc_id", F.col("carry_0").cast("string").alias("source"), "text", n_words(F.col("text")).alias("size"))
    d = d.withColumn("quality", quality_weight(F.col("text"), F.col("size")))
    key = -F.ln(uniform(F.col("doc_id"), F.col("text"))) / F.col("quality")
    rows = d.select("doc_id", "source", "size", "quality", key.alias("key"))
    # Equal rows are one row from here on, so that no number of copies can crowd a bin.
    rows = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")))
    sources = weighted_sources(rows, weights)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, total * share if share != 1 else total, cap)
    full = (cap * F.col("source_size")).cast("double")
    target = F.least(full, F.col("weight") * F.lit(level)) if math.isfinite(level) else full
    quota = F.floor(target + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0)
    bins = F.greatest(F.lit(1.0), F.col("n") / F.lit(math.e * BIN_ROWS))
    sources = sources.withColumns({"target": target, "quota": quota, "bins": bins}).withColumn("epochs", epochs)
    sources = sources.withColumn("rest", F.col("quota") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "of")

    placed = rows.join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn("bin", F.floor(F.ln("key") * F.col("bins")))
    words = placed.where("size > 0 and rest > 0").groupBy("of", "bin", "rest").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    before = F.sum("words").over(Window.partitionBy("of").orderBy("bin")) - F.col("words")
    ends = words.withColumn("before", before).where("before < rest and before + words >= rest")
    ends = ends.select(F.col("of").alias("end_of"), F.col("bin").alias("end_bin"), (F.col("rest") - F.col("before")).alias("left"))
    placed = placed.join(ends, F.col("of").eqNullSafe(F.col("end_of")), "left")

    # Only rows of the bin in which a budget ends need an order.
    last = placed.where("bin = end_bin and size > 0")
    own = Window.partitionBy("of").orderBy("key", "doc_id", "size", "quality").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("at", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(own), F.lit(0)))
    others = placed.where("end_bin is null or bin <> end_bin or size = 0").withColumn("at", F.when(F.col("bin") < F.col("end_bin"), F.lit(None).cast("bigint")).otherwise(F.col("left")))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))
    every = last.unionByName(others).select("*", copies.alias("copy"))
    missing = F.col("left") - F.col("at") - F.col("copy") * F.col("size")
    part = F.when(F.col("end_bin").isNull(), 0).when(F.col("at").isNull(), F.col("size")).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), missing)))
    return every.select("doc_id", "source", "size", "quality", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"))


def op11_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, by the contract's weights; see `mix`."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
