"""What filters remove together: counts of failure masks, their subset-zeta transform, and every order of the filters.

Each document's failures are one bit mask. Summing a part's counts over the subsets of a mask (the zeta transform) gives at
once how many documents survive any set of filters, so a step of an order is the difference of two neighbouring sets, and
so are the labelled documents that it loses. Texts are read once; afterwards only rows of an id, a digest and a mask move.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, documents

#: Filters in the order of their bits. A to D are told by the text alone, E by the texts of smaller doc_ids.
FILTERS = "ABCDE"
_N = len(FILTERS)
_ALL = (1 << _N) - 1
_E = 1 << FILTERS.index("E")
_BLANKS = " \t\n\x0b\x0c\r"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: under 100 words, few distinct words, many capitals, a symbol."""
    bare = F.trim(text, F.lit(_BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents fail exactly the filters of the mask, and how many of those carry a label.

    A document fails E if a smaller doc_id has the same text (by SHA-256). A group of equal texts is never gathered: rows are
    counted by text and id, then by text alone, where only the least id matters.
    """
    d = documents(docs, ("lang",)).select("doc_id", F.coalesce("carry_0", F.lit("")).alias("part"), text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = cut(d).groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("q"), (F.col("toxic") == 1).cast("int").alias("x"))
    marks = marks.where("doc_id is not null").groupBy("doc_id").agg(F.max("q").alias("q"), F.max("x").alias("x"))
    marked = rows.where("doc_id is not null").join(marks, "doc_id", "left").select("doc_id", "digest", "part", "mask", "n", F.coalesce("q", F.lit(0)).alias("q"), F.coalesce("x", F.lit(0)).alias("x"))
    texts = marked.groupBy("digest", "part", "mask", "q", "x").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    split = texts.select("part", "q", "x", "mask", "n", firsts.alias("firsts")).select(
        "part", "q", "x", F.inline(F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + _E).alias("mask"), (F.col("n") - F.col("firsts")).alias("n"))))
    )
    unnamed = rows.where("doc_id is null").select("part", F.lit(0).alias("q"), F.lit(0).alias("x"), "mask", "n")
    return split.unionByName(unnamed).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("q")).alias("good"), F.sum(F.col("n") * F.col("x")).alias("toxic"))


def survivors(cells: DataFrame) -> DataFrame:
    """part and arrays n, good, toxic: at index s the documents that fail none of the filters in set s (set 0: all)."""
    masks = F.sequence(F.lit(0), F.lit(_ALL))
    by_mask = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("cells"))

    def zeta(name: str) -> Column:
        dense = F.transform(masks, lambda m: F.coalesce(F.try_element_at("cells", m)[name], F.lit(0).cast("bigint")))
        bits = F.array(*(F.lit(1 << i) for i in range(_N)))
        below = F.aggregate(bits, dense, lambda a, bit: F.transform(a, lambda v, i: v + F.when(i.bitwiseAND(bit) > 0, F.get(a, i - bit)).otherwise(0)))
        return F.transform(masks, lambda s: F.get(below, F.lit(_ALL) - s)).alias(name)

    return by_mask.select("part", zeta("n"), zeta("good"), zeta("toxic"))


def _steps() -> str:
    """All steps of all orders, as JSON."""
    rows = []
    for order in permutations(range(_N)):
        before = 0
        for step, i in enumerate(order, 1):
            rows.append({"filter_order": "".join(FILTERS[j] for j in order), "step": step, "bit": 1 << i, "before": before})
            before |= 1 << i
    return json.dumps(rows)


def order_audit(alive: DataFrame) -> DataFrame:
    """Each part's rows for all orders and steps, from its `survivors`."""
    factorial = [1, 1, 2, 6, 24]
    weights = F.array(*(F.lit(factorial[k] * factorial[_N - 1 - k]).cast("bigint") for k in range(_N)))
    n = F.col("n")

    def shapley(bit: Column) -> Column:
        """Removed by the filter, summed over all orders: a set of others that came before stands for |set|! (4 - |set|)! orders."""
        removed = lambda s: F.get(weights, F.bit_count(s)) * (F.get(n, s) - F.get(n, s + bit))
        others = F.filter(F.sequence(F.lit(0), F.lit(_ALL)), lambda s: s.bitwiseAND(bit) == 0)
        return F.aggregate(others, F.lit(0).cast("bigint"), lambda a, s: a + removed(s))

    values = alive.withColumn("shapleys", F.array(*(shapley(F.lit(1 << i)) for i in range(_N))))
    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order string, step int, bit int, before int>>")
    rows = values.select("*", F.inline(steps))
    bit, before = F.col("bit"), F.col("before")
    at = lambda name, s: F.get(F.col(name), s)
    lost = lambda name: at(name, before) - at(name, before + bit)
    return rows.select(
        "part",
        "filter_order",
        "step",
        at("n", before + bit).alias("kept"),
        lost("n").alias("removed"),
        (at("n", F.lit(0)) - at("n", bit) - lost("n")).alias("redundant"),
        (at("n", F.lit(_ALL) - bit) - at("n", F.lit(_ALL))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapleys", F.log2(bit).cast("int")).alias("shapley"),
    )


def op13_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each lang (null: empty), all 120 orders of the filters and each step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null text is empty, and fails A alone. Repeated rows count each; equal rows of one doc_id are not each other's copies. A
    row without doc_id has no label, fails E never and makes none fail it. Repeated labels of an id count as one that has each
    mark any of them has; null marks are none. Columns other than doc_id, text and lang are ignored. An empty table gives no rows.
    """
    return order_audit(survivors(failure_counts(docs, labels)))
