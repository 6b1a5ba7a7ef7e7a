"""Leaf paths of JSON objects at any depth, as a function of texts, a DataFrame operator and an SQL table function.

Objects are walked, lists stay whole as JSON. A leaf that is text is given as it is, others as JSON, null as null; an empty object has
no leaves. The walk keeps its own stack, so depth has no bound of its own; what is no JSON object has no leaves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAVES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


def _told(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def leaves(text: str | None) -> Iterator[tuple[str, str | None]]:
    """path and value of each leaf, in the order of the text."""
    try:
        root = json.loads(text or "")
    except (ValueError, RecursionError):
        return
    stack = [("", root)] if isinstance(root, dict) else []
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            stack += [(f"{path}.{k}" if path else k, v) for k, v in reversed(value.items())]
        else:
            yield path, _told(value)


@F.pandas_udf(LEAVES)
def leaf_list(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"path": p, "value": v} for p, v in leaves(t)] for t in texts], dtype=object)


@F.udtf(returnType=T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))
class Leaves:
    """The table function `rl_leaves(json)`."""

    def eval(self, text: str) -> Iterator[tuple[str, str | None]]:
        yield from leaves(text)


@F.pandas_udf(T.StringType())
def consensus(values: pd.Series) -> str | None:
    """The aggregate `rl_consensus(x)`: what all values with something in them agree on, else null."""
    own = {v.strip() for v in values.dropna() if v.strip()}
    return own.pop() if len(own) == 1 else None



def register(spark: SparkSession) -> list[str]:
    """Registers the table function and the aggregate with the session; their names."""
    spark.udtf.register("rl_leaves", Leaves)
    spark.udf.register("rl_consensus", consensus)
    return ["rl_leaves", "rl_consensus"]


def flatten(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, value of each leaf of a column of JSON objects."""
    return rows.select(key, F.inline(leaf_list(F.col(text))))
