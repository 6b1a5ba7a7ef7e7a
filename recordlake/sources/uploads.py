"""Uploaded exports: compressed or plain bytes, containers of several shapes, and wrapped payloads."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed keys under which an export may hold its rows, and a row its payload, in the order in which they count; and keys that make an export a row itself.
CONTAINERS = ("savedCopies", "bots", "records", "items", "snapshots")
WRAPPERS = ("snapshot", "savedCopy", "character", "bot", "record")
ROW_IDS = ("character_id", "characterId", "botId", "id")
#: Fixed number of wrappers that are looked through.
DEPTH = 4
MAGIC = b"\x1f\x8b"


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of bytes that are gzip, told by their first two, or plain; null for what is neither text nor whole."""

    def one(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else (gzip.decompress(raw) if raw[:2] == MAGIC else raw).decode()
        except (OSError, EOFError, UnicodeDecodeError):
            return None

    return content.map(one)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each uploaded file."""
    return spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("text"))


def _inner(v: Column, key: str, *kinds: str) -> Column:
    """What a variant holds under a key, if it is of one of the kinds."""
    x = F.try_variant_get(v, f"$.{key}", "variant")
    kind = F.schema_of_variant(x)
    return F.when(F.coalesce(*(F.when(kind.startswith(k), True) for k in kinds), F.lit(False)), x)


def unwrapped(v: Column, depth: int = DEPTH) -> Column:
    """The payload below up to `depth` wrappers: the first wrapper key that holds an object, else the value itself."""
    for _ in range(depth):
        v = F.coalesce(*(_inner(v, k, "OBJECT") for k in WRAPPERS), v)
    return v


def contained(uploads: DataFrame, text: str = "text") -> DataFrame:
    """The columns of `uploads` with pos, payload: the rows of a list, or of the first of CONTAINERS that is a list or map; an object with an id is one row."""
    keep = [c for c in uploads.columns if c != text]
    v, kind = F.col("v"), F.schema_of_variant("v")
    own = uploads.select(*keep, F.try_parse_json(text).alias("v")).where("v is not null")
    held = F.coalesce(F.when(kind.startswith("ARRAY"), v), *(_inner(v, k, "ARRAY", "OBJECT") for k in CONTAINERS))
    has_id = F.coalesce(*(F.when(F.try_variant_get(v, f"$.{k}", "variant").isNotNull(), True) for k in ROW_IDS), F.lit(False))
    own = own.select(*keep, "v", held.alias("c"), has_id.alias("single"))
    rows = F.coalesce(F.try_variant_get("c", "$", "array<variant>"), F.map_values(F.try_variant_get("c", "$", "map<string,variant>")))
    rows = F.when(F.col("c").isNotNull(), rows).when(F.col("single"), F.array("v"))
    return own.select(*keep, F.posexplode(rows).alias("pos", "row")).select(*keep, "pos", unwrapped(F.col("row")).alias("payload"))
