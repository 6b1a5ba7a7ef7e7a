"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.session import shared_dir

#: Has Spark delete the shuffle files of an action when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch, all of which a Python worker holds at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts its lineage. Shuffle files go with the write; `drop` removes the rest.

    `rows` bounds Arrow batches of whole texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    before, batch = spark.conf.get(CLEANUP, None), spark.conf.get(BATCH)
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(rows or batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before or "false")
        spark.conf.set(BATCH, batch)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Remove what `cut` has written, once nothing that is still to be computed reads it."""
    for df in cuts:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text, so that other columns can't clash; null text is empty. Columns to carry along become carry_0, ..."""
    also = [F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)]
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *also)


def carried(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("carry_")]


def carried_schema(df: DataFrame) -> str:
    """The carried columns' part of a schema text."""
    return "".join(f", {f.name} {f.dataType.simpleString()}" for f in df.schema if f.name.startswith("carry_"))


#: ASCII white space, the word separator of the white-space word rule.
SPACE = "\\x20\\x09-\\x0D"

#: Bytes of the alphanumeric word rule (0-9, a-z, non-ASCII) stay; all others become a blank.
_ALNUM = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def alnum_words(text: str) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_ALNUM).split()


def space_words(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def nullable_ints(values: pd.Series) -> pd.Series:
    """A column of ids that may hold nulls, as pandas' nullable integers."""
    return values.astype("Int64")


def slices(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Arrow batches cut to at most `rows` rows."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows].reset_index(drop=True)


def by_key(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a stream that is sorted by `keys`, holding one group and one batch at a time."""
    rest: pd.DataFrame | None = None
    for frame in frames:
        if not len(frame):
            continue
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        values = frame[keys].to_numpy()
        change = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        starts = [0, *change.tolist()]
        for a, b in zip(starts, starts[1:], strict=False):
            yield frame.iloc[a:b]
        rest = frame.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield rest
