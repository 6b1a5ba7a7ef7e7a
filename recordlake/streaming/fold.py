"""Streaming folds of observations: last-known state, deletion confirmation, rate limits and receipts.

States are keyed by entity and hold only what the next decision needs. Late rows are always admitted, so there is
no watermark; each fold's result doesn't depend on the order in which a batch's rows arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recordlake.operators.temporal import last_known


#: Batches after which the deltas since the last base are merged into a new one.
COMPACT_EVERY = 16


def merge_last_known(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> None:
    """Folds a stream of entity_id, pos, at, path, k into a table of the newest value per key, and waits for its end.

    A batch writes one row per key it has, as a delta under its number, so its work follows the batch and not the table; a
    repeated batch overwrites its own delta. Now and then deltas are merged into a base, and what the base before covers goes.
    """

    def fold(batch: DataFrame, number: int) -> None:
        own = batch.where("k is not null").groupBy("entity_id", "path").agg(F.max_by("k", F.struct("at", "pos")).alias("k"), F.max(F.struct("at", "pos")).alias("seen"))
        own.select("entity_id", "path", "k", F.col("seen.at").alias("at"), F.col("seen.pos").alias("pos")).write.mode("overwrite").parquet(f"{out}/delta/batch={number}")
        if (number + 1) % compact_every == 0:
            _merged(spark, out, number).write.mode("overwrite").parquet(f"{out}/base/batch={number}")
            _drop_covered(spark, out, number)

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _drop_covered(spark: SparkSession, out: str, base: int) -> None:
    """Removes what the base before `base` covers: its deltas and older bases. The newest two generations stay, for those who read now."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(out).getFileSystem(spark._jsc.hadoopConfiguration())
    found = {kind: {int(f.getPath().getName().split("=")[1]): f.getPath() for f in files.listStatus(hadoop(f"{out}/{kind}")) if f.getPath().getName().startswith("batch=")} for kind in ("base", "delta")}
    before = max((n for n in found["base"] if n < base), default=None)
    if before is not None:
        for path in [p for n, p in found["delta"].items() if n <= before] + [p for n, p in found["base"].items() if n < before]:
            files.delete(path, True)


def _merged(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """Newest value per key of the newest base below batch `before` and the deltas behind it."""
    rows, base = spark.read.parquet(f"{out}/delta"), None
    try:
        bases = spark.read.parquet(f"{out}/base")
        bases = bases if before is None else bases.where(F.col("batch") < before)
        base = bases.agg(F.max("batch")).head()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    if base is not None:
        rows = rows.where(F.col("batch") > base).unionByName(bases.where(F.col("batch") == base))
    newest = rows.groupBy("entity_id", "path").agg(F.max_by(F.struct("k", "at", "pos"), F.struct("at", "pos")).alias("n"))
    return newest.select("entity_id", "path", "n.*")


def read_merged(spark: SparkSession, out: str) -> DataFrame:
    """The table as of the newest batch."""
    return _merged(spark, out)


def confirm_deletions(stream: DataFrame, needed: int = 2) -> DataFrame:
    """entity_id, count, confirmed after each batch: not-found checks of different runs; a success clears the count.

    `stream`: entity_id, run, pos, code. A run counts once; other codes change nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, "")
        for r in pd.concat(list(frames)).sort_values("pos").itertuples():
            if r.code == 200:
                count, last = 0, ""
            elif r.code == 404 and r.run != last:
                count, last = count + 1, r.run
        state.update((count, last))
        yield pd.DataFrame({"entity_id": [key[0]], "count": [count], "confirmed": [count >= needed]})

    return stream.groupBy("entity_id").applyInPandasWithState(step, "entity_id bigint, count int, confirmed boolean", "count int, last string", "update", GroupStateTimeout.NoTimeout)


def rate_limited(stream: DataFrame, allowed: int = 6, hours: int = 24, chunks: int = 12) -> DataFrame:
    """entity_id, pos, accepted: events within the limit of accepted ones per sliding span; a known group's chunk costs nothing.

    `stream`: entity_id, pos, t (seconds), grp. Only accepted events count, and state holds at most `allowed` groups.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [list(x) for x in zip(*state.get, strict=True)] if state.exists else []
        out = []
        for r in pd.concat(list(frames)).sort_values(["t", "pos"]).itertuples():
            held = [h for h in held if h[0] > r.t - hours * 3600]
            known = next((h for h in held if h[1] == r.grp), None)
            if known:
                ok = known[2] < chunks
                known[2] += ok
            else:
                ok = len(held) < allowed
                if ok:
                    held.append([r.t, r.grp, 1])
            out.append((key[0], r.pos, bool(ok)))
        state.update(tuple(map(list, zip(*held, strict=True))) if held else ([], [], []))
        yield pd.DataFrame(out, columns=["entity_id", "pos", "accepted"])

    return stream.groupBy("entity_id").applyInPandasWithState(step, "entity_id bigint, pos bigint, accepted boolean", "t array<bigint>, grp array<string>, n array<int>", "append", GroupStateTimeout.NoTimeout)


def import_once(spark: SparkSession, bundles: DataFrame, receipts: str) -> DataFrame:
    """Bundles (sha, ...) without a receipt; `leave_receipts` writes theirs after they are merged."""
    try:
        known = spark.read.parquet(receipts).select("sha")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return bundles.dropDuplicates(["sha"])
        raise
    return bundles.dropDuplicates(["sha"]).join(known, "sha", "left_anti")


def leave_receipts(bundles: DataFrame, receipts: str) -> None:
    bundles.select("sha").distinct().write.mode("append").parquet(receipts)


def skip_unchanged(incoming: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Rows (id, hash) whose hash isn't the stored one of their id."""
    return incoming.join(fingerprints.select("id", "hash"), ["id", "hash"], "left_anti")


def parity(batch: DataFrame, merged: DataFrame) -> DataFrame:
    """Keys on which a streaming fold and the batch operator differ."""
    a = last_known(batch).select("entity_id", "path", F.col("k").alias("want"))
    return a.join(merged.select("entity_id", "path", F.col("k").alias("got")), ["entity_id", "path"], "full").where("not (want <=> got)")
