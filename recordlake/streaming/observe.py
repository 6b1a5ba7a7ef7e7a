"""Per-entity fold of an observation stream: last-known leaves, each source's newest document, metrics and status in one state.

Documents may arrive in any order and split over batches. They wait in the entity's state until the watermark has passed
their time; a timer then folds them in order of (at, source), so the events are those of the batch operators. What arrives
later than the watermark allows is dropped by Spark and belongs to the import of late snapshots (`history.import_snapshots`).

A call of the state costs far more than a row, so what an entity's fold knows is one value, a batch's rows wait as one item, and an
entity has one timer a batch, for the earliest time that waits, and not one per time: what the watermark has passed is folded
by the first that goes off. Times are whole microseconds, as in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keeps state with list variables.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EVENTS = "entity_id bigint, source string, at timestamp, path string, kind string, `from` string, `to` string"
_FOLDED = EVENTS.replace("at timestamp", "us bigint")
_EVENT = Row("entity_id", "source", "us", "path", "kind", "from", "to")


class ObservationFold(StatefulProcessor):
    """Rows (entity_id, source, at, path, value, us): one per leaf of a document; value null is there but empty, us is at in microseconds.

    Events by kind: value, hidden-or-empty and hidden-or-missing, as `history.observe` has them; metric: a leaf of `metrics`
    has another value than before; new, deleted, restored and restore-candidate: a document with a value of `gone_leaf` tells
    of a deletion, and only the source `verifier` brings a deleted entity back, others make it a candidate.
    """

    def __init__(self, text_leaves: tuple[str, ...], volatile: tuple[str, ...], metrics: tuple[str, ...], gone_leaf: str, verifier: str) -> None:
        self.text_leaves, self.volatile, self.metrics, self.gone_leaf, self.verifier = text_leaves, volatile, metrics, gone_leaf, verifier

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us array<bigint>, source array<string>, path array<string>, value array<string>")
        leaves = "map<string, string>"
        self.known = handle.getValueState("known", f"status string, since bigint, known {leaves}, latest {leaves}, current map<string, {leaves}>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        self.wait([(r.us, r.source, r.path, r.value) for r in rows])
        return iter(())

    def wait(self, rows: list[tuple]) -> None:
        """A timer goes off when the watermark is beyond it, so a time with parts of a millisecond needs the next one."""
        self.waiting.appendValue(tuple(map(list, zip(*rows, strict=True))))
        self.handle.registerTimer(-(-min(r[0] for r in rows) // 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        until = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = [], []
        for item in self.waiting.get():
            for row in zip(*item, strict=True):
                (ready if row[0] <= until else later).append(row)
        if ready:
            self.waiting.clear()
            if later:
                self.wait(later)
            for event in self.fold(sorted(ready, key=lambda r: r[:3])):
                yield _EVENT(key[0], *event)

    def fold(self, rows: list[tuple]) -> Iterator[tuple]:
        status, since, known, latest, current = self.known.get() or (None, None, {}, {}, {})
        for (at, source), group in groupby(rows, key=lambda r: r[:2]):
            own = {}
            for _, _, path, value in group:
                own[path] = value if own.get(path) is None else max(own[path], value or own[path])
            before = current.get(source, {})
            for path, value in own.items():
                if path.rsplit(".", 1)[-1] in self.volatile:
                    continue
                if value is not None and known.get(path) != value:
                    if status:
                        yield source, at, path, "value", known.get(path), value
                elif value is None and before.get(path) is not None:
                    yield source, at, path, "hidden-or-empty", before[path], None
            for path, value in before.items():
                leaf = path.rsplit(".", 1)[-1]
                if path not in own and value is not None and leaf in self.text_leaves and leaf not in self.volatile:
                    yield source, at, path, "hidden-or-missing", value, None
            current[source] = own
            known |= {p: v for p, v in own.items() if v is not None}
            for path, value in own.items():
                if path.rsplit(".", 1)[-1] in self.metrics and value is not None and latest.get(path) != value:
                    yield source, at, path, "metric", latest.get(path), value
                    latest[path] = value
            gone = any(v is not None and p.rsplit(".", 1)[-1] == self.gone_leaf for p, v in own.items())
            kind, now = self.turned(status, gone, source)
            if kind:
                yield source, at, "status", kind, status, now
                status, since = (now, at) if now else (status, since)
        self.known.update((status, since, known, latest, current))

    def turned(self, status: str | None, gone: bool, source: str) -> tuple[str | None, str | None]:
        """The event of a document, and the status it leads to."""
        if gone:
            return ("deleted", "deleted") if status != "deleted" else (None, None)
        if status == "deleted":
            return ("restored", "public") if source == self.verifier else ("restore-candidate", None)
        return (None, None) if status else ("new", "public")

    def close(self) -> None:
        pass


def observe_stream(stream: DataFrame, fold: ObservationFold, lateness: str) -> DataFrame:
    """Events of a stream of observations; `lateness` is how far behind the newest time a row may come."""
    rows = stream.withWatermark("at", lateness).select("entity_id", "source", "at", "path", "value", F.unix_micros("at").alias("us"))
    events = rows.groupBy("entity_id").transformWithState(fold, _FOLDED, "Append", "EventTime")
    return events.select("entity_id", "source", F.timestamp_micros("us").alias("at"), "path", "kind", "from", "to")


def fold_files(spark: SparkSession, stream: DataFrame, fold: ObservationFold, lateness: str, out: str, checkpoint: str) -> DataFrame:
    """Runs the fold over what there is of a stream and returns the events written to `out`, which all executors share."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        events = observe_stream(stream, fold, lateness)
        events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(EVENTS).parquet(out)


def closing_row(rows: DataFrame, lateness: str) -> DataFrame:
    """A row without an entity so late that the watermark passes all others: the end of a stream that is known to be complete."""
    end = F.max("at") + F.expr(f"INTERVAL {lateness}") + F.expr("INTERVAL 1 DAY")
    ends = rows.agg(end.alias("at"))
    return ends.select(*(F.col("at") if c == "at" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns)).where("at is not null")
