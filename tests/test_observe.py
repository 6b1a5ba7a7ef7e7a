"""The observation fold as a stream against the batch operator and against a plain fold."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import Row

from recordlake.operators import history
from recordlake.streaming import observe

SCHEMA = "entity_id bigint, source string, at timestamp, path string, value string"
TEXT, VOLATILE = ("greeting", "scenario"), ("messages", "gone")


def documents() -> list[tuple]:
    rng, out = random.Random(5), []
    for entity in range(4):
        for _ in range(14):
            at = datetime(2024, 1, 1) + timedelta(hours=rng.randrange(60), microseconds=rng.choice([0, 0, 250]))
            source = rng.choice(["api", "listing", "search"])
            leaves = {p: rng.choice([None, "x", "y", "z"]) for p in rng.sample(["a.greeting", "scenario", "b.title", "messages", "gone"], rng.randrange(1, 5))}
            if "gone" in leaves and rng.random() < 0.6:
                leaves["gone"] = None
            if not any((entity, source, at) == (e, s, t) for e, s, t, *_ in out):
                out += [(entity, source, at, p, v) for p, v in leaves.items()]
    return out


def plain_status_and_metrics(rows: list[tuple]) -> set[tuple]:
    out, docs = set(), {}
    for e, s, at, p, v in rows:
        docs.setdefault((e, at, s), {})[p] = v
    status, metric = {}, {}
    for (e, at, s), own in sorted(docs.items()):
        v = own.get("messages")
        if v is not None and v != metric.get(e):
            out.add((e, s, at, "messages", "metric", metric.get(e), v))
            metric[e] = v
        was = status.get(e)
        if own.get("gone") is not None:
            if was != "deleted":
                out.add((e, s, at, "status", "deleted", was, "deleted"))
            status[e] = "deleted"
        elif was == "deleted":
            out.add((e, s, at, "status", "restored" if s == "api" else "restore-candidate", was, "public" if s == "api" else None))
            status[e] = "public" if s == "api" else was
        elif was is None:
            out.add((e, s, at, "status", "new", None, "public"))
            status[e] = "public"
    return out


def test_stream_over_shuffled_batches(spark, tmp_path):
    rows = documents()
    table = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in history.observe(table, TEXT, VOLATILE).select("entity_id", "source", "at", "path", "kind", "from", "to").collect()}
    assert {r[4] for r in want} == {"value", "hidden-or-empty", "hidden-or-missing"}
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    for part in (shuffled[::2], shuffled[1::2]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    observe.closing_row(table, "30 DAYS").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fold = observe.ObservationFold(TEXT, VOLATILE, ("messages",), "gone", "api")
    got = [tuple(r) for r in observe.fold_files(spark, stream, fold, "30 DAYS", str(tmp_path / "out"), str(tmp_path / "state")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want | plain_status_and_metrics(rows)


def test_baseline_is_the_first_document_of_any_leaf(spark):
    """A first document that only has volatile leaves is a baseline too: what comes next is a change."""
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, "api", at, "messages", "5"), (1, "api", at + timedelta(days=1), "b.title", "x")], SCHEMA)
    assert [(r.kind, r["from"], r.to) for r in history.observe(rows, TEXT, VOLATILE).collect()] == [("value", None, "x")]


class Counted:
    """A handle that keeps its variables in memory and counts the calls."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, {}, set()

    def getListState(self, name, schema):  # noqa: N802
        return self

    getMapState = getValueState = getListState

    def called(self, *args):
        self.calls += 1
        self.timers |= {a for a in args if isinstance(a, int)}

    registerTimer = appendList = appendValue = updateValue = update = put = clear = called  # noqa: N815

    def get(self):
        self.calls += 1
        return None


def test_calls_of_an_entity_do_not_grow_with_its_times():
    handle = Counted()
    fold = observe.ObservationFold(TEXT, VOLATILE, ("messages",), "gone", "api")
    fold.init(handle)
    rows = [Row(entity_id=1, source="api", at=None, path="a", value="x", us=86_400_000_000 * day + 1) for day in range(30, 0, -1)]
    assert list(fold.handleInputRows((1,), iter(rows), None)) == []
    assert handle.timers == {86_400_001} and handle.calls == 2
    events = list(fold.fold([(r.us, r.source, r.path, str(i)) for i, r in enumerate(reversed(rows))]))
    assert [e[3] for e in events].count("value") == 29 and handle.calls == 4


def test_stream_folded_in_several_steps(spark, tmp_path):
    """The watermark follows the documents, so each batch folds what came before onto what the state knows."""
    rows = sorted(documents(), key=lambda r: r[2])
    table = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in history.observe(table, TEXT, VOLATILE).select("entity_id", "source", "at", "path", "kind", "from", "to").collect()}
    times = sorted({r[2] for r in rows})
    for low, high in ((0, 20), (20, 40), (40, len(times))):
        own = set(times[low:high])
        spark.createDataFrame([r for r in rows if r[2] in own], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    observe.closing_row(table, "1 HOURS").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fold = observe.ObservationFold(TEXT, VOLATILE, ("messages",), "gone", "api")
    got = [tuple(r) for r in observe.fold_files(spark, stream, fold, "1 HOURS", str(tmp_path / "out"), str(tmp_path / "state")).collect()]
    assert len(got) == len(set(got)) and set(got) == want | plain_status_and_metrics(rows)
