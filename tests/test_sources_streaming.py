from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from recordlake.operators.temporal import last_known
from recordlake.sources import journals, publish, records
from recordlake.streaming import fold


def test_records_and_keys(spark, tmp_path):
    for name, body in (("ab/ab1.json", '{"id": 1}'), ("ab/ab2.json", "{broken"), ("zz/cd3.json", "{}")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(body)
    assert tuple(records.read_counters(records.read_records(spark, str(tmp_path))).head()) == (3, 2, 1)
    keys = {r.id: r.canonical for r in records.scan_keys(spark, str(tmp_path)).collect()}
    assert keys == {"ab1": True, "ab2": True, "cd3": False}
    media = records.distinct_media(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)))
    assert media.count() == 3


def test_locations(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    own = records.best_location(ids, spark.createDataFrame([(1, "a")], "id int, doc string"), spark.createDataFrame([(1, "x"), (2, "b")], "id int, doc string"))
    assert sorted(map(tuple, own.collect())) == [(1, "a", "direct"), (2, "b", "sharded"), (3, None, None)]


def test_journal(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"id": "x", "v": 1}\n\nnot json\n[1]\n{"v": 2}\n{"id": "y"}\n')
    journals.append_journal(spark.createDataFrame([("x", 2)], "id string, v int"), str(tmp_path))
    own = journals.read_journal(spark, str(tmp_path))
    assert sorted(r.id for r in own.collect()) == ["x", "x", "y"]
    assert journals.pending(own, ["file", "line"]).count() == 2


def test_publish_only_changes(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert publish.publish(rows, root)
    assert not publish.publish(rows.orderBy(F.desc("id")), root)
    assert publish.publish(rows.where("id = 1"), root)
    assert publish.read_published(spark, root).count() == 1
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, str(tmp_path / "none"))
    from_zero = rows.selectExpr("id - 1 as id")
    assert publish.require_shards(from_zero, "id", 2) is from_zero
    with pytest.raises(ValueError):
        publish.require_shards(rows, "id", 2)  # shards 1 and 2 aren't 0 and 1
    with pytest.raises(ValueError):
        publish.require_shards(rows, "id", 3)


def test_checked_csv(spark, tmp_path):
    (tmp_path / "good.csv").write_text("id,views\n1,5\n")
    (tmp_path / "bad.csv").write_text("views,id\n5,1\n")
    assert publish.read_checked_csv(spark, str(tmp_path / "good.csv"), "id int, views int").head().views == 5
    with pytest.raises(Exception, match="(?i)header|schema"):
        publish.read_checked_csv(spark, str(tmp_path / "bad.csv"), "id int, views int").collect()
    publish.write_sorted_csv(spark.range(10), str(tmp_path / "out"), "id")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 10


SCHEMA = "entity_id bigint, pos bigint, at bigint, path string, k bigint"


@pytest.mark.parametrize("compact_every", [2, 16])
def test_stream_fold_equals_batch(spark, tmp_path, compact_every):
    data = [(i % 3, i, i // 2, "ab"[i % 2], None if i % 5 == 0 else i) for i in range(40)]
    for n in range(5):
        spark.createDataFrame(data[n::5], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fold.merge_last_known(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"), compact_every)
    assert len(list((tmp_path / "out").glob("base/batch=*"))) == 5 // compact_every
    merged = fold.read_merged(spark, str(tmp_path / "out"))
    assert merged.count() == last_known(spark.createDataFrame(data, SCHEMA)).count()
    assert fold.parity(spark.createDataFrame(data, SCHEMA), merged).count() == 0


def run_stream(spark, tmp_path, batches, schema, f, name):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in*"))
    mode = "append" if name == "limits" else "update"
    f(stream).writeStream.foreachBatch(lambda d, n: out.extend(d.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return out


def test_deletions_and_limits(spark, tmp_path):
    checks = [[(1, "r1", 1, 404), (1, "r1", 2, 404), (2, "r1", 3, 404)], [(1, "r2", 4, 404), (2, "r2", 5, 200)]]
    (tmp_path / "a").mkdir()
    got = {r.entity_id: (r["count"], r.confirmed) for r in run_stream(spark, tmp_path / "a", checks, "entity_id bigint, run string, pos bigint, code int", fold.confirm_deletions, "deletions")}
    assert got == {1: (2, True), 2: (0, False)}
    events = [[(1, i, i * 60, f"g{i}") for i in range(8)], [(1, 8, 500, "g0"), (1, 9, 90_000, "g9")]]
    (tmp_path / "b").mkdir()
    ok = {r.pos: r.accepted for r in run_stream(spark, tmp_path / "b", events, "entity_id bigint, pos bigint, t bigint, grp string", fold.rate_limited, "limits")}
    assert [ok[i] for i in range(10)] == [True] * 6 + [False, False, True, True]


def test_receipts_and_fingerprints(spark, tmp_path):
    bundles = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "sha string, v int")
    receipts = str(tmp_path / "receipts")
    assert fold.import_once(spark, bundles, receipts).count() == 2
    fold.leave_receipts(bundles.where("sha = 'a'"), receipts)
    assert [r.sha for r in fold.import_once(spark, bundles, receipts).collect()] == ["b"]
    incoming = spark.createDataFrame([(1, "x"), (2, "y")], "id int, hash string")
    assert [r.id for r in fold.skip_unchanged(incoming, spark.createDataFrame([(1, "x"), (2, "z")], "id int, hash string")).collect()] == [2]
