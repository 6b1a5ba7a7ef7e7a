from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from recordlake.operators import catalogue, contracts
from recordlake.operators.contracts import Constraint
from recordlake.sources import families


def test_contracts_of_each_kind(spark):
    tags = spark.createDataFrame([("a-b", ["bot"], "x"), ("a-b", ["bot", "page"], " "), ("A", [], None), (None, None, "long text")], "id string, scopes array<string>, note string")
    rules = spark.createDataFrame([(1, "a-b", "approve"), (2, "zz", "maybe"), (3, None, None)], "n int, tag string, decision string")
    rows = [
        Constraint("tags", "id", "id", "unique"),
        Constraint("tags", "note", "id", "pattern", ("[a-z0-9]+(?:-[a-z0-9]+)*",)),
        Constraint("tags", "id", "scopes", "members", ("bot", "book")),
        Constraint("tags", "id", "note", "required"),
        Constraint("tags", "id", "note", "max_length", ("5",)),
        Constraint("rules", "n", "tag", "reference", target="tags.id"),
        Constraint("rules", "n", "decision", "enum", ("approve", "reject")),
    ]
    tables = {"tags": tags, "rules": rules}
    assert {(r.constraint, r.key, r.value) for r in contracts.violations(tables, rows).collect()} == {
        ("tags.id unique", "a-b", "2 rows"),
        ("tags.id pattern", None, "A"),
        ("tags.scopes members", "a-b", "page"),
        ("tags.note required", "a-b", " "),
        ("tags.note required", "A", None),
        ("tags.note max_length", None, "9 characters"),
        ("rules.tag reference", "2", "zz"),
        ("rules.decision enum", "2", "maybe"),
    }
    with pytest.raises(ValueError, match="rules.tag reference: 2 has zz"):
        contracts.require(tables, rows[5:6])
    contracts.require({"tags": tags.where("note = 'x'"), "rules": rules.where("n = 1")}, rows)
    with pytest.raises(ValueError, match="unknown kind"):
        contracts.violations(tables, [Constraint("tags", "id", "id", "odd")])


def test_values_that_meet_are_dealt_out_by_their_number(spark, monkeypatch):
    """More tasks than the session's partitions, so that none holds more values as the tables grow; the breaches are the same."""
    monkeypatch.setattr(contracts, "PER_TASK", 10)
    owners = spark.range(95).select((F.col("id") % 90).alias("id"))
    things = spark.range(200).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 93).alias("owner"))
    tables = {"owners": owners, "things": things}
    unique, reference = Constraint("owners", "id", "id", "unique"), Constraint("things", "id", "owner", "reference", target="owners.id")
    assert contracts.violations(tables, [unique]).rdd.getNumPartitions() == 10
    assert contracts.violations(tables, [reference]).rdd.getNumPartitions() == 20
    want = {("owners.id unique", str(i), "2 rows") for i in range(5)} | {("things.owner reference", str(i), str(i % 93)) for i in range(200) if i % 7 and i % 93 >= 90}
    assert {tuple(r) for r in contracts.violations(tables, [unique, reference]).collect()} == want


def test_families_behind_one_manifest(spark, tmp_path):
    root = str(tmp_path / "site")
    a = spark.createDataFrame([(i, i % 3, "x") for i in range(9)], "id int, shard int, v string")
    b = a.where("shard = 0")
    with pytest.raises(FileNotFoundError):
        families.read_family(spark, root, "a")
    assert families.publish_families({"a": (a, "shard"), "b": (b, "shard")}, root, basis="full")
    assert not families.publish_families({"b": (b, "shard"), "a": (a.orderBy(F.desc("id")), "shard")}, root, basis="full")
    assert families.manifest(spark, root)["basis"] == "full" and families.manifest(spark, root)["families"]["a"]["shards"] == {"0": 3, "1": 3, "2": 3}

    # A family that fails while it is written leaves the version before, whole.
    broken = a.withColumn("v", F.when(F.col("id") == 5, F.raise_error(F.lit("killed"))).otherwise("new"))
    with pytest.raises(Exception, match="killed"):
        families.publish_families({"a": (a.withColumn("v", F.lit("new")), "shard"), "b": (broken, "shard")}, root)
    assert {r.v for r in families.read_family(spark, root, "a").collect()} == {"x"}

    version = families.manifest(spark, root)["version"]
    part = next((tmp_path / "site" / f"version={version}" / "a" / "shard=1").glob("*.parquet"))
    part.unlink()
    with pytest.raises(Exception, match="(?i)shards differ|not exist"):
        families.read_family(spark, root, "a").count()
    assert families.read_family(spark, root, "b").count() == 3


def test_guarded_delete(spark, tmp_path):
    root, folder = str(tmp_path / "site"), tmp_path / "records"
    folder.mkdir()
    for i in range(5):
        (folder / f"r{i}.json").write_text(json.dumps({"id": f"r{i}", "listing": True} | ({"content": 1} if i == 4 else {})))
    (folder / "r9.json").write_text("{broken")
    (folder / "other.txt").write_text("{}")
    keys = F.map_keys(F.from_json("text", "map<string,string>"))
    only_listing = F.size(F.array_except(keys, F.array(F.lit("id"), F.lit("listing")))) == 0
    rows = spark.createDataFrame([(f"r{i}", i == 0, 0) for i in range(10)], "id string, saved boolean, shard int")
    run = lambda **k: families.delete_guarded(families.objects(spark, str(folder)), root, "books", "id", F.col("saved"), only_listing, **k)
    with pytest.raises(FileNotFoundError):
        run(apply=True)
    families.publish_families({"books": (rows, "shard")}, root, complete=False)
    with pytest.raises(ValueError, match="complete"):
        run(apply=True)
    families.publish_families({"books": (rows, "shard")}, root)
    plan = run()
    assert (plan["candidates"], plan["deletable"], plan["protected"], plan["removed"]) == (6, 3, 3, 0) and plan["bytes"] > 60
    assert run(apply=True, most=2)["removed"] == 2 and run(apply=True)["removed"] == 1
    assert sorted(p.name for p in folder.iterdir() if not p.name.endswith(".crc")) == ["other.txt", "r0.json", "r4.json", "r9.json"]


def test_catalogue(spark):
    records = spark.createDataFrame(
        [(1, "public", " A  b", "t" * 400, ["x", " x ", "", None]), (2, None, None, None, None), (3, "odd", "n", "", ["Y"]), (None, "public", "no id", "", [])],
        "id int, status string, name string, title string, tags array<string>",
    )
    own = catalogue.summaries(records, 4)
    first = own.where("id = 1").first()
    assert first.name == "A b" and len(first.title) == 320 and first.title.endswith("…") and first.tags == ["x", "x"]
    counted = catalogue.counts(own)
    got = {(r.kind, r.name): r.n for r in counted.where("kind <> 'shard'").collect()}
    assert got == {("total", "records"): 3, ("status", "public"): 1, ("status", "unknown"): 1, ("status", "odd"): 1, ("tag", "x"): 2, ("tag", "Y"): 1}
    assert sum(r.n for r in counted.where("kind = 'shard'").collect()) == 3
    gap = catalogue.reconciliation(counted).first()
    assert (gap.tracked, gap.public, gap.unknown, gap.count_gap, gap.unreconciled, gap.beyond) == (3, 1, 1, 1, 1, 0)
    assert [(r.tag, r.n) for r in catalogue.top_tags(counted).collect()] == [("x", 2), ("Y", 1)]
    assert catalogue.reconciliation(catalogue.counts(own.limit(0))).first().tracked == 0
