"""Families of shards published behind one manifest, and deletes that only a complete catalogue allows.

A version is written family by family, read back and counted, and only then named by the manifest, which is one small file. So a
write that is killed at any point leaves readers with the version before. Readers fail where shards or rows of the manifest are missing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .publish import content_hash


def _manifests(spark: SparkSession, root: str) -> list[dict]:
    try:
        rows = spark.read.json(f"{root}/manifest", schema="at bigint, body string").orderBy(F.desc("at")).limit(1).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return [json.loads(r["body"]) for r in rows]


def manifest(spark: SparkSession, root: str) -> dict:
    """The newest manifest: version, complete, and for each family its shards with their rows."""
    found = _manifests(spark, root)
    if not found:
        raise FileNotFoundError(f"no manifest under {root}")
    return found[0]


def _shards(rows: DataFrame, shard: str) -> dict[str, int]:
    """Rows by shard; shards are a fixed small number of a family."""
    return {str(r[0]): r[1] for r in rows.groupBy(F.col(shard).cast("string")).agg(F.count(F.lit(1))).collect()}


def publish_families(families: dict[str, tuple[DataFrame, str]], root: str, complete: bool = True, **also: object) -> bool:
    """Writes families (rows and the name of their shard column) as a new version; false if it is the one that is published already.

    `complete` says whether the scan behind the rows saw everything; `also` goes into the manifest as it is.
    """
    spark = next(iter(families.values()))[0].sparkSession
    hashes = {name: content_hash(rows) for name, (rows, _) in sorted(families.items())}
    version = content_hash(spark.createDataFrame([(json.dumps([hashes, complete, also], sort_keys=True),)], "v string"))
    before = _manifests(spark, root)
    if before and before[0]["version"] == version:
        return False
    written = {}
    for name, (rows, shard) in families.items():
        path = f"{root}/version={version}/{name}"
        rows.write.mode("overwrite").partitionBy(shard).parquet(path)
        stored = spark.read.parquet(path) if rows.limit(1).count() else rows
        written[name] = {"shard": shard, "shards": _shards(stored, shard), "hash": hashes[name]}
        if sum(written[name]["shards"].values()) != rows.count():
            raise OSError(f"{name}: not all rows were stored")
    body = json.dumps({"version": version, "complete": complete, "families": written, **also}, sort_keys=True)
    spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("at"), F.lit(body).alias("body")).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return True


def read_family(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A family's rows of the published version; an error where a shard or a row of the manifest isn't there."""
    now = manifest(spark, root)
    own = now["families"][name]
    if not own["shards"]:
        raise ValueError(f"{name} is empty")
    rows = spark.read.parquet(f"{root}/version={now['version']}/{name}")
    if _shards(rows, own["shard"]) != own["shards"]:
        raise ValueError(f"{name}: shards differ from the manifest")
    return rows


def objects(spark: SparkSession, folder: str, suffix: str = ".json") -> DataFrame:
    """path, id (the file's name), size and text of each stored object."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select("path", F.regexp_extract("path", rf"([^/]+){suffix.replace('.', chr(92) + '.')}$", 1).alias("id"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


def delete_guarded(stored: DataFrame, root: str, family: str, key: str, saved: Column, deletable: Column, most: int = 800, apply: bool = False) -> dict:
    """Deletes objects (path, id, size, text) that `deletable` holds for and that no row of the published family protects by `saved`.

    Refused unless the newest manifest is complete and its family whole. All objects are judged before the first one goes, and an
    object whose text can't be judged stays. At most `most` go in one run, which bounds what the driver lists; the rest stay for the next.
    """
    spark = stored.sparkSession
    if manifest(spark, root).get("complete") is not True:
        raise ValueError("a delete needs a complete catalogue")
    protected = read_family(spark, root, family).where(saved).select(F.col(key).cast("string").alias("id")).distinct()
    judged = stored.join(protected.withColumn("kept", F.lit(True)), "id", "left").withColumn("go", F.coalesce(deletable, F.lit(False)) & F.col("kept").isNull())
    total = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if("go").alias("go"), F.sum(F.when(F.col("go"), F.col("size"))).alias("size")).head()
    removed = 0
    if apply:
        for r in judged.where("go").select("path").orderBy("path").limit(most).collect():
            path = spark._jvm.org.apache.hadoop.fs.Path(r.path)
            removed += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False))
    return {"candidates": total.n, "deletable": total.go, "protected": total.n - total.go, "bytes": total["size"] or 0, "removed": removed}
