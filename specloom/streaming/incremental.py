"""Incremental merging of a drop folder: each micro-batch updates the last record per key, ids stay permanent.

State lies on shared storage. Records are held in buckets of keys: a batch rewrites only the buckets it touches, and a
manifest, written last under a new name, says which generation of each bucket counts. A batch that is run again after a
failure gives the same result; generations no manifest needs are deleted once the next one stands.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions.text import natural_key
from specloom.operators import registry
from specloom.operators.merge import last_per_key

BUCKETS = 64


class _Store:
    """A folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, prefix: str) -> list[str]:
        at = self.path(self.folder)
        if not self.fs.exists(at):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at) if x.getPath().getName().startswith(prefix))

    def read(self, name: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(f"{self.folder}/{name}").collect())

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written beside and renamed to a name that isn't there yet."""
        tmp, at = self.path(f"{self.folder}/_{name}"), self.path(f"{self.folder}/{name}")
        out = self.fs.create(tmp, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if not self.fs.rename(tmp, at) and not self.fs.exists(at):
            raise OSError(f"{name} can't be put in place")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.folder}/{name}"), True)


def _manifest(store: _Store) -> dict:
    names = store.names("manifest-")
    return json.loads(store.read(names[-1])) if names else {"batch": -1, "buckets": {}, "registry": None}


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _records(spark: SparkSession, state: str, buckets: dict[str, int]) -> DataFrame | None:
    """Rows of the named buckets, of the generation that counts for each."""
    if not buckets:
        return None
    paths = [f"{state}/records-{at}/bucket={b}" for b, at in sorted(buckets.items())]
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def current(spark: SparkSession, state: str) -> tuple[DataFrame | None, DataFrame, int]:
    """(records or None, registry, last batch)"""
    now = _manifest(_Store(spark, state))
    reg = spark.createDataFrame([], registry.SCHEMA) if now["registry"] is None else spark.read.parquet(f"{state}/registry-{now['registry']}")
    return _records(spark, state, now["buckets"]), reg, now["batch"]


def absorb(state: str):
    """A foreachBatch function: newest row per natural key by `ord` over the old records and the batch. Equal `ord`s end at the
    row with the larger hash; an empty batch changes nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = _Store(spark, state)
        now = _manifest(store)
        if batch_id <= now["batch"]:
            return
        batch = batch.persist()
        touched = [r[0] for r in batch.select(_bucket(natural_key()).alias("b")).distinct().collect()]  # at most BUCKETS
        if not touched:
            batch.unpersist()
            return
        old = _records(spark, state, {b: at for b, at in now["buckets"].items() if int(b) in set(touched)})
        rows = batch if old is None else old.drop("nk").unionByName(batch, allowMissingColumns=True)
        keep = last_per_key(rows.withColumn("_ord", F.struct("ord", F.xxhash64(*rows.columns))), "_ord")
        keep.withColumn("bucket", _bucket(F.col("nk"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/records-{batch_id}")
        batch.unpersist()
        reg = spark.createDataFrame([], registry.SCHEMA) if now["registry"] is None else spark.read.parquet(f"{state}/registry-{now['registry']}")
        keys = spark.read.parquet(f"{state}/records-{batch_id}").select("nk")
        at = now["registry"]
        if at is None or keys.join(reg.select("nk"), "nk", "left_anti").take(1):
            registry.assign(reg, keys, limit=2**31 - 1).write.mode("overwrite").parquet(f"{state}/registry-{batch_id}")
            at = batch_id
        buckets = now["buckets"] | {str(b): batch_id for b in touched}
        store.write(f"manifest-{batch_id:012d}", json.dumps({"batch": batch_id, "buckets": buckets, "registry": at}))
        _tidy(store, now, buckets, at)

    return run


def _tidy(store: _Store, before: dict, buckets: dict[str, int], reg: int | None) -> None:
    """Delete what neither the manifest nor the one before it names: a reader may still be at that one."""
    need = {*before["buckets"].values(), *buckets.values()}
    for name in store.names("records-"):
        if int(name.partition("-")[2]) not in need:
            store.delete(name)
    for name in store.names("registry-"):
        if int(name.partition("-")[2]) not in {before["registry"], reg}:
            store.delete(name)
    for name in store.names("manifest-")[:-2]:
        store.delete(name)


def follow(spark: SparkSession, folder: str, schema: str, state: str, checkpoint: str):
    """A streaming query over JSON files dropped into `folder`; ends when all that is there has been absorbed."""
    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(absorb(state)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts per event type and window; rows later than `late` behind the newest are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))


__all__ = ["absorb", "current", "event_windows", "follow", "natural_key"]
