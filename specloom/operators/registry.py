"""Permanent surrogate ids: a table (nk, id, retired) that grows and never gives an id twice.

Where the highest id that was ever given belongs to no key any more, a row without a key (nk null, retired) holds its place.
"""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.session import cut

SCHEMA = "nk string, id int, retired boolean"
LAST = 65535


def load(spark: SparkSession, path: str | Path) -> DataFrame:
    """A missing file is an empty registry, a corrupt one a ValueError. Older versions' further keys are ignored.

    The file's next id counts: ids below it are never given again, though their keys may be gone.
    """
    p = Path(path)
    if not p.exists():
        return spark.createDataFrame([], SCHEMA)
    try:
        got = json.loads(p.read_text(encoding="utf-8"))
        gone = set(got.get("retired_models", []))
        rows = [(k, int(v), int(v) in gone) for k, v in got["models"].items()]
        last = int(got.get("next_model_id", 1)) - 1
        if last > max((r[1] for r in rows), default=0):
            rows.append((None, last, True))
        return spark.createDataFrame(rows, SCHEMA)
    except (KeyError, TypeError, AttributeError, ValueError, json.JSONDecodeError) as e:
        raise ValueError(f"{path} is no registry: {e}") from e


def assign(registry: DataFrame, keys: DataFrame, limit: int = LAST) -> DataFrame:
    """The registry with every key of `keys` (nk): known keys keep their id, new ones continue in key order.

    New keys are ranked without gathering them in one task: a range exchange sorts them, counts per partition shift the
    ranks. Null keys get none. OverflowError beyond `limit`.
    """
    new = keys.select("nk").where("nk is not null").distinct().join(registry.select("nk"), "nk", "left_anti")
    ranged = cut(new.repartitionByRange("nk").sortWithinPartitions("nk").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    sizes = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row per partition
    top = registry.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m
    if top + sum(sizes.values()) > limit:
        raise OverflowError(f"{top + sum(sizes.values())} ids are more than {limit}")
    at, starts = top, []
    for part in sorted(sizes):
        starts.append((part, at))
        at += sizes[part]
    shift = registry.sparkSession.createDataFrame(starts, "part int, start int")
    in_part = F.col("row") - F.shiftleft(F.col("part").cast("long"), 33)
    rows = ranged.join(F.broadcast(shift), "part").select("nk", (F.col("start") + in_part + 1).cast("int").alias("id"), F.lit(False).alias("retired"))
    return registry.unionByName(rows)


def retire(registry: DataFrame, keys: DataFrame) -> DataFrame:
    """Mark keys as retired; their ids stay taken. Repeating it changes nothing."""
    gone = keys.select("nk").distinct().withColumn("gone", F.lit(True))
    return registry.join(gone, "nk", "left").select("nk", "id", (F.col("retired") | F.coalesce("gone", F.lit(False))).alias("retired"))


def save(registry: DataFrame, path: str | Path) -> None:
    """Version 2 file, replaced at once. A registry holds at most 65,535 rows."""
    rows = registry.orderBy("id").collect()
    doc = {"version": 2, "models": {r.nk: r.id for r in rows if r.nk is not None}, "retired_models": sorted(r.id for r in rows if r.retired and r.nk is not None), "next_model_id": max([r.id for r in rows], default=0) + 1}
    write_atomic(path, json.dumps(doc, indent=2, ensure_ascii=False))


def write_atomic(path: str | Path, text: str) -> None:
    """Write beside the target, then rename over it."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=p.parent, prefix=p.name)
    with os.fdopen(fd, "w", encoding="utf-8") as out:
        out.write(text)
    os.replace(tmp, p)
