"""Session helpers shared by all operators: reading tables, durable lineage cuts, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size that a side may have to be broadcast by `small_side`.
BROADCAST_BYTES = 16 * 1024 * 1024

_FOLDERS: dict[str, str] = {}


def local_session(cores: str = "8", app: str = "specloom", **conf: str) -> SparkSession:
    """A session for one machine; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once per application: their Python workers need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="specloom-zip-")) / "specloom.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_folder(spark: SparkSession) -> str:
    """The folder of this application's written tables, inside the shared one that the cluster names in
    ``spark.checkpoint.dir``; it is deleted when the application ends.

    Only on one machine (master ``local``) may that setting be missing: a temporary folder is used then.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        named = _FOLDERS.get("local") or _FOLDERS.setdefault("local", tempfile.mkdtemp(prefix="specloom-cut-"))
    folder = f"{named.rstrip('/')}/specloom-{sc.applicationId}"
    if folder not in _FOLDERS:
        path, fs = _hadoop(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _FOLDERS[folder] = folder
    return folder


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in `cut_folder` and read it back from there.

    A lost executor therefore never loses the rows, and what follows reads only the columns it needs and knows the size of
    what it reads.
    """
    spark = df.sparkSession
    path = f"{cut_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete what `cut` has written so far; frames that read it must be done with."""
    folder = cut_folder(spark)
    path, fs = _hadoop(spark, folder)
    fs.delete(path, True)
    fs.mkdirs(path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of `df`."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if the optimizer's estimate is within `limit`; else `df` as it is (a shuffled join)."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", by: tuple[str, ...] = (), salts: int = 16) -> DataFrame:
    """`big` joined to `small`, which has few rows per key, where any one key may hold a large share of `big`.

    `small` is broadcast if its size allows; else the rows of each key of `big` are dealt by the columns `by` to `salts` parts
    and `small` is given to every part. `how`: inner, left, left_semi or left_anti.
    """
    if plan_bytes(small) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), keys, how)
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*(by or big.columns)), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """Rows that feed a CPU-bound Python stage, dealt out again only if the input has fewer splits than the cluster has cores.

    Large inputs come in many splits and are not exchanged; a small table in one file would otherwise keep one core busy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
