"""Registered queries of schema drift and nested records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.operators import drift, nested
from specloom.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "raw_files"), table(spark, sf_dir, "raw_lines"))


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all cached files in one table; extras as JSON text."""
    got = drift.unify(table(spark, sf_dir, "raw_files"), table(spark, sf_dir, "raw_lines"))
    return got.withColumn("extras", F.to_json("extras"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.machine_nodes(table(spark, sf_dir, "machine_xml"))


def p4_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory ranges with the device and the slot they hang below."""
    t = nested.machine_tables(table(spark, sf_dir, "machine_xml"))
    devices = t["devices"].select("xml_id", F.col("node_no").alias("device_no"), F.col("parent_no").alias("slot_node"), F.col("tag").alias("device_tag"), "device_id")
    slots = t["slots"].select("xml_id", F.col("node_no").alias("slot_node"), "slot")
    ranges = t["ranges"].select("xml_id", "node_no", F.col("parent_no").alias("device_no"), "base", F.col("size").alias("range_size"))
    return ranges.join(devices, ["xml_id", "device_no"]).join(slots, ["xml_id", "slot_node"])


def p4_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that the documents' own repeated elements make: rows and columns of each, and rows without a parent row."""
    tables = nested.discovered_tables(table(spark, sf_dir, "machine_xml"), "xml_id", "xml_text")
    each = [t.agg(F.lit(g).alias("group_path"), F.count("*").alias("n_rows"), F.lit(len(t.columns)).alias("n_columns"), F.count_if(F.col("parent_no") <= 0).alias("top_rows")) for g, t in tables.items()]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_unified, p4_found, p4_ranges, p4_tables)}
