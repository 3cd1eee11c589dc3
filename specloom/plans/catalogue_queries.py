"""Registered queries of the machine catalogue over the catalogue tables: the catalogue's own columns, the merge of both sources, XML
facts and slot maps. What only a parser can read has no SQL; its tests hold it against hand-written documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions.codec import ViewState
from specloom.operators import merge as mg
from specloom.operators import registry, view
from specloom.operators.catalog import machine_catalog
from specloom.plans import pipeline
from specloom.session import table
from specloom.sources import machines

#: rules that name the devices of the test tables' documents
LUT = [{"element": "ROM", "id_pattern": "(?i)basic|bios|system", "abbr": "MAIN"}, {"element": "ROM", "id_pattern": "(?i)floppy|disk", "abbr": "DSK"}, {"element": "RAM", "id_pattern": None, "abbr": "RAM"}, {"element": "MemoryMapper", "id_pattern": None, "abbr": "MM"}]


def machine_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every machine description; documents sent twice give a row each."""
    docs = table(spark, sf_dir, "machine_xml").withColumn("doc", F.concat_ws("#", "file_name", "xml_id"))
    return machines.read_facts(docs, doc="doc")


def machine_slot_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 cells of every machine description."""
    docs = table(spark, sf_dir, "machine_xml").withColumn("doc", F.concat_ws("#", "file_name", "xml_id"))
    return pipeline.machine_slot_map(machines.read_devices(docs, doc="doc"), LUT)


def catalog_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived columns of the machine catalogue."""
    raw = table(spark, sf_dir, "msxorg_raw").withColumn("wait_cycles", F.when(F.col("year") == 1985, "2"))
    got = machine_catalog().derive(raw.withColumn("slotmap_1_0_0", F.when(F.col("rec_id") % 3 == 0, "CS1!")).withColumn("slotmap_2_0_0", F.when(F.col("rec_id") % 4 == 0, "ES1")))
    return got.select("rec_id", "wait_cycles", "nmos_cmos", "fpga_support", "cartridge_slots", "expansion_slots")


_SPACE = r"[\s\x1c-\x1f\x85\pZ]"
_KEY = " || '|' || ".join(rf"regexp_replace(lower(coalesce({c}, '')), '^{_SPACE}+|{_SPACE}+$', '', 'g')" for c in ("manufacturer", "model"))
_SIDES = f"""with l as (select * from (select *, {_KEY} as nk, row_number() over (partition by {_KEY} order by rec_id desc) as k from openmsx_raw) where k = 1),
    r as (select * from (select *, {_KEY} as nk, row_number() over (partition by {_KEY} order by rec_id desc) as k from msxorg_raw) where k = 1)"""


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    side = lambda name, *extra: table(spark, sf_dir, name).select("manufacturer", "model", "year", "region", "vdp", "main_ram_kb", "tape_interface", *extra, F.col("rec_id").alias("ord"))
    return mg.merge(side("openmsx_raw", "openmsx_id"), side("msxorg_raw", "msxorg_title", "engine"))


def merge_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources joined on the natural key with the precedence of each field."""
    return _merged(spark, sf_dir)[0].select("nk", "year", "region", "vdp", "main_ram_kb", "tape_interface", "openmsx_id", "msxorg_title", "engine", "has_left", "has_right")


def merge_machine_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[1].where(F.col("field").isin("year", "tape_interface"))


def sort_comma_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of a list column, whatever the order of its parts."""
    raw = table(spark, sf_dir, "openmsx_raw").select(F.col("rec_id").alias("id"), "connectivity")
    return view.with_rank(raw, view.sort_keys("connectivity", False, "string", listed=True)).select("id", F.col("pos").cast("long"))


def filter_comma_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.filtered(table(spark, sf_dir, "openmsx_raw").select("rec_id", "connectivity"), {"connectivity": "printer|!cassette"})


def registry_retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that only one source holds are retired; an id that belongs to no key any more is not given again."""
    merged = _merged(spark, sf_dir)[0].select("nk", "has_left", "has_right")
    old = spark.createDataFrame([(None, 100, True)], registry.SCHEMA)
    got = registry.assign(old, merged.select("nk"), limit=2**31 - 1)
    return registry.retire(got, merged.where("not (has_left and has_right)").select("nk")).where("nk is not null")


def row_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells the rows between two machines have in the visible columns of a view with a collapsed group."""
    cat = machine_catalog()
    raw = table(spark, sf_dir, "openmsx_raw").select(F.col("rec_id").alias("id"), "manufacturer")
    ranked = view.with_rank(raw, view.sort_keys("manufacturer", False, "string"))
    cells = view.row_cells(ranked, [f.id for f in cat.visible(ViewState())], 1, 9)
    kept = view.prune(cells, cat, ViewState(collapsed_groups={8, 9, 10, 11}))
    return kept.groupBy("id").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (machine_facts, machine_slot_maps, catalog_derived, merge_machines, merge_machine_conflicts, sort_comma_list, filter_comma_list, registry_retired, row_cells)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    visible = len(machine_catalog().visible(ViewState(collapsed_groups={8, 9, 10, 11})))
    return {
        "catalog_derived": """select rec_id, coalesce(case when year = 1985 then '2' end, case when contains(engine, 'T976') then '1' end) as wait_cycles,
            case when contains(engine, 'T976') then 'CMOS' else 'NMOS' end as nmos_cmos, case when contains(engine, 'Altera') then 'Yes' end as fpga_support,
            cast(coalesce(case when rec_id % 3 = 0 then 1 end, scraped_cart_slots) as integer) as cartridge_slots, cast(case when rec_id % 4 = 0 then 1 end as integer) as expansion_slots from msxorg_raw""",
        "merge_machines": f"""{_SIDES} select coalesce(l.nk, r.nk) as nk, coalesce(l.year, r.year) as year, coalesce(r.region, l.region) as region, coalesce(l.vdp, r.vdp) as vdp,
            coalesce(l.main_ram_kb, r.main_ram_kb) as main_ram_kb, coalesce(l.tape_interface, r.tape_interface) as tape_interface, l.openmsx_id, r.msxorg_title, r.engine,
            l.nk is not null as has_left, r.nk is not null as has_right from l full join r on l.nk = r.nk""",
        "merge_machine_conflicts": f"""{_SIDES}, j as (select l.nk, l.year as a, r.year as b, l.tape_interface as c, r.tape_interface as d from l join r on l.nk = r.nk)
            select nk, 'year' as field, cast(a as varchar) as left_value, cast(b as varchar) as right_value from j where a <> b
            union all select nk, 'tape_interface', c, d from j where c <> d""",
        "sort_comma_list": """select rec_id as id, row_number() over (order by array_to_string(list_sort([trim(x) for x in string_split(lower(connectivity), ',')]), ', ') nulls last, rec_id) as pos from openmsx_raw""",
        "filter_comma_list": "select rec_id, connectivity from openmsx_raw where contains(lower(coalesce(connectivity, '—')), 'printer') and not contains(lower(coalesce(connectivity, '—')), 'cassette')",
        "registry_retired": f"""{_SIDES}, j as (select coalesce(l.nk, r.nk) as nk, l.nk is null or r.nk is null as retired from l full join r on l.nk = r.nk)
            select nk, cast(100 + row_number() over (order by nk) as integer) as id, retired from j""",
        "row_cells": f"""with r as (select rec_id as id, row_number() over (order by lower(manufacturer) nulls last, rec_id) as pos from openmsx_raw), e as (select min(pos) as lo, max(pos) as hi from r where id in (1, 9))
            select id, cast({visible} as bigint) as n from r, e where pos between lo and hi""",
    }
