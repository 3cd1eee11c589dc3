"""Command line: build, merge, and parsing of mirrored sources."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.operators import merge as mg
from specloom.operators import publish, registry, rules, slots
from specloom.operators.catalog import machine_catalog
from specloom.operators.registry import write_atomic
from specloom.plans.pipeline import Inputs, build, machine_records, renumbered, wiki_records
from specloom.session import local_session, ship
from specloom.sources import files, live, machines, pages

SLOTMAP = ", ".join(f"{slots.slot_column(*c)} string" for c in slots.SLOT_COLUMNS)
RIGHT = "manufacturer string, model string, generation string, standard string, msxorg_title string, year int, region string, main_ram_kb int, vram_kb int, vdp string, psg string, audio_channels int, fm_chip string, floppy_drives string, scraped_cart_slots int, cartridge_slots int, engine string, keyboard_layout string, tape_interface string, connectivity string, " + SLOTMAP
LEFT = machines.FACTS.replace("doc string, ", "").replace(", error string", "") + ", standard string, cartridge_slots int, character_set string, keyboard_type string, " + SLOTMAP
#: a local supplement may hold any field of either source
LOCAL = ", ".join(dict.fromkeys([*LEFT.split(", "), *RIGHT.split(", "), "himem_addr string"]))


def _ordered(df: DataFrame) -> DataFrame:
    return df.withColumn("ord", F.monotonically_increasing_id())


def _write(df: DataFrame, path: str | None) -> None:
    """One JSON array to a file, or to the standard output; meant for results of a catalogue's size."""
    text = json.dumps([json.loads(r) for r in df.toJSON().toLocalIterator()], indent=2, ensure_ascii=False)
    write_atomic(path, text) if path else print(text)


def _fetch_openmsx(spark: SparkSession, a: argparse.Namespace, mirror: str | None, only: bool, ex: rules.Excludes, out: str | None) -> None:
    lut = rules.load_lut(a.lut) if a.lut else None
    blobs = live.descriptions(spark, mirror, only, ex, a.delay, a.limit)
    roms = (files.sha1_index(spark, a.sha1s), files.rom_files(spark, a.roms)) if a.sha1s and a.roms else ()
    _write(ex.keep(machine_records(blobs, lut, *roms)).orderBy("doc").drop("doc", "error"), out)


def _fetch_msxorg(spark: SparkSession, a: argparse.Namespace, mirror: str | None, only: bool, ex: rules.Excludes, out: str | None) -> None:
    lut = rules.load_lut(a.lut) if a.lut else None
    got = pages.read_pages(live.wiki_pages(spark, mirror, only, a.delay, a.limit)).persist()
    failed = publish.fetch_stats(got, F.size("specs") == 0)
    if publish.too_many_failures(failed):
        print(f"more than a fifth of the pages have no specification table: {failed.first().asDict()}", file=sys.stderr)
    _write(ex.keep(wiki_records(got, lut)).orderBy("doc", "variant_no").drop("doc", "variant_no"), out)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="specloom")
    sub = p.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build", help="merge cached sources and write the payload")
    m = sub.add_parser("merge", help="merge cached sources and write records and conflicts")
    for q in (b, m):
        q.add_argument("--openmsx", default="data/openmsx-raw.json")
        q.add_argument("--msxorg", default="data/msxorg-raw.json")
        q.add_argument("--resolutions")
        q.add_argument("-o", "--output", default="out.js" if q is b else "merged.json")
    m.add_argument("--conflicts")
    for name in ("local", "registry", "aliases", "excludes", "substitutions", "link-shares", "lut", "wiki-base", "xml-base", "sha1s", "roms", "openmsx-mirror", "msxorg-mirror"):
        b.add_argument(f"--{name}", default="")
    b.add_argument("--fetch", action="store_true", help="read the sources anew and cache them before the build")
    b.add_argument("-l", "--local-only", action="store_true", help="read both mirrors only")
    b.add_argument("--local-openmsx-only", action="store_true")
    b.add_argument("--local-msxorg-only", action="store_true")
    b.add_argument("--delay", type=float, default=0.3)
    b.set_defaults(limit=0)
    x = sub.add_parser("fetch-openmsx", help="parse a mirror of machine descriptions")
    w = sub.add_parser("fetch-msxorg", help="parse a mirror of wiki pages")
    for q in (x, w):
        q.add_argument("mirror", nargs="?", help="folder to read alone, as --MIRROR -l")
        q.add_argument("-o", "--output", help="default: standard output")
        q.add_argument("--delay", type=float, default=0.3 if q is x else 0.5)
        q.add_argument("--limit", type=int, default=0)
        q.add_argument("--excludes", default="")
        q.add_argument("--lut", default="", help="rules that name devices; without them no slot maps are made")
    x.add_argument("--openmsx-mirror", default="", help="stands in for what can't be had live")
    x.add_argument("-l", "--local-openmsx-only", action="store_true")
    w.add_argument("--msxorg-mirror", default="", help="stands in for what can't be had live")
    w.add_argument("-l", "--local-msxorg-only", action="store_true")
    for q in (b, x, w):
        q.add_argument("--config", default="", help="JSON with openmsx_mirror, msxorg_mirror and slotmap_symbols")
    x.add_argument("--sha1s", default="", help="text index of ROM files: sha1 and path")
    x.add_argument("--roms", default="", help="folder the index speaks of; with it, ROM facts and mirrors beyond a file's end")
    a = p.parse_args(argv)
    spark = local_session()
    ship(spark)
    conf = files.config(a.config) if getattr(a, "config", "") else {}
    ex = rules.Excludes.load(a.excludes) if getattr(a, "excludes", "") else rules.Excludes([])
    if a.cmd in ("fetch-openmsx", "fetch-msxorg"):
        xml = a.cmd == "fetch-openmsx"
        mirror = a.mirror or (a.openmsx_mirror or conf.get("openmsx_mirror") if xml else a.msxorg_mirror or conf.get("msxorg_mirror"))
        only = bool(a.mirror) or (a.local_openmsx_only if xml else a.local_msxorg_only)
        if not a.lut:
            print("no --lut: no slot maps", file=sys.stderr)
        (_fetch_openmsx if xml else _fetch_msxorg)(spark, a, mirror, only, ex, a.output)
        return 0
    if a.cmd == "build" and a.fetch:
        _fetch_openmsx(spark, a, a.openmsx_mirror or conf.get("openmsx_mirror"), a.local_only or a.local_openmsx_only, ex, a.openmsx)
        _fetch_msxorg(spark, a, a.msxorg_mirror or conf.get("msxorg_mirror"), a.local_only or a.local_msxorg_only, ex, a.msxorg)
    left, right = _ordered(files.records(spark, a.openmsx, LEFT)), _ordered(files.records(spark, a.msxorg, RIGHT))
    res = rules.load_resolutions(spark, a.resolutions) if a.resolutions else None
    if a.cmd == "merge":
        merged, conflicts = mg.merge(mg.normalise(mg.migrate(left)), mg.normalise(mg.migrate(right)), resolutions=res)
        _write(renumbered(merged).orderBy("nk"), a.output)
        if a.conflicts:
            rows = [{"natural_key": r.nk, "field": r.field, "openmsx_value": r.left_value, "msxorg_value": r.right_value, "use": "openmsx"} for r in conflicts.orderBy("nk", "field").toLocalIterator()]
            write_atomic(a.conflicts, json.dumps(rows, indent=2, ensure_ascii=False))
        return 0
    local = _ordered(files.records(spark, a.local, LOCAL, required=False)) if a.local else None
    lut = rules.load_lut(a.lut) if a.lut else []
    built = build(
        Inputs(
            left, right, registry.load(spark, a.registry or "no-registry"), local, rules.Aliases.load(a.aliases) if a.aliases else None, ex if a.excludes else None,
            rules.load_substitutions(a.substitutions) if a.substitutions else None, res, rules.load_link_shares(spark, a.link_shares) if a.link_shares else None, a.wiki_base, a.xml_base,
            files.symbols(a.config) if a.config else None,
        )
    )
    publish.write_payload(a.output, publish.payload(built.records, machine_catalog(), rules.tooltips(lut)))
    if a.registry:
        registry.save(built.registry, a.registry)
    for i in built.dead_rules:
        print(f"exclude rule {i} matched nothing")
    print(f"{built.records.count()} records, {built.conflicts.count()} conflicts -> {Path(a.output)}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
