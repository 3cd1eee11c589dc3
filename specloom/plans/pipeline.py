"""The whole build as one lazy plan: exclude, canonicalise, merge, substitute, derive, number, link, project."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions.text import natural_key
from specloom.operators import merge as mg
from specloom.operators import publish, registry, rules, slots
from specloom.operators.catalog import Catalog, machine_catalog
from specloom.sources import files, machines, pages


@dataclass
class Inputs:
    """Sources with an `ord` column each; any may be None. Local rows are neither excluded nor migrated."""

    left: DataFrame
    right: DataFrame
    registry: DataFrame
    local: DataFrame | None = None
    aliases: rules.Aliases | None = None
    excludes: rules.Excludes | None = None
    substitutions: dict | None = None
    resolutions: DataFrame | None = None
    link_shares: DataFrame | None = None
    wiki_base: str = ""
    xml_base: str = ""
    symbols: dict | None = None


@dataclass
class Built:
    records: DataFrame
    conflicts: DataFrame
    registry: DataFrame
    dead_rules: list[int]


def machine_slot_map(devices: DataFrame, lut: list[dict]) -> DataFrame:
    """Slot map of every document from device rows: classify, pack compound devices, then fill."""
    classified = devices.withColumn("label", F.coalesce(rules.first_match(lut, "tag", "id"), F.col("tag")))
    classified = classified.withColumn("abbr", F.when((F.col("kind") == "device") & (F.upper(F.trim("mappertype")) == "PANASONIC"), "PM").otherwise(F.col("label")))
    parts = slots.packed(classified.where("kind = 'part'"), ("doc", "ms", "ss"), "doc_ord")
    d = classified.where("kind = 'device'").unionByName(parts)
    if "file_size" not in d.columns:
        d = d.withColumn("file_size", F.lit(None).cast("long"))
    return slots.slot_map(devices.where("kind = 'slot'").select("doc", "doc_ord", "ms", "ss", "external"), d, devices.where("kind = 'mirror'"))


def machine_records(docs: DataFrame, lut: list[dict] | None = None, index: DataFrame | None = None, roms: DataFrame | None = None, xml: str = "content") -> DataFrame:
    """Facts of every machine with its slot map, if there are rules to name its devices, and what its main ROM says, if there
    are an index (sha1, path) and ROM files (path, length, content)."""
    out, devices = machines.read_facts(docs, xml=xml), machines.read_devices(docs, xml=xml)
    if index is not None and roms is not None:
        devices = devices.persist()
        size = files.first_file(devices, index, roms.select("path", "length"))
        devices = devices.join(size.select("doc", "doc_ord", "path", F.col("length").alias("file_size")), ["doc", "doc_ord"], "left")
        bios = devices.where("kind = 'bios'").select("doc", "path", F.col("win_base").alias("offset"))
        said = files.rom_bytes(bios.join(roms.select("path", "content"), "path"))
        out = out.join(said.select("doc", "character_set", "keyboard_type"), "doc", "left")
    if lut is not None:
        names = [slots.slot_column(*c) for c in slots.SLOT_COLUMNS]
        out = out.join(slots.widen(machine_slot_map(devices, lut), "doc"), "doc", "left").withColumns({c: F.coalesce(c, F.lit(slots.ABSENT)) for c in names})
    return out


def wiki_records(got: DataFrame, lut: list[dict] | None = None) -> DataFrame:
    """Records of parsed wiki pages with the generation of their categories and, if there are rules, their slot maps."""
    out = pages.page_records(got, pages.page_listing(got))
    if lut is not None:
        out = out.join(slots.widen(slots.html_slot_map(got.select("doc", F.inline("cells")), cell_kind("text", lut)), "doc"), "doc", "left")
    return out


def cell_kind(text: Column | str, lut: list[dict]) -> Column:
    """What a wiki slot cell says: cartridge before slot before expansion before mirror before the text patterns."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    patterns = [r for r in lut if r.get("id_pattern") and not str(r.get("element") or "").startswith("__")]
    spot = next((i for i, r in enumerate(patterns) if r["abbr"] == "FW"), len(patterns))
    ordered = [{"element": None, "id_pattern": r["id_pattern"], "abbr": r["abbr"]} for r in patterns]
    ordered[spot:spot] = [{"element": None, "id_pattern": p, "abbr": a} for p, a in TEXT_PATTERNS]
    return (
        F.when(t.rlike(r"(?i)\bcartridge\b"), "CS").when(t.rlike(r"(?i)\bslot\b|\bES\b"), "ES").when(t.rlike(r"(?i)\bexpansion\b|\d+-pin\s+bus"), "EXP")
        .when(t.rlike(r"(?i)^mirror$"), "MIRROR").otherwise(rules.first_match(ordered, F.lit(""), t))
    )


#: fixed values: text patterns of devices that have no name pattern of their own, in order
TEXT_PATTERNS = (
    (r"panasonic\s+(?:mapper|ram)", "PM"), (r"memory\s+mapper|\d+\s*[kmgt]b\s+memory\b", "MM"), (r"\bram\b", "RAM"), (r"main[\s\-]rom", "MAIN"), (r"disk\s+rom|floppy", "DSK"),
    (r"msx[\s\-]*music|fmpac|fm\s+(?:voicing|music)", "MUS"), (r"\brs[\s\-]?232\b", "RS"), (r"\bmodem\b", "MOD"), (r"bunsetsu", "BUN"),
)


def renumbered(merged: DataFrame) -> DataFrame:
    """Merged records with the cartridge and expansion slots of their slot maps numbered anew."""
    have = [c for c in merged.columns if c.startswith("slotmap_")]
    if not have:
        return merged
    wide = slots.widen(slots.renumber(slots.lengthen(merged.select("nk", *have))))
    return merged.drop(*have).join(wide, "nk", "left")


def build(inp: Inputs, catalog: Catalog | None = None) -> Built:
    """Records ready to publish: `id`, `nk`, `links` and the active columns; conflicts; the grown registry; dead rules.

    Natural keys are taken anew after substitutions, so two records may end on one id; both are kept.
    """
    cat = catalog or machine_catalog()
    ex, al = inp.excludes or rules.Excludes([]), inp.aliases or rules.Aliases({})
    ready = lambda df: mg.normalise(al.apply(df))
    left, right = mg.migrate(inp.left), mg.migrate(inp.right)
    dead = ex.dead(left.select("manufacturer", "model").unionByName(right.select("manufacturer", "model"))) if ex.rules else []
    merged, conflicts = mg.merge(ready(ex.keep(left)), ready(ex.keep(right)), ready(inp.local) if inp.local is not None else None, inp.resolutions)
    out = cat.derive(rules.substitute(renumbered(merged), inp.substitutions or {}))
    if inp.symbols:
        out = out.withColumns({c: slots.restyle(c, inp.symbols) for c in out.columns if c.startswith("slotmap_")})
    out = out.withColumn("nk", natural_key())
    reg = registry.assign(inp.registry, out.select("nk"))
    for c in ("msxorg_title", "openmsx_id"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    linked = publish.links(out, inp.wiki_base, inp.xml_base)
    if inp.link_shares is not None:
        linked = publish.share_links(linked, inp.link_shares)
    return Built(cat.project(linked.join(reg.select("nk", "id"), "nk"), "id", "nk", "links"), conflicts, reg, dead)
