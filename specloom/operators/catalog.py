"""The column catalogue: permanent ids, groups, display facts, and what follows from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions.codec import ViewState

SPARK_TYPES = {"string": "string", "number": "int", "boolean": "boolean"}


@dataclass(frozen=True)
class Group:
    id: int
    key: str
    label: str
    order: int


@dataclass(frozen=True)
class Field:
    """`derive` fills the column where it is null; `listed` marks comma lists; hidden columns feed others and are never
    shown; retired ones keep their id for ever."""

    id: int
    key: str
    label: str
    group: str
    type: str = "string"
    short_label: str | None = None
    tooltip: str | None = None
    linkable: bool = False
    truncate: int = 0
    shaded: bool = False
    hidden: bool = False
    retired: bool = False
    listed: bool = False
    derive: Callable[[DataFrame], Column] | None = field(default=None, compare=False)


class Catalog:
    def __init__(self, groups: list[Group], fields: list[Field]):
        self.groups, self.fields = list(groups), list(fields)
        for what, items in (("group", groups), ("column", fields)):
            for attr in ("id", "key"):
                seen = [getattr(x, attr) for x in items]
                if len(set(seen)) < len(seen):
                    raise ValueError(f"duplicate {what} {attr}")
        known = {g.key for g in groups}
        for f in fields:
            if f.id <= 0:
                raise ValueError("column ids start at 1")
            if f.group not in known:
                raise ValueError(f"{f.key}: unknown group {f.group}")
            if f.hidden and f.retired:
                raise ValueError(f"{f.key}: hidden or retired, not both")
            if f.derive is not None and (f.hidden or f.retired or not callable(f.derive)):
                raise ValueError(f"{f.key}: cannot be derived")
        self.by_key = {f.key: f for f in fields}

    def active(self) -> list[Field]:
        return [f for f in self.fields if not f.hidden and not f.retired]

    def visible(self, state: ViewState) -> list[Field]:
        """Active columns less the hidden ones; of a collapsed group only the first column stays."""
        ids = {g.key: g.id for g in self.groups}
        out, seen = [], set()
        for f in self.active():
            if f.id in state.hidden_columns:
                continue
            if ids[f.group] in state.collapsed_groups:
                if f.group in seen:
                    continue
                seen.add(f.group)
            out.append(f)
        return out

    def project(self, df: DataFrame, *keep: str) -> DataFrame:
        """Active columns in declared order with their types and metadata; missing ones are null, others vanish."""
        cols = []
        for f in self.active():
            kind = SPARK_TYPES[f.type]
            c = F.col(f.key).cast(kind) if f.key in df.columns else F.lit(None).cast(kind)
            cols.append(c.alias(f.key, metadata=self.describe(f)))
        return df.select(*keep, *cols)

    def describe(self, f: Field) -> dict:
        """A column's facts; optional ones only where they say something."""
        gid = next(g.id for g in self.groups if g.key == f.group)
        out = {"id": f.id, "key": f.key, "label": f.label, "groupId": gid, "type": f.type}
        extra = {"shortLabel": f.short_label, "tooltip": f.tooltip, "linkable": f.linkable, "truncateLimit": f.truncate, "shaded": f.shaded}
        return out | {k: v for k, v in extra.items() if v}

    def derive(self, df: DataFrame) -> DataFrame:
        """Fill derived columns where they are null, in declared order; each sees those before it."""
        for f in self.active():
            if f.derive is not None:
                new = f.derive(df).cast(SPARK_TYPES[f.type])
                df = df.withColumn(f.key, F.coalesce(F.col(f.key), new) if f.key in df.columns else new)
        return df

    def frame(self, spark: SparkSession) -> DataFrame:
        """The catalogue as a table, with each column's place in its group."""
        place: dict[str, int] = {}
        rows = []
        for i, f in enumerate(self.active()):
            rows.append((f.id, f.key, f.label, f.group, i, place.setdefault(f.group, 0)))
            place[f.group] += 1
        return spark.createDataFrame(rows, "column_id int, key string, label string, group_key string, idx int, col_order int")

    def group_header(self, spark: SparkSession, state: ViewState) -> DataFrame:
        """Per group, in order: how many columns show, how many are hidden, whether one of them is filtered."""
        groups = spark.createDataFrame([(g.key, g.label, g.order) for g in self.groups], "group_key string, label string, ord int")
        flags = spark.createDataFrame([(f.id, f.id in state.hidden_columns, f.id in state.filters) for f in self.active()], "column_id int, hid boolean, filtered boolean")
        per = self.frame(spark).select("column_id", "group_key").join(flags, "column_id").groupBy("group_key").agg(F.count_if(~F.col("hid")).alias("visible"), F.count_if("hid").alias("hidden"), F.bool_or("filtered").alias("filtered"))
        return groups.join(per, "group_key").orderBy("ord")

    def picker(self, spark: SparkSession, locked: str = "identity") -> DataFrame:
        """Columns one may hide, by group order; the locked group isn't offered."""
        groups = spark.createDataFrame([(g.key, g.order) for g in self.groups], "group_key string, ord int")
        return self.frame(spark).where(F.col("group_key") != locked).join(groups, "group_key").orderBy("ord", "idx")


def contains(column: str, part: str) -> Callable[[DataFrame], Column]:
    return lambda df: F.coalesce(F.col(column), F.lit("")).contains(part) if column in df.columns else F.lit(False)


def _engine(yes: str, no: str | None, part: str) -> Callable[[DataFrame], Column]:
    test = contains("engine", part)
    return lambda df: F.when(test(df), F.lit(yes)).otherwise(F.lit(no))


def _slots(kind: str, fallback: str | None = None) -> Callable[[DataFrame], Column]:
    """Sub-slots whose page 0 is of a kind, counted over the wide columns; 0 falls back."""

    def build(df: DataFrame) -> Column:
        have = [f"slotmap_{ms}_{ss}_0" for ms in range(4) for ss in range(4) if f"slotmap_{ms}_{ss}_0" in df.columns]
        n = sum((F.coalesce(F.col(c).rlike(rf"^{kind}\d+!?$"), F.lit(False)).cast("int") for c in have), F.lit(0))
        some = F.nullif(n, F.lit(0))
        return F.coalesce(some, F.col(fallback)) if fallback and fallback in df.columns else some

    return build


#: fixed values: groups and columns of the machine catalogue with their permanent ids
GROUPS = [
    Group(0, "identity", "Identity", 0), Group(12, "release", "Release", 1), Group(1, "memory", "Memory", 2), Group(2, "video", "Video", 3), Group(3, "audio", "Audio", 4),
    Group(4, "media", "Media", 5), Group(5, "cpu", "CPU/Chipsets", 6), Group(6, "other", "Other", 7), Group(7, "emulation", "Emulation", 8),
    *[Group(8 + ms, f"slotmap_{ms}", f"Slotmap, slot {ms}", 9 + ms) for ms in range(4)],
]
FIELDS = [
    Field(1, "manufacturer", "Manufacturer", "identity", truncate=12), Field(2, "model", "Model", "identity", linkable=True, truncate=20),
    Field(3, "year", "Year", "release", "number"), Field(4, "region", "Region", "release"), Field(5, "generation", "Generation", "release", short_label="Gen"),
    Field(7, "main_ram_kb", "Main RAM (KB)", "memory", "number", "Main RAM", "Main RAM (KB)"), Field(10, "mapper", "Memory Mapper", "memory"), Field(94, "sram_kb", "SRAM", "memory"), Field(95, "himem_addr", "HIMEM Addr", "memory"),
    Field(11, "vdp", "VDP", "video"), Field(8, "vram_kb", "VRAM (KB)", "video", "number", "VRAM", "VRAM (KB)"), Field(96, "wait_cycles", "Wait Cycles", "video", derive=_engine("1", None, "T976")),
    Field(15, "psg", "PSG", "audio"), Field(16, "fm_chip", "MSX-MUSIC", "audio"),
    Field(18, "floppy_drives", "Floppy Drive(s)", "media", short_label="Floppy Drv", tooltip="Floppy Drive(s)"),
    Field(19, "cartridge_slots", "Cartridge Slots", "media", "number", "Cart Slots", "Cartridge Slots", derive=_slots("CS", "scraped_cart_slots")),
    Field(101, "expansion_slots", "Expansion Slots", "media", "number", "Exp Slots", "Expansion Slots", derive=_slots("ES")),
    Field(20, "tape_interface", "Tape Interface", "media", short_label="Tape I/F", tooltip="Tape Interface"),
    Field(22, "cpu", "CPU", "cpu"), Field(23, "cpu_speed_mhz", "CPU Speed (MHz)", "cpu", "number", retired=True), Field(24, "sub_cpu", "Sub-CPU", "cpu"),
    Field(97, "nmos_cmos", "NMOS/CMOS", "cpu", short_label="NMOS/​CMOS", derive=_engine("CMOS", "NMOS", "T976")), Field(98, "rtc", "RTC", "cpu"), Field(99, "engine", "Engine", "cpu"),
    Field(100, "z80_turbo", "Z80 Turbo", "cpu", short_label="Z80 Turbo", tooltip="Z80 turbo mode supported"),
    Field(25, "keyboard_layout", "Keyboard Layout", "other", short_label="KB Layout", tooltip="Keyboard Layout"),
    Field(103, "character_set", "Character Set", "other", short_label="Char Set", tooltip="Character set of the main ROM (byte 0x002B, lower nibble)"),
    Field(104, "keyboard_type", "Keyboard Type", "other", short_label="KB Type", tooltip="Keyboard type of the main ROM (byte 0x002C, lower nibble)"),
    Field(27, "connectivity", "Connectivity/Ports", "other", short_label="Conn/ Ports", tooltip="Connectivity/Ports", listed=True),
    Field(28, "openmsx_id", "Machine ID", "emulation", short_label="Machine ID", tooltip="Machine ID", linkable=True, truncate=20), Field(29, "fpga_support", "FPGA", "emulation", derive=_engine("Yes", None, "Altera")),
    Field(102, "scraped_cart_slots", "Scraped Cart Slots", "media", "number", hidden=True),
    *[Field(30 + 16 * ms + 4 * ss + p, f"slotmap_{ms}_{ss}_{p}", f"{ss} / P{p}", f"slotmap_{ms}", shaded=ss % 2 == 1) for ms in range(4) for ss in range(4) for p in range(4)],
]


def machine_catalog() -> Catalog:
    return Catalog(GROUPS, FIELDS)
