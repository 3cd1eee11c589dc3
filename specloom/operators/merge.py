"""Reconciling sources: a keyed full outer join of three tables with per-field precedence and a conflict report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions.text import mapped, mapped_list, natural_key
from specloom.operators.slots import ABSENT, EMPTY, is_slot_type

#: fixed values: spellings that are no conflict
REGIONS = {"south korea": "Korea", "korea": "Korea", "the netherlands": "Netherlands", "netherlands": "Netherlands"}
FM_CHIPS = {
    "msx-music": "YM2413", "msx music": "YM2413", "fm-pac": "YM2413", "fmpac": "YM2413", "fm-pak": "YM2413", "fmpak": "YM2413", "ym2413": "YM2413",
    "msx-audio": "MSX-AUDIO", "msx audio": "MSX-AUDIO", "moonsound": "MoonSound",
}
GENERATIONS = {"msx": "MSX1", "msx1": "MSX1", "msx2": "MSX2", "msx2+": "MSX2+", "turbo r": "turbo R", "msxturbor": "turbo R"}


@dataclass(frozen=True)
class Precedence:
    """Which side wins a field that both sources hold differently."""

    right_always: frozenset[str] = frozenset({"openmsx_id", "msxorg_title"})
    prefer_left: frozenset[str] = frozenset({"scraped_cart_slots", "vdp", "vram_kb", "main_ram_kb", "psg"})
    prefer_right: frozenset[str] = frozenset({"keyboard_layout", "region"})
    slot_prefix: str = "slotmap_"
    names: tuple[str, str] = field(default=("openmsx", "msxorg"))


def normalise(df: DataFrame) -> DataFrame:
    """Region, FM chip and generation under one spelling each; unknown values stay as they are."""
    known = {"region": lambda c: mapped(c, REGIONS, fold=True), "fm_chip": lambda c: mapped_list(c, FM_CHIPS), "generation": lambda c: mapped(c, GENERATIONS, fold=True)}
    return df.withColumns({c: f(c) for c, f in known.items() if c in df.columns and df.schema[c].dataType.typeName() == "string"})


def migrate(df: DataFrame) -> DataFrame:
    """Legacy columns: `standard` overwrites `generation`, `cartridge_slots` fills `scraped_cart_slots` where that is missing."""
    if "standard" in df.columns:
        new = F.coalesce("standard", "generation") if "generation" in df.columns else F.col("standard")
        df = df.withColumn("generation", new).drop("standard")
    if "cartridge_slots" in df.columns:
        new = F.coalesce("scraped_cart_slots", "cartridge_slots") if "scraped_cart_slots" in df.columns else F.col("cartridge_slots")
        df = df.withColumn("scraped_cart_slots", new).drop("cartridge_slots")
    return df


def last_per_key(df: DataFrame, order: str, key: Column | None = None) -> DataFrame:
    """One row per natural key, the last by `order`; a partial aggregate, so hot keys combine before the exchange."""
    nk = natural_key() if key is None else key
    rest = [c for c in df.columns if c != order]
    return df.groupBy(nk.alias("nk")).agg(F.max_by(F.struct(*rest), order).alias("r")).select("nk", *[F.col(f"r.{c}").alias(c) for c in rest])


def field_rule(name: str, rules: Precedence, left: Column, right: Column, resolved: Column | None = None) -> tuple[Column, Column]:
    """(value, is_conflict) of one field where both sources have the record."""
    both = left.isNotNull() & right.isNotNull()
    differ = both & (left.cast("string") != right.cast("string"))
    if name in rules.right_always:
        return F.coalesce(right, left), F.lit(False)
    plain = F.coalesce(left, right)
    if resolved is None:
        resolved = F.lit(None).cast("string")
    value = F.when(differ & (resolved == rules.names[0]), left).when(differ & resolved.isNotNull(), right)
    if name in rules.prefer_left:
        return value.otherwise(plain), F.lit(False)
    if name in rules.prefer_right:
        return value.when(differ, right).otherwise(plain), F.lit(False)
    open_ = differ & resolved.isNull()
    if name.startswith(rules.slot_prefix):
        right_slot = is_slot_type(right)
        takes = right_slot & (is_slot_type(left) | left.isin(EMPTY, ABSENT))
        return value.when(differ & takes, right).otherwise(plain), open_ & ~F.coalesce(takes, F.lit(False))
    return value.otherwise(plain), open_


def merge(left: DataFrame, right: DataFrame, local: DataFrame | None = None, resolutions: DataFrame | None = None, rules: Precedence = Precedence(), order: str = "ord") -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(merged rows, conflicts) of two scraped sources and a local supplement, joined on the natural key.

    Of duplicates in one source the last by `order` counts. Columns missing on one side are null there. Of several resolutions of one
    field the first by name counts. Non-null local fields win over everything. Conflicts keep the left value and are reported as (nk, field, left_value, right_value).
    Presence flags has_left, has_right, has_local tell where a row came from. Empty inputs give empty outputs.
    """
    a, b = last_per_key(left, order), last_per_key(right, order)
    fields = list(dict.fromkeys([c for c in [*a.columns, *b.columns] if c != "nk"]))
    kinds = {f.name: f.dataType for f in [*b.schema.fields, *a.schema.fields]}
    side = lambda df, p: df.select("nk", F.struct(*[(F.col(c).cast(kinds[c]) if c in df.columns else F.lit(None).cast(kinds[c])).alias(c) for c in fields]).alias(p))
    j = side(a, "l").join(side(b, "r"), "nk", "full_outer")
    chosen = F.lit(None).cast("map<string,string>")
    if resolutions is not None:
        one = resolutions.groupBy("nk", "field").agg(F.min("source").alias("source"))
        per = one.groupBy("nk").agg(F.map_from_entries(F.collect_list(F.struct("field", "source"))).alias("res"))
        j = j.join(per, "nk", "left")
        chosen = F.col("res")
    out, conflicts = [], []
    for c in fields:
        value, clash = field_rule(c, rules, F.col(f"l.{c}"), F.col(f"r.{c}"), chosen[c])
        out.append(value.alias(c))
        conflicts.append(F.when(clash, F.struct(F.lit(c).alias("field"), F.col(f"l.{c}").cast("string").alias("left_value"), F.col(f"r.{c}").cast("string").alias("right_value"))))
    m = j.select("nk", *out, F.col("l").isNotNull().alias("has_left"), F.col("r").isNotNull().alias("has_right"), F.array_compact(F.array(*conflicts)).alias("_conflicts"))
    report = m.where("has_left and has_right").select("nk", F.inline("_conflicts"))
    merged = m.drop("_conflicts")
    if local is not None:
        merged = overlay(merged, last_per_key(local, order))
    else:
        merged = merged.withColumn("has_local", F.lit(False))
    return merged, report


def overlay(base: DataFrame, local: DataFrame) -> DataFrame:
    """Non-null fields of `local` win; keys that only it has are added."""
    own = [c for c in local.columns if c != "nk"]
    lo = local.select("nk", F.struct(*own).alias("x"))
    j = base.join(lo, "nk", "full_outer")
    flags = ("has_left", "has_right", "has_local")
    cols = [c for c in base.columns if c != "nk" and c not in flags]
    out = [F.coalesce(F.col(f"x.{c}").cast(base.schema[c].dataType), F.col(c)).alias(c) if c in own else F.col(c) for c in cols]
    out += [F.col(f"x.{c}").alias(c) for c in own if c not in cols]
    return j.select("nk", *out, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_left", "has_right")], F.col("x").isNotNull().alias("has_local"))


def presence(merged: DataFrame) -> DataFrame:
    """How many keys each combination of sources holds."""
    return merged.groupBy("has_left", "has_right", "has_local").agg(F.count("*").alias("n"))


def conflict_summary(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("field").agg(F.count("*").alias("n")).orderBy("field")
