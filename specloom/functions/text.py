"""Scalar text expressions shared by operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space plus the separators that count as white space when a string is stripped.
_SPACE = r"[\s\x1c-\x1f\x85]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without leading and trailing white space of any script (`trim` takes plain blanks only)."""
    return F.regexp_replace(col(c), rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def natural_key(manufacturer: Column | str = "manufacturer", model: Column | str = "model") -> Column:
    """lower(strip(manufacturer)) || '|' || lower(strip(model)); null counts as ''. Lower-cased first, then stripped."""
    side = lambda c: strip(F.lower(F.coalesce(col(c).cast("string"), F.lit(""))))
    return F.concat(side(manufacturer), F.lit("|"), side(model))


def comma_list(c: Column | str) -> Column:
    """Parts of a comma list trimmed, emptied of blanks, sorted without regard to case and accents, joined with ', '."""
    parts = F.filter(F.transform(F.split(col(c), ","), strip), lambda x: x != "")
    keyed = F.transform(F.array_sort(F.transform(parts, lambda x: F.struct(base_key(x).alias("k"), x.alias("v")))), lambda s: s["v"])
    return F.array_join(keyed, ", ")


#: fixed values: accented Latin letters and their bases, position by position
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_BASES = "aaaaaaceeeeiiiinooooouuuuyy"


def base_key(c: Column | str) -> Column:
    """Key of the comparison that ignores case and accents."""
    return F.translate(F.lower(col(c)), _ACCENTED, _BASES)


def display_text(c: Column | str, data_type: str = "string", listed: bool = False) -> Column:
    """What a cell shows: an em dash for null and '', Yes/No for booleans, sorted parts for comma lists."""
    x = col(c)
    if data_type == "boolean":
        text = F.when(x, "Yes").when(~x, "No")
    else:
        text = comma_list(x) if listed else x.cast("string")
    return F.when(x.isNull() | (x.cast("string") == ""), F.lit("—")).otherwise(text)


def truncated(c: Column | str, limit: int) -> Column:
    """Texts longer than `limit` end in an ellipsis at that length; 0 and less leave the text as it is."""
    x = col(c)
    return x if limit <= 0 else F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit - 1), F.lit("…"))).otherwise(x)


def slug_to_filename(url: Column | str, suffix: str = ".html") -> Column:
    """File name of a mirrored page: the percent-decoded part after '/wiki/', '_' as blank, ':' and '/' as '_'. '+' stays."""
    slug = F.regexp_extract(col(url), r"/wiki/(.*)$", 1)
    return F.concat(F.translate(F.url_decode(F.replace(slug, F.lit("+"), F.lit("%2B"))), "_:/", " __"), F.lit(suffix))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def year_of(c: Column | str) -> Column:
    return _first(col(c), r"(\d{4})").cast("int")


def ram_kb(c: Column | str) -> Column:
    """'64kB in slot 3-0 + 16kB SRAM' -> 64: a size said to be main or in a slot before any other."""
    return F.coalesce(_first(col(c), r"(?i)(\d+)\s*kB\s+(?:in|mapped|main|slot)"), _first(col(c), r"(?i)(\d+)\s*kB")).cast("int")


def vram_kb(c: Column | str) -> Column:
    return _first(col(c), r"(?i)(\d+)\s*kB").cast("int")


def best_vdp(c: Column | str) -> Column:
    """The highest of the display chips named; the first of equals."""
    found = F.regexp_extract_all(col(c), F.lit(r"(?i)(V9958|V9938|TMS99[12][89]A?)"), F.lit(1))
    rank = lambda x: F.when(F.upper(x) == "V9958", 2).when(F.upper(x) == "V9938", 1).otherwise(0)
    keyed = F.transform(found, lambda x, i: F.struct(rank(x).alias("r"), (-i).alias("i"), x.alias("v")))
    return F.array_max(keyed)["v"]


def fm_chips(c: Column | str) -> Column:
    """FM chips named in an audio text, in fixed order; null if none."""
    low = F.lower(col(c))
    has = lambda *ws: F.rlike(low, F.lit("|".join(ws)))
    chips = F.array_compact(F.array(F.when(has("msx-music", "ym2413", "opll"), "MSX-MUSIC"), F.when(has("msx-audio", "y8950", "opa"), "MSX-AUDIO"), F.when(has("moonsound", "opl4"), "MoonSound")))
    return F.nullif(F.array_join(chips, ", "), F.lit(""))


def psg_chip(c: Column | str) -> Column:
    return F.when(F.lower(col(c)).rlike("psg|ay-3-8910|ym2149"), "AY-3-8910")


def floppy_drives(c: Column | str) -> Column:
    """Number of drives as text: 'N x 3.5 floppy', else 'two' or 'three', else 1 where a drive is named at all."""
    x, low = col(c), F.lower(col(c))
    counted = _first(x, r"(?i)(\d+)\s*[×x]\s*(?:\d+kB\s+)?(?:3[,.]5|5[,.]25)[\"”″]?\s*(?:floppy|disk|FDD)")
    named = low.contains("floppy") | low.contains("disk drive") | low.contains("3,5") | low.contains("3.5")
    return F.when(named, F.coalesce(counted, F.when(low.contains("two"), "2").when(low.contains("three"), "3").otherwise("1")))


def cartridge_slots(c: Column | str) -> Column:
    return _first(col(c), r"(?i)(\d+)\s*cartridge\s*slot").cast("int")


def int_text(c: Column | str) -> Column:
    """Strict integer of a text with outer white space; anything else is null."""
    return F.when(strip(c).rlike(r"^[+-]?\d{1,9}$"), strip(c)).cast("int")


def hex_or_int(c: Column | str) -> Column:
    """'0x4000' or '16384' -> 16384; anything else is null."""
    s = strip(c)
    hexed = F.conv(F.regexp_extract(s, r"^0[xX]([0-9a-fA-F]{1,8})$", 1), 16, 10).cast("long")
    return F.when(s.rlike(r"^0[xX][0-9a-fA-F]{1,8}$"), hexed).when(s.rlike(r"^[+-]?\d{1,18}$"), s.cast("long"))


def low_nibble(c: Column | str, names: dict[int, str]) -> Column:
    """Name of the lower four bits; null where the list has none."""
    pairs = [F.lit(x) for k, v in names.items() for x in (k, v)]
    return F.create_map(*pairs)[col(c).bitwiseAND(F.lit(15)).cast("int")]


def mapped(c: Column | str, names: dict[str, str], keep: bool = True, fold: bool = False) -> Column:
    """Look a value up in a fixed map; `keep` passes on what isn't listed, `fold` looks up lower-cased and stripped."""
    key = strip(F.lower(col(c))) if fold else col(c)
    hit = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key]
    return F.coalesce(hit, col(c)) if keep else hit


def mapped_list(c: Column | str, names: dict[str, str]) -> Column:
    """`mapped` for each part of a comma list."""
    look = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.array_join(F.transform(F.transform(F.split(col(c), ","), strip), lambda p: F.coalesce(look[F.lower(p)], p)), ", ")
