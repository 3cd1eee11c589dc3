"""Address ranges on a fixed grid: 4 main slots x 4 sub-slots x 4 pages of 16 KiB, in long form (doc, ms, ss, p, abbr).

Everything is grouped by document, so one machine never meets another's rows; first-wins rules are min_by aggregates with
map-side combining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGE = 0x4000
ABSENT, EMPTY, MIRROR, SUBSLOT = "⌧", "⌴", "*", "!"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pages_of(base: Column | str, size: Column | str) -> Column:
    """Pages 0..3 that [base, base + size) meets; a range of size 0 meets the page it lies strictly inside."""
    b, s = _c(base).cast("long"), _c(size).cast("long")
    return F.filter(F.sequence(F.lit(0), F.lit(3)), lambda p: (p * PAGE < b + s) & ((p + 1) * PAGE > b))


def is_slot_type(cell: Column | str) -> Column:
    """CS1, ES2!, a bare CS, EXP."""
    return _c(cell).rlike(r"^(?:(?:CS|ES)\d*!?|EXP)$")


def page_map(devices: DataFrame, key: tuple[str, ...] = ("doc", "ms", "ss"), order: str = "doc_ord") -> DataFrame:
    """(key, p, abbr, n): of the devices that claim a page the first in document order; n > 1 tells of an overlap.

    `devices` has mem_base, mem_size and abbr; devices without memory or without a range claim nothing.
    """
    each = devices.where("mem_base is not null and mem_size is not null").withColumn("p", F.explode(pages_of("mem_base", "mem_size")))
    return each.groupBy(*key, "p").agg(F.min_by("abbr", order).alias("abbr"), F.count("*").alias("n"))


def packed(children: DataFrame, wrapper: tuple[str, ...], order: str, size: str = "win_size", base: str = "wrap_base", room: str = "wrap_size") -> DataFrame:
    """Children of a compound device, one after the other inside the wrapper's range: adds mem_base and mem_size.

    What lies beyond the wrapper is clipped; children that begin beyond it are dropped.
    """
    w = Window.partitionBy(*wrapper).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(size).over(w), F.lit(0))
    out = children.withColumn("_at", at).where(F.col("_at") < F.col(room))
    return out.withColumn("mem_base", F.col(base) + F.col("_at")).withColumn("mem_size", F.least(F.col(size), F.col(room) - F.col("_at"))).drop("_at")


def mirrored_outside(devices: DataFrame) -> DataFrame:
    """Pages of a device's memory outside its visible range, as mirrors of it: (doc, ms, ss, p, abbr). A mirror is called by what
    the device is (`label`, where there is one), whatever drives it."""
    d = devices.where("vis_base is not null and vis_size is not null and mem_base is not null")
    gone = F.array_except(pages_of("mem_base", "mem_size"), pages_of("vis_base", "vis_size"))
    return d.select("doc", "ms", "ss", F.explode(gone).alias("p"), F.concat(_label(devices), F.lit(MIRROR)).alias("abbr"), "doc_ord")


def mirrored_beyond(devices: DataFrame) -> DataFrame:
    """Pages of a device's memory at or beyond the end of its file: (doc, ms, ss, p, abbr), visible or not. `file_size` null:
    none."""
    d = devices.where("file_size is not null and mem_base is not null")
    beyond = F.filter(pages_of("mem_base", "mem_size"), lambda p: p * PAGE - F.col("mem_base") >= F.col("file_size"))
    return d.select("doc", "ms", "ss", F.explode(beyond).alias("p"), F.concat(_label(devices), F.lit(MIRROR)).alias("abbr"), "doc_ord")


def _label(devices: DataFrame) -> Column:
    return F.col("label") if "label" in devices.columns else F.col("abbr")


def mode_of(df: DataFrame, key: tuple[str, ...], value: str = "abbr") -> DataFrame:
    """The most frequent value per key; of ties the smallest."""
    return df.groupBy(*key).agg(F.mode(value, True).alias(value))


def mirror_elements(mirrors: DataFrame, pages: DataFrame) -> DataFrame:
    """Explicit mirrors (doc, ms, ss, mem_base, mem_size, mirror_ps, mirror_ss) take the mode of their origin slot.

    Hosts outside 0..3 are dropped; a cartridge slot is an origin like any other; an origin without devices gives none.
    """
    origin = mode_of(pages.where(~F.col("abbr").endswith(MIRROR)), ("doc", "ms", "ss")).withColumnsRenamed({"ms": "mirror_ps", "ss": "mirror_ss", "abbr": "origin"})
    m = mirrors.where("ms between 0 and 3 and ss between 0 and 3").withColumn("mirror_ss", F.coalesce("mirror_ss", F.lit(0)))
    each = m.withColumn("p", F.explode(pages_of("mem_base", "mem_size"))).join(origin, ["doc", "mirror_ps", "mirror_ss"])
    return each.select("doc", "ms", "ss", "p", F.concat("origin", F.lit(MIRROR)).alias("abbr"), "doc_ord")


def fill(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """All 64 cells of each document. `layout`: (doc, ms, expanded, external, number): the primaries there are.

    An external primary is CS{number} on its four pages; a plain one has sub-slot 0 only; an expanded one has all four.
    Cells without a device are EMPTY where the sub-slot exists and ABSENT where it doesn't.
    """
    grid = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda m: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.struct(m.alias("ms"), F.floor(k / 4).cast("int").alias("ss"), (k % 4).alias("p"))))))
    scaffold = layout.select("doc").distinct().select("doc", grid.alias("g")).select("doc", "g.*")
    full = scaffold.join(layout, ["doc", "ms"], "left").join(cells.select("doc", "ms", "ss", "p", "abbr"), ["doc", "ms", "ss", "p"], "left")
    real = F.col("expanded").isNotNull() & ((F.col("ss") == 0) | F.col("expanded"))
    cart = F.when(F.coalesce("external", F.lit(False)) & (F.col("ss") == 0), F.concat(F.lit("CS"), F.col("number").cast("string")))
    return full.select("doc", "ms", "ss", "p", F.coalesce(F.when(real, F.coalesce("abbr", cart, F.lit(EMPTY))), F.lit(ABSENT)).alias("abbr"))


def slot_map(slots: DataFrame, devices: DataFrame, mirrors: DataFrame | None = None) -> DataFrame:
    """The 64-cell map of every document from its slots and classified devices.

    `slots`: (doc, doc_ord, ms, ss, external), ss null for primaries; `devices`: (doc, doc_ord, ms, ss, abbr, mem_base,
    mem_size, vis_base, vis_size, file_size). Stages overwrite one another in this order: devices (first claims a page) and
    cartridge slots, pages of each device outside its visible range and beyond its file, explicit mirrors of what stands then.
    Cartridge slots are numbered in document order; what they hold is in no cell.
    """
    w = Window.partitionBy("doc").orderBy("doc_ord")
    ms_ok = slots.where("ms between 0 and 3 and (ss is null or ss between 0 and 3)")
    expanded = ms_ok.groupBy("doc", "ms").agg(F.bool_or(F.col("ss").isNotNull()).alias("expanded"), F.bool_or(F.col("ss").isNull() & F.col("external")).alias("external"))
    carts = ms_ok.join(expanded.withColumnsRenamed({"external": "p_ext"}), ["doc", "ms"]).where("external and (ss is null or not p_ext)").withColumn("number", F.row_number().over(w))
    layout = expanded.join(carts.where("ss is null").groupBy("doc", "ms").agg(F.min("number").alias("number")), ["doc", "ms"], "left")
    pages = page_map(devices)
    four = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("p")
    number = F.concat(F.lit("CS"), F.col("number").cast("string"))
    slot = carts.select("doc", "ms", F.coalesce("ss", F.lit(0)).alias("ss"), four, F.when(F.col("ss").isNull(), number).otherwise(F.concat(number, F.lit(SUBSLOT))).alias("abbr"))
    stage = lambda df, n, o: df.select("doc", "ms", "ss", "p", "abbr", F.lit(n).alias("stage"), o.cast("long").alias("o"))
    stages = stage(pages, 0, F.lit(0)).unionByName(stage(slot, 0, F.lit(1)))
    # device by device, first what can't be seen, then what lies beyond the file
    stages = stages.unionByName(stage(mirrored_outside(devices), 1, F.col("doc_ord") * 2)).unionByName(stage(mirrored_beyond(devices), 1, F.col("doc_ord") * 2 + 1))
    last = lambda df: df.groupBy("doc", "ms", "ss", "p").agg(F.max_by("abbr", F.struct("stage", "o")).alias("abbr"))
    cells = last(stages)
    if mirrors is not None:
        cells = last(stage(cells, 0, F.lit(0)).unionByName(stage(mirror_elements(mirrors, cells), 1, F.col("doc_ord"))))
    return fill(cells, layout)


def html_slot_map(cells: DataFrame, classify: Column) -> DataFrame:
    """Slot map of a flattened table (doc, r, c, text): rows with an address label are pages, the last row without one above
    is the header that names the columns.

    Cartridge and expansion columns are numbered from left to right by kind, '!' inside expanded slots; the text 'mirror'
    takes the mode of the same sub-slot, else of the whole table, else '?*'. Ties end at the smallest.
    """
    addr = F.nullif(F.regexp_extract("text", r"\b([0-9A-Fa-f]{4})[hH]", 1), F.lit(""))
    labelled = cells.withColumn("page", F.floor(F.conv(addr, 16, 10).cast("long") / PAGE).cast("int"))
    rows = labelled.where("c = 0").select("doc", "r", F.when(F.col("page").between(0, 3), F.col("page")).alias("p"))
    first_data = rows.where("p is not null").groupBy("doc").agg(F.min("r").alias("first"))
    head_row = rows.join(first_data, "doc").where("p is null and r < first").groupBy("doc").agg(F.max("r").alias("r"))
    bare = F.regexp_replace(F.regexp_replace(F.trim("text"), r"^[Ss]lot\s*", ""), r"[^0-9\-‑]+$", "")
    two, one = F.regexp_extract(bare, r"(\d)\D(\d)$", 1), F.regexp_extract(bare, r"(?:^|\D)(\d)$", 1)
    head = cells.join(head_row, ["doc", "r"]).where("c > 0").select("doc", "c", F.nullif(F.coalesce(F.nullif(two, F.lit("")), one), F.lit("")).cast("int").alias("ms"), F.coalesce(F.nullif(F.regexp_extract(bare, r"(\d)\D(\d)$", 2), F.lit("")).cast("int"), F.lit(0)).alias("ss")).where("ms between 0 and 3 and ss between 0 and 3")
    grown = head.groupBy("doc", "ms").agg((F.count_distinct("ss") > 1).alias("expanded"))
    data = cells.where("c > 0").join(rows.where("p is not null"), ["doc", "r"]).join(head, ["doc", "c"]).join(grown, ["doc", "ms"])
    data = data.withColumn("kind", F.when(F.trim("text") == "", F.lit("")).otherwise(classify))
    top = data.join(first_data, "doc").where(F.col("r") == F.col("first")).where(F.col("kind").isin("CS", "ES"))
    number = top.withColumn("n", F.row_number().over(Window.partitionBy("doc", "kind").orderBy("c"))).select("doc", "c", "kind", "n")
    data = data.join(number, ["doc", "c", "kind"], "left")
    slot = F.when(F.col("kind").isin("CS", "ES"), F.concat("kind", F.coalesce(F.col("n").cast("string"), F.lit("")), F.when(F.col("expanded"), SUBSLOT).otherwise("")))
    data = data.withColumn("abbr", F.coalesce(slot, F.when(F.col("kind") == "", None).when(F.col("kind") == "MIRROR", None).otherwise(F.coalesce("kind", F.substring(F.trim("text"), 1, 10)))))
    same = mode_of(data.where("abbr is not null"), ("doc", "ms", "ss")).withColumnRenamed("abbr", "own")
    all_ = mode_of(data.where("abbr is not null"), ("doc",)).withColumnRenamed("abbr", "any")
    data = data.join(same, ["doc", "ms", "ss"], "left").join(all_, "doc", "left")
    abbr = F.when(F.col("kind") == "MIRROR", F.concat(F.coalesce("own", "any", F.lit("?")), F.lit(MIRROR))).otherwise(F.col("abbr"))
    out = data.select("doc", "ms", "ss", "p", abbr.alias("abbr")).where("abbr is not null").groupBy("doc", "ms", "ss", "p").agg(F.min("abbr").alias("abbr"))
    layout = grown.select("doc", "ms", "expanded", F.lit(False).alias("external"), F.lit(None).cast("int").alias("number"))
    return fill(out, layout)


def renumber(cells: DataFrame, key: str = "nk") -> DataFrame:
    """Cartridge and expansion slots numbered anew in (ms, ss) order, each kind from 1, by their cell on page 0.

    The new name is set on all four pages and keeps its '!'; EXP and slots not on page 0 keep what they have.
    """
    first = cells.where("p = 0").withColumn("kind", F.nullif(F.regexp_extract("abbr", r"^(CS|ES)\d*!?$", 1), F.lit(""))).where("kind is not null")
    w = Window.partitionBy(key, "kind").orderBy("ms", "ss")
    named = first.select(key, "ms", "ss", F.concat("kind", F.row_number().over(w).cast("string"), F.when(F.col("abbr").endswith(SUBSLOT), SUBSLOT).otherwise("")).alias("new"))
    return cells.join(named, [key, "ms", "ss"], "left").withColumn("abbr", F.coalesce("new", "abbr")).drop("new")


def slot_column(ms: int, ss: int, p: int) -> str:
    return f"slotmap_{ms}_{ss}_{p}"


SLOT_COLUMNS = [(ms, ss, p) for ms in range(4) for ss in range(4) for p in range(4)]


def restyle(column: Column | str, symbols: dict[str, str]) -> Column:
    """A cell in configured symbols (absent, empty_page, mirror_suffix, subslot_suffix; others as they are)."""
    c = _c(column)
    old = {"absent": ABSENT, "empty_page": EMPTY, "mirror_suffix": MIRROR, "subslot_suffix": SUBSLOT}
    new = {k: symbols.get(k, v) for k, v in old.items()}
    tail = F.when(c.endswith(MIRROR), new["mirror_suffix"]).when(c.rlike(r"^(?:CS|ES)\d*!$"), new["subslot_suffix"])
    return F.when(c == ABSENT, new["absent"]).when(c == EMPTY, new["empty_page"]).when(tail.isNotNull(), F.concat(F.substring(c, F.lit(1), F.length(c) - 1), tail)).otherwise(c)


def widen(cells: DataFrame, key: str = "nk") -> DataFrame:
    """Long form to 64 columns, one aggregate and no pivot pre-pass."""
    return cells.groupBy(key).agg(*[F.max(F.when((F.col("ms") == ms) & (F.col("ss") == ss) & (F.col("p") == p), F.col("abbr"))).alias(slot_column(ms, ss, p)) for ms, ss, p in SLOT_COLUMNS])


def lengthen(df: DataFrame, key: str = "nk") -> DataFrame:
    """64 columns to long form; columns that are missing or null give no row."""
    have = [(ms, ss, p) for ms, ss, p in SLOT_COLUMNS if slot_column(ms, ss, p) in df.columns]
    each = F.array(*[F.struct(F.lit(ms).alias("ms"), F.lit(ss).alias("ss"), F.lit(p).alias("p"), F.col(slot_column(ms, ss, p)).alias("abbr")) for ms, ss, p in have])
    return df.select(key, F.inline(each)).where("abbr is not null")


def count_slots(cells: DataFrame, kind: str, key: str = "nk") -> DataFrame:
    """Sub-slots whose page 0 is a slot of this kind; none is null."""
    hit = (F.col("p") == 0) & F.col("abbr").rlike(rf"^{kind}\d+!?$")
    return cells.groupBy(key).agg(F.nullif(F.count_if(hit), F.lit(0)).cast("int").alias("n"))
