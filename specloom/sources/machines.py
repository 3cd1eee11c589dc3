"""Machine descriptions in XML as facts and device rows, in one parse per document and in document order.

Broken documents never fail a task: what stands before the error is kept, as a recovering parser would, and the error is
reported in a column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: code lists of machine descriptions
TYPES = {"MSX": "MSX1", "MSX2": "MSX2", "MSX2+": "MSX2+", "MSXturboR": "turbo R"}
REGIONS = {
    "jp": "Japan", "kr": "Korea", "eu": "Europe", "us": "USA", "gb": "UK", "fr": "France", "de": "Germany", "es": "Spain", "nl": "Netherlands", "br": "Brazil",
    "se": "Sweden", "it": "Italy", "pt": "Portugal", "ru": "Russia", "sa": "Saudi Arabia", "il": "Israel", "kw": "Kuwait", "ar": "Argentina", "me": "Middle East",
}
KEYBOARDS = {
    "jp_jis": "Japanese (JIS)", "jp_ansi": "Japanese (ANSI)", "int": "International", "es": "Spanish", "fr": "French (AZERTY)", "de": "German (QWERTZ)", "gb": "UK",
    "pt": "Portuguese", "br": "Brazilian", "kr": "Korean", "ru": "Russian", "ar": "Arabic", "se": "Swedish",
}
CHARACTER_SETS = {0: "Japanese", 1: "International", 2: "Korean"}
KEYBOARD_TYPES = {0: "Japanese", 1: "International", 2: "French (AZERTY)", 3: "UK", 4: "German", 5: "Russian", 6: "Spanish", 7: "Swedish", 8: "Code 8", 9: "Code 9", 10: "Spanish"}
FM_TAGS = ("MSX-MUSIC", "MSX-MUSIC-WX", "FMPAC", "MSX-AUDIO", "MoonSound", "YM2413")
DISK_TAGS = ("TC8566AF", "WD2793", "MB8877A", "Microsol")
VDP_SPECS = {"TMS9918A": ("256x192", 16, 32), "TMS9928A": ("256x192", 16, 32), "TMS9929A": ("256x192", 16, 32), "V9938": ("512x424", 256, 32), "V9958": ("512x424", 19268, 32)}

#: the device that holds the main ROM, and the size of the blocks a firmware file is cut into
BIOS, BLOCK = "MSX BIOS with BASIC ROM", 8192

FACTS = (
    "doc string, manufacturer string, model string, year int, region string, generation string, openmsx_id string, main_ram_kb int, mapper string, sram_kb string, vdp string, vram_kb int, "
    "max_resolution string, max_colors int, max_sprites int, psg string, audio_channels int, fm_chip string, floppy_drives string, scraped_cart_slots int, tape_interface string, cpu string, "
    "sub_cpu string, keyboard_layout string, connectivity string, rtc string, z80_turbo string, error string"
)
DEVICES = (
    "doc string, doc_ord int, kind string, ms int, ss int, external boolean, tag string, id string, mem_base long, mem_size long, vis_base long, vis_size long, win_size long, wrap_base long, "
    "wrap_size long, mappertype string, sha1s array<string>, first_block int, win_base long, mirror_ps int, mirror_ss int"
)


def number(s: str | None) -> int | None:
    """'0x4000' or '16384'; anything else is null."""
    s = (s or "").strip()
    return int(s, 16) if re.fullmatch(r"0[xX][0-9a-fA-F]+", s) else int(s) if re.fullmatch(r"[+-]?\d+", s) else None


def _text(e: ET.Element | None) -> str | None:
    return ((e.text or "").strip() or None) if e is not None else None


def _small(s: str | None) -> int | None:
    return int(s) if s is not None and re.fullmatch(r"[+-]?\d{1,9}", s) else None


def parse(xml: bytes | str | None) -> tuple[ET.Element | None, str | None]:
    """(root, error): the tree up to the first error."""
    if xml is None:
        return None, "no document"
    data = xml.encode("utf-8", "surrogatepass") if isinstance(xml, str) else xml
    parser = ET.XMLPullParser(["start"])
    root, error = None, None
    try:
        parser.feed(data)
        parser.close()
    except ET.ParseError as e:
        error = str(e)
    try:
        for _, e in parser.read_events():
            root = e
            break
    except ET.ParseError as e:
        error = error or str(e)
    return root, error


def _found(devices: ET.Element, tag: str) -> list[ET.Element]:
    return list(devices.iter(tag))


def _unique(items: list[str]) -> list[str]:
    return list(dict.fromkeys(items))


def facts(doc: str, root: ET.Element, error: str | None) -> dict | None:
    """The record of one machine, or None for other kinds of machine and records without maker or code."""
    info = root.find("info")
    if info is None:
        return None
    get = lambda t: _text(info.find(t))
    kind, maker, code = get("type"), get("manufacturer"), get("code")
    if kind not in TYPES or not maker or not code:
        return None
    region = get("region")
    out = {"doc": doc, "manufacturer": maker, "model": code, "year": _small(get("release_year")), "region": REGIONS.get(region, region), "generation": TYPES[kind], "openmsx_id": doc.rsplit("/", 1)[-1].removesuffix(".xml"), "error": error}
    out |= {"cpu": "R800" if kind == "MSXturboR" else "Z80", "sub_cpu": "Z80" if kind == "MSXturboR" else None}
    dev = root.find("devices")
    if dev is None:
        return out
    size = lambda e: _small(_text(e.find("size"))) or 0
    mappers, proprietary = _found(dev, "MemoryMapper"), _found(dev, "PanasonicRAM")
    ram = sum(map(size, mappers)) + sum(map(size, proprietary))
    ids = _unique([i for m in mappers if (i := m.get("id"))])
    mapper = (", ".join(ids) if len(ids) > 1 else "Yes") if ids else "Yes" if proprietary else None
    if not ram:
        plain = sum(size(r) or sum((number(m.get("size")) or 0) for m in r.findall("mem")) // 1024 for r in _found(dev, "RAM"))
        ram, mapper = plain, "No" if plain else mapper
    roms = [r for r in _found(dev, "ROM") if _text(r.find("mappertype")) == "PANASONIC"]
    sram = _small(_text(roms[0].find("sramsize"))) if roms else None
    vdp = next(iter(_found(dev, "VDP")), None)
    version = _text(vdp.find("version")) if vdp is not None else None
    specs = VDP_SPECS.get(version, (None, None, None))
    drives = sum(_small(_text(d.find("drives"))) or 0 for t in DISK_TAGS for d in _found(dev, t))
    carts = sum(1 if p.get("external") == "true" else sum(s.get("external") == "true" for s in p.findall("secondary")) for p in root.iter("primary"))
    ppi = next(iter(_found(dev, "PPI")), None)
    board = _text(ppi.find("keyboard_type")) if ppi is not None else None
    psg, turbo = bool(_found(dev, "PSG")), dev.find("Matsushita")
    ports = [name for name, held in (("Cassette", root.find("CassettePort") is not None), ("Printer", bool(_found(dev, "PrinterPort")))) if held]
    out |= {
        "main_ram_kb": ram or None, "mapper": mapper, "sram_kb": str(sram) if sram else None, "vdp": version, "vram_kb": (_small(_text(vdp.find("vram"))) or None) if vdp is not None else None,
        "max_resolution": specs[0], "max_colors": specs[1], "max_sprites": specs[2], "psg": "AY-3-8910" if psg else None, "audio_channels": 3 if psg else None,
        "fm_chip": ", ".join(_unique([e.get("id", t) for t in FM_TAGS for e in _found(dev, t)])) or None, "floppy_drives": str(drives) if drives else None, "scraped_cart_slots": carts or None,
        "tape_interface": "Yes" if root.find("CassettePort") is not None else None, "keyboard_layout": KEYBOARDS.get(board, board), "connectivity": ", ".join(ports) or None,
        "rtc": "Yes" if dev.find("RTC") is not None else "No", "z80_turbo": "Yes" if turbo is not None and _text(turbo.find("hasturbo")) == "true" else "No",
    }
    return out


def _range(e: ET.Element | None) -> tuple[int | None, int | None]:
    return (number(e.get("base")), number(e.get("size"))) if e is not None else (None, None)


def _sha1s(e: ET.Element) -> list[str]:
    return [t.lower() for s in e.findall("sha1") if (t := _text(s))]


def bios_file(root: ET.Element) -> tuple[list[str], int] | None:
    """(hashes, offset) of the file that holds the main ROM: its own one, or the firmware file its blocks are cut from."""
    bios = next((e for e in root.iter() if e is not root and e.get("id") == BIOS), None)
    rom = bios.find("rom") if bios is not None else None
    if rom is None:
        return None
    if rom.find("sha1") is not None:
        return _sha1s(rom), _range(rom.find("window"))[0] or 0
    first = number(_text(rom.find("firstblock")))
    firmware = next(root.iter("PanasonicRom"), None)
    whole = firmware.find("rom") if firmware is not None else None
    return (_sha1s(whole), first * BLOCK) if first is not None and whole is not None else None


def device_rows(doc: str, root: ET.Element) -> Iterator[dict]:
    """Slots ('slot'), devices ('device', with their first memory range), children of compound devices ('part') and explicit
    mirrors ('mirror') in document order; at the end the file of the main ROM ('bios', its offset as win_base)."""
    n = 0
    blank = dict.fromkeys([c.split()[0] for c in DEVICES.split(", ")])

    def row(**kw) -> dict:
        nonlocal n
        n += 1
        return blank | {"doc": doc, "doc_ord": n} | kw

    def device(e: ET.Element, ms: int | None, ss: int, classified: bool) -> Iterator[dict]:
        if e.tag == "Mirror":
            b, s = _range(e.find("mem"))
            yield row(kind="mirror", ms=ms, ss=ss, tag=e.tag, mem_base=b, mem_size=s, mirror_ps=number(_text(e.find("ps"))), mirror_ss=number(_text(e.find("ss"))))
            return
        if not classified:
            return
        if e.tag.startswith("ToshibaTCX"):
            b, s = _range(e.find("mem"))
            for r in e:
                if (size := _range(r.find("window"))[1]) is not None and size > 0 and b is not None and s is not None:
                    yield row(kind="part", ms=ms, ss=ss, tag=r.tag.upper(), id=r.get("id"), win_size=size, wrap_base=b, wrap_size=s)
            return
        rom, vis = e.find("rom"), _range(e.find("rom_visibility"))
        own = {"id": e.get("id"), "tag": e.tag, "mappertype": _text(e.find("mappertype")), "vis_base": vis[0], "vis_size": vis[1]}
        if e.tag == "ROM" or rom is not None:
            own |= {"sha1s": _sha1s(rom if rom is not None else e)}
            if rom is not None:
                own |= {"win_base": _range(rom.find("window"))[0], "first_block": number(_text(rom.find("firstblock")))}
        b, s = _range(e.find("mem"))
        yield row(kind="device", ms=ms, ss=ss, mem_base=b, mem_size=s, **own)

    for dev in root.findall("devices"):
        for p in dev.findall("primary"):
            ms = number(p.get("slot"))
            cart, expanded = p.get("external") == "true", p.find("secondary") is not None
            yield row(kind="slot", ms=ms, external=cart, tag="primary")
            for c in p:
                if c.tag == "secondary":
                    ss = number(c.get("slot"))
                    yield row(kind="slot", ms=ms, ss=ss, external=c.get("external") == "true", tag="secondary")
                    for d in c:
                        yield from device(d, ms, ss, not cart and c.get("external") != "true")
                else:
                    # what stands beside the sub-slots of an expanded slot, or in a cartridge slot, is in no slot map
                    yield from device(c, ms, 0, not cart and not expanded)
    if (bios := bios_file(root)) is not None:
        yield row(kind="bios", tag="bios", sha1s=bios[0], win_base=bios[1])


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def read_facts(docs: DataFrame, doc: str = "file_name", xml: str = "xml_text") -> DataFrame:
    """One row per machine that is wanted; null documents and other kinds of machine give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for d, x in zip(b.d, b.x, strict=True):
                root, error = parse(x)
                if root is not None and (r := facts(d or "", root, error)):
                    got.append(r)
            yield _frame(got, FACTS)

    return docs.select(F.col(doc).alias("d"), F.col(xml).alias("x")).mapInPandas(run, FACTS)


def read_devices(docs: DataFrame, doc: str = "file_name", xml: str = "xml_text") -> DataFrame:
    """Slot, device, part and mirror rows of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for d, x in zip(b.d, b.x, strict=True):
                root, _ = parse(x)
                if root is not None:
                    got += device_rows(d or "", root)
            yield _frame(got, DEVICES)

    return docs.select(F.col(doc).alias("d"), F.col(xml).alias("x")).mapInPandas(run, DEVICES)
