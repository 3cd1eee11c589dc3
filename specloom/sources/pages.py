"""Wiki pages: category listings, specification tables, port lists and slot tables, parsed once per page.

Only what needs a cursor over the markup is done here (links, cells, bullets, row and column spans); everything after that
is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions import text as tx
from specloom.operators.publish import explode_variants, highest_per_url, without_notes
from specloom.sources.files import mirrored_page, next_page

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PAGE = "doc string, specs map<string,string>, bullets array<string>, links array<struct<href:string,text:string,title:string,listed:boolean>>, cells array<struct<r:int,c:int,text:string>>"


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def iter(self, *tags: str) -> Iterator[_Node]:
        for c in self.children:
            if isinstance(c, _Node):
                if c.tag in tags:
                    yield c
                yield from c.iter(*tags)

    def text(self) -> str:
        parts: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if x.strip():
                    parts.append(x.strip())
            else:
                stack += reversed(x.children)
        return " ".join(parts)


class _Tree(HTMLParser):
    """A forgiving tree: unknown end tags are ignored, cells, rows and items end where the next begins."""

    ENDS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "p": {"p"}}
    STOP = {"li": {"ul", "ol"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "p": {"div", "td", "li", "body"}}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.stack[k].tag
            if t in self.STOP.get(tag, ()):
                break
            if t in self.ENDS.get(tag, ()):
                del self.stack[k:]
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag not in ("script", "style"):
            self.stack[-1].children.append(data)


def tree(html: bytes | str) -> _Node:
    t = _Tree()
    t.feed(html.decode("utf-8", "replace") if isinstance(html, bytes) else html)
    t.close()
    return t.root


def _rows(table: _Node) -> list[list[_Node]]:
    own = [r for r in table.iter("tr")]
    nested = {id(r) for inner in table.iter("table") for r in inner.iter("tr")}
    return [[c for c in r.children if isinstance(c, _Node) and c.tag in ("td", "th")] for r in own if id(r) not in nested]


def specs(root: _Node) -> dict[str, str]:
    """The first table with a Brand or Model row, as key -> value; of equal keys the last counts."""
    for table in root.iter("table"):
        got = {cs[0].text().rstrip(":").strip(): cs[1].text() for cs in _rows(table) if len(cs) == 2}
        if "Brand" in got or "Model" in got:
            return got
    return {}


def section(root: _Node, part: str) -> list[_Node]:
    """What follows the first h2 or h3 whose text has `part`, up to the next of them."""
    flat: list[_Node] = []

    def walk(n: _Node) -> None:
        for c in n.children:
            if isinstance(c, _Node):
                if c.tag in ("h2", "h3", "ul", "ol", "p", "table", "dl"):
                    flat.append(c)
                else:
                    walk(c)

    walk(root)
    for k, n in enumerate(flat):
        if n.tag in ("h2", "h3") and part in n.text().lower():
            rest = flat[k + 1 :]
            return rest[: next((i for i, x in enumerate(rest) if x.tag in ("h2", "h3")), len(rest))]
    return []


def bullets(root: _Node) -> list[str]:
    """Items of the connections section, one text per bullet, so that a negation stays in its bullet."""
    out = []
    for n in section(root, "connection"):
        out += [x.text() for x in n.children if isinstance(x, _Node) and x.tag == "li"] if n.tag == "ul" else [n.text()]
    return out


def flatten(table: _Node) -> list[list[str]]:
    """A table as a rectangle: spans repeat their text, row spans end with the table, short rows are padded with ''."""
    rows = _rows(table)
    grid: list[dict[int, str]] = [{} for _ in rows]
    for r, cells in enumerate(rows):
        c = 0
        for cell in cells:
            while c in grid[r]:
                c += 1
            span = lambda a, cell=cell: int(v) if (v := cell.attrs.get(a, "1")).isdigit() and int(v) > 0 else 1
            for rr in range(r, min(len(rows), r + span("rowspan"))):
                for cc in range(c, c + span("colspan")):
                    grid[rr][cc] = cell.text()
            c += span("colspan")
    width = max((max(g, default=-1) + 1 for g in grid), default=0)
    return [[g.get(c, "") for c in range(width)] for g in grid]


def slot_cells(root: _Node) -> list[tuple[int, int, str]]:
    """Cells of the first table in the first slot map section."""
    for n in section(root, "slot map"):
        for t in [n] if n.tag == "table" else list(n.iter("table")):
            return [(r, c, x) for r, row in enumerate(flatten(t)) for c, x in enumerate(row)]
    return []


def category_lists(node: _Node) -> Iterator[_Node]:
    """Elements that list the members of a category."""
    for c in node.children:
        if isinstance(c, _Node):
            if c.attrs.get("id") == "mw-pages" or "mw-category" in c.attrs.get("class", "").split():
                yield c
            else:
                yield from category_lists(c)


def read_pages(docs: DataFrame, doc: str = "file_name", html: str = "content") -> DataFrame:
    """One row per page with its specification map, bullets, links and slot table cells; null pages give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, h in zip(b.d, b.h, strict=True):
                if h is None:
                    continue
                root = tree(h)
                listed = {id(a) for n in category_lists(root) for a in n.iter("a")}
                links = [{"href": a.attrs.get("href", ""), "text": a.text(), "title": a.attrs.get("title", ""), "listed": id(a) in listed} for a in root.iter("a")]
                out.append((d, specs(root), bullets(root), links, [{"r": r, "c": c, "text": t} for r, c, t in slot_cells(root)]))
            yield pd.DataFrame(out, columns=["doc", "specs", "bullets", "links", "cells"])

    return docs.select(F.col(doc).alias("d"), F.col(html).alias("h")).mapInPandas(run, PAGE)


_NO = r"(?i)\b(no|not|without|none)\b"


def ports(items: Column) -> tuple[Column, Column, Column]:
    """(connectivity, tape, cartridge slots) of a list of bullets; a negated bullet names no port. The
    last bullet that counts cartridge slots counts; one that doesn't stands for two where none does."""
    said = F.filter(F.transform(items, F.lower), lambda b: ~F.rlike(b, F.lit(_NO)))
    any_of = lambda *ws: F.exists(said, lambda b: F.rlike(b, F.lit("|".join(map(re.escape, ws)))))
    tape = any_of("data recorder", "cassette")
    list_ = F.array_compact(F.array(F.when(tape, "Cassette"), F.when(any_of("printer", "parallel", "centronics"), "Printer")))
    carts = F.filter(F.transform(items, F.lower), lambda b: b.contains("cartridge slot"))
    count = F.transform(carts, lambda b: F.nullif(F.regexp_extract(b, r"(\d+)\s*[×x]?\s*cartridge", 1), F.lit("")).cast("int"))
    counted = F.filter(count, lambda n: n.isNotNull())
    slots = F.when(F.size(counted) > 0, F.element_at(counted, -1)).when(F.size(count) > 0, 2)
    return F.nullif(F.array_join(list_, ", "), F.lit("")), F.when(tape, "Yes"), slots


def page_records(pages: DataFrame, listing: DataFrame) -> DataFrame:
    """Records of model pages: one row per model a page names. `listing`: (doc, title, generation). Pages without a
    specification table or a model name give none."""
    s = lambda k: F.nullif(F.trim(F.col("specs")[k]), F.lit(""))
    media = F.nullif(F.concat_ws(" ", s("Media"), s("Extras")), F.lit(""))
    port, tape, carts = ports(F.col("bullets"))
    psg = tx.psg_chip(s("Audio"))
    out = pages.join(listing, "doc").where(s("Model").isNotNull()).select(
        "doc", without_notes(F.coalesce(s("Brand"), F.lit(""))).alias("manufacturer"), s("Model").alias("model"), "generation", F.col("title").alias("msxorg_title"),
        tx.year_of(s("Year")).alias("year"), s("Region").alias("region"), F.nullif(tx.ram_kb(s("RAM")), F.lit(0)).alias("main_ram_kb"), F.nullif(tx.vram_kb(s("VRAM")), F.lit(0)).alias("vram_kb"), tx.best_vdp(s("Video")).alias("vdp"),
        psg.alias("psg"), F.when(psg.isNotNull(), 3).alias("audio_channels"), tx.fm_chips(s("Audio")).alias("fm_chip"), tx.floppy_drives(media).alias("floppy_drives"), F.coalesce(tx.cartridge_slots(media), carts).alias("scraped_cart_slots"),
        s("Chipset").alias("engine"), s("Keyboard layout").alias("keyboard_layout"), tape.alias("tape_interface"), port.alias("connectivity"),
    )
    return explode_variants(out)


def category_links(pages: DataFrame, skip_titles: tuple[str, ...]) -> DataFrame:
    """(doc, ord, url, title) of the model links of category pages, overview and special pages left out. Addresses are
    without their host; a link without a title goes by its text."""
    each = pages.select("doc", F.posexplode("links").alias("ord", "l")).where("l.listed")
    each = each.select("doc", "ord", F.regexp_replace("l.href", r"^(?:https?:)?//[^/]+", "").alias("url"), F.coalesce(F.nullif("l.title", F.lit("")), "l.text").alias("title"))
    return each.where(F.col("url").startswith("/wiki/") & ~F.col("url").rlike(r"/wiki/(Category|Special):") & (F.col("title") != "") & ~F.col("title").isin(*skip_titles))


#: fixed values: the categories in the order they are read, and the generation each stands for
CATEGORIES = {"MSX2": "Category:MSX2_Computers", "MSX2+": "Category:MSX2%2B_Computers", "turbo R": "Category:MSX_turbo_R_Computers", "MSX1": "Category:MSX1_Computers"}
RANKS = {"MSX1": 0, "MSX2": 1, "MSX2+": 2, "turbo R": 3}
SKIP_TITLES = ("MSX1", "MSX2", "MSX2+", "MSX turbo R")
BASE = "https://www.msx.org"


def page_name(doc: Column | str) -> Column:
    """Name of a saved page without the ending that browsers give it."""
    return F.regexp_replace(doc, r"(?: - MSX Wiki)?\.html$", "")


def page_file(doc: Column | str) -> Column:
    """File name of a saved page without what browsers add to it."""
    return F.concat(page_name(doc), F.lit(".html"))


def crawled(pages: DataFrame) -> list[tuple[str, str, int]]:
    """(doc, generation, place) of the category pages that are reached from each first page by 'next' links, in order."""
    found = {r.name: (r.doc, [(x.href, x.text) for x in r.links]) for r in pages.where(F.col("doc").startswith("Category_")).select("doc", page_name("doc").alias("name"), "links").toLocalIterator()}
    out: list[tuple[str, str, int]] = []
    for generation, slug in CATEGORIES.items():
        page = 1
        while (got := found.get(mirrored_page(f"{BASE}/wiki/{slug}", page, ""))) is not None:
            out.append((got[0], generation, len(out)))
            if next_page(got[1], BASE) is None:
                break
            page += 1
    return out


def page_listing(pages: DataFrame) -> DataFrame:
    """(doc, title, generation) of the pages of a mirror: per address the highest generation of the categories that list it
    and the title of its first link. Saved pages that no category lists keep their name as title and no generation."""
    spark = pages.sparkSession
    places = spark.createDataFrame(crawled(pages), "doc string, generation string, place int")
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[F.col("generation")]
    links = category_links(pages.join(F.broadcast(places), "doc", "left_semi"), SKIP_TITLES).join(F.broadcast(places), "doc")
    best = highest_per_url(links.select("url", "generation", "title", (F.col("place") * 1_000_000 + F.col("ord")).alias("ord")), rank)
    slug = F.substring_index(F.substring("url", len("/wiki/") + 1, 10_000), "?", 1)
    slug = F.coalesce(F.try_url_decode(F.replace(slug, F.lit("+"), F.lit("%2B"))), slug)
    best = best.select(F.translate(F.translate(slug, "_", " "), ":/", "__").alias("name"), "generation", "title")
    names = pages.select("doc", page_name("doc").alias("name")).where(~F.col("name").startswith("Category_") & ~F.col("name").isin(*SKIP_TITLES))
    return names.join(best, "name", "left").select("doc", F.coalesce("title", "name").alias("title"), "generation")
