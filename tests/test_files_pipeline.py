import json

import pytest
from pyspark.sql import functions as F

from specloom.__main__ import main
from specloom.operators import registry, rules
from specloom.plans import pipeline
from specloom.sources import files, live, pages
from specloom.streaming import incremental


def test_readers(spark, tmp_path):
    (tmp_path / "A b+.xml").write_text("<a/>")
    (tmp_path / "WIP_x.xml").write_text("<a/>")
    (tmp_path / "Cut1.xml").write_text("<a/>")
    got = files.mirror(spark, str(tmp_path), excludes=rules.Excludes([{"filename": "Cut?.xml"}]), skip_prefixes=files.SKIP_PREFIXES)
    assert [r.file_name for r in got.collect()] == ["A b+.xml"] and files.mirror(spark, str(tmp_path / "none")).count() == 0
    a = spark.createDataFrame([("x", b"1"), ("y", None)], files.BLOBS)
    both = files.with_fallback(a.select("file_name"), a, spark.createDataFrame([("y", b"2"), ("x", b"3")], files.BLOBS))
    assert {r.file_name: bytes(r.content) for r in both.collect()} == {"x": b"1", "y": b"2"}
    (tmp_path / "sha.txt").write_text("ABCD ./roms/a b.rom\n\nef ../x\n")
    index = files.sha1_index(spark, str(tmp_path / "sha.txt"))
    assert {(r.sha1, r.path) for r in index.collect()} == {("abcd", "roms/a b.rom"), ("ef", "x")}
    dev = spark.createDataFrame([("d", 1, ["zz", "ef", "abcd"])], "doc string, doc_ord int, sha1s array<string>")
    sizes = spark.createDataFrame([("x", 8), ("roms/a b.rom", 9)], "path string, length long")
    assert files.first_file(dev, index, sizes).first().length == 8
    rom = bytearray(64)
    rom[0x2B], rom[0x2C] = 0x12, 0xF3
    r = files.rom_bytes(spark.createDataFrame([(bytes(rom), 0), (b"x", 0)], "content binary, offset int")).collect()
    assert (r[0].character_set, r[0].keyboard_type, r[1].character_set) == ("Korean", "UK", None)
    (tmp_path / "h.txt").write_text("A - B - 0xF380\nnone\n")
    assert files.himem(spark, str(tmp_path / "h.txt")).first().name == "A - B"
    assert files.symbols(tmp_path / "no")["absent"] == "⌧" and files.config(tmp_path / "h.txt") == {}
    with pytest.raises(FileNotFoundError):
        files.records(spark, str(tmp_path / "no"), "a int")
    (tmp_path / "o.json").write_text("{}")
    with pytest.raises(ValueError):
        files.records(spark, str(tmp_path / "o.json"), "a int")
    assert files.records(spark, str(tmp_path / "no"), "a int", required=False).count() == 0


def test_web():
    from urllib.error import HTTPError

    calls = []

    def opener(url):
        calls.append(url)
        if len(calls) < 3:
            raise HTTPError(url, 503, "busy", None, None)
        return b"ok"

    assert files.fetch("u", opener, wait=0) == b"ok" and len(calls) == 3
    with pytest.raises(HTTPError):
        files.fetch("u", lambda u: (_ for _ in ()).throw(HTTPError(u, 404, "no", None, None)), wait=0)
    assert files.next_page([("/wiki/index.php?title=Category:X&from=Y", "next 200")], "https://h") == "https://h/wiki/Category:X?pagefrom=Y"
    assert files.next_page([("/wiki/A?pagefrom=B", "previous")], "https://h") is None
    assert files.mirrored_page("https://h/wiki/Category:A%2B_b", 2) == "Category_A+ b_page2.html"


def test_contents_listing():
    body = json.dumps([{"name": n, "type": t, "download_url": f"u/{n}"} for n, t in (("A.xml", "file"), ("Acid2.xml", "file"), ("dir.xml", "dir"), ("B.txt", "file"), ("Cut1.xml", "file"))])
    assert live.contents_listing(body, rules.Excludes([{"filename": "Cut?.xml"}])) == {"A.xml": "u/A.xml"}


def test_live_with_a_mirror_behind(spark, tmp_path):
    web, mirror = tmp_path / "web", tmp_path / "mirror"
    web.mkdir(), mirror.mkdir()
    (web / "A.xml").write_text("live"), (mirror / "B.xml").write_text("kept"), (mirror / "Z.xml").write_text("old")
    listing = json.dumps([{"name": n, "type": "file", "download_url": (web / n).as_uri()} for n in ("A.xml", "B.xml", "C.xml")]).encode()

    def read(**kw):
        return {r.file_name: r.content and bytes(r.content) for r in live.descriptions(spark, delay=0, **kw).collect()}

    def down(url):
        raise OSError("down")

    assert read(get=lambda u: listing) == {"A.xml": b"live", "B.xml": None, "C.xml": None}
    assert read(mirror=str(mirror), get=lambda u: listing) == {"A.xml": b"live", "B.xml": b"kept", "C.xml": None}
    assert read(mirror=str(mirror), get=lambda u: listing, limit=1) == {"A.xml": b"live"}
    assert read(mirror=str(mirror), get=down) == read(mirror=str(mirror), local_only=True) == {"B.xml": b"kept", "Z.xml": b"old"}
    with pytest.raises(OSError):
        read(get=down)
    with pytest.raises(ValueError):
        read(local_only=True)


def test_wiki_crawl(spark, tmp_path):
    base = (tmp_path / "site").as_uri()
    at, mirror = tmp_path / "site" / "wiki", tmp_path / "mirror"
    at.mkdir(parents=True), mirror.mkdir()
    (at / "Acme_X1").write_text("live X1")
    (mirror / "Acme Y2 - MSX Wiki.html").write_text("saved Y2")
    box = lambda *ls, more="": '<div id="mw-pages">' + "".join(f'<a href="{h}" title="{t}">x</a>' for h, t in ls) + f"</div>{more}"
    told = {
        "Category:MSX2_Computers": box(("/wiki/Acme_X1", "Acme X1"), ("/wiki/MSX2", "MSX2"), ("/wiki/Category:Z", "Z"), more='<a href="/wiki/Category:MSX2_Computers?pagefrom=B">next 200</a>'),
        "Category:MSX2_Computers?pagefrom=B": box(("/wiki/Acme_Y2", "Acme Y2")),
    }
    (mirror / "Category_MSX1 Computers - MSX Wiki.html").write_text(box(("/wiki/Acme_X1", "again")))

    def get(url):
        body = told.get(url.split("/wiki/", 1)[1])
        if body is None:
            raise OSError(url)
        return body.encode()

    def read(**kw):
        return {r.file_name: r.content and bytes(r.content) for r in live.wiki_pages(spark, base=base, delay=0, get=get, **kw).collect() if not r.file_name.startswith("Category_")}

    assert read() == {"Acme X1.html": b"live X1", "Acme Y2.html": None}
    assert read(mirror=str(mirror)) == {"Acme X1.html": b"live X1", "Acme Y2.html": b"saved Y2"}
    names = {r.file_name for r in live.wiki_pages(spark, mirror=str(mirror), base=base, delay=0, get=get).collect() if r.file_name.startswith("Category_")}
    assert names == {"Category_MSX2 Computers.html", "Category_MSX2 Computers_page2.html", "Category_MSX1 Computers.html"}
    assert set(read(mirror=str(mirror), local_only=True)) == {"Acme Y2 - MSX Wiki.html"}
    assert pages.SKIP_TITLES


def test_build_fetches_from_mirrors(spark, tmp_path, capsys):
    x, w = tmp_path / "x", tmp_path / "w"
    x.mkdir(), w.mkdir()
    (x / "Acme_X1.xml").write_text("<msxconfig><info><manufacturer>Acme</manufacturer><code>X1</code><type>MSX2</type></info><devices><primary slot='0'/><primary slot='1' external='true'/></devices></msxconfig>")
    (w / "Acme X1 - MSX Wiki.html").write_text("<table><tr><td>Brand</td><td>Acme</td></tr><tr><td>Model</td><td>X1</td></tr><tr><td>Year</td><td>1986</td></tr></table>")
    (tmp_path / "lut.json").write_text(json.dumps([{"element": "ROM", "id_pattern": "bios", "abbr": "MAIN", "tooltip": "m"}]))
    (tmp_path / "conf.json").write_text(json.dumps({"openmsx_mirror": str(x), "msxorg_mirror": str(w), "slotmap_symbols": {"absent": "none", "empty_page": "free"}}))
    args = ["build", "--fetch", "-l", "--config", str(tmp_path / "conf.json"), "--lut", str(tmp_path / "lut.json"), "--openmsx", str(tmp_path / "l.json"), "--msxorg", str(tmp_path / "r.json"), "-o", str(tmp_path / "out.js")]
    assert main(args) == 0
    text = (tmp_path / "out.js").read_text()
    doc = json.loads(text[text.index("{") : text.rindex("}") + 1])
    row = dict(zip([c["key"] for c in doc["columns"]], doc["models"][0]["values"], strict=True))
    assert (row["year"], row["generation"], row["slotmap_0_0_0"], row["slotmap_0_1_0"], row["slotmap_1_0_0"]) == (1986, "MSX2", "free", "none", "CS1")
    capsys.readouterr()
    assert main(["fetch-openmsx", str(x)]) == 0
    assert json.loads(capsys.readouterr().out)[0]["model"] == "X1"


def test_build_is_idempotent_and_cli(spark, tmp_path):
    left = [{"manufacturer": "Acme", "model": "X1", "standard": "MSX2", "year": 1985, "openmsx_id": "Acme_X1"}, {"manufacturer": "Gone", "model": "Q"}]
    right = [{"manufacturer": "ACME", "model": "x1", "year": 1986, "msxorg_title": "Acme X1", "engine": "T9769"}, {"manufacturer": "Zed", "model": "None"}]
    for name, rows in (("l", left), ("r", right)):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    (tmp_path / "ex.json").write_text(json.dumps([{"manufacturer": "Gone", "model": "*"}, {"manufacturer": "Never", "model": "*"}]))
    args = ["build", "--openmsx", str(tmp_path / "l.json"), "--msxorg", str(tmp_path / "r.json"), "--registry", str(tmp_path / "reg.json"), "--excludes", str(tmp_path / "ex.json"), "--wiki-base", "w/", "-o", str(tmp_path / "out.js")]
    assert main(args) == 0
    once = (tmp_path / "out.js").read_text()
    assert main(args) == 0 and (tmp_path / "out.js").read_text() == once
    doc = json.loads(once[once.index("{") : once.rindex("}") + 1])
    cols = [c["key"] for c in doc["columns"]]
    row = dict(zip(cols, doc["models"][0]["values"], strict=True))
    assert len(doc["models"]) == 2 and row["generation"] == "MSX2" and row["year"] == 1985 and row["wait_cycles"] == "1" and doc["models"][0]["links"]["model"] == "w/Acme_X1"
    assert main(["merge", "--openmsx", str(tmp_path / "l.json"), "--msxorg", str(tmp_path / "r.json"), "-o", str(tmp_path / "m.json"), "--conflicts", str(tmp_path / "c.json")]) == 0
    assert [c["field"] for c in json.loads((tmp_path / "c.json").read_text())] == ["manufacturer", "model", "year"]


def test_cli_keeps_slot_maps_and_all_local_fields(spark, tmp_path):
    left = [{"manufacturer": "Acme", "model": "X1", "scraped_cart_slots": 9, "slotmap_0_0_0": "MAIN", "slotmap_1_0_0": "CS7", "slotmap_2_0_0": "⌴", "slotmap_3_3_3": "RAM"}]
    right = [{"manufacturer": "Acme", "model": "X1", "engine": "T9769", "msxorg_title": "Old", "slotmap_0_0_0": "SUB", "slotmap_2_0_0": "ES4"}]
    local = [{"manufacturer": "Acme", "model": "X1", "engine": "S1985", "msxorg_title": "New", "slotmap_3_3_3": "MM", "himem_addr": "0xF380"}]
    for name, rows in (("l", left), ("r", right), ("own", local)):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    src = ["--openmsx", str(tmp_path / "l.json"), "--msxorg", str(tmp_path / "r.json")]
    assert main(["build", *src, "--local", str(tmp_path / "own.json"), "--wiki-base", "w/", "-o", str(tmp_path / "out.js")]) == 0
    text = (tmp_path / "out.js").read_text()
    doc = json.loads(text[text.index("{") : text.rindex("}") + 1])
    row = dict(zip([c["key"] for c in doc["columns"]], doc["models"][0]["values"], strict=True))
    assert [row[f"slotmap_{c}"] for c in ("0_0_0", "1_0_0", "2_0_0", "3_3_3", "3_0_0")] == ["MAIN", "CS1", "ES1", "MM", None]
    assert (row["cartridge_slots"], row["expansion_slots"], row["engine"], row["himem_addr"]) == (1, 1, "S1985", "0xF380") and doc["models"][0]["links"]["model"] == "w/New"
    assert main(["merge", *src, "-o", str(tmp_path / "m.json"), "--conflicts", str(tmp_path / "c.json")]) == 0
    got = json.loads((tmp_path / "m.json").read_text())[0]
    assert (got["slotmap_1_0_0"], got["slotmap_2_0_0"], got["slotmap_3_3_3"]) == ("CS1", "ES1", "RAM")
    assert [(c["field"], c["openmsx_value"], c["msxorg_value"]) for c in json.loads((tmp_path / "c.json").read_text())] == [("slotmap_0_0_0", "MAIN", "SUB")]


def test_fetch_openmsx_joins_slot_maps_and_rom_facts(spark, tmp_path):
    head = "<msxconfig><info><manufacturer>Acme</manufacturer><code>%s</code><type>MSX2</type></info><devices>"
    own = '<primary slot="0"><ROM id="MSX BIOS with BASIC ROM"><mem base="0" size="0x8000"/><rom><sha1>none</sha1><sha1>AB</sha1><window base="0x10"/></rom></ROM></primary><primary slot="1" external="true"/></devices></msxconfig>'
    block = '<PanasonicRom><rom><sha1>CD</sha1></rom></PanasonicRom><primary slot="0"><ROM id="MSX BIOS with BASIC ROM"><rom><firstblock>1</firstblock></rom></ROM></primary></devices></msxconfig>'
    (tmp_path / "m").mkdir(), (tmp_path / "roms" / "sub").mkdir(parents=True)
    for name, body in (("A", own), ("B", block), ("C", "</devices></msxconfig>")):
        (tmp_path / "m" / f"{name}.xml").write_text(head % name + body)
    small, big = bytearray(0x4000), bytearray(0x4000)
    small[0x3B], small[0x3C], big[0x202B], big[0x202C] = 0x12, 0xF3, 0x01, 0x04
    (tmp_path / "roms" / "sub" / "a b+.rom").write_bytes(small), (tmp_path / "roms" / "big.rom").write_bytes(big)
    (tmp_path / "sha.txt").write_text("ab ./sub/a b+.rom\ncd ./big.rom\n")
    (tmp_path / "lut.json").write_text(json.dumps([{"element": "ROM", "id_pattern": "bios", "abbr": "MAIN", "tooltip": "m"}]))
    args = ["fetch-openmsx", str(tmp_path / "m"), "--lut", str(tmp_path / "lut.json"), "--sha1s", str(tmp_path / "sha.txt"), "--roms", str(tmp_path / "roms"), "-o", str(tmp_path / "o.json")]
    assert main(args) == 0
    a, b, c = json.loads((tmp_path / "o.json").read_text())
    assert [a[f"slotmap_{k}"] for k in ("0_0_0", "0_0_1", "0_0_2", "1_0_3", "2_0_0")] == ["MAIN", "MAIN*", "⌴", "CS1", "⌧"]
    assert (a["character_set"], a["keyboard_type"], b["character_set"], b["keyboard_type"]) == ("Korean", "UK", "International", "German")
    assert sum(k.startswith("slotmap_") for k in c) == 64 and c["slotmap_0_0_0"] == "⌧" and "character_set" not in c


def test_fetch_msxorg_joins_slot_maps_and_generations(spark, tmp_path):
    m = tmp_path / "w"
    m.mkdir()
    link = '<a href="%s" title="%s">t</a>'
    listing = lambda *ls, more="": '<div><a href="/wiki/Acme_Z9" title="Acme Z9">side</a></div><div id="mw-pages">' + "".join(link % x for x in ls) + f"</div>{more}"
    nxt = '<a href="/wiki/index.php?title=Category:MSX1_Computers&amp;from=B">next 200</a>'
    (m / "Category_MSX1 Computers - MSX Wiki.html").write_text(listing(("/wiki/Acme_X1", "Acme X1"), ("/wiki/MSX1", "MSX1"), more=nxt))
    (m / "Category_MSX1 Computers_page2 - MSX Wiki.html").write_text(listing(("https://www.msx.org/wiki/Acme_X2/5%2B", "Acme X2/5+")))
    (m / "Category_MSX1 Computers_page3 - MSX Wiki.html").write_text(listing(("/wiki/Acme_Z9", "stale")))
    (m / "Category_MSX2+ Computers - MSX Wiki.html").write_text(listing(("/wiki/Acme_X1", "Acme X1")))
    spec = "<table><tr><td>Brand</td><td>Acme</td></tr><tr><td>Model</td><td>%s</td></tr></table>"
    table = "<h2>Slot Map</h2><table><tr><th>Page</th><th>Slot 0</th><th>Slot 1</th></tr><tr><td>0000h</td><td>Main ROM</td><td>Cartridge</td></tr></table>"
    for name, body in (("Acme X1", spec % "X1" + table), ("Acme X2_5+", spec % "X2"), ("Acme Z9", spec % "Z9"), ("MSX1", spec % "any")):
        (m / f"{name} - MSX Wiki.html").write_text(body)
    (tmp_path / "lut.json").write_text(json.dumps([{"element": None, "id_pattern": "main", "abbr": "MAIN", "tooltip": "m"}]))
    assert main(["fetch-msxorg", str(m), "--lut", str(tmp_path / "lut.json"), "-o", str(tmp_path / "o.json")]) == 0
    got = json.loads((tmp_path / "o.json").read_text())
    assert [(r["model"], r["msxorg_title"], r.get("generation")) for r in got] == [("X1", "Acme X1", "MSX2+"), ("X2", "Acme X2/5+", "MSX1"), ("Z9", "Acme Z9", None)]
    assert (got[0]["slotmap_0_0_0"], got[0]["slotmap_1_0_0"], got[0]["slotmap_2_0_0"]) == ("MAIN", "CS1", "⌧") and "slotmap_0_0_0" not in got[1]
    assert main(["fetch-msxorg", str(m), "--limit", "1", "-o", str(tmp_path / "o.json")]) == 0
    assert [(r["model"], r["generation"]) for r in json.loads((tmp_path / "o.json").read_text())] == [("X1", "MSX2+")]


def test_dead_rules_and_substituted_keys(spark):
    df = spark.createDataFrame([("None", "X", 1), ("A", "Y", 2)], "manufacturer string, model string, ord long")
    inp = pipeline.Inputs(df, df.limit(0), spark.createDataFrame([], registry.SCHEMA), substitutions={"manufacturer": [("(?i)^none$", None)]}, excludes=rules.Excludes([{"manufacturer": "B", "model": "*"}]))
    built = pipeline.build(inp)
    assert built.dead_rules == [0] and {r.nk: r.id for r in built.records.select("nk", "id").collect()} == {"a|y": 1, "|x": 2}


def test_incremental(spark, tmp_path):
    drop, state = tmp_path / "drop", tmp_path / "state"
    drop.mkdir(), state.mkdir()
    schema = "manufacturer string, model string, year int, ord long"
    for k, rows in enumerate(([("A", "1", 1, 1), ("B", "2", 1, 1)], [("a", "1", 2, 2), ("C", "3", 1, 2)])):
        (drop / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("manufacturer", "model", "year", "ord"), r, strict=True))) for r in rows))
        incremental.follow(spark, str(drop), schema, str(state), str(tmp_path / "ck")).awaitTermination()
    rec, reg, _ = incremental.current(spark, str(state))
    assert {(r.nk, r.year) for r in rec.collect()} == {("a|1", 2), ("b|2", 1), ("c|3", 1)} and {r.nk: r.id for r in reg.collect()} == {"a|1": 1, "b|2": 2, "c|3": 3}
    # a batch run again changes nothing; generations that nothing names any more go
    batch = spark.createDataFrame([("A", "1", 9, 9), ("Z", "9", 3, 3)], schema)
    for n in (5, 5, 6, 7):
        incremental.absorb(str(state))(batch if n < 7 else batch.limit(0), n)
    rec, reg, at = incremental.current(spark, str(state))
    assert at == 6 and {(r.nk, r.year) for r in rec.collect()} == {("a|1", 9), ("b|2", 1), ("c|3", 1), ("z|9", 3)} and {r.nk: r.id for r in reg.collect()}["z|9"] == 4
    assert len(list(state.glob("manifest-*"))) == 2 and not (state / "registry-0").exists()
    ev = spark.createDataFrame([(1,)], "x int").select(F.timestamp_seconds(F.lit(0)).alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"))
    assert incremental.event_windows(ev).first().n == 1
