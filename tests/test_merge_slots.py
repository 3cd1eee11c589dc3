import pytest
from pyspark.sql import functions as F

from specloom.operators import merge as mg
from specloom.operators import slots
from specloom.plans import pipeline
from specloom.sources import machines, pages

LUT = [{"element": "ROM", "id_pattern": "main", "abbr": "MAIN", "tooltip": "m"}, {"element": "RAM|MemoryMapper", "id_pattern": None, "abbr": "RAM", "tooltip": "r"}]
XML = """<?xml version="1.0"?><msxconfig><info><manufacturer>Acme</manufacturer><code>X1</code><type>MSX2</type><release_year>1986</release_year><region>jp</region></info><CassettePort/>
<devices><VDP><version>V9938</version><vram>128</vram></VDP><PPI><keyboard_type>fr</keyboard_type></PPI><PSG/><RTC/>
<primary slot="0"><ROM id="Main BIOS"><mem base="0x0000" size="0x8000"/><rom><sha1>AB</sha1></rom><rom_visibility base="0" size="0x4000"/></ROM></primary>
<primary slot="1" external="true"/><primary slot="3"><secondary slot="0"><MemoryMapper id="mm"><size>64</size><mem base="0" size="0x10000"/></MemoryMapper></secondary>
<secondary slot="2" external="true"/><secondary slot="1"><Mirror><ps>0</ps><mem base="0x4000" size="0x4000"/></Mirror><ToshibaTCX-200x><mem base="0" size="0x8000"/><rom id="a"><window base="0" size="0x4000"/></rom><rom id="b"><window base="0" size="0x8000"/></rom></ToshibaTCX-200x></secondary></primary>
<primary slot="2" external="true"/></devices></msxconfig>"""


@pytest.fixture(scope="module")
def sides(spark):
    s = "manufacturer string, model string, ord long, vdp string, region string, openmsx_id string, year int, slotmap_0_0_0 string, extra int"
    left = spark.createDataFrame([("Acme", "X1", 1, "old", "JP", "a", 1, "CS1", 1), ("ACME ", "x1", 2, "V9938", "Japan", "b", 1986, "CS1", None), ("B", "2", 1, None, None, None, None, "⌧", 3)], s)
    right = spark.createDataFrame([("acme", "X1", 1, "V9958", "Nippon", None, 1987, "ES2!", None), ("b", "2", 1, "T", "EU", None, 3, "EXP", 4), ("C", "3", 1, None, "x", None, 1, "RAM", None)], s)
    return left, right


def test_ladder(spark, sides):
    merged, conflicts = mg.merge(*sides)
    m = {r.nk: r for r in merged.collect()}
    a = m["acme|x1"]
    assert (a.vdp, a.region, a.openmsx_id, a.year, a.slotmap_0_0_0) == ("V9938", "Nippon", "b", 1986, "ES2!")
    assert m["b|2"].slotmap_0_0_0 == "EXP" and m["b|2"].extra == 3 and m["c|3"].has_right and not m["c|3"].has_left
    got = {(r.nk, r.field, r.left_value, r.right_value) for r in conflicts.collect()}
    assert got >= {("acme|x1", "year", "1986", "1987"), ("b|2", "extra", "3", "4")} and ("acme|x1", "vdp") not in {g[:2] for g in got}
    res = spark.createDataFrame([("acme|x1", "year", "msxorg"), ("acme|x1", "vdp", "x")], "nk string, field string, source string")
    r = {r.nk: r for r in mg.merge(*sides, resolutions=res)[0].collect()}["acme|x1"]
    assert r.year == 1987 and r.vdp == "V9958"
    local = spark.createDataFrame([("acme", "x1", 1, 2000, "z"), ("d", "4", 1, 5, None)], "manufacturer string, model string, ord long, year int, himem_addr string")
    m = {r.nk: r for r in mg.merge(*sides, local)[0].collect()}
    assert m["acme|x1"].year == 2000 and m["acme|x1"].himem_addr == "z" and m["d|4"].has_local and not m["d|4"].has_left
    empty = mg.merge(sides[0].limit(0), sides[1].limit(0))
    assert empty[0].count() == empty[1].count() == 0


def test_migrate_and_normalise(spark):
    df = spark.createDataFrame([("MSX2", "x", 2, None), (None, "msx", 3, 4)], "standard string, generation string, cartridge_slots int, scraped_cart_slots int")
    got = [(r.generation, r.scraped_cart_slots) for r in mg.normalise(mg.migrate(df)).collect()]
    assert got == [("MSX2", 2), ("MSX1", 4)]


def test_pages_and_renumber(spark):
    got = spark.createDataFrame([(0, 0), (0x3FFF, 2), (100, 0), (0x4000, 0xC000), (-5, 3)], "b long, s long").select(slots.pages_of("b", "s").alias("p")).collect()
    assert [r.p for r in got] == [[], [0, 1], [0], [1, 2, 3], []]
    cells = spark.createDataFrame([("k", 1, 0, p, "CS7") for p in range(4)] + [("k", 2, 1, p, "CS!") for p in range(4)] + [("k", 3, 0, 1, "CS9"), ("k", 3, 1, 0, "EXP")], "nk string, ms int, ss int, p int, abbr string")
    got = {(r.ms, r.ss, r.p): r.abbr for r in slots.renumber(cells).collect()}
    assert got[1, 0, 3] == "CS1" and got[2, 1, 0] == "CS2!" and got[3, 0, 1] == "CS9" and got[3, 1, 0] == "EXP"


def test_machine_xml(spark):
    docs = spark.createDataFrame([("x.xml", XML), ("bad.xml", XML[: XML.index("<RTC/>")]), ("null.xml", None), ("other.xml", XML.replace("MSX2", "SVI"))], "file_name string, xml_text string")
    f = {r.doc: r for r in machines.read_facts(docs).collect()}
    assert set(f) == {"x.xml", "bad.xml"} and f["bad.xml"].error and f["bad.xml"].vdp == "V9938"
    x = f["x.xml"]
    assert (x.region, x.main_ram_kb, x.mapper, x.keyboard_layout, x.scraped_cart_slots, x.rtc, x.tape_interface, x.max_resolution) == ("Japan", 64, "Yes", "French (AZERTY)", 3, "Yes", "Yes", "512x424")
    cells = pipeline.machine_slot_map(machines.read_devices(docs.where("file_name = 'x.xml'")), LUT)
    got = {(r.ms, r.ss, r.p): r.abbr for r in cells.collect()}
    assert len(got) == 64
    assert [got[0, 0, p] for p in range(4)] == ["MAIN", "MAIN*", "⌴", "⌴"] and got[0, 1, 0] == "⌧"
    assert got[1, 0, 2] == "CS1" and got[2, 0, 0] == "CS3" and got[3, 2, 1] == "CS2!" and got[3, 0, 3] == "RAM" and got[3, 3, 0] == "⌴"
    assert got[3, 1, 0] == "ROM" and got[3, 1, 1] == "MAIN*"


def cells_of(spark, body, sizes=()):
    xml = f"<msxconfig><info><manufacturer>A</manufacturer><code>B</code><type>MSX2</type></info>{body}</msxconfig>"
    devices = machines.read_devices(spark.createDataFrame([("x", xml)], "file_name string, xml_text string"))
    if sizes:
        devices = devices.join(spark.createDataFrame(sizes, "id string, file_size long"), "id", "left")
    return {(r.ms, r.ss, r.p): r.abbr for r in pipeline.machine_slot_map(devices, LUT).collect()}


def test_slot_map_of_expanded_and_cartridge_slots(spark):
    got = cells_of(
        spark,
        """<devices><primary slot="0"><RAM><mem base="0" size="0x10000"/></RAM><secondary slot="1"><ROM id="Main x"><mem base="0" size="0x4000"/><mem base="0x8000" size="0x4000"/></ROM></secondary>
        <secondary slot="2" external="true"><RAM><mem base="0" size="0x4000"/></RAM></secondary></primary><primary slot="1" external="true"><RAM><mem base="0" size="0x4000"/></RAM></primary>
        <primary slot="2"><Mirror><mem base="0x4000" size="0x4000"/><ps>1</ps></Mirror><Mirror><mem base="0x8000" size="0x4000"/><ps>0</ps><ss>2</ss></Mirror></primary></devices>""",
    )
    assert got[0, 0, 0] == got[0, 3, 2] == "⌴"  # what stands beside the sub-slots is in none
    assert (got[0, 1, 0], got[0, 1, 2]) == ("MAIN", "⌴")  # the first memory range counts
    assert got[0, 2, 0] == "CS1!" and [got[1, 0, p] for p in range(4)] == ["CS2"] * 4 and got[1, 1, 0] == "⌧"
    assert (got[2, 0, 1], got[2, 0, 2], got[2, 0, 0]) == ("CS2*", "CS1!*", "⌴")  # cartridge slots have mirrors too


def test_mirrors_are_called_by_the_device(spark):
    body = """<devices><primary slot="0"><ROM id="Main m"><mem base="0" size="0x10000"/><mappertype>PANASONIC</mappertype><rom_visibility base="0x4000" size="0x8000"/><rom><sha1>a</sha1></rom></ROM></primary>
    <primary slot="1"><Mirror><mem base="0" size="0x4000"/><ps>0</ps></Mirror></primary></devices>"""
    got = cells_of(spark, body)
    assert [got[0, 0, p] for p in range(4)] == ["MAIN*", "PM", "PM", "MAIN*"] and got[1, 0, 0] == "PM*"
    got = cells_of(spark, body, [("Main m", 0x8000)])  # visible or not, what lies beyond the file is a mirror
    assert [got[0, 0, p] for p in range(4)] == ["MAIN*", "PM", "MAIN*", "MAIN*"]


def test_connectivity_and_cells_restyled(spark):
    xml = "<msxconfig><info><manufacturer>A</manufacturer><code>B</code><type>MSX2</type></info><CassettePort/><devices><PrinterPort/><MSX-RS232/></devices></msxconfig>"
    docs = spark.createDataFrame([("x", xml), ("y", xml.replace("<CassettePort/>", "")), ("z", xml.replace("<PrinterPort/>", "").replace("<CassettePort/>", ""))], "file_name string, xml_text string")
    assert {r.doc: r.connectivity for r in machines.read_facts(docs).collect()} == {"x": "Cassette, Printer", "y": "Printer", "z": None}
    df = spark.createDataFrame([("⌧",), ("⌴",), ("RAM*",), ("CS1!",), ("X!",), (None,)], "c string")
    look = {"absent": "-", "empty_page": "o", "mirror_suffix": "~", "subslot_suffix": "^"}
    assert [r[0] for r in df.select(slots.restyle("c", look)).collect()] == ["-", "o", "RAM~", "CS1^", "X!", None]


def test_port_bullets(spark):
    df = spark.createDataFrame([(["3 cartridge slots", "one cartridge slot"],), (["a cartridge slot"],), (["printer"],), (["1 cartridge", "2 x cartridge slot", "no cartridge slot"],)], "b array<string>")
    assert [r[0] for r in df.select(pages.ports(F.col("b"))[2]).collect()] == [3, 2, None, 2]


def test_doubled_resolutions(spark):
    side = spark.createDataFrame([("a", "b", 1, 0)], "manufacturer string, model string, year int, ord long")
    res = spark.createDataFrame([("a|b", "year", "openmsx"), ("a|b", "year", "msxorg")], "nk string, field string, source string")
    merged, left = mg.merge(side, side.withColumn("year", F.lit(2)), resolutions=res)
    assert merged.first().year == 2 and left.count() == 0


HTML = """<table><tr><td>Brand:</td><td>Acme (Manufacturer: B)</td></tr><tr><td>Model</td><td>X1 / X2</td></tr><tr><td>Year</td><td>1986-10</td></tr><tr><td>RAM</td><td>64kB</td></tr><tr><td>Audio</td><td>PSG, YM2413</td></tr></table>
<h2>Slot Map</h2><table><tr><th></th><th rowspan=1 colspan=2>Slot 1</th><th>x</th></tr><tr><th>Page</th><th>Slot 0</th><th>1-0</th><th>1-1*</th></tr>
<tr><td>Page 0000h</td><td>Main ROM<td rowspan="2">Cartridge</td><td>Mirror</td></tr><tr><td>Page 4000h</td><td></td><td>Slot ES</td></tr><tr><td>Page 8000h</td><td>Widget thing</td></tr></table>
<h3>Connections</h3><ul><li>Note: no printer port!<li>Cassette</li><li>2 cartridge slots</li></ul><h2>End</h2><ul><li>printer</li></ul>"""


def test_pages(spark):
    docs = spark.createDataFrame([("a", HTML), ("b", "<p>nothing"), ("c", None)], "file_name string, content string")
    p = pages.read_pages(docs).persist()
    listing = spark.createDataFrame([("a", "Acme X1", "MSX2"), ("b", "B", "MSX1")], "doc string, title string, generation string")
    rows = pages.page_records(p, listing).orderBy("variant_no").collect()
    assert [r.model for r in rows] == ["X1", "X2"] and rows[0].manufacturer == "Acme" and rows[0].year == 1986 and rows[0].fm_chip == "MSX-MUSIC"
    assert rows[0].connectivity == "Cassette" and rows[0].tape_interface == "Yes" and rows[0].scraped_cart_slots == 2
    cells = p.where("doc = 'a'").select("doc", F.inline("cells"))
    got = {(r.ms, r.ss, r.p): r.abbr for r in slots.html_slot_map(cells, pipeline.cell_kind("text", LUT)).collect()}
    assert got[0, 0, 0] == "MAIN" and got[1, 0, 0] == got[1, 0, 1] == "CS1!" and got[0, 0, 2] == "Widget thi" and got[0, 1, 0] == "⌧" and got[1, 2, 0] == "⌴"
    assert got[1, 1, 0].endswith("*") and got[2, 0, 0] == "⌧"
