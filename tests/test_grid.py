import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specloom.functions import codec, text
from specloom.functions.codec import ViewState
from specloom.operators import publish, registry, rules, view
from specloom.operators.catalog import Catalog, Field, Group, machine_catalog
from specloom.plans import grid_queries

IDS = st.sets(st.integers(1, 300), max_size=8)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 90), st.booleans(), st.sets(st.integers(0, 31)), IDS, IDS, st.dictionaries(st.integers(1, 90), st.text(max_size=12), max_size=4), st.sets(st.tuples(st.integers(1, 300), st.integers(1, 90)), max_size=6))
def test_codec_round_trip(sort, desc, groups, cols, rows, filters, sel):
    s = ViewState(sort or None, desc and bool(sort), groups, cols, rows, {k: v for k, v in filters.items() if "\ud800" not in v}, sel)
    assert codec.from_hash(codec.to_hash(s), range(1, 301), range(32), range(1, 301)) == s


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=30))
def test_codec_never_raises(junk):
    codec.decode(junk, range(9), range(9), range(9))


def test_codec_bytes_and_resilience():
    s = ViewState(sort_column=2, descending=True, hidden_columns={0, 9})
    assert codec.decode(codec.encode(s)[:8], range(99), [], []) == ViewState()
    assert codec.encode(ViewState()) == "AQAAAAAAAAAAAAAAAAAAAAA"[: len(codec.encode(ViewState()))]
    assert codec.decode(codec.encode(s), [9], [], []).hidden_columns == {9}
    assert codec.bitset([]) == b"" and codec.bitset([0, 9]) == b"\x01\x02" and codec.ids_of(b"\x01\x02") == {0, 9}


def test_codec_round_trip_of_all_customers(spark, tmp_path):
    spark.range(0, 140_000, 7).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    assert grid_queries.codec_roundtrip_all(spark, str(tmp_path)).first().n == 20_000
    assert grid_queries.codec_roundtrip(spark, str(tmp_path)).first().n == 65_535 // 7


def test_state_changes():
    s = ViewState(selected={(1, 2), (1, 3)})
    s.next_sort(4), s.next_sort(4)
    assert s.descending
    s.next_sort(4)
    assert s.sort_column is None
    s.hide_columns([2])
    assert s.selected == {(1, 3)}
    s.set_filter(3, " x ")
    s.set_filter(4, " ")
    assert s.filters == {3: "x"} and s.reset() and s == ViewState()


CAT = Catalog([Group(0, "a", "A", 0), Group(1, "b", "B", 1)], [Field(1, "n", "N", "a"), Field(2, "v", "V", "b", "number"), Field(3, "w", "W", "b", short_label="w.")])


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "É", 5, None), (2, "a", None, ""), (3, "e", 7, "x|y"), (4, "b", 5, "Z"), (5, "A", 1, "q")], "id long, n string, v int, w string")


def ids(df):
    return [r.id for r in df.orderBy("pos").collect()]


def test_filters(rows):
    f = lambda e, c="w": sorted(r.id for r in view.filtered(rows, {c: e}).collect())
    assert f("—") == [1, 2] and f("!—") == [3, 4, 5] and f(" | ") == [1, 2, 3, 4, 5] and f("z|Q") == [4, 5] and f("!z|!") == [1, 2, 3, 5] and f("5", "v") == [1, 4]


def test_sort_is_stable_and_nulls_last(rows):
    asc = view.with_rank(rows, view.sort_keys("v", False, "integer"))
    desc = view.with_rank(rows, view.sort_keys("v", True, "integer"))
    assert ids(asc) == [5, 1, 4, 3, 2] and ids(desc) == [3, 1, 4, 5, 2]
    assert ids(view.with_rank(rows, view.sort_keys("n", False, "string"))) == [2, 5, 4, 1, 3]


def test_gaps_and_empty(spark, rows):
    vis, runs = view.gaps(rows, F.col("id").isin(1, 3, 4), "id")
    assert {(r.id, r.row_number) for r in vis.collect()} == {(2, 1), (5, 2)}
    assert {(r.after_row, r.id) for r in runs.collect()} == {(0, 1), (1, 3), (1, 4)}
    assert {tuple(r) for r in view.gap_runs(runs, "id").collect()} == {(0, 1, 1, 1), (1, 2, 3, 4)}
    far = rows.withColumn("id", F.when(F.col("id") == 5, 2**60 + 1).otherwise(F.col("id")).cast("long"))
    assert {(r.id, r.row_number) for r in view.gaps(far, F.col("id").isin(1, 3, 4), "id")[0].collect()} == {(2, 1), (2**60 + 1, 2)}
    vis, runs = view.gaps(rows.limit(0), F.lit(True), "id")
    assert vis.count() == runs.count() == 0


def test_view_selection_and_export(spark, rows):
    s = ViewState(sort_column=2, hidden_columns={3}, hidden_rows={3}, filters={3: "!q"})
    got = view.apply_view(rows, CAT, s)
    assert got.columns == ["pos", "id", "n", "v"] and ids(got) == [1, 4, 2]
    r = view.with_rank(rows, [F.col("id")])
    assert {(x.id, x.column_id) for x in view.rectangle(r, [1, 2, 3], (2, 2), (3, 1)).collect()} == {(2, 1), (2, 2), (3, 1), (3, 2)}
    assert view.row_range(r, 2, 99).count() == 0
    sel = spark.createDataFrame([(1, 1), (1, 3), (3, 3)], "id long, column_id int")
    assert [x.line for x in view.tsv(r, CAT, sel, headers=True).orderBy("pos").collect()] == ["N\tw.", "É\t", "x|y"]


def test_catalog(spark):
    cat = machine_catalog()
    assert (len(cat.fields), len(cat.active())) == (96, 94)
    assert cat.by_key["slotmap_3_3_3"].id == 93 and cat.by_key["slotmap_1_2_0"].label == "2 / P0"
    assert [f.key for f in CAT.visible(ViewState(collapsed_groups={1}))] == ["n", "v"]
    for bad in ([Field(1, "x", "", "a"), Field(1, "y", "", "a")], [Field(0, "x", "", "a")], [Field(1, "x", "", "zz")], [Field(1, "x", "", "a", hidden=True, retired=True)], [Field(1, "x", "", "a", hidden=True, derive=lambda d: 1)]):
        with pytest.raises(ValueError):
            Catalog(CAT.groups, bad)
    df = spark.createDataFrame([(1, "T9769", None), (2, None, "9")], "id int, engine string, wait_cycles string")
    out = {r.id: r for r in cat.derive(df).collect()}
    assert out[1].wait_cycles == "1" and out[1].nmos_cmos == "CMOS" and out[2].wait_cycles == "9" and out[2].nmos_cmos == "NMOS"
    assert [c for c in cat.project(df, "id").columns][:3] == ["id", "manufacturer", "model"]
    assert cat.picker(spark).count() == 92


def test_registry(spark, tmp_path):
    p = tmp_path / "reg.json"
    assert registry.load(spark, p).count() == 0
    keys = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "nk string")
    one = registry.assign(registry.load(spark, p), keys)
    assert {r.nk: r.id for r in one.collect()} == {"a": 1, "b": 2}
    one = registry.retire(registry.retire(one, keys.where("nk = 'b'")), keys.where("nk = 'b'"))
    registry.save(one, p)
    two = registry.assign(registry.load(spark, p), keys.union(spark.createDataFrame([("0",)], "nk string")))
    assert {r.nk: (r.id, r.retired) for r in two.collect()} == {"a": (1, False), "b": (2, True), "0": (3, False)}
    # the highest key is gone from the file, its id is not given again
    doc = json.loads(p.read_text())
    del doc["models"]["b"]
    p.write_text(json.dumps(doc))
    left = registry.assign(registry.load(spark, p), spark.createDataFrame([("n",), ("m",)], "nk string"))
    assert {r.nk: r.id for r in left.where("nk is not null").collect()} == {"a": 1, "m": 3, "n": 4}
    registry.save(registry.load(spark, p), p)
    assert json.loads(p.read_text())["next_model_id"] == 3 and list(json.loads(p.read_text())["models"]) == ["a"]
    with pytest.raises(OverflowError):
        registry.assign(two, spark.createDataFrame([("z",)], "nk string"), limit=3)
    p.write_text("[]")
    with pytest.raises(ValueError):
        registry.load(spark, p)


def test_rules(spark, tmp_path):
    with pytest.raises(ValueError):
        rules.Aliases({"m": {"A": ["x"], "B": ["X"]}})
    with pytest.raises(ValueError):
        rules.Excludes([{"model": "x"}])
    with pytest.raises(ValueError):
        rules.check_lut([{"element": "A", "id_pattern": None, "abbr": "a", "tooltip": "1"}, {"element": "B", "id_pattern": None, "abbr": "a", "tooltip": "2"}])
    with pytest.raises(FileNotFoundError):
        rules.load_lut(tmp_path / "none")
    (tmp_path / "s.json").write_text(json.dumps({"m": [{"match": "(?i)^none$", "replace": None}, {"match": "x", "replace": "X"}]}))
    df = spark.createDataFrame([("None", 1), ("axb", 2), (None, 3)], "m string, k int")
    assert [r.m for r in rules.substitute(df, rules.load_substitutions(tmp_path / "s.json")).orderBy("k").collect()] == [None, "X", None]
    for pat, yes, no in (("A?c*", "Abcd", "abc"), ("[!a]x", "bx", "ax"), ("a.b*", "a.bc", "axb")):
        got = spark.createDataFrame([(yes,), (no,)], "f string").select(F.rlike("f", F.lit(rules.glob_regex(pat)))).collect()
        assert [r[0] for r in got] == [rules.glob_match(yes, pat), rules.glob_match(no, pat)] == [True, False]


def test_scalars(spark):
    df = spark.createDataFrame([("　Acme\x1c", " X-1 ", "b, É,a,, e", "Two 720kB 3,5\" floppy disk drives", "64kB in slot 3-0 + 16kB SRAM", "TMS9918A or v9958")], "m string, n string, l string, f string, r string, v string")
    r = df.select(text.natural_key("m", "n").alias("nk"), text.comma_list("l").alias("l"), text.floppy_drives("f").alias("f"), text.ram_kb("r").alias("r"), text.best_vdp("v").alias("v"), text.hex_or_int(F.lit("0x10")).alias("h"), text.int_text(F.lit(" 7 ")).alias("i"), text.slug_to_filename(F.lit("h/wiki/A+b%3Ac_d/e")).alias("s")).first()
    assert (r.nk, r.l, r.f, r.r, r.v, r.h, r.i, r.s) == ("acme|x-1", "a, b, e, É", "2", 64, "v9958", 16, 7, "A+b_c d_e.html") or r.l == "a, b, É, e"


def test_publish(spark):
    df = spark.createDataFrame([("a", "A B", None, 1), ("b", None, None, 2), ("c", None, "id1", 3), ("d", None, None, 4)], "nk string, msxorg_title string, openmsx_id string, id int")
    shares = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("a", "c")], "nk string, donor string")
    got = {r.nk: r.links for r in publish.share_links(publish.links(df, "w/", "x/"), shares).collect()}
    assert got == {"a": {"model": "w/A_B"}, "b": {"model": "w/A_B"}, "c": {"openmsx_id": "x/id1.xml", "model": "w/A_B"}, "d": None}
    cat = Catalog([Group(0, "a", "A", 0)], [Field(1, "nk", "K", "a"), Field(2, "n", "N", "a", "number")])
    doc = json.loads(publish.payload(publish.links(df, "w/", "x/").withColumn("n", F.lit(64)), cat, {}))
    assert doc["models"][0] == {"id": 1, "values": ["a", 64], "links": {"model": "w/A_B"}} and "links" not in doc["models"][1]
