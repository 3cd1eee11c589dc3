import json

import pytest
from pyspark.sql import functions as F

from specloom.operators import drift, nested


def test_nested_cases(spark):
    xml = """<r><devices><x/><primary slot=" 1 "><A id="q"><mem base="1"/><mem base="2"/><size> 8 </size></A><secondary external="true" slot="z"><B/><secondary/></secondary></primary></devices></r>"""
    df = spark.createDataFrame([(1, xml, "e"), (2, None, "e"), (3, "<r><devices>", "e"), (4, "<r/>", "e"), (5, "", "e")], "xml_id long, xml_text string, tag string")
    got = {(r.xml_id, r.node_no, r.parent_no, r.tag, r.slot_no, r.is_external) for r in nested.machine_nodes(df).collect()}
    assert got == {
        (1, 1, 0, "primary", 1, 0), (1, 2, 1, "A", -1, 0), (1, 3, 2, "mem", -1, 0), (1, 4, 2, "mem", -1, 0), (1, 5, 1, "secondary", -1, 1), (1, 6, 5, "B", -1, 0), (1, 7, 5, "secondary", -1, 0),
        (2, 0, -1, "malformed", -1, 0), (3, 0, -1, "malformed", -1, 0), (5, 0, -1, "malformed", -1, 0),
    }
    t = nested.machine_tables(df)
    assert t["devices"].where("tag = 'A'").first().size == "8" and {r.base for r in t["ranges"].collect()} == {"1", "2"}
    assert nested.machine_nodes(df.limit(0)).count() == 0
    rep = {r.path: r.max_siblings for r in nested.repeated_paths(df, "xml_id", "xml_text").collect()}
    assert rep["/r/devices/primary/A/mem"] == 2 and rep["/r/devices"] == 1


def test_discovered_tables(spark):
    one = '<r v="1"><head><name>a</name></head><box n="x"><item k="1">p</item><item k="2"><deep>q</deep></item></box><box n="y"/></r>'
    df = spark.createDataFrame([(1, one), (2, "<r><head><name>b</name></head><box/></r>"), (3, "<r>"), (4, None)], "xml_id long, xml_text string").withColumn("grp", F.lit("clash"))
    t = nested.discovered_tables(df, "xml_id", "xml_text")
    assert set(t) == {"", "/r/box", "/r/box/item"}
    assert {(r.xml_id, r["r/@v"], r["r/head/name/#"]) for r in t[""].collect()} == {(1, "1", "a"), (2, None, "b")}
    assert {(r.xml_id, r.node_no, r.parent_no, r["@n"]) for r in t["/r/box"].collect()} == {(1, 1, 0, "x"), (1, 4, 0, "y"), (2, 1, 0, None)}
    assert {(r.node_no, r.parent_no, r["@k"], r["#"], r["deep/#"]) for r in t["/r/box/item"].collect()} == {(2, 1, "1", "p", None), (3, 1, "2", None, "q")}
    assert nested.discovered_tables(df.limit(0), "xml_id", "xml_text")[""].count() == 0


def test_drift_edges(spark):
    """Nulls in any column, repeated rows, clashing columns and values of any depth."""
    deep = {"a": 1}
    for _ in range(40):
        deep = {"a": deep}
    rows = [machine(1, big="x" * 200_000, deep=deep), machine(1, big="x" * 200_000, deep=deep), {}]
    f, lines = files(spark, [rows, [machine(1, large="x" * 200_000, deep=[deep])], []])
    odd = spark.createDataFrame([(None, None, "{}"), (None, 1, '{"model": null}'), (7, None, '{"z": 1}')], lines.schema)
    clash = lambda df: df.withColumn("rec", F.lit(1)).withColumn("key", F.lit("k")).withColumn("kinds", F.lit("x"))
    got = {tuple(r) for r in drift.changes(clash(f.union(f)), clash(lines.union(odd).union(lines))).collect()}
    assert (2, "renamed", "big", "large") in got and (2, "retyped", "deep", "deep") in got
    assert {(k, o) for i, k, o, _ in got if i == 3} == {("removed", x) for x in ("model", "maker", "large", "deep")}
    same = spark.createDataFrame([(1, 5, None), (2, 5, None), (3, None, 1)], "file_id long, series_id long, file_seq int")
    assert {tuple(r) for r in drift.steps(same).collect()} == {(2, 1)}


def files(spark, versions):
    f = [(k + 1, 1, k + 1) for k in range(len(versions))]
    lines = [(100 * k + i, k + 1, json.dumps(r) if isinstance(r, dict) else r) for k, rows in enumerate(versions) for i, r in enumerate(rows)]
    return spark.createDataFrame(f, "file_id long, series_id long, file_seq int"), spark.createDataFrame(lines, "line_id long, file_id long, payload string")


def machine(i, **kw):
    return {"model": f"ABC-{i}", "maker": "Acme" if i % 2 else "Zenith", **kw}


def test_changes(spark):
    one = [machine(i, year=1980 + i, rtc="Yes" if i % 3 else "No", gone=i) for i in range(8)]
    two = [machine(i, released={"value": 1980 + i}, rtc=bool(i % 3), new="n", none=None) for i in range(7)] + ["{broken", None, "[1]", '{"x": NaN}']
    f, lines = files(spark, [one, two + two[:3]])
    got = {tuple(r) for r in drift.changes(f, lines).select("file_id", "change_kind", "old_field", "new_field").collect()}
    assert got == {(2, "renamed", "year", "released"), (2, "retyped", "year", "released"), (2, "retyped", "rtc", "rtc"), (2, "removed", "gone", ""), (2, "added", "", "new"), (2, "added", "", "none")}
    assert drift.changes(f.limit(0), lines).count() == 0 and drift.changes(f, lines.limit(0)).count() == 0


def test_units_and_nesting_are_followed(spark):
    one = [machine(i, ram=8 << i % 4, gen={"value": f"MSX{i % 3}", "note": "x"}, other=i) for i in range(8)]
    two = [machine(i, memory=f"{8 << i % 4} kB", standard=[f"MSX{i % 3}"], colour="grey") for i in range(8)]
    f, lines = files(spark, [one, two])
    got = {tuple(r) for r in drift.changes(f, lines).select("change_kind", "old_field", "new_field").collect()}
    assert got == {("renamed", "ram", "memory"), ("retyped", "ram", "memory"), ("renamed", "gen", "standard"), ("retyped", "gen", "standard"), ("removed", "other", ""), ("added", "", "colour")}


def test_unify(spark):
    f, lines = files(spark, [[{"model": f"QQQ-{i}", "standard": "MSX1", "year": 1980 + i} for i in range(6)], [{"model": f"QQQ-{i}", "std": ["MSX1"], "year": str(1980 + i), "odd": i} for i in range(6)], [{"model": f"QQQ-{i}", "std": "MSX1", "year": "n/a" if i < 2 else 1980 + i} for i in range(6)] + [{}, {"model": None}]])
    got = drift.unify(f, lines, share=0.8)
    assert dict(got.dtypes) == {"file_id": "bigint", "line_id": "bigint", "model": "string", "odd": "bigint", "standard": "string", "year": "bigint", "extras": "map<string,string>"}
    rows = got.collect()
    assert len(rows) == 20 and {r.standard for r in rows} == {"MSX1", None} and sum(r.model is None for r in rows) == 2
    assert {r.year for r in rows if r.file_id == 2} == set(range(1980, 1986))
    assert sorted(r.extras["year"] for r in rows if r.extras) == ["n/a", "n/a"]
    assert drift.unify(f, lines.limit(0)).count() == 0


def test_columns_join_names_over_series(spark):
    names = spark.createDataFrame([(1, "k", "standard"), (2, "k", "standard"), (3, "k", "generation"), (4, "k", "GENERATION"), (5, "k", "vdp")], "file_id long, key string, canonical string")
    named = spark.createDataFrame([(1, "standard", "generation"), (2, "generation", "standard"), (3, "vdp", "standard")], "file_id long, old_field string, new_field string")
    assert drift.column_names(names, named) == {"standard": "standard", "generation": "standard", "GENERATION": "standard", "vdp": "vdp"}


def test_canonical_names_of_a_long_series(spark):
    n = 300
    schemas = spark.createDataFrame([(k, "new" if k > 2 else "old", ["string"]) for k in range(1, n + 1)], "file_id long, key string, kinds array<string>")
    named = spark.createDataFrame([(3, "old", "new")], "file_id long, old_field string, new_field string")
    pairs = spark.createDataFrame([(k, k - 1) for k in range(2, n + 1)], "file_id long, prev_id long")
    got = drift.canonical_names(schemas, named, pairs).collect()
    assert len(got) == n and {r.canonical for r in got} == {"old"}
    circle = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "file_id long, prev_id long")
    with pytest.raises(ValueError):
        drift.canonical_names(schemas.where("file_id <= 3").withColumn("key", F.lit("k")), named.limit(0), circle)


def plain(**kinds):
    return {k: ([v], []) for k, v in kinds.items()}


def test_flooding_is_one_to_one():
    old, new = plain(a="string", k="string", vram_kb="number"), plain(a="string", keys="string", VRAM="string")
    both = {("k", "keys"): (9, 9), ("k", "VRAM"): (9, 1), ("vram_kb", "keys"): (9, 0), ("vram_kb", "VRAM"): (9, 9)}
    assert set(drift.match_fields(old, new, both)) == {("k", "keys"), ("vram_kb", "VRAM")}
    assert drift.match_fields(plain(a="string"), plain(b="string"), {("a", "b"): (5, 1)}) == []
    assert drift.match_fields(plain(sound_chip="string"), plain(soundChip="string"), {}) == [("sound_chip", "soundChip")]
    assert drift.match_fields(plain(a="string"), {}, {}) == []
    assert drift.name_tokens("scrapedCartSlots_raw") == ("scraped", "cart", "slots", "raw")


def test_flooding_decides(monkeypatch):
    """Without propagation the seeds alone accept nothing that changed its name, and equal scores accept everything."""
    old, new = plain(model="string", region="string", year="number"), plain(model="string", country="string", weight="number")
    both = {("region", "country"): (20, 20), ("region", "weight"): (20, 0), ("year", "country"): (20, 0), ("year", "weight"): (20, 1)}
    assert drift.match_fields(old, new, both) == [("region", "country")]
    flood = drift.flood
    monkeypatch.setattr(drift, "flood", lambda g: drift.np.array(g.seeds))
    assert drift.match_fields(old, new, both) == []
    monkeypatch.setattr(drift, "flood", lambda g: drift.np.ones(len(g.seeds)))
    assert len(drift.match_fields(old, new, both)) == 2
    g = drift.PairGraph()
    g.edge(g.node("x", 1.0), g.node("y", 0.0), "values")
    assert flood(g)[1] > 0.3
    with pytest.raises(RuntimeError):
        flood(g, rounds=1)
