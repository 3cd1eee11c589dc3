"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from specloom.llm import canon_map, entity_match, fusion, leakage, packing, sentences

NAMES = ("id", "t", "d", "i", "v", "k", "n", "token", "word", "mark", "at", "rec", "rank", "part", "block", "row", "salt", "score", "l_rec", "r_rec", "makers", "value", "start_pos", "canon_id2")


def clash(df):
    return df.withColumns({c: F.lit("clash") for c in NAMES if c not in df.columns})


def nulls(df):
    """`df` with every row twice and a row of nulls."""
    blank = df.sparkSession.createDataFrame([(None,) * len(df.columns)], df.schema)
    return clash(df.union(df).union(blank))


def test_entity_match(spark):
    left = spark.createDataFrame([(1, "Acme", "ABC-100", "Acme_ABC-100"), (2, "", "", ""), (3, "Acme", "x" * 100_000, None)], "rec_id long, manufacturer string, model string, openmsx_id string")
    right = spark.createDataFrame([(11, "ACME", "abc 100", "t"), (12, None, None, None), (13, " ", " / ", "/")], "rec_id long, manufacturer string, model string, msxorg_title string")
    for f in entity_match.FACTS:
        left, right = left.withColumn(f, F.lit(None).cast("string")), right.withColumn(f, F.lit(None).cast("string"))
    got = entity_match.match(nulls(left), nulls(right)).collect()
    assert {(r.openmsx_rec_id, r.msxorg_rec_id, r.confidence) for r in got} == {(1, 11, 0.5)}


def test_canon_map(spark):
    canon = spark.createDataFrame([(1, "Acme", "AB-1234"), (2, "Acme", "AB-1234"), (3, None, None), (4, "Z", "")], "canon_id long, manufacturer string, model string")
    typed = spark.createDataFrame([(1, None, "AB 1234"), (2, "", ""), (3, "Acme", "9" * 50_000), (4, "Acme", "?" * 9)], "entry_id long, match_manufacturer string, match_model string")
    got = {(r.id, r.canon_id) for r in canon_map.map_models(nulls(typed), nulls(canon)).collect()}
    assert got == {(1, 1), (3, -1), (4, -1)}
    assert {r.canon_id for r in canon_map.map_models(clash(typed), canon.limit(0)).collect()} == {-1} and canon_map.map_models(typed.limit(0), canon).count() == 0
    regions = spark.createDataFrame([(1, "Japan", "jp", None), (2, None, None, None), (3, "Japan", "zz", "")], "region_id long, region string, code string, local_name string")
    said = spark.createDataFrame([(1, "japan"), (2, ""), (3, "x" * 50_000), (4, "()"), (5, "/")], "rec_id long, region string")
    got = {(r.id, r.canon_id) for r in canon_map.map_regions(nulls(said), nulls(regions)).collect()}
    assert got >= {(1, 1), (3, -1), (4, -1), (5, -1)} and not any(i == 2 for i, _ in got)
    assert {r.canon_id for r in canon_map.map_regions(clash(said), regions.limit(0)).collect()} == {-1}


def test_fusion(spark):
    schema = "rec_id long, manufacturer string, model string, origin string, edited_at timestamp, vdp string, keyboard_layout string, region string, main_ram_kb int"
    df = spark.createDataFrame([(1, "A", "x", "o", None, "V" * 50_000, "", " ", 0), (2, "A", "x", "o", None, "W", None, None, None)], schema)
    origins = spark.createDataFrame([("o", 1), ("o", 2), (None, 3)], "origin string, trust int")
    got = {(r.group_key, r.field_name, r.rec_id) for r in fusion.precedence(nulls(df).drop("rank"), clash(origins)).collect()}
    assert got == {("a|x", "vdp", 1)}
    found, weight = fusion.truth_discovery(nulls(df), clash(origins))
    assert [(r.group_key, r.rec_id) for r in found.collect()] == [("a|x", 1)] and set(weight) == {"o"}


def test_texts(spark):
    docs = spark.createDataFrame([(1, "One two. Three four."), (2, ""), (3, "word " * 100_000)], "doc_id long, text string")
    got = [tuple(r) for r in sentences.split_sentences(nulls(docs).drop("start_pos")).where("doc_id = 1").collect()]
    assert sorted(got) == [(1, 0, 8), (1, 0, 8), (1, 9, 20), (1, 9, 20)]
    packs = clash(spark.createDataFrame([(1, 64), (1, 64), (None, None), (2, 0)], "pack_id long, capacity_tokens int"))
    rows = packing.pack_documents(nulls(docs), packs).where("pack_id = 1")
    per = {r.container_no: r.n for r in rows.groupBy("container_no").agg(F.sum("n_tokens").alias("n")).collect()}
    assert max(per.values()) <= 64 and rows.where("doc_id is null").count() == 1
    items = spark.createDataFrame([(5, "One two three four five six seven eight nine ten eleven twelve thirteen."), (6, "")], "item_id long, text string")
    leak = docs.union(spark.createDataFrame([(9, "zz One two three four five six seven eight nine ten eleven twelve zz " + "pad " * 50_000)], docs.schema))
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(nulls(leak), nulls(items)).collect()} == {(9, 5)}


@pytest.mark.parametrize("text", [None, "", " \n ", "\ud83d", "a" * 300_000, "." * 10_000, "「" * 3000, "1. " * 3000, "\n- " * 3000])
def test_any_text_is_cut(text):
    spans = sentences.sentence_spans(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
