"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm import canon_map, entity_match, fusion, leakage, packing, sentences
from specloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = entity_match.pairs(table(spark, sf_dir, "openmsx_raw"), table(spark, sf_dir, "msxorg_raw"))
    return got.select(F.col("openmsx_rec_id").cast("long"), F.col("msxorg_rec_id").cast("long"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per machine that both sources hold, with its numbers of records and the confidence of its weakest rule."""
    rows, _ = entity_match.classes(table(spark, sf_dir, "openmsx_raw"), table(spark, sf_dir, "msxorg_raw"))
    return rows


def p1_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and mean confidence of each rule."""
    got = entity_match.match(table(spark, sf_dir, "openmsx_raw"), table(spark, sf_dir, "msxorg_raw"))
    return got.groupBy("rule").agg(F.count("*").alias("pairs"), F.max("confidence").alias("confidence"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = canon_map.map_models(table(spark, sf_dir, "alias_entries"), table(spark, sf_dir, "canon_models"))
    regions = canon_map.map_regions(table(spark, sf_dir, "msxorg_raw"), table(spark, sf_dir, "canon_regions"))
    cols = lambda df, name: df.select(F.lit(name).alias("field_name"), F.col("id").cast("long").alias("row_id"), F.col("canon_id").cast("long"))
    return cols(models, "model").unionByName(cols(regions, "region"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.precedence(table(spark, sf_dir, "local_raw"), table(spark, sf_dir, "origins"))


def p5_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best supported value of each field by iterative truth discovery."""
    found, _ = fusion.truth_discovery(table(spark, sf_dir, "local_raw"), table(spark, sf_dir, "origins"))
    return found.select("group_key", "field_name", "value", "rec_id")


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.survivors(table(spark, sf_dir, "local_raw"), table(spark, sf_dir, "origins"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks with the shares of the item's passage and question that the document holds, in thousandths."""
    got = leakage.leak_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return got.select("doc_id", "item_id", *[F.round(F.col(c) * 1000).cast("int").alias(c) for c in ("passage_share", "question_share")])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_confidence, p1_classes, p3_found, p5_found, p5_truth, p5_survivors, p6_containers, p7_found, p7_overlap, p8_found)
    return {f.__name__: f for f in own}


_SPACE = r"[\s\x1c-\x1f\x85\pZ]"
_NK = "||'|'||".join(rf"regexp_replace(lower(coalesce({c}, '')), '^{_SPACE}+|{_SPACE}+$', '', 'g')" for c in ("manufacturer", "model"))
_FILL = ", ".join(f"'{w}'" for w in fusion.FILLERS)


def _says(field: str) -> str:
    if field == "main_ram_kb":
        return "main_ram_kb > 0"
    core = rf"regexp_replace(lower({field}), '^[^\pL\pN_]+|[^\pL\pN_]+$', '', 'g')"
    return f"{field} is not null and {core} <> '' and {core} not in ({_FILL})"


def _p5(fields: tuple[str, ...], body: str) -> str:
    picks = " union all ".join(
        f"select group_key, '{f}' as field_name, rec_id, cast({f} as varchar) as value, row_number() over (partition by group_key order by trust desc, edited_at desc nulls last, rec_id) as k from r where {_says(f)}" for f in fields
    )
    return f"""with r as (select {_NK} as group_key, l.*, coalesce(o.trust, -1) as trust from local_raw l
      left join (select origin, max(trust) as trust from origins group by origin) o using (origin)),
      n as (select group_key, count(*) as n_rows from r group by group_key), picks as (select * from ({picks}) where k = 1) {body}"""


def oracle_sql() -> dict[str, str]:
    best = ", ".join(f"max(case when field_name = '{f}' then value end) as {f}" for f in fusion.FIELDS)
    return {
        "p5_found": _p5(fusion.FIELDS, "select group_key, field_name, rec_id from picks join n using (group_key) where n_rows >= 2"),
        "p5_survivors": _p5(fusion.FIELDS, f"select group_key, n_rows, {best} from n left join picks using (group_key) group by group_key, n_rows"),
    }
