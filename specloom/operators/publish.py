"""What is done to merged records before they are shown: variants, links, statistics and the payload."""

from __future__ import annotations

import json
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions.text import strip
from specloom.operators.catalog import Catalog
from specloom.operators.registry import write_atomic


def explode_variants(df: DataFrame, column: str = "model") -> DataFrame:
    """One row per part of a name split at ' / '; all other columns are copied. A null name gives one row."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode_outer(F.split(column, " / ")).alias("variant_no", column)).withColumn(column, strip(column))


def without_notes(c: Column | str) -> Column:
    """A name without what stands in brackets."""
    return strip(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s*\(.*?\)\s*", ""))


def highest_per_url(pages: DataFrame, rank: Column) -> DataFrame:
    """(url, generation, title, ord): a page listed in several categories has the highest rank, in order of first sight."""
    keyed = pages.withColumn("_r", rank)
    return keyed.groupBy("url").agg(F.max_by("generation", F.struct("_r", -F.col("ord"))).alias("generation"), F.min_by("title", "ord").alias("title"), F.min("ord").alias("ord"))


def links(df: DataFrame, wiki_base: str, xml_base: str) -> DataFrame:
    """Adds `links`: {model: page of the title, openmsx_id: file of the id}; keys without a value are absent, an empty map is
    null."""
    pairs = F.array(
        F.struct(F.lit("model").alias("k"), F.concat(F.lit(wiki_base), F.replace("msxorg_title", F.lit(" "), F.lit("_"))).alias("v")),
        F.struct(F.lit("openmsx_id").alias("k"), F.concat(F.lit(xml_base), "openmsx_id", F.lit(".xml")).alias("v")),
    )
    got = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    return df.withColumn("links", F.when(F.size(got) > 0, got))


def share_links(df: DataFrame, shares: DataFrame, key: str = "nk") -> DataFrame:
    """Records without a model link take their donor's, one hop only; donors without one lend nothing."""
    donors = df.where(F.col("links")["model"].isNotNull()).select(F.col(key).alias("donor"), F.col("links")["model"].alias("_lent")).dropDuplicates(["donor"])
    per = shares.select(F.col("nk").alias(key), "donor").dropDuplicates([key]).join(donors, "donor").select(key, "_lent")
    j = df.join(per, key, "left")
    own = F.coalesce("links", F.create_map().cast("map<string,string>"))
    lend = F.col("_lent").isNotNull() & own["model"].isNull()
    return j.withColumn("links", F.when(lend, F.map_concat(own, F.create_map(F.lit("model"), F.col("_lent")))).otherwise(F.col("links"))).drop("_lent")


def fetch_stats(df: DataFrame, failed: Column, *by: str) -> DataFrame:
    """(by, n, failed, permille)"""
    agg = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"))
    return agg.withColumn("permille", F.floor(F.col("failed") * 1000 / F.col("n")).cast("long"))


def too_many_failures(stats: DataFrame, limit_permille: int = 200) -> bool:
    return bool(stats.where(F.col("permille") > limit_permille).take(1))


def payload(df: DataFrame, catalog: Catalog, tips: dict[str, str], generated: str | None = None) -> str:
    """The published document: groups, columns, one positional row of values per record in id order, tooltips.

    Records carry `id` (a 16-bit number, which bounds them) and may carry `links`.
    """
    keys = [f.key for f in catalog.active()]
    values = F.array(*[F.col(k).cast("variant") for k in keys])
    fields = [F.col("id"), values.alias("values")] + ([F.col("links")] if "links" in df.columns else [])
    rows = catalog.project(df, "id", *(["links"] if "links" in df.columns else [])).orderBy("id").select(F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("j"))
    models = [json.loads(r.j) for r in rows.toLocalIterator()]
    groups = [{"id": g.id, "key": g.key, "label": g.label, "order": g.order} for g in sorted(catalog.groups, key=lambda g: g.order)]
    doc = {"version": 1, "generated": generated or date.today().isoformat(), "groups": groups, "columns": [catalog.describe(f) for f in catalog.active()], "models": models, "slotmap_lut": tips}
    return json.dumps(doc, ensure_ascii=False)


def write_payload(path: str | Path, text: str, variable: str = "window.CATALOG_DATA") -> None:
    """A script that sets one variable, replaced at once."""
    write_atomic(path, f"// Generated file\n// Do not edit\n{variable} = {text};\n")
