"""The query layer of a grid: filters, stable sort, projection, suppression with gaps, selection and export.

A view is a `ViewState` over a table with an `id` column and the columns of a catalogue; it compiles to one lazy plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.functions.codec import ViewState
from specloom.functions.text import comma_list, display_text
from specloom.operators.catalog import Catalog, Field
from specloom.session import cut


def matches(text: Column, expression: str) -> Column:
    """Filter language: parts split at '|'; any positive part must be inside the text and no '!part' may be; case is ignored.
    Blank parts and a bare '!' say nothing; without parts everything passes."""
    parts = [p.strip() for p in expression.split("|") if p.strip()]
    low = F.lower(text)
    inside = [low.contains(p.lower()) for p in parts if not p.startswith("!")]
    outside = [~low.contains(p[1:].strip().lower()) for p in parts if p.startswith("!") and p[1:].strip()]
    terms = outside + ([reduce(lambda a, b: a | b, inside)] if inside else [])
    return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)


def filtered(df: DataFrame, filters: dict[str, str], kinds: dict[str, str] | None = None) -> DataFrame:
    """All columns' filters at once, on the text a cell shows ('—' finds nulls). Comma lists are matched as they are stored."""
    kinds = kinds or {f.name: f.dataType.typeName() for f in df.schema.fields}
    for column, expression in filters.items():
        df = df.where(matches(display_text(column, kinds.get(column, "string")), expression))
    return df


def sort_keys(column: str, descending: bool, data_type: str, listed: bool = False, tie: tuple[str, ...] = ("id",)) -> list[Column]:
    """Nulls last either way; texts without regard to case and accents; equal values keep the order of `tie`."""
    key = F.collate(comma_list(column) if listed else F.col(column), "UNICODE_CI_AI") if data_type == "string" else F.col(column)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), *[F.col(t).asc() for t in tie]]


def with_rank(df: DataFrame, keys: list[Column], name: str = "pos") -> DataFrame:
    """Position of each row in a total order, without one task for all rows.

    A range exchange splits the order, each partition is numbered on its own and shifted by the sizes before it; the only
    thing that reaches the driver is one count per partition. The order is written out first: partitions made anew after a loss
    might otherwise be cut elsewhere than those that were counted.
    """
    ordered = cut(df.orderBy(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    sizes = {r._part: r.n for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    at, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, at))
        at += sizes[part]
    shift = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    in_part = F.col("_row") - F.shiftleft(F.col("_part").cast("long"), 33)
    return ordered.join(F.broadcast(shift), "_part").withColumn(name, F.col("_start") + in_part + 1).drop("_part", "_row", "_start")


def gaps(df: DataFrame, hidden: Column, order: str, key: str = "id", partition: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(visible rows with row_number, hidden rows with after_row): after_row is the number of visible rows before it, so hidden
    rows with one after_row are one gap, a trailing one like any other. `gap_runs` sums them up.

    With `partition` the walk is done per group, in parallel. Without it no single task sees all rows.
    """
    flagged = df.withColumn("_hid", F.coalesce(hidden, F.lit(False)))
    if partition:
        w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        walked = flagged.withColumn("row_number", F.sum((~F.col("_hid")).cast("long")).over(w))
    else:
        walked = running_count(flagged, ~F.col("_hid"), order, "row_number")
    visible = walked.where("not _hid").drop("_hid")
    return visible, walked.where("_hid").drop("_hid").withColumnRenamed("row_number", "after_row")


def gap_runs(hidden: DataFrame, order: str, key: str = "id", partition: tuple[str, ...] = ()) -> DataFrame:
    """(partition, after_row, n_hidden, first_id, last_id) of each run of hidden rows, however long it is."""
    ends = [f(key, order).alias(name) for f, name in ((F.min_by, "first_id"), (F.max_by, "last_id"))]
    return hidden.groupBy(*partition, "after_row").agg(F.count("*").alias("n_hidden"), *ends)


def running_count(df: DataFrame, counted: Column, order: str, name: str) -> DataFrame:
    """Running count of `counted` in the order of a column: a range exchange splits the order, each partition counts on its own
    and starts from the totals before it, of which there is one per partition. The order is written out first, as in
    `with_rank`."""
    ordered = cut(df.orderBy(order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    totals = ordered.groupBy("_part").agg(F.count_if(counted).alias("_n"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row per partition
    w = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    return ordered.withColumn("_in", F.sum(counted.cast("long")).over(w)).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_row", "_in", "_before")


def row_range(ranked: DataFrame, first: int, last: int, key: str = "id", pos: str = "pos") -> DataFrame:
    """Rows between two anchors, both included, in visible order. An anchor that isn't there selects nothing."""
    ends = ranked.where(F.col(key).isin(first, last)).agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.count_distinct(key).alias("n"))
    return ranked.join(F.broadcast(ends.where(F.lit(len({first, last})) == F.col("n"))), F.col(pos).between(F.col("lo"), F.col("hi"))).drop("lo", "hi", "n")


def rectangle(ranked: DataFrame, columns: list[int], first: tuple[int, int], last: tuple[int, int], key: str = "id") -> DataFrame:
    """(id, column) of the visible rows and columns between two cells; if a column isn't visible only the last cell."""
    if first[1] not in columns or last[1] not in columns:
        return ranked.sparkSession.createDataFrame([last], f"{key} long, column_id int")
    a, b = sorted((columns.index(first[1]), columns.index(last[1])))
    rows = row_range(ranked, first[0], last[0], key)
    return rows.select(F.col(key), F.explode(F.array(*[F.lit(c) for c in columns[a : b + 1]])).alias("column_id"))


def row_cells(ranked: DataFrame, columns: list[int], first: int, last: int, key: str = "id") -> DataFrame:
    """(id, column_id) of all visible cells of the rows between two anchors."""
    return row_range(ranked, first, last, key).select(F.col(key), F.explode(F.array(*[F.lit(c) for c in columns]).cast("array<int>")).alias("column_id"))


def prune(selected: DataFrame, catalog: Catalog, state: ViewState) -> DataFrame:
    """Selected cells less those of rows and columns that a view doesn't show, collapsed groups included."""
    kept = selected.where(F.col("column_id").isin([f.id for f in catalog.visible(state)]))
    return kept.where(~F.col("id").isin(*sorted(state.hidden_rows))) if state.hidden_rows else kept


def selected_count(selected: DataFrame, key: str = "id") -> DataFrame:
    """(n_cells, n_rows, n_columns) of a selection; cells given twice count once."""
    cells = selected.select(key, "column_id").distinct()
    return cells.agg(F.count("*").alias("n_cells"), F.count_distinct(key).alias("n_rows"), F.count_distinct("column_id").alias("n_columns"))


def tsv(ranked: DataFrame, catalog: Catalog, selected: DataFrame, state: ViewState | None = None, headers: bool = False, key: str = "id", pos: str = "pos") -> DataFrame:
    """(pos, line): only selected cells of each row, in visible column order, raw values; null is empty, booleans Yes/No.

    `selected`: (id, column_id). The optional header (pos 0) names the union of the selected columns. Rows without a
    selected cell give no line.
    """
    visible = catalog.visible(state or ViewState())
    cells = []
    for i, f in enumerate(visible):
        x = F.col(f.key)
        text = F.when(x, "Yes").when(~x, "No") if ranked.schema[f.key].dataType.typeName() == "boolean" else x.cast("string")
        cells.append(F.struct(F.lit(i).alias("i"), F.lit(f.id).alias("column_id"), F.coalesce(text, F.lit("")).alias("t")))
    long = ranked.select(key, pos, F.inline(F.array(*cells))).join(selected.select(key, "column_id").distinct(), [key, "column_id"])
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]), "\t").alias("line")
    rows = long.groupBy(pos).agg(line)
    if not headers:
        return rows
    used = {r.column_id for r in selected.select("column_id").distinct().collect()}
    head = "\t".join(f.short_label or f.label for f in visible if f.id in used)
    return ranked.sparkSession.createDataFrame([(0, head)], rows.schema).unionByName(rows)


def apply_view(df: DataFrame, catalog: Catalog, state: ViewState, ranked: bool = True) -> DataFrame:
    """Filter, suppress, sort and project a table by a view; `pos` numbers the visible rows from 1.

    Hidden columns' filters stay in force. Ids the catalogue doesn't know are ignored. Without a sort column rows go by id.
    """
    by_id = {f.id: f for f in catalog.fields}
    out = filtered(df, {by_id[c].key: t for c, t in state.filters.items() if c in by_id and by_id[c].key in df.columns})
    if state.hidden_rows:
        out = out.where(~F.col("id").isin(*sorted(state.hidden_rows)))
    f: Field | None = by_id.get(state.sort_column) if state.sort_column else None
    keys = sort_keys(f.key, state.descending, df.schema[f.key].dataType.typeName(), f.listed) if f else [F.col("id").asc()]
    keep = ["id", *[v.key for v in catalog.visible(state) if v.key in df.columns and v.key != "id"]]
    if not ranked:
        return out.orderBy(*keys).select(*keep)
    return with_rank(out, keys).select("pos", *keep)
