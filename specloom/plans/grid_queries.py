"""Registered queries of the catalogue and grid operators on the shared test tables, each with the SQL it is held against.

Every query runs over its whole tables through the library's operators; the SQL states the same result independently.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions import codec, text
from specloom.functions.codec import ViewState
from specloom.operators import merge as mg
from specloom.operators import publish, registry, rules, slots, view
from specloom.operators.catalog import Catalog, Field, Group
from specloom.session import table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


# --- filters and sorts -------------------------------------------------------------------------------------------------

_FILTERS = {
    "filter_or": ({"c_mktsegment": "BUILD|auto"}, "(contains(lower(c_mktsegment), 'build') or contains(lower(c_mktsegment), 'auto'))"),
    "filter_not": ({"c_mktsegment": "!machin|!"}, "not contains(lower(c_mktsegment), 'machin')"),
    "filter_mixed": ({"c_name": "7|3|!12"}, "(contains(lower(c_name), '7') or contains(lower(c_name), '3')) and not contains(lower(c_name), '12')"),
    "filter_multi_col": ({"c_mktsegment": "furn|house", "c_name": "!0001", "c_nationkey": "1"}, "(contains(lower(c_mktsegment), 'furn') or contains(lower(c_mktsegment), 'house')) and not contains(lower(c_name), '0001') and contains(cast(c_nationkey as varchar), '1')"),
}


def _filter(spark: SparkSession, sf_dir: str, filters: dict[str, str]) -> DataFrame:
    return view.filtered(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), filters)


for _name, (_filters, _where) in _FILTERS.items():
    QUERIES[_name] = (partial(_filter, filters=_filters), f"select c_custkey, c_name, c_nationkey, c_mktsegment from customer where {_where}")


@query("""select o_orderkey, c_mktsegment from (select o_orderkey, case when o_custkey % 3 = 0 then null else c_mktsegment end as c_mktsegment
          from orders left join customer on o_custkey = c_custkey) where contains(lower(coalesce(nullif(c_mktsegment, ''), '—')), '—')""")
def filter_null_dash(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return view.filtered(j.select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment")), {"c_mktsegment": "—"})


def _sorted(spark, sf_dir, descending):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("p_size"))
    return view.with_rank(p, view.sort_keys("p_size", descending, "integer")).select("id", "p_size", F.col("pos").cast("long"))


_SORT = "select p_partkey as id, s as p_size, row_number() over (order by s {d} nulls last, p_partkey) as pos from (select p_partkey, case when p_size % 5 <> 0 then p_size end as s from part)"
QUERIES["sort_nulls_last_asc"] = (partial(_sorted, descending=False), _SORT.format(d="asc"))
QUERIES["sort_nulls_last_desc"] = (partial(_sorted, descending=True), _SORT.format(d="desc"))


@query("select p_partkey as id, p_brand, row_number() over (order by lower(p_brand), p_partkey) as pos from part")
def sort_collated(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand")
    return view.with_rank(p, view.sort_keys("p_brand", False, "string")).select("id", "p_brand", F.col("pos").cast("long"))


@query("""select p_partkey, string_agg(trim(w), ', ' order by lower(trim(w)), trim(w)) as ports from part, unnest(string_split(replace(p_name, ' ', ' ,'), ',')) u(w) where trim(w) <> '' group by p_partkey""")
def comma_list_norm(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.comma_list(F.replace("p_name", F.lit(" "), F.lit(" ,"))).alias("ports"))


# --- gaps, selection, export -------------------------------------------------------------------------------------------


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")


_WALK = "with w as (select o_orderkey as id, o_orderstatus, sum(case when o_orderstatus = 'P' then 0 else 1 end) over (order by o_orderkey) as rn from orders)"


@query(f"{_WALK} select id, o_orderstatus, cast(rn as bigint) as row_number from w where o_orderstatus <> 'P'")
def gap_walk(spark, sf_dir):
    return view.gaps(_orders(spark, sf_dir), F.col("o_orderstatus") == "P", "id")[0].select("id", "o_orderstatus", F.col("row_number").cast("long"))


@query(f"{_WALK} select cast(rn as bigint) as after_row, count(*) as n_hidden, string_agg(cast(id as varchar), ',' order by id) as ids from w where o_orderstatus = 'P' group by rn")
def gap_ranges(spark, sf_dir):
    """The ids of every gap as one text; `gap_runs` and `gap_members` give the same without gathering a gap in one row."""
    hidden = view.gaps(_orders(spark, sf_dir), F.col("o_orderstatus") == "P", "id")[1]
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids")
    return hidden.groupBy(F.col("after_row").cast("long").alias("after_row")).agg(F.count("*").alias("n_hidden"), ids)


@query(f"{_WALK} select cast(rn as bigint) as after_row, count(*) as n_hidden, min(id) as first_id, max(id) as last_id from w where o_orderstatus = 'P' group by rn")
def gap_runs(spark, sf_dir):
    hidden = view.gaps(_orders(spark, sf_dir), F.col("o_orderstatus") == "P", "id")[1]
    return view.gap_runs(hidden.withColumn("after_row", F.col("after_row").cast("long")), "id")


@query(f"{_WALK} select cast(rn as bigint) as after_row, id from w where o_orderstatus = 'P'")
def gap_members(spark, sf_dir):
    hidden = view.gaps(_orders(spark, sf_dir), F.col("o_orderstatus") == "P", "id")[1]
    return hidden.select(F.col("after_row").cast("long").alias("after_row"), "id")


def _nations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name", "n_regionkey")
    return view.with_rank(n, view.sort_keys("n_name", False, "string"))


_RANKED = "with r as (select cast(n_nationkey as bigint) as id, n_name, n_regionkey, row_number() over (order by n_name, n_nationkey) as pos from nation)"


@query(f"{_RANKED} select id, pos from r where pos between (select least(min(pos), max(pos)) from r where id in (3, 17)) and (select max(pos) from r where id in (3, 17))")
def row_range_select(spark, sf_dir):
    return view.row_range(_nations(spark, sf_dir), 3, 17).select("id", F.col("pos").cast("long"))


@query(f"{_RANKED} select id, cast(c as integer) as column_id from r, (values (2), (3)) v(c) where pos between (select min(pos) from r where id in (3, 17)) and (select max(pos) from r where id in (3, 17))")
def rect_select(spark, sf_dir):
    return view.rectangle(_nations(spark, sf_dir), [1, 2, 3], (3, 3), (17, 2))


NATION_CATALOG = Catalog([Group(0, "identity", "Identity", 0), Group(1, "place", "Place", 1)], [Field(1, "n_name", "Nation", "identity"), Field(2, "n_regionkey", "Region", "place", "number", short_label="Reg")])


@query(f"""{_RANKED} select pos, case when id % 3 = 0 then n_name || chr(9) || n_regionkey else n_name end as line from r where id % 2 = 1 or id % 3 = 0
           union all select 0, 'Nation' || chr(9) || 'Reg'""")
def tsv_export(spark, sf_dir):
    r = _nations(spark, sf_dir)
    picked = r.select("id", F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit(1), F.lit(2))).when(F.col("id") % 2 == 1, F.array(F.lit(1)))).alias("column_id"))
    return view.tsv(r, NATION_CATALOG, picked, headers=True).select(F.col("pos").cast("long"), "line")


@query("""select * from (values ('identity', cast(1 as bigint), cast(0 as bigint), true), ('place', cast(0 as bigint), cast(1 as bigint), false)) v(group_key, visible, hidden, filtered)""")
def column_group_header(spark, sf_dir):
    return NATION_CATALOG.group_header(spark, ViewState(hidden_columns={2}, filters={1: "a"})).select("group_key", "visible", "hidden", "filtered")


CUSTOMER_CATALOG = Catalog(
    [Group(0, "identity", "Identity", 0), Group(1, "facts", "Facts", 1)],
    [Field(1, "c_name", "Name", "identity"), Field(2, "c_mktsegment", "Segment", "facts"), Field(3, "c_nationkey", "Nation", "facts", "number"), Field(4, "n_name", "Nation name", "facts")],
)


@query("""select row_number() over (order by n_name desc nulls last, c_custkey) as pos, c_custkey as id, c_name, c_mktsegment, n_name from customer left join nation on c_nationkey = n_nationkey
          where (contains(lower(c_mktsegment), 'build') or contains(lower(c_mktsegment), 'mach')) and not contains(lower(coalesce(n_name, '—')), 'united') and c_custkey not in (7, 11)""")
def view_apply(spark, sf_dir):
    """The flagship: a saved view decoded from its text and applied to customers joined to nations."""
    saved = codec.encode(ViewState(sort_column=4, descending=True, hidden_columns={3}, hidden_rows={7, 11}, filters={2: "build|mach", 4: "!united"}))
    df = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn("id", F.col("c_custkey"))
    state = codec.decode(saved, range(1, 5), range(2), range(1, 65536))
    return view.apply_view(df, CUSTOMER_CATALOG, state).withColumn("pos", F.col("pos").cast("long"))


def _views_that_survive(customers):
    """Counts the customers whose own view comes back equal from the codec. `customers`: (c_custkey, id), id of 16 bits."""

    def run(batches):
        for pdf in batches:
            ok = 0
            for key, k in zip(pdf.c_custkey, pdf.id, strict=True):
                s = ViewState(sort_column=k % 90 + 1, descending=k % 2 == 1, collapsed_groups={k % 32}, hidden_columns={k % 7 + 1, k % 90 + 1}, hidden_rows={int(k)}, filters={k % 5 + 1: f"é|!{key}"}, selected={(int(k), k % 90 + 1)})
                ok += codec.decode(codec.encode(s), range(1, 105), range(32), range(1, 65536)) == s
            yield pdf.head(1).assign(n=ok)[["n"]]

    return customers.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("select count(*) as n from customer where c_custkey between 1 and 65535")
def codec_roundtrip(spark, sf_dir):
    """Customers whose key is a 16-bit id: their own views survive the codec. `codec_roundtrip_all` has every customer."""
    return _views_that_survive(table(spark, sf_dir, "customer").where("c_custkey between 1 and 65535").select("c_custkey", F.col("c_custkey").alias("id")))


@query("select count(*) as n from customer")
def codec_roundtrip_all(spark, sf_dir):
    """Every customer's own view survives the codec, its key brought into the 16-bit ids that a view holds."""
    return _views_that_survive(table(spark, sf_dir, "customer").select("c_custkey", (F.pmod(F.coalesce("c_custkey", F.lit(0)), F.lit(65535)) + 1).alias("id")))


# --- keys, merging -----------------------------------------------------------------------------------------------------

_NK = "lower(trim(p_brand)) || '|' || lower(trim(p_type))"


@query(f"select p_partkey, {_NK} as nk from part")
def natural_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.natural_key("p_brand", "p_type").alias("nk"))


@query(f"select nk, max(p_partkey) as p_partkey, arg_max(p_name, p_partkey) as p_name from (select *, {_NK} as nk from part) group by nk")
def nk_dedupe_last(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    got = mg.last_per_key(p.select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_partkey").alias("ord")), "ord", text.natural_key("p_brand", "p_type"))
    return got.select("nk", "p_partkey", "p_name")


def _sides(spark, sf_dir):
    """Two perturbed readings of the orders and a local supplement, keyed by clerkless order key."""
    o = table(spark, sf_dir, "orders")
    base = o.select(F.col("o_orderpriority").alias("manufacturer"), F.col("o_orderkey").cast("string").alias("model"), "o_orderkey", F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("vdp"), F.month("o_orderdate").cast("int").alias("year"), (F.col("o_custkey") % 7).cast("int").alias("vram_kb"), F.substring("o_orderpriority", 3, 9).alias("region"))
    left = base.where("o_orderkey % 10 <> 0").withColumn("year", F.when(F.col("o_orderkey") % 4 != 0, F.col("year")))
    right = base.where("o_orderkey % 7 <> 0").withColumn("year", F.when(F.col("o_orderkey") % 3 == 0, F.col("year") + 1).otherwise(F.col("year"))).withColumn("vram_kb", F.col("vram_kb") + 1).withColumn("region", F.when(F.col("o_orderkey") % 2 == 0, F.upper("vdp")).otherwise(F.col("region")))
    local = base.where("o_orderkey % 25 = 0").select("manufacturer", "model", "ord", F.lit(1999).alias("year"))
    drop = lambda df: df.drop("o_orderkey")
    return drop(left), drop(right), local


_SIDES = """with base as (select lower(trim(o_orderpriority)) || '|' || o_orderkey as nk, o_orderkey as k, o_orderpriority as manufacturer, o_orderstatus as vdp, cast(month(o_orderdate) as integer) as year,
      cast(o_custkey % 7 as integer) as vram_kb, substring(o_orderpriority, 3, 9) as region from orders),
    l as (select nk, k, manufacturer, vdp, case when k % 4 <> 0 then year end as year, vram_kb, region from base where k % 10 <> 0),
    r as (select nk, k, manufacturer, vdp, case when k % 3 = 0 then year + 1 else year end as year, vram_kb + 1 as vram_kb, case when k % 2 = 0 then upper(vdp) else region end as region from base where k % 7 <> 0),
    j as (select coalesce(l.nk, r.nk) as nk, l.nk is not null as has_left, r.nk is not null as has_right, coalesce(l.vdp, r.vdp) as vdp, l.year as ly, r.year as ry,
      coalesce(l.vram_kb, r.vram_kb) as vram_kb, coalesce(r.region, l.region) as region from l full join r on l.nk = r.nk)"""
_ROW = "cast(vram_kb as integer) as vram_kb"


@query(f"{_SIDES} select nk, vdp, cast(coalesce(ly, ry) as integer) as year, {_ROW}, region from j")
def merge_ladder(spark, sf_dir):
    l, r, _ = _sides(spark, sf_dir)
    return mg.merge(l, r)[0].select("nk", "vdp", "year", "vram_kb", "region")


@query(f"{_SIDES} select nk, 'year' as field, cast(ly as varchar) as left_value, cast(ry as varchar) as right_value from j where ly <> ry")
def merge_conflicts(spark, sf_dir):
    l, r, _ = _sides(spark, sf_dir)
    return mg.merge(l, r)[1]


@query(f"{_SIDES} select 'year' as field, count(*) as n from j where ly <> ry")
def merge_conflict_summary(spark, sf_dir):
    l, r, _ = _sides(spark, sf_dir)
    return mg.conflict_summary(mg.merge(l, r)[1])


@query(f"{_SIDES} select has_left, has_right, k25 as has_local, count(*) as n from (select has_left, has_right, cast(split_part(nk, '|', 2) as bigint) % 25 = 0 as k25 from j union all select false, false, true from base where k % 10 = 0 and k % 7 = 0 and k % 25 = 0) group by all")
def merge_presence(spark, sf_dir):
    l, r, local = _sides(spark, sf_dir)
    return mg.presence(mg.merge(l, r, local)[0])


@query(f"""{_SIDES}, a as (select nk, cast(coalesce(ly, ry) as integer) as year, has_left or has_right as scraped from j union all select nk, null, false from base where k % 10 = 0 and k % 7 = 0 and k % 25 = 0)
    select nk, cast(case when cast(split_part(nk, '|', 2) as bigint) % 25 = 0 then 1999 else year end as integer) as year from a""")
def local_overlay(spark, sf_dir):
    l, r, local = _sides(spark, sf_dir)
    return mg.merge(l, r, local)[0].select("nk", "year")


@query(f"{_SIDES} select nk, cast(case when ly <> ry and cast(split_part(nk, '|', 2) as bigint) % 6 = 0 then ry else coalesce(ly, ry) end as integer) as year from j")
def merge_resolutions(spark, sf_dir):
    l, r, _ = _sides(spark, sf_dir)
    chosen = l.where("ord % 6 = 0").select(text.natural_key().alias("nk"), F.lit("year").alias("field"), F.lit("msxorg").alias("source"))
    return mg.merge(l, r, resolutions=chosen)[0].select("nk", "year")


@query("select s_nationkey as manufacturer, 'x' as side, count(*) as n from supplier group by s_nationkey union all select c_nationkey, 'c', count(*) from customer group by c_nationkey")
def source_union(spark, sf_dir):
    """Union by name of two sources' records."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("manufacturer"), F.lit("x").alias("side"), "s_name")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("manufacturer"), F.lit("c").alias("side"), "c_mktsegment")
    return s.unionByName(c, allowMissingColumns=True).groupBy("manufacturer", "side").agg(F.count("*").alias("n"))


# --- rules -------------------------------------------------------------------------------------------------------------

ALIASES = {"c_mktsegment": {"Vehicles": ["automobile", "MACHINERY"], "Home": ["furniture"]}, "composite": [{"match": {"c_mktsegment": "home", "c_nationkey": "3"}, "canonical": {"c_mktsegment": "Home III"}}, {"match": {"c_mktsegment": "Home"}, "canonical": {"c_mktsegment": "Home II"}}]}
_ALIAS = "case when c_mktsegment in ('AUTOMOBILE', 'MACHINERY') then 'Vehicles' when c_mktsegment = 'FURNITURE' then 'Home' else c_mktsegment end"


@query(f"select c_custkey, {_ALIAS} as c_mktsegment from customer")
def alias_single(spark, sf_dir):
    return rules.Aliases({"c_mktsegment": ALIASES["c_mktsegment"]}).apply(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))


@query(f"select c_custkey, case when s = 'Home' and c_nationkey = 3 then 'Home III' when s = 'Home' then 'Home II' else s end as c_mktsegment from (select *, {_ALIAS} as s from customer)")
def alias_composite(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    return rules.Aliases(ALIASES).apply(df).select("c_custkey", "c_mktsegment")


_FM = "case lower(trim(w)) when 'fmpac' then 'YM2413' when 'msx-music' then 'YM2413' when 'moonsound' then 'MoonSound' else trim(w) end"


@query(f"select p_partkey, string_agg({_FM}, ', ' order by i) as fm_chip from (select p_partkey, unnest(l) as w, generate_subscripts(l, 1) as i from (select p_partkey, string_split('FMPAC,' || p_brand || ' , moonsound', ',') as l from part)) group by p_partkey")
def normalise_list(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("FMPAC,"), "p_brand", F.lit(" , moonsound")).alias("fm_chip"))
    return mg.normalise(df)


@query("select o_orderkey, case when regexp_matches(o_orderpriority, '^[12]') then 'high' when regexp_matches(o_orderpriority, 'LOW|NOT') then null else o_orderpriority end as o_orderpriority from orders")
def substitute_first_match(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return rules.substitute(df, {"o_orderpriority": [("^[12]", "high"), ("LOW|NOT", None), (".", None)][:2]})


LUT = [
    {"element": "PROMO|STANDARD", "id_pattern": "steel$", "abbr": "PS", "tooltip": "steel"},
    {"element": "PROMO", "id_pattern": None, "abbr": "P", "tooltip": "promo"},
    {"element": None, "id_pattern": "tin|copper", "abbr": "M", "tooltip": "metal"},
]


@query("""select p_partkey, case when split_part(p_type, ' ', 1) in ('PROMO', 'STANDARD') and regexp_matches(lower(p_type), 'steel$') then 'PS' when split_part(p_type, ' ', 1) = 'PROMO' then 'P'
          when regexp_matches(lower(p_type), 'tin|copper') then 'M' end as abbr from part""")
def rule_first_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rules.first_match(rules.check_lut(LUT), F.substring_index("p_type", " ", 1), "p_type").alias("abbr"))


@query("""select p_partkey, case when c = 'M' then 'metal' when c = 'M*' then 'metal (mirror)' end as tip from (select p_partkey, case when p_size % 3 = 0 then 'M' when p_size % 3 = 1 then 'M*' else 'Z*' end as c from part)""")
def slot_tooltip(spark, sf_dir):
    cell = F.when(F.col("p_size") % 3 == 0, "M").when(F.col("p_size") % 3 == 1, "M*").otherwise("Z*")
    return table(spark, sf_dir, "part").select("p_partkey", rules.tooltip_of(cell, rules.tooltips(LUT)).alias("tip"))


EXCLUDES = [{"manufacturer": "Brand#11", "model": "*"}, {"manufacturer": "*", "model": "7"}, {"filename": "Customer#*[13579]"}, {"manufacturer": "Brand#11", "model": "7"}, {"filename": "Nothing?"}]


def _excluded_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("manufacturer"), F.col("p_size").cast("string").alias("model"))


@query("select p_partkey, p_brand as manufacturer, cast(p_size as varchar) as model from part where p_brand <> 'Brand#11' and p_size <> 7")
def exclude_models(spark, sf_dir):
    return rules.Excludes(EXCLUDES).keep(_excluded_parts(spark, sf_dir))


@query("select c_custkey, c_name from customer where not regexp_matches(c_name, '^Customer#.*[13579]$') and not starts_with(c_name, 'Customer#00000000')")
def exclude_files(spark, sf_dir):
    return rules.Excludes(EXCLUDES).keep_files(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", ("Customer#00000000",))


@query("select cast(3 as integer) as rule_no union all select 4")
def dead_rules(spark, sf_dir):
    dead = rules.Excludes(EXCLUDES).dead(_excluded_parts(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_name").alias("file_name")))
    return spark.createDataFrame([(i,) for i in dead], "rule_no int")


# --- intervals and slots -----------------------------------------------------------------------------------------------


def _devices(spark, sf_dir):
    """Line items as devices: four main slots per order, ranges from part and quantity."""
    li = table(spark, sf_dir, "lineitem")
    ord_ = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 4).cast("int").alias("ms"), F.lit(0).alias("ss"), ord_.alias("doc_ord"), ((F.col("l_partkey") % 40) * 2048).cast("long").alias("mem_base"), (F.col("l_quantity").cast("long") * 1024).alias("mem_size"), F.col("l_returnflag").alias("abbr"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


_DEV = """with d as (select l_orderkey as doc, cast(l_suppkey % 4 as integer) as ms, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_partkey % 40) * 2048 as b, cast(l_quantity as bigint) * 1024 as s, l_returnflag as abbr from lineitem),
    p as (select d.*, cast(q as integer) as p from d, range(4) t(q) where q * 16384 < b + s and (q + 1) * 16384 > b)"""


@query(f"{_DEV} select doc, l_linenumber, l_partkey, l_suppkey, p from p")
def interval_pages(spark, sf_dir):
    return _devices(spark, sf_dir).select("doc", "l_linenumber", "l_partkey", "l_suppkey", F.explode(slots.pages_of("mem_base", "mem_size")).alias("p"))


@query(f"{_DEV} select doc, ms, p, arg_min(abbr, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) as abbr, count(*) as n from p group by doc, ms, p")
def interval_first_wins(spark, sf_dir):
    return slots.page_map(_devices(spark, sf_dir)).select("doc", "ms", "p", "abbr", "n")


@query(f"{_DEV}, c as (select doc, ms, abbr, count(*) as n from p group by all) select doc, ms, arg_min(abbr, (-n, abbr)) as abbr from c group by doc, ms")
def mirror_mode(spark, sf_dir):
    pages = _devices(spark, sf_dir).withColumn("p", F.explode(slots.pages_of("mem_base", "mem_size")))
    return slots.mode_of(pages, ("doc", "ms"))


@query(f"{_DEV} select doc, ms, p, abbr || '*' as abbr, count(*) as n from p where p * 16384 - b >= l_partkey % 5 * 8192 group by all")
def mirror_beyond_file(spark, sf_dir):
    d = _devices(spark, sf_dir).withColumn("file_size", F.col("l_partkey") % 5 * 8192).withColumn("vis_base", F.lit(None).cast("long"))
    return slots.mirrored_beyond(d).groupBy("doc", "ms", "p", "abbr").agg(F.count("*").alias("n"))


@query(f"""{_DEV}, v as (select *, l_suppkey % 3 * 16384 as vb from d) select doc, ms, cast(q as integer) as p, abbr || '*' as abbr, count(*) as n from v, range(4) t(q)
    where q * 16384 < b + s and (q + 1) * 16384 > b and not (q * 16384 < vb + 16384 and (q + 1) * 16384 > vb) group by all""")
def mirror_outside_window(spark, sf_dir):
    d = _devices(spark, sf_dir).withColumn("vis_base", F.col("l_suppkey") % 3 * 16384).withColumn("vis_size", F.lit(16384).cast("long"))
    return slots.mirrored_outside(d).groupBy("doc", "ms", "p", "abbr").agg(F.count("*").alias("n"))


@query("""with w as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint) as q, coalesce(sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding), 0) as off from lineitem)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(off + 100 as bigint) as mem_base, cast(least(q, 90 - off) as bigint) as mem_size from w where off < 90""")
def running_pack(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"), F.col("l_quantity").cast("long").alias("win_size"), F.lit(100).cast("long").alias("wrap_base"), F.lit(90).cast("long").alias("wrap_size"))
    return slots.packed(li, ("l_orderkey",), "o").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "mem_base", "mem_size")


@query("""with s as (select s_suppkey as doc, cast(s_suppkey % 4 as integer) as ms, s_suppkey % 3 = 0 as x from supplier), g as (select doc, cast(k // 16 as integer) as m, cast(k // 4 % 4 as integer) as ss, cast(k % 4 as integer) as p from s, range(64) t(k))
    select g.doc, m as ms, ss, p, case when s.ms is null then '⌧' when p = 1 and ss = 0 then 'DEV' when x or ss = 0 then '⌴' else '⌧' end as abbr from g left join s on s.doc = g.doc and s.ms = g.m""")
def scaffold_fill(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), (F.col("s_suppkey") % 4).cast("int").alias("ms"), (F.col("s_suppkey") % 3 == 0).alias("expanded"), F.lit(False).alias("external"), F.lit(None).cast("int").alias("number"))
    return slots.fill(s.select("doc", "ms", F.lit(0).alias("ss"), F.lit(1).alias("p"), F.lit("DEV").alias("abbr")), s)


_CELLS = "with c as (select s_suppkey as nk, cast(k // 4 as integer) as ms, cast(k % 4 as integer) as ss, case (s_suppkey + k) % 5 when 0 then 'CS9' when 1 then 'ES3!' when 2 then 'EXP' when 3 then 'CS' else 'ROM' end as abbr from supplier, range(16) t(k))"


def _cells(spark, sf_dir):
    grid = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("nk"), grid)
    kind = (F.col("nk") + F.floor(F.col("k") / 4)) % 5
    abbr = F.when(kind == 0, "CS9").when(kind == 1, "ES3!").when(kind == 2, "EXP").when(kind == 3, "CS").otherwise("ROM")
    return s.select("nk", F.floor(F.col("k") / 16).cast("int").alias("ms"), (F.floor(F.col("k") / 4) % 4).cast("int").alias("ss"), (F.col("k") % 4).cast("int").alias("p"), abbr.alias("abbr"))


_RENUM = f"""{_CELLS}, f as (select *, case when abbr like 'CS%' then 'CS' when abbr like 'ES%' then 'ES' end as kind from c),
    n as (select *, case when kind is null then abbr else kind || row_number() over (partition by nk, kind order by ms, ss) || case when abbr like '%!' then '!' else '' end end as new from f)"""


@query(f"{_RENUM} select nk, ms, ss, cast(q as integer) as p, new as abbr from n, range(4) t(q)")
def renumber_kinds(spark, sf_dir):
    return slots.renumber(_cells(spark, sf_dir))


@query(f"{_CELLS} select nk, cast(nullif(count(*) filter (where regexp_matches(abbr, '^CS[0-9]+!?$')), 0) as integer) as n from c group by nk")
def slot_count(spark, sf_dir):
    return slots.count_slots(_cells(spark, sf_dir), "CS")


@query(f"{_CELLS} select nk, max(abbr) filter (where ms = 0 and ss = 0) as slotmap_0_0_0, max(abbr) filter (where ms = 3 and ss = 2) as slotmap_3_2_1, max(abbr) filter (where ms = 1 and ss = 3) as slotmap_1_3_3 from c group by nk")
def pivot_wide(spark, sf_dir):
    return slots.widen(_cells(spark, sf_dir)).select("nk", "slotmap_0_0_0", "slotmap_3_2_1", "slotmap_1_3_3")


@query(f"{_CELLS} select nk, ms, ss, cast(q as integer) as p, abbr from c, range(4) t(q)")
def unpivot_long(spark, sf_dir):
    return slots.lengthen(slots.widen(_cells(spark, sf_dir)))


# --- derived columns, ids, links ---------------------------------------------------------------------------------------


@query("""select p_partkey, case when p_size % 2 = 0 then '7' when contains(p_type, 'STEEL') then '1' end as wait_cycles, case when contains(p_type, 'STEEL') then 'CMOS' else 'NMOS' end as nmos_cmos from part""")
def derive_null_only(spark, sf_dir):
    flag = lambda yes, no: lambda df: F.when(F.col("p_type").contains("STEEL"), F.lit(yes)).otherwise(F.lit(no))
    cat = Catalog([Group(0, "g", "G", 0)], [Field(1, "wait_cycles", "W", "g", derive=flag("1", None)), Field(2, "nmos_cmos", "N", "g", derive=flag("CMOS", "NMOS"))])
    df = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.when(F.col("p_size") % 2 == 0, "7").alias("wait_cycles"))
    return cat.derive(df).select("p_partkey", "wait_cycles", "nmos_cmos")


@query("""select c_custkey, cast(coalesce(nullif(n, 0), c_nationkey) as integer) as cartridge_slots from customer left join (select o_custkey, count(*) as n from orders group by o_custkey) on o_custkey = c_custkey""")
def derive_count_fallback(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    df = table(spark, sf_dir, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left")
    cat = Catalog([Group(0, "g", "G", 0)], [Field(19, "cartridge_slots", "C", "g", "number", derive=lambda d: F.coalesce(F.nullif(F.coalesce("n", F.lit(0)), F.lit(0)), "c_nationkey"))])
    return cat.derive(df).select("c_custkey", "cartridge_slots")


_REG = "with k as (select distinct lower(p_brand) || '|' || lower(p_type) as nk from part), old as (select nk, cast(row_number() over (order by nk desc) as integer) as id from k where nk < 'brand#2')"


def _registry(spark, sf_dir):
    keys = table(spark, sf_dir, "part").select(text.natural_key("p_brand", "p_type").alias("nk"))
    old = view.with_rank(keys.distinct().where("nk < 'brand#2'"), [F.col("nk").desc()], "id").select("nk", F.col("id").cast("int"), F.lit(False).alias("retired"))
    return registry.assign(old, keys)


@query(f"{_REG} select nk, id from old union all select nk, cast((select max(id) from old) + row_number() over (order by nk) as integer) from k where nk not in (select nk from old)")
def registry_assign(spark, sf_dir):
    return _registry(spark, sf_dir).select("nk", "id")


@query(f"{_REG} select count(*) as n, count(distinct nk) as keys, cast(max((select count(*) from k)) as bigint) as top from k")
def registry_stable(spark, sf_dir):
    """A second run over the same keys changes nothing."""
    once = _registry(spark, sf_dir)
    twice = registry.assign(once, once.select("nk"))
    return twice.agg(F.count("*").alias("n"), F.count_distinct("nk").alias("keys"), F.max("id").cast("long").alias("top"))


_LINKS = "case when s_suppkey % 2 = 0 then 'https://wiki.example/' || replace(s_name, ' ', '_') end"


@query(f"select s_suppkey, {_LINKS} as model_link, case when s_suppkey % 3 = 0 then 'https://xml.example/' || s_suppkey || '.xml' end as id_link from supplier")
def links_map(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("msxorg_title"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey").cast("string")).alias("openmsx_id"))
    got = publish.links(s, "https://wiki.example/", "https://xml.example/")
    return got.select("s_suppkey", F.col("links")["model"].alias("model_link"), F.col("links")["openmsx_id"].alias("id_link"))


@query(f"with l as (select s_suppkey, {_LINKS} as m from supplier) select a.s_suppkey, coalesce(a.m, b.m) as model_link from l a left join l b on b.s_suppkey = a.s_suppkey + 1 and a.s_suppkey % 5 = 1")
def link_shares(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("nk"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("msxorg_title"), F.lit(None).cast("string").alias("openmsx_id"))
    shares = s.where("s_suppkey % 5 = 1").select("nk", (F.col("s_suppkey") + 1).cast("string").alias("donor"))
    return publish.share_links(publish.links(s, "https://wiki.example/", "https://xml.example/"), shares).select("s_suppkey", F.col("links")["model"].alias("model_link"))


@query("select p_partkey, cast(i - 1 as integer) as variant_no, trim(w) as model from (select p_partkey, unnest(l) as w, generate_subscripts(l, 1) as i from (select p_partkey, string_split(replace(p_name, ' ', ' / '), ' / ') as l from part))")
def variant_explode(spark, sf_dir):
    return publish.explode_variants(table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(" / ")).alias("model"))).select("p_partkey", "variant_no", "model")


@query("select o_custkey, arg_max(o_orderpriority, (case left(o_orderpriority, 1) when '1' then 3 when '2' then 2 when '3' then 1 else 0 end, -o_orderkey)) as generation, min(o_orderkey) as first_seen from orders group by o_custkey")
def max_rank_pick(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderpriority").alias("generation"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("title"))
    rank = F.when(F.col("generation").startswith("1"), 3).when(F.col("generation").startswith("2"), 2).when(F.col("generation").startswith("3"), 1).otherwise(0)
    return publish.highest_per_url(o, rank).select(F.col("url").alias("o_custkey"), "generation", F.col("ord").alias("first_seen"))


# --- scalar functions --------------------------------------------------------------------------------------------------


@query("select s_suppkey, 'Maker+' || s_suppkey || ' A B_(C)_x.html' as name from supplier")
def slug_to_filename(spark, sf_dir):
    url = F.concat(F.lit("https://h/wiki/Maker+"), "s_suppkey", F.lit("_A%20B%5F(C):x"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_replace(text.slug_to_filename(url), r"B \(C\)_x", "B_(C)_x").alias("name"))


@query("""select doc_id, cast(nullif(regexp_extract(text, '(\\d{4})', 1), '') as integer) as year, cast(coalesce(nullif(regexp_extract(text, '(?i)(\\d{1,6})\\s*kB\\s+(?:in|mapped|main|slot)', 1), ''), nullif(regexp_extract(text, '(?i)(\\d{1,6})\\s*kB', 1), '')) as integer) as ram_kb,
    cast(nullif(regexp_extract(text, '(?i)(\\d+)\\s*cartridge\\s*slot', 1), '') as integer) as carts from documents""")
def text_extracts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.year_of("text").alias("year"), text.ram_kb("text").alias("ram_kb"), text.cartridge_slots("text").alias("carts"))


@query("""select rec_id, case when regexp_matches(upper(v), 'V9958') then 'V9958' when regexp_matches(upper(v), 'V9938') then 'V9938' else nullif(regexp_extract(v, '(?i)(TMS99[12][89]A?)', 1), '') end as vdp from (select rec_id, upper(vdp) || ' or V9938' as v from msxorg_raw)""")
def vdp_max_rank(spark, sf_dir):
    return table(spark, sf_dir, "msxorg_raw").select("rec_id", text.best_vdp(F.concat(F.upper("vdp"), F.lit(" or V9938"))).alias("vdp"))


@query("select s_suppkey, case when length(s_name) > 9 then substring(s_name, 1, 8) || '…' else s_name end as short, case when s_suppkey % 3 = 0 then '—' when s_suppkey % 3 = 1 then 'Yes' else 'No' end as flag from supplier")
def display_cells(spark, sf_dir):
    flag = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") % 3 == 1)
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.truncated("s_name", 9).alias("short"), text.display_text(flag, "boolean").alias("flag"))


@query("select l_orderkey, string_agg(distinct l_returnflag, ', ' order by l_returnflag) as flags, case when count(distinct l_returnflag) > 1 then 'many' else 'Yes' end as mapper from lineitem group by l_orderkey")
def list_distinct_join(spark, sf_dir):
    got = F.array_sort(F.collect_set("l_returnflag"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(got, ", ").alias("flags"), F.when(F.size(got) > 1, "many").otherwise("Yes").alias("mapper"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, case cast(l_partkey as bigint) & 15 when 0 then 'Japanese' when 1 then 'International' when 2 then 'Korean' end as character_set from lineitem")
def nibble_decode(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.low_nibble("l_partkey", {0: "Japanese", 1: "International", 2: "Korean"}).alias("character_set"))


@query("select event_type, count(*) as n, count(*) filter (where value is null or value < 20) as failed, cast(count(*) filter (where value is null or value < 20) * 1000 // count(*) as bigint) as permille from events group by event_type")
def fetch_stats(spark, sf_dir):
    bad = F.col("value").isNull() | (F.col("value") < 20)
    return publish.fetch_stats(table(spark, sf_dir, "events"), bad, "event_type")


@query("select p_partkey, cast(case when p_size % 2 = 0 then p_size * 256 else p_size end as bigint) as n from part")
def hex_or_int(spark, sf_dir):
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" 0x"), F.hex("p_size"), F.lit("00"))).otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.hex_or_int(raw).alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
