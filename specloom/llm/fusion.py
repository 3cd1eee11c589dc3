"""Best representative of each duplicate group, field by field.

Two ways to pick a field's value:

* `precedence`: the row of the most trusted origin, then the latest edit, then the smallest id. One map-side combined
  aggregate, so a key with a third of all rows costs one partial row per map task and never gathers.
* `truth_discovery`: source reliability and weighted value votes are estimated in turn until the reliabilities settle; the
  value with the highest support wins, and the row that supplies it is its best row by precedence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from specloom.functions.text import natural_key, strip
from specloom.session import cut, small_side

FIELDS = ("vdp", "keyboard_layout", "region", "main_ram_kb")
#: fixed values: words that fill a field without saying anything (compared lower-cased, outer marks removed)
FILLERS = (
    "n/a", "na", "n.a", "none", "null", "nil", "nan", "unknown", "unk", "not known", "unspecified", "not specified", "undefined", "missing", "no data",
    "tbd", "tba", "tbc", "to be checked", "to be confirmed", "to be determined", "to be done", "todo", "not sure", "not stated", "not given", "see remark", "see photo", "xxx", "dunno", "no idea", "empty", "blank",
)


def says_something(field: Column, numeric: bool) -> Column:
    """False for null, blank, marks only and filler words; for numbers false for null, NaN, 0 and less."""
    if numeric:
        return F.coalesce((field > 0) & ~F.isnan(field.cast("double")), F.lit(False))
    core = F.regexp_replace(F.lower(strip(field)), r"(?U)^[^\w]+|[^\w]+$", "")
    return F.coalesce((core != "") & ~core.isin(*FILLERS), F.lit(False))


def claims(df: DataFrame, origins: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per informative field value: (group_key, field_name, rec_id, value, origin, trust, edited_at, rank).

    `rank` orders a group's rows: trust, then edit time (null is earliest), then the smaller id. Origins that are not listed
    have the lowest trust. Extra columns of `df` are ignored.
    """
    trust = small_side(origins.groupBy("origin").agg(F.max("trust").alias("trust")))
    rows = df.select(natural_key().alias("group_key"), "rec_id", "origin", "edited_at", *fields).join(trust, "origin", "left")
    numeric = {f.name: f.dataType.typeName() in ("integer", "long", "short", "byte", "double", "float", "decimal") for f in df.schema.fields}
    each = F.array_compact(F.array(*[F.when(says_something(F.col(f), numeric[f]), F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value"))) for f in fields]))
    rank = F.struct(F.coalesce("trust", F.lit(-1)).alias("trust"), F.coalesce(F.unix_micros("edited_at"), F.lit(-(2**63))).alias("edited"), (-F.col("rec_id")).alias("first"))
    return rows.select("group_key", "rec_id", "origin", "edited_at", "trust", rank.alias("rank"), F.inline(each))


def precedence(df: DataFrame, origins: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(group_key, field_name, rec_id): the row that supplies each field of each natural key with two or more rows.

    A field of which no row says anything gives no row; rows with a null maker or model group under ''. Ties end at the
    smallest rec_id. All fields are picked in one aggregate over the unexpanded rows.
    """
    trust = small_side(origins.groupBy("origin").agg(F.max("trust").alias("trust")))
    numeric = {f.name: f.dataType.typeName() in ("integer", "long", "short", "byte", "double", "float", "decimal") for f in df.schema.fields}
    rows = df.select(natural_key().alias("group_key"), "rec_id", "origin", "edited_at", *[says_something(F.col(f), numeric[f]).alias(f) for f in fields]).join(trust, "origin", "left")
    rank = F.struct(F.coalesce("trust", F.lit(-1)), F.coalesce(F.unix_micros("edited_at"), F.lit(-(2**63))), -F.col("rec_id"))
    picks = [F.max_by("rec_id", F.when(F.col(f), rank)).alias(f) for f in fields]
    best = rows.groupBy("group_key").agg(F.count("*").alias("n"), *picks).where("n >= 2")
    each = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field_name"), F.col(f).alias("rec_id"))) for f in fields]))
    return best.select("group_key", F.inline(each))


def survivors(df: DataFrame, origins: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One surviving record per natural key: its row count, and of each field the value picked by `precedence`."""
    got = claims(df, origins, fields)
    best = [F.max_by("value", F.when(F.col("field_name") == f, F.col("rank"))).alias(f) for f in fields]
    size = df.groupBy(natural_key().alias("group_key")).agg(F.count("*").alias("n_rows"))
    return size.join(got.groupBy("group_key").agg(*best), "group_key", "left")


def truth_discovery(df: DataFrame, origins: DataFrame, fields: tuple[str, ...] = FIELDS, rounds: int = 1000, eps: float = 1e-3, prior: float = 20.0) -> tuple[DataFrame, dict[str, float]]:
    """Iterative truth discovery over all rows: ((group_key, field_name, value, support, rec_id), origin reliability).

    Claims are first summed to (group, field, value, origin) counts; a hot group therefore is as large as its distinct
    values times origins, not as its rows. Each round votes with the logarithm of every origin's odds of being right, then
    re-estimates each origin as the smoothed share of its claims that agree with the winners (`prior` pseudo-claims at the
    starting value). It ends when no reliability moves by `eps`; if they come back to where they were or move after `rounds`
    rounds they never settle: RuntimeError. Only one number per origin reaches the driver. The counts are exchanged by group and
    field once, kept, and every round works where they lie.
    """
    got = claims(df, origins, fields)
    folded = F.lower(strip("value"))
    counts = cut(got.groupBy("group_key", "field_name", folded.alias("v"), F.coalesce("origin", F.lit("")).alias("origin"))
                 .agg(F.count("*").alias("n"), F.max_by(F.struct("value", "rec_id"), "rank").alias("best"), F.max("rank").alias("rank"), F.max("trust").alias("trust")))
    known = counts.groupBy("origin").agg(F.max("trust").alias("trust")).collect()  # one row per source
    if len(known) > 10_000:
        raise ValueError("more than 10,000 sources; group them first")
    start = {r.origin: 0.55 + 0.1 * min(4, max(0, r.trust or 0)) for r in known}
    weight = dict(start)

    # a number of partitions that is asked for stays as it is, so the groupings and the join below need no exchange of their own
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    held = counts.repartition(n, "group_key", "field_name").persist(StorageLevel.MEMORY_AND_DISK)

    def vote() -> DataFrame:
        odds = F.lit(0.0)
        if weight:
            pairs = [x for o, w in weight.items() for x in (F.lit(o), F.log(F.lit(w / (1 - w)) + 1.0))]
            odds = F.create_map(*pairs)[F.col("origin")]
        per = held.groupBy("group_key", "field_name", "v").agg(F.round(F.sum(odds * F.log1p("n")), 9).alias("support"), F.max_by("best", "rank").alias("best"), F.max("rank").alias("rank"))
        return per.groupBy("group_key", "field_name").agg(F.max_by(F.struct("v", "support", "best"), F.struct("support", "rank")).alias("w")).select("group_key", "field_name", "w.v", "w.support", "w.best")

    seen: set[tuple] = set()
    for _ in range(rounds):
        won = vote().select("group_key", "field_name", F.col("v").alias("won"))
        share = held.join(won, ["group_key", "field_name"]).groupBy("origin").agg(F.sum(F.when(F.col("v") == F.col("won"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("n")).collect()
        nxt = {r.origin: min(0.99, max(0.01, (r.hit + prior * start[r.origin]) / (r.n + prior))) for r in share}
        moved = max((abs(nxt[o] - weight[o]) for o in nxt), default=0.0)
        weight |= nxt
        if moved < eps:
            break
        state = tuple(round(weight[o], 9) for o in sorted(weight))
        if state in seen:
            raise RuntimeError("reliabilities go in a circle")
        seen.add(state)
    else:
        raise RuntimeError(f"reliabilities haven't settled after {rounds} rounds")
    out = cut(vote().select("group_key", "field_name", F.col("best.value").alias("value"), "support", F.col("best.rec_id").alias("rec_id")))
    held.unpersist()
    return out, weight


