"""Schemas that drift between the files of a series.

Each file has a schema graph: its fields, the tokens of their names, their JSON types, and the members of nested objects and
arrays with their types. Where a file lost and gained fields against the one before it, the two graphs are matched by
similarity flooding: scores of node pairs are propagated along equally labelled edges until they settle. How far the values of
the same records agree is one more node beside each pair. A lost and a gained field are one if their settled score is high
enough against that of the fields that kept their names. Renamed fields then carry one canonical name, and all records are cast
and united into the matched schema.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.session import cut, join_hot, small_side

#: How much of a score passes along the edges of each label: what records hold says most, types and places least.
WEIGHTS = {"field": 0.05, "values": 1.0, "token": 0.1, "type": 0.1, "inner type": 0.1, "member": 0.1}
#: What two equal names start a pair with, and how many agreeing records they stand for (less alike ones by their square).
NAME_SEED, NAME_RECORDS = 0.2, 0.25
#: Share of the measure's settled score from which a lost and a gained field are one. On the small tables pairs that agree on
#: their records settle above 0.55, all others below 0.3.
ACCEPT = 0.42

RECORDS = "file_id long, line_id long, keys array<string>, kinds array<string>, texts array<string>, inner_keys array<string>, inner_marks array<string>"


def _kind(v: object) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def _plain(v: object) -> str | None:
    """The fact a value states, whatever its JSON type: 64, "64", [64] and {"value": 64, "note": ..} are one."""
    if isinstance(v, str):
        return v.strip()
    if isinstance(v, dict):
        return _plain(v["value"]) if "value" in v else json.dumps(v, sort_keys=True, ensure_ascii=False)
    if isinstance(v, list):
        return ", ".join(p for x in v if (p := _plain(x)) is not None)
    if v is None:
        return None
    if isinstance(v, bool):
        return "Yes" if v else "No"
    if isinstance(v, float) and v.is_integer():
        v = int(v)
    return str(v)


def _marks(v: object, path: str = "") -> Iterator[str]:
    """'path:type' of all members of an object and elements of an array, however deep."""
    inner = v.items() if isinstance(v, dict) else (("[]", x) for x in v)
    for k, x in inner:
        at = f"{path}/{k}"
        yield f"{at}:{_kind(x) or ''}"
        if isinstance(x, (dict, list)):
            yield from _marks(x, at)


def fact(text: Column | str) -> Column:
    """A value as it is compared: lower case, a number without its unit ('64 kB' states 64)."""
    return F.regexp_replace(F.lower(text), r"^([+-]?[0-9]+(?:[.][0-9]+)?) *[a-z]{1,3}$", "$1")


def _refuse(name: str) -> object:
    raise ValueError(name)


def read_records(lines: DataFrame) -> DataFrame:
    """One row per line that parses as a JSON object: (file_id, line_id, rec, keys, kinds, texts, inner_keys, inner_marks).

    `rec` is a hash of the record's content, so that lines sent twice are one record. `inner_marks` are the members of nested
    values, `inner_keys` the fields they stand in. Lines that are null or no JSON give no row, nor do JSON values that are no
    object (they have no field); an empty object is a record without fields.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = json.JSONDecoder(parse_constant=_refuse).decode
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for file_id, line_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    record = loads(text)
                    if not isinstance(record, dict):
                        continue
                    inner = [(k, m) for k, v in record.items() if isinstance(v, (dict, list)) for m in dict.fromkeys(_marks(v))]
                    row = (file_id, line_id, list(record), [_kind(v) for v in record.values()], [_plain(v) for v in record.values()], [k for k, _ in inner], [m for _, m in inner])
                except (TypeError, ValueError, RecursionError):
                    continue
                for c, x in zip(out, row, strict=True):
                    c.append(x)
            words = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int64(), *[words] * 5], strict=True)], names=[c.split()[0] for c in RECORDS.split(", ")])

    got = lines.select(F.col("file_id").cast("long"), F.col("line_id").cast("long"), F.col("payload").cast("string")).mapInArrow(run, RECORDS)
    return got.withColumn("rec", F.xxhash64(F.array_sort(F.arrays_zip("keys", "kinds", "texts"))))


def file_schemas(records: DataFrame) -> DataFrame:
    """(file_id, key, kinds, marks): per field the sorted JSON types of its non-null values and its nested members.

    Rows are made distinct by map-side combined hash aggregates first: at most a handful of types and members per field leave
    each map task, however many rows a file has.
    """
    own = F.transform(F.arrays_zip("keys", "kinds"), lambda x: F.struct(x["keys"].alias("key"), x["kinds"].alias("kind"), F.lit(None).cast("string").alias("mark")))
    inner = F.transform(F.arrays_zip("inner_keys", "inner_marks"), lambda x: F.struct(x["inner_keys"].alias("key"), F.lit(None).cast("string").alias("kind"), x["inner_marks"].alias("mark")))
    each = records.select("file_id", F.inline(F.concat(own, inner))).distinct()
    return each.groupBy("file_id", "key").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set("mark")).alias("marks"))


def steps(files: DataFrame) -> DataFrame:
    """(file_id, prev_id) of successive files of each series, by file_seq, then file_id. Only ids are windowed. A series of
    which a file has no sequence number keeps that file first."""
    w = Window.partitionBy("series_id").orderBy(F.col("file_seq").asc_nulls_first(), "file_id")
    ids = files.select("series_id", "file_seq", "file_id").distinct()
    return ids.withColumn("prev_id", F.lag("file_id").over(w)).where("prev_id is not null").select("file_id", "prev_id")


_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


@lru_cache(100_000)
def name_tokens(name: str) -> tuple[str, ...]:
    """'scrapedCartSlots_raw' -> ('scraped', 'cart', 'slots', 'raw')"""
    return tuple(t.lower() for t in _WORD.findall(name)) or (name.lower(),)


@lru_cache(100_000)
def likeness(a: str, b: str) -> float:
    """How alike two tokens are: 1 if equal, 0.8 if one begins the other ('gen', 'generation'), else by shared runs of letters."""
    if a == b:
        return 1.0
    return 0.8 if len(min(a, b, key=len)) > 1 and (a.startswith(b) or b.startswith(a)) else SequenceMatcher(None, a, b).ratio() ** 2


@lru_cache(100_000)
def name_similarity(a: str, b: str) -> float:
    if a.lower() == b.lower():
        return 1.0
    x, y = set(name_tokens(a)), set(name_tokens(b))
    inside = len(x & y) / min(len(x), len(y))
    joined = SequenceMatcher(None, "".join(name_tokens(a)), "".join(name_tokens(b))).ratio()
    return max(0.9 * inside if x <= y or y <= x else 0.6 * inside, joined)


class PairGraph:
    """A pairwise connectivity graph: nodes are pairs of nodes of two schema graphs, edges join pairs that equally labelled edges
    of both schemas connect."""

    def __init__(self) -> None:
        self.nodes: dict[tuple, int] = {}
        self.seeds: list[float] = []
        self.edges: list[tuple[int, int, str, float]] = []

    def node(self, pair: tuple, seed: float) -> int:
        if pair not in self.nodes:
            self.nodes[pair] = len(self.seeds)
            self.seeds.append(seed)
        return self.nodes[pair]

    def edge(self, p: int, q: int, label: str, weight: float = 1.0) -> None:
        self.edges.append((p, q, label, weight * WEIGHTS[label]))


def flood(graph: PairGraph, rounds: int = 1000, eps: float = 1e-4) -> np.ndarray:
    """Scores at the fixpoint of next = normalise(seed + now + inflow(seed + now)).

    Each pair passes its score on along every label in equal shares, times the weight of the edge. Ends when no score moves by more than `eps`;
    RuntimeError if that takes more than `rounds`.
    """
    seed = np.array(graph.seeds)
    now = seed.copy()
    out: dict[tuple[int, str], int] = {}
    for p, q, label, _ in graph.edges:
        out[p, label] = out.get((p, label), 0) + 1
        out[q, label] = out.get((q, label), 0) + 1
    src = np.array([x for p, q, _, _ in graph.edges for x in (p, q)], dtype=np.int64)
    dst = np.array([x for p, q, _, _ in graph.edges for x in (q, p)], dtype=np.int64)
    share = np.array([weight / out[x, label] for p, q, label, weight in graph.edges for x in (p, q)])
    for _ in range(rounds):
        base = seed + now
        nxt = base + np.bincount(dst, base[src] * share, len(seed)) if len(src) else base
        nxt = nxt / (nxt.max() or 1.0)
        moved = np.abs(nxt - now).max(initial=0.0)
        now = nxt
        if moved < eps:
            return now
    raise RuntimeError(f"scores haven't settled after {rounds} rounds")


def pair_scores(old: dict[str, tuple[list[str], list[str]]], new: dict[str, tuple[list[str], list[str]]], both: dict[tuple[str, str], tuple[int, int]]) -> dict[tuple[str, str], float]:
    """Settled score of each (lost, gained) pair as a share of what a field that keeps its name and values scores.

    `old`, `new`: field -> (JSON types, nested members); `both`: (lost, gained) -> (linked records with both values, of these
    with equal ones).
    """
    gone, came = sorted(set(old) - set(new)), sorted(set(new) - set(old))
    kept = sorted(set(old) & set(new))
    g = PairGraph()
    root = g.node(("root",), 0.0)
    # a field that keeps its name, types and values is the measure; it is there even if the files share no field
    measure = g.node(("field", "", ""), NAME_SEED)
    g.edge(root, measure, "field")
    g.edge(measure, g.node(("token", "", ""), 1.0), "token")
    g.edge(measure, g.node(("type", "", ""), 1.0), "type")
    g.edge(measure, g.node(("values", "", ""), 1.0), "values")

    def kinds(p: int, xs: list[str], ys: list[str], label: str) -> None:
        for x in xs:
            for y in ys:
                g.edge(p, g.node(("type", x, y), 1.0 if x == y else 0.3), label)

    for a, b in [(f, f) for f in kept] + [(a, b) for a in gone for b in came]:
        p = g.node(("field", a, b), NAME_SEED * name_similarity(a, b))
        g.edge(root, p, "field")
        for x in name_tokens(a):
            for y in name_tokens(b):
                g.edge(p, g.node(("token", x, y), likeness(x, y)), "token")
        (xs, xm), (ys, ym) = old[a], new[b]
        kinds(p, xs, ys, "type")
        at, bt = dict(m.rsplit(":", 1) for m in xm), dict(m.rsplit(":", 1) for m in ym)
        for path in sorted(set(at) & set(bt)):
            m = g.node(("member", a, b, path), 1.0)
            g.edge(p, m, "member")
            kinds(m, [at[path]], [bt[path]], "type")
        # a value may have moved into a list or into the member that is called so
        kinds(p, xs, sorted({bt[m] for m in ("/value", "/[]") if m in bt}), "inner type")
        kinds(p, sorted({at[m] for m in ("/value", "/[]") if m in at}), ys, "inner type")
        if a == b:
            agreement = 1.0
        else:
            n, same = both.get((a, b), (0, 0))
            agreement = (same + NAME_RECORDS * name_similarity(a, b) ** 2) / (n + NAME_RECORDS)
        g.edge(p, g.node(("values", a, b), agreement), "values", agreement)
    score = flood(g)
    top = score[measure]
    return {(a, b): float(score[g.nodes["field", a, b]] / top) for a in gone for b in came}


def _links(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file_id, prev_id, rec, prev_rec): records of successive files that share most values which one record alone has in either.

    Such a value identifies a record in whatever field it stands, so the link needs no field name. Values meet by a 64-bit hash;
    two that fell together would be one vote among several. One exchange brings both sides of a step together.
    """
    text = F.filter(F.array_distinct(F.transform("texts", fact)), lambda t: t.isNotNull() & (F.length(t) > 0))
    each = records.select("file_id", "rec", F.explode(F.transform(text, lambda t: F.xxhash64(t))).alias("v"))
    lone = each.groupBy("file_id", "v").agg(F.min("rec").alias("rec"), F.max("rec").alias("last")).where("rec = last").select("file_id", "v", "rec")
    ends = F.array(F.struct(F.col("file_id").alias("at"), F.col("file_id").alias("step"), F.lit(True).alias("now")), F.struct(F.col("prev_id").alias("at"), F.col("file_id").alias("step"), F.lit(False).alias("now")))
    sides = pairs.select(F.inline(ends))
    met = join_hot(lone.withColumnRenamed("file_id", "at"), sides, ["at"], by=("v",))
    one = met.groupBy("step", "v").agg(F.max(F.when(F.col("now"), F.col("rec"))).alias("rec"), F.max(F.when(~F.col("now"), F.col("rec"))).alias("prev_rec"))
    votes = one.where("rec is not null and prev_rec is not null").groupBy("step", "rec", "prev_rec").agg(F.count("*").alias("n"))
    best = votes.groupBy("step", "rec").agg(F.max(F.struct("n", "prev_rec")).alias("best")).select(F.col("step").alias("file_id"), "rec", F.col("best.prev_rec").alias("prev_rec"))
    return best


def moved_fields(schemas: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file_id, prev_id, key, old_kinds, new_kinds, old_marks, new_marks): the fields of both files of each step; what a side
    lacks is null."""
    now = pairs.join(schemas, "file_id").select("file_id", "prev_id", "key", F.lit(True).alias("now"), "kinds", "marks")
    before = pairs.join(schemas.withColumnRenamed("file_id", "prev_id"), "prev_id").select("file_id", "prev_id", "key", F.lit(False).alias("now"), "kinds", "marks")
    pick = lambda c, now: F.max(F.when(F.col("now") == now, F.col(c)))
    return now.unionByName(before).groupBy("file_id", "prev_id", "key").agg(pick("kinds", False).alias("old_kinds"), pick("kinds", True).alias("new_kinds"), pick("marks", False).alias("old_marks"), pick("marks", True).alias("new_marks"))


def agreements(records: DataFrame, fields: DataFrame) -> DataFrame:
    """(file_id, a, b, n, same): for each lost and gained field of a step on how many linked records both hold a value, and the
    same one.

    `fields`: (file_id, prev_id, key, side) with side 'gone' or 'came'. Records sent twice count once. Only hashes of the values of
    moved fields are exchanged.
    """
    open_ = fields.select("file_id", "prev_id").distinct()
    links = _links(records, open_)
    gone = fields.where("side = 'gone'").groupBy(F.col("prev_id").alias("at"), F.col("file_id").alias("step")).agg(F.collect_set("key").alias("wanted"))
    came = fields.where("side = 'came'").groupBy(F.col("file_id").alias("at"), F.col("file_id").alias("step")).agg(F.collect_set("key").alias("wanted"))

    def values(wanted: DataFrame, rec: str, field: str, value: str) -> DataFrame:
        each = join_hot(records.select(F.col("file_id").alias("at"), "rec", "keys", "texts"), wanted, ["at"], by=("rec",))
        own = F.filter(F.arrays_zip("keys", "texts"), lambda x: x["texts"].isNotNull() & F.array_contains("wanted", x["keys"]))
        hashed = F.transform(own, lambda x: F.struct(x["keys"].alias(field), F.xxhash64(fact(x["texts"])).alias(value)))
        return each.select(F.col("step").alias("file_id"), F.col("rec").alias(rec), F.inline(hashed)).distinct()

    now = links.join(values(came, "rec", "b", "new"), ["file_id", "rec"])
    met = now.join(values(gone, "prev_rec", "a", "old"), ["file_id", "prev_rec"])
    return met.groupBy("file_id", "a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("old") == F.col("new")).alias("same"))


def match_fields(old: dict[str, tuple[list[str], list[str]]], new: dict[str, tuple[list[str], list[str]]], both: dict[tuple[str, str], tuple[int, int]], accept: float = ACCEPT) -> list[tuple[str, str]]:
    """Renames (lost field, gained field) between two schemas: the pairs of `pair_scores` from `accept` on, one partner each, the
    highest first; of equal scores the first by name."""
    found: list[tuple[str, str]] = []
    for (a, b), score in sorted(pair_scores(old, new, both).items(), key=lambda x: (-x[1], x[0])):
        if score >= accept and all(a != x and b != y for x, y in found):
            found.append((a, b))
    return found


def renames(records: DataFrame, schemas: DataFrame, pairs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(file_id, old_field, new_field): fields of a file that hold what another field held in the file before.

    Only the two schema graphs of a step and one row per lost and gained pair reach the task that matches them.
    """
    side = F.when(F.col("new_kinds").isNull(), "gone").when(F.col("old_kinds").isNull(), "came")
    moved = cut(moved_fields(schemas, pairs).withColumn("side", side))
    open_ = moved.where("side is not null").groupBy("file_id").agg(F.bool_or(F.col("side") == "gone").alias("g"), F.bool_or(F.col("side") == "came").alias("c")).where("g and c").select("file_id")
    moved = cut(moved.join(small_side(open_), "file_id", "left_semi"))
    both = agreements(records, moved.where("side is not null"))
    none = F.lit(None).cast("array<string>")
    graph = moved.select("file_id", F.col("key").alias("a"), F.lit("").alias("b"), "old_kinds", "new_kinds", "old_marks", "new_marks", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("same")).unionByName(
        both.select("file_id", "a", "b", *[none.alias(f"{x}_{y}") for y in ("kinds", "marks") for x in ("old", "new")], "n", "same")
    )

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file_id, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                old = {r["a"]: (r["old_kinds"], r["old_marks"]) for r in rows if not r["n"] and r["old_kinds"] is not None}
                new = {r["a"]: (r["new_kinds"], r["new_marks"]) for r in rows if not r["n"] and r["new_kinds"] is not None}
                both = {(r["a"], r["b"]): (r["n"], r["same"]) for r in rows if r["n"]}
                out += [(file_id, a, b) for a, b in match_fields(old, new, both, accept)]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["file_id", "old_field", "new_field"])

    # few bytes but much work a row: the exchange must not be merged into a few partitions by size
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    each = graph.repartition(n, "file_id").groupBy("file_id").agg(F.collect_list(F.struct(*[c for c in graph.columns if c != "file_id"])).alias("rows"))
    return each.mapInArrow(select, "file_id long, old_field string, new_field string")


def changes(files: DataFrame, lines: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Every change of a file against the one before it in its series: (file_id, change_kind, old_field, new_field).

    change_kind is added, removed, renamed or retyped. First files have none; a file without any JSON record has no field,
    so the next one adds all of its fields. Field names that differ in case are different names.
    """
    records = cut(read_records(lines))
    pairs, schemas = cut(steps(files)), cut(file_schemas(records))
    return changes_of(schemas, renames(records, schemas, pairs, accept), pairs)


def changes_of(schemas: DataFrame, named: DataFrame, pairs: DataFrame) -> DataFrame:
    now = pairs.join(schemas, "file_id").select("file_id", F.col("key").alias("new_field"), F.col("kinds").alias("new_kinds"))
    before = pairs.join(schemas.withColumnRenamed("file_id", "prev_id"), "prev_id").select("file_id", F.col("key").alias("old_field"), F.col("kinds").alias("old_kinds"))
    # each field of the new file under the name it had before
    now = now.join(named, ["file_id", "new_field"], "left").withColumn("was", F.coalesce("old_field", "new_field")).withColumn("renamed", F.col("old_field").isNotNull()).drop("old_field")
    met = now.join(before.withColumn("was", F.col("old_field")), ["file_id", "was"], "full_outer")
    typed = (F.size("old_kinds") > 0) & (F.size("new_kinds") > 0) & (F.col("old_kinds") != F.col("new_kinds"))
    kinds: Column = F.array_compact(
        F.array(
            F.when(F.col("old_field").isNull(), F.lit("added")),
            F.when(F.col("new_field").isNull(), F.lit("removed")),
            F.when(F.col("renamed"), F.lit("renamed")),
            F.when(typed, F.lit("retyped")),
        )
    )
    return met.select("file_id", F.explode(kinds).alias("change_kind"), F.coalesce("old_field", F.lit("")).alias("old_field"), F.coalesce("new_field", F.lit("")).alias("new_field"))


def canonical_names(schemas: DataFrame, named: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file_id, key, canonical): the first name of each field in its series, followed back through renames.

    Pointers to the field of the file before are doubled each round until none moves (log2 of the longest series rounds), so
    no series is gathered in one task. Files that follow one another in a circle have no first name: ValueError.
    """
    here = pairs.join(schemas.select("file_id", "key"), "file_id").join(named.withColumnRenamed("new_field", "key"), ["file_id", "key"], "left")
    back = here.select("file_id", "key", "prev_id", F.coalesce("old_field", "key").alias("prev_key"))
    exists = schemas.select(F.col("file_id").alias("prev_id"), F.col("key").alias("prev_key"))
    at = schemas.select("file_id", "key").join(back.join(exists, ["prev_id", "prev_key"], "left_semi"), ["file_id", "key"], "left")
    at = cut(at.select("file_id", "key", F.coalesce("prev_id", "file_id").alias("to_id"), F.coalesce("prev_key", "key").alias("to_key")))
    for _ in range(pairs.count().bit_length() + 1):
        hop = at.select(F.col("file_id").alias("to_id"), F.col("key").alias("to_key"), F.col("to_id").alias("hop_id"), F.col("to_key").alias("hop_key"))
        nxt = cut(at.join(hop, ["to_id", "to_key"]).select("file_id", "key", F.col("hop_id").alias("new_id"), F.col("hop_key").alias("new_key"), ((F.col("hop_id") != F.col("to_id")) | (F.col("hop_key") != F.col("to_key"))).alias("moved")))
        more = bool(nxt.where("moved").take(1))
        at = nxt.select("file_id", "key", F.col("new_id").alias("to_id"), F.col("new_key").alias("to_key"))
        if not more:
            break
    else:
        raise ValueError("files follow one another in a circle")
    return at.select("file_id", "key", F.col("to_key").alias("canonical"))


def column_names(names: DataFrame, named: DataFrame, least: int = 2, limit: int = 10_000) -> dict[str, str]:
    """Canonical name -> column of the one table, over all series.

    Series begin with different names of one field. Names that a rename joins in `least` or more steps of any series, in either
    direction, are one column, unless that is rare beside what either name is usually renamed to; so are names of the same tokens. A
    column is called by the name most files use. Only distinct names and their counts reach the driver: ValueError beyond
    `limit` names or ten times as many renames.
    """
    uses = {r.canonical: r.n for r in names.groupBy("canonical").agg(F.count("*").alias("n")).limit(limit + 1).collect()}
    said = named.groupBy("old_field", "new_field").agg(F.count("*").alias("n")).limit(limit * 10 + 1).collect()
    if len(uses) > limit or len(said) > limit * 10:
        raise ValueError(f"more than {limit} field names")
    up: dict[str, str] = {}

    def top(x: str) -> str:
        while (y := up.get(x, x)) != x:
            x = y
        return x

    def join(x: str, y: str) -> None:
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)

    votes: dict[frozenset, int] = {}
    for r in said:
        votes[frozenset((r.old_field, r.new_field))] = votes.get(frozenset((r.old_field, r.new_field)), 0) + r.n
    best: dict[str, int] = {}
    for pair, n in votes.items():
        for x in pair:
            best[x] = max(best.get(x, 0), n)
    folded: dict[str, str] = {}
    for x in sorted({*uses, *best}):
        join(x, folded.setdefault("".join(name_tokens(x)), x))
    for pair, n in votes.items():
        x, y = sorted(pair)
        # a chance match of two well known names is outvoted by their usual partners
        if n >= least and n * 4 >= min(best[x], best[y]):
            join(x, y)
    chosen: dict[str, str] = {}
    for x in sorted(uses, key=lambda x: (-uses[x], x)):
        chosen.setdefault(top(x), x)
    return {x: chosen[top(x)] for x in uses}


def matched_schema(records: DataFrame, columns: DataFrame, share: float = 0.99) -> dict[str, str]:
    """Column -> type of the one table: the narrowest of boolean, bigint, double and string that `share` or more of the column's
    values can be cast to. `columns`: (file_id, key, column)."""
    each = records.select("file_id", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("texts").alias("text")))).where("text is not null")
    # by pattern: a cast that fails costs an exception
    can = lambda t: F.count_if(F.col("text").rlike(NUMBERS[t])).alias(t)
    # summed up by file and field before they meet their columns
    typed = each.groupBy("file_id", "key").agg(F.count("*").alias("n"), F.count_if(F.col("text").isin("Yes", "No")).alias("boolean"), can("bigint"), can("double"))
    kinds_of = ("n", "boolean", "bigint", "double")
    got = typed.join(small_side(columns), ["file_id", "key"]).groupBy("column").agg(*[F.sum(k).alias(k) for k in kinds_of]).collect()
    kinds = {r["column"]: next((t for t in ("boolean", "bigint", "double") if r[t] >= share * r.n), "string") for r in got}
    return {r["column"]: kinds.get(r["column"], "string") for r in columns.select("column").distinct().collect()}


#: numbers of each type, with or without a unit
NUMBERS = {"bigint": r"^[+-]?[0-9]{1,18} *[A-Za-z]{0,3}$", "double": r"^[+-]?[0-9]+(?:[.][0-9]+)? *[A-Za-z]{0,3}$"}


def number(text: Column) -> Column:
    """A number's text without its unit ('64 kB'); other texts as they are."""
    return F.regexp_replace(text, r"^([+-]?[0-9]+(?:[.][0-9]+)?) *[A-Za-z]{1,3}$", "$1")


def unify(files: DataFrame, lines: DataFrame, share: float = 0.99) -> DataFrame:
    """All records of all files in one table: (file_id, line_id, the columns of the matched schema by name, extras map).

    Fields go by their canonical name in the series, then by `column_names` over all series; a column has the type of
    `matched_schema`. A value that can't be cast is kept in `extras` under its own name, as are all of a field whose column another
    field of the same file fills.
    Lines sent twice stay two rows, an empty object is a row of nulls; lines that aren't JSON objects have none. Each record is
    united where it stands: only the list of names is joined to it.
    """
    records = cut(read_records(lines))
    pairs, schemas = cut(steps(files)), cut(file_schemas(records))
    named = cut(renames(records, schemas, pairs))
    names = canonical_names(schemas, named, pairs)
    spark = records.sparkSession
    chosen = spark.createDataFrame(sorted(column_names(names, named).items()), "canonical string, column string")
    columns = cut(names.join(F.broadcast(chosen), "canonical").select("file_id", "key", "column"))
    kinds = matched_schema(records, columns, share)
    # of several fields of one file that are one column the one of that name fills it, else the first
    first = columns.groupBy("file_id", "column").agg(F.min(F.struct(F.col("key") != F.col("column"), "key")).alias("x")).select("file_id", "column", F.col("x.key").alias("key"))
    typed = first.join(F.broadcast(spark.createDataFrame(sorted(kinds.items()), "column string, kind string")), "column")
    per_file = cut(typed.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("column", "kind")))).alias("at")))
    rows = join_hot(records.select("file_id", "line_id", "keys", "texts"), per_file, ["file_id"], "left", by=("line_id",))
    held = F.filter(F.arrays_zip("keys", "texts"), lambda x: x["texts"].isNotNull())
    rows = rows.select("file_id", "line_id", F.transform(held, lambda x: F.struct(x["keys"].alias("key"), x["texts"].alias("text"), F.col("at")[x["keys"]].alias("to"))).alias("entries"))
    own = F.map_from_entries(F.transform(F.filter("entries", lambda x: x["to"].isNotNull()), lambda x: F.struct(x["to"]["column"], x["text"])))
    bad = lambda x: F.when(x["to"]["kind"] == "bigint", ~x["text"].rlike(NUMBERS["bigint"])).when(x["to"]["kind"] == "double", ~x["text"].rlike(NUMBERS["double"])).when(x["to"]["kind"] == "boolean", ~x["text"].isin("Yes", "No")).otherwise(x["to"].isNull())
    extras = F.map_from_entries(F.transform(F.filter("entries", bad), lambda x: F.struct(x["key"], x["text"])))
    rows = rows.select("file_id", "line_id", own.alias("m"), extras.alias("extras"))
    value = lambda c, t: F.col("m")[c] if t == "string" else F.when(F.col("m")[c].isin("Yes", "No"), F.col("m")[c] == "Yes") if t == "boolean" else number(F.col("m")[c]).try_cast(t)
    clash = {"file_id", "line_id", "extras"}
    return rows.select("file_id", "line_id", *[value(c, t).alias(c if c.lower() not in clash else f"field_{c}") for c, t in sorted(kinds.items())], "extras")
