"""Matching the same machines across two sources that share no identifier.

A cascade of deterministic rules, run in passes: each pass joins the records that no earlier pass resolved exactly on weaker
attribute combinations, and of the rules of one pass the first that gives a record a partner counts. Rules read names only. A
rule's confidence is the smoothed precision of its pairs on labels: those given, or else silver labels by the hardware facts,
which no rule reads.

The left source is reduced to its distinct keys with their number of records; the right one is matched row by row against
them, so its copies are spread over all tasks whatever they share. Classes are one row each; pairs of records are only made
where they are asked for, and those of a large class in many parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.names import maker_key, maker_keys, plain, signature, variants
from specloom.session import cut, join_hot

#: facts compared for silver labels; they take no part in the rules
FACTS = ("year", "generation", "vdp", "main_ram_kb", "vram_kb", "fm_chip", "floppy_drives", "keyboard_layout", "scraped_cart_slots")
#: Records of one key from which its pairs are made in parts of that many.
LARGE = 20_000


@dataclass(frozen=True)
class Rule:
    """`maker`, `mark`: the columns of the right side that meet the left key; without `maker` the left's makers of that mark
    must be alike or named in the title, and the nearest one counts. Rules of one `step` run in one pass."""

    name: str
    step: int
    maker: str | None
    mark: str


RULES = (
    Rule("maker+model", 1, "r_maker", "r_sig"),
    Rule("title maker+model", 1, "r_title_maker", "r_sig"),
    Rule("maker+title", 1, "r_title_maker", "r_title_sig"),
    Rule("model, maker alike", 2, None, "r_sig"),
    Rule("title, maker alike", 2, None, "r_title_sig"),
)


def _left(df: DataFrame) -> DataFrame:
    """Entries of the left source, also under the mark in its own id where that reads otherwise."""
    by_id = signature(F.translate(F.regexp_replace("openmsx_id", "^[^_]*_", ""), "_", " "))
    sigs = F.filter(F.array_distinct(F.array(signature("model"), by_id)), lambda s: F.length(s) >= 3)
    return df.select(F.col("rec_id").alias("l_rec"), maker_key("manufacturer").alias("l_maker"), F.explode(sigs).alias("l_sig"))


def _right(df: DataFrame) -> DataFrame:
    """Entries of the right source: one per model that the page names and maker it may be of."""
    title = F.regexp_replace(plain("msxorg_title"), r"\s+/\s+.*$", "")
    row = df.select(
        F.col("rec_id").alias("r_rec"), F.posexplode_outer(variants("model")).alias("at", "r_model"), maker_keys("manufacturer").alias("makers"),
        maker_key(F.regexp_extract(title, r"^\s*([^\s]+)", 1)).alias("r_title_maker"), signature(title).alias("r_title_sig"),
        F.concat_ws(" ", plain("manufacturer"), title, plain("model")).alias("r_name"),
    )
    sig = F.coalesce(signature("r_model"), F.lit(""))
    whole = F.when((F.length(sig) >= 3) & signature("r_model", fold=False).rlike("^[A-Z]{2}"), sig)
    # a later part may leave out the letters; the title may stand in for the first part only
    row = row.withColumn("part", F.coalesce("at", F.lit(0))).drop("at").withColumn("r_sig", whole).withColumn("r_title_sig", F.when((F.col("part") == 0) & (F.length("r_title_sig") >= 3) & (whole.isNull() | F.endswith("r_title_sig", sig)), F.col("r_title_sig")))
    return row.withColumn("r_maker", F.explode_outer("makers")).withColumn("r_maker", F.coalesce("r_maker", F.lit(""))).drop("makers", "r_model")


def _exact(open_: DataFrame, keys: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """Hits of rules that name both maker and mark: one equi-join for all of them."""
    tries = [F.struct(F.lit(n).alias("rule_no"), F.col(r.maker).alias("l_maker"), F.col(r.mark).alias("l_sig")) for n, r in rules]
    each = open_.select("r_rec", "part", F.inline(F.array(*tries))).where("l_sig <> ''")
    return join_hot(each, keys.select("l_maker", "l_sig"), ["l_maker", "l_sig"], by=("r_rec",))


def _alike(open_: DataFrame, keys: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """Hits of rules by the mark alone. Each mark meets all makers the left has of it as one list, so a mark that many makers
    use makes no rows; of the alike ones the nearest is kept."""
    makers = cut(keys.groupBy("l_sig").agg(F.collect_set("l_maker").alias("makers")))
    tries = [F.struct(F.lit(n).alias("rule_no"), F.col(r.mark).alias("l_sig")) for n, r in rules]
    each = open_.select("r_rec", "part", "r_maker", "r_title_maker", "r_name", F.inline(F.array(*tries))).where("l_sig <> ''")
    met = join_hot(each, makers, ["l_sig"], by=("r_rec",))
    near = lambda m: (F.col("r_maker") == "") | (F.levenshtein(m, F.col("r_maker")) <= F.when(F.length(m) < 6, 1).otherwise(2)) | F.contains(F.col("r_name"), m)
    other = F.when(F.col("r_maker") == "", F.col("r_title_maker")).otherwise(F.col("r_maker"))
    priced = F.transform(F.filter("makers", near), lambda m: F.struct(F.levenshtein(m, other).alias("d"), m.alias("l_maker")))
    met = met.withColumn("c", priced)
    return met.select("r_rec", "part", "rule_no", "l_sig", F.explode(F.filter("c", lambda x: x["d"] == F.array_min(F.col("c"))["d"])).alias("x")).select("r_rec", "part", "rule_no", F.col("x.l_maker").alias("l_maker"), "l_sig")


def _hits(lefts: DataFrame, rights: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """((l_maker, l_sig, n_left) of the left, (r_rec, part, l_maker, l_sig, rule_no) of all passes)"""
    keys = cut(lefts.groupBy("l_maker", "l_sig").agg(F.count("*").alias("n_left")))
    open_, found = rights, None
    for step in sorted({r.step for r in rules}):
        own = [(n, r) for n, r in enumerate(rules) if r.step == step]
        parts = [f(open_, keys, some).select("r_rec", "part", "rule_no", "l_maker", "l_sig") for f, some in ((_exact, [x for x in own if x[1].maker]), (_alike, [x for x in own if not x[1].maker])) if some]
        tried = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        # as many as the makers and marks of one record: the first rule that hit keeps its hits
        first = tried.groupBy("r_rec", "part").agg(F.collect_set(F.struct("rule_no", "l_maker", "l_sig")).alias("h"))
        hit = cut(first.select("r_rec", "part", F.explode(F.filter("h", lambda x: x["rule_no"] == F.array_min(F.col("h"))["rule_no"])).alias("x")).select("r_rec", "part", "x.*"))
        found = hit if found is None else found.unionByName(hit)
        open_ = open_.join(hit.select("r_rec", "part").distinct(), ["r_rec", "part"], "left_anti")
    return keys, found


def rule_confidence(found: DataFrame, left_facts: DataFrame, right_facts: DataFrame, smoothing: tuple[float, float] = (1.0, 1.0), least: int = 3, share: float = 0.6) -> DataFrame:
    """(rule_no, n, hit, confidence): each rule's precision on silver labels.

    A record is judged where it and its class share `least` or more known facts, and is right if `share` of them agree.
    Confidence is (hit + a) / (n + a + b).
    """
    both = join_hot(found.join(right_facts, "r_rec"), left_facts, ["l_maker", "l_sig"], by=("r_rec",))
    same = sum([F.coalesce((F.col(f"l_{f}") == F.col(f"r_{f}")).cast("int"), F.lit(0)) for f in FACTS], F.lit(0))
    known = sum([(F.col(f"l_{f}").isNotNull() & F.col(f"r_{f}").isNotNull()).cast("int") for f in FACTS], F.lit(0))
    judged = both.select("rule_no", known.alias("known"), same.alias("same")).where(F.col("known") >= least)
    return _smoothed(judged.select("rule_no", (F.col("same") >= share * F.col("known")).alias("is_match")), smoothing)


def _smoothed(judged: DataFrame, smoothing: tuple[float, float]) -> DataFrame:
    a, b = smoothing
    stats = judged.groupBy("rule_no").agg(F.count("*").alias("n"), F.count_if("is_match").alias("hit"))
    return stats.withColumn("confidence", (F.col("hit") + a) / (F.col("n") + a + b))


def _facts(side: str) -> list[Column]:
    return [F.lower(F.trim(F.col(f).cast("string"))).alias(f"{side}_{f}") for f in FACTS]


def pairs(left: DataFrame, right: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(openmsx_rec_id, msxorg_rec_id, rule_no): pairs of records of one machine; see `match`."""
    lefts, rights = cut(_left(left)), cut(_right(right))
    keys, found = _hits(lefts, rights, rules)
    return _pairs(lefts, keys, found)


def _pairs(lefts: DataFrame, keys: DataFrame, found: DataFrame) -> DataFrame:
    found = found.groupBy("r_rec", "l_maker", "l_sig").agg(F.min("rule_no").alias("rule_no"))
    on = ["l_maker", "l_sig"]
    # at most one row per LARGE records of the left
    large = keys.where(F.col("n_left") > LARGE).select(*on, F.ceil(F.col("n_left") / LARGE).cast("int").alias("parts"))
    if large.take(1):
        lefts = lefts.join(F.broadcast(large), on, "left").withColumn("_at", F.pmod(F.xxhash64("l_rec"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        found = found.join(F.broadcast(large), on, "left").withColumn("_at", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        on = [*on, "_at"]
    return lefts.join(found, on).groupBy(F.col("l_rec").alias("openmsx_rec_id"), F.col("r_rec").alias("msxorg_rec_id")).agg(F.min("rule_no").alias("rule_no"))


def match(left: DataFrame, right: DataFrame, rules: tuple[Rule, ...] = RULES, labels: DataFrame | None = None, smoothing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(openmsx_rec_id, msxorg_rec_id, rule, confidence): pairs of records of one machine.

    Each model a page names is resolved on its own by the first rule that gives it a partner; all copies of either record
    pair. Null or empty names resolve only by what else is known (title, id); entries without any mark match nothing.
    `labels`: (openmsx_rec_id, msxorg_rec_id, is_match) to measure the rules on instead of silver labels; `smoothing` (a, b).
    A rule of which nothing can be judged has a / (a + b).
    """
    lefts, rights = cut(_left(left)), cut(_right(right))
    keys, found = _hits(lefts, rights, rules)
    found = cut(found)
    rows = _pairs(lefts, keys, found)
    if labels is None:
        conf = rule_confidence(found, _left_facts(left), right.select(F.col("rec_id").alias("r_rec"), *_facts("r")), smoothing)
    else:
        conf = _smoothed(rows.join(labels, ["openmsx_rec_id", "msxorg_rec_id"]), smoothing)
    names = F.array(*[F.lit(r.name) for r in rules])
    return rows.join(F.broadcast(conf), "rule_no", "left").select("openmsx_rec_id", "msxorg_rec_id", names[F.col("rule_no")].alias("rule"), F.coalesce("confidence", F.lit(smoothing[0] / sum(smoothing))).alias("confidence"))


def _left_facts(left: DataFrame) -> DataFrame:
    """Facts of each left key: the most frequent value of each, of equal ones the smallest."""
    each = _left(left).join(left.select(F.col("rec_id").alias("l_rec"), *_facts("l")), "l_rec")
    return cut(each.groupBy("l_maker", "l_sig").agg(*[F.mode(f"l_{f}", True).alias(f"l_{f}") for f in FACTS]))


def classes(left: DataFrame, right: DataFrame, rules: tuple[Rule, ...] = RULES, smoothing: tuple[float, float] = (1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """((class_maker, class_mark, n_openmsx, n_msxorg, rule, confidence), (source, rec_id, class_maker, class_mark)).

    One row per machine that both sources hold and the records that belong to it, without any pair of records. `rule` is the
    weakest that a record of the class rests on. A page of two models belongs to both.
    """
    lefts, rights = cut(_left(left)), cut(_right(right))
    keys, found = _hits(lefts, rights, rules)
    found = cut(found.groupBy("r_rec", "l_maker", "l_sig").agg(F.min("rule_no").alias("rule_no")))
    conf = rule_confidence(found, _left_facts(left), right.select(F.col("rec_id").alias("r_rec"), *_facts("r")), smoothing)
    per = cut(found.groupBy("l_maker", "l_sig").agg(F.count("*").alias("n_msxorg"), F.max("rule_no").alias("rule_no")).join(keys, ["l_maker", "l_sig"]))
    names = F.array(*[F.lit(r.name) for r in rules])
    rows = per.join(F.broadcast(conf), "rule_no", "left").select(
        F.col("l_maker").alias("class_maker"), F.col("l_sig").alias("class_mark"), F.col("n_left").alias("n_openmsx"), "n_msxorg", names[F.col("rule_no")].alias("rule"), F.coalesce("confidence", F.lit(smoothing[0] / sum(smoothing))).alias("confidence")
    )
    key = [F.col("l_maker").alias("class_maker"), F.col("l_sig").alias("class_mark")]
    mine = join_hot(lefts, per.select("l_maker", "l_sig"), ["l_maker", "l_sig"], by=("l_rec",)).select(F.lit("openmsx").alias("source"), F.col("l_rec").alias("rec_id"), *key)
    return rows, mine.unionByName(found.select(F.lit("msxorg").alias("source"), F.col("r_rec").alias("rec_id"), *key))
