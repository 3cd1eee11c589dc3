"""Mapping freely typed values to the entries of a reference list.

Every distinct typed token is joined to the reference vocabulary by edit distance: both sides are exploded to their
one-character deletions, met in an equi-join, and each met pair is priced by a weighted edit distance that knows how typing
errors look. Repaired tokens are combined with soft TF-IDF to rank whole entries; a value that names no entry is reported
with -1. Only distinct values are repaired, so a value typed millions of times costs as much as one typed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.llm.names import maker_key, plain
from specloom.session import cut, join_hot, small_side

#: fixed values: other names of listed regions
REGION_NAMES = {
    "jp": ("nippon", "nihon"), "kr": ("south korea", "republic of korea"), "us": ("america", "united states of america", "u.s.a.", "u.s.", "north america"),
    "gb": ("great britain", "u.k.", "britain", "england"), "nl": ("holland", "the netherlands"), "br": ("brasilien",), "ru": ("soviet union", "ussr", "cccp"),
    "tw": ("formosa",), "cz": ("czech republic",), "tr": ("turkiye",), "ae": (), "sa": ("ksa",), "eu": ("european union",), "fr": ("frankreich",), "de": ("allemagne", "west germany"), "es": ("spanien",), "it": ("italien",), "se": ("schweden",),
}
_LIKE = {"O": "0", "I": "1", "L": "1"}


def typing_cost(typed: str, meant: str, limit: float = 1.6, digits_differ: bool = True) -> float:
    """Price of reading `typed` as `meant`: 1 for a letter left out, doubled, swapped with the next or hit wrong, 1.5 for one
    that came in from nowhere, 0.2 for a look-alike. A digit for another digit is no typing error but another number."""
    n, m = len(typed), len(meant)
    if abs(n - m) > limit:
        return 99.0
    before: list[float] = []
    row = [j * 1.0 for j in range(m + 1)]
    for i in range(1, n + 1):
        a = typed[i - 1]
        extra = 1.0 if (i > 1 and typed[i - 2] == a) or (i < n and typed[i] == a) else 1.5
        now = [row[0] + extra]
        for j in range(1, m + 1):
            b = meant[j - 1]
            if a == b:
                sub = 0.0
            elif _LIKE.get(a, a) == _LIKE.get(b, b):
                sub = 0.2
            else:
                sub = 9.0 if digits_differ and a.isdigit() and b.isdigit() else 1.0
            best = min(row[j - 1] + sub, row[j] + extra, now[j - 1] + 1.0)
            if i > 1 and j > 1 and a == meant[j - 2] and typed[i - 2] == b and a != b:
                best = min(best, before[j - 2] + 1.0)
            now.append(best)
        before, row = row, now
    return row[m]


def deletions(token: Column, shortest: int = 3) -> Column:
    """The token and its one-character deletions, look-alikes folded: how many of them differ is left to the price. Tokens
    under `shortest` letters have only themselves."""
    token = F.translate(token, "".join(_LIKE), "".join(_LIKE.values()))
    n = F.length(token)
    gone = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, n)))
    return F.array_distinct(F.concat(F.array(token), F.when(n >= shortest, gone).otherwise(F.array(token))))


def repair(tokens: DataFrame, vocabulary: DataFrame, limit: float = 1.6, shortest: int = 3, by: tuple[str, ...] = (), longest: int | None = None) -> DataFrame:
    """(*by, token, word, cost): each distinct token beside the vocabulary words it may stand for, of the same `by` columns (strings).

    Exact words cost 0. Words within one edit beside any look-alikes are found by shared deletions, which is all that a price of
    `limit` below 2 can pay for; dearer pairs are dropped. Tokens that are longer than any word by more than one letter stand for none;
    `longest` is the length of the longest word, if it is known.
    """
    if longest is None:
        longest = vocabulary.agg(F.max(F.length("word")).alias("n")).first().n or 0
    t = tokens.where(F.length("token") <= longest + 1).select(*by, "token").distinct().select(*by, "token", F.explode(deletions(F.col("token"), shortest)).alias("k"))
    v = vocabulary.select(*by, "word").distinct().select(*by, "word", F.explode(deletions(F.col("word"), shortest)).alias("k"))
    met = t.join(small_side(v), [*by, "k"]).select(*by, "token", "word").distinct()

    def price(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(cost=[typing_cost(a, b, limit) for a, b in zip(pdf.token, pdf.word, strict=True)])

    return met.mapInPandas(price, "".join(f"{c} string, " for c in by) + "token string, word string, cost double").where(F.col("cost") <= limit)


def mark(c: Column | str) -> Column:
    """A model name without maker, nickname, notes and separators; look-alikes are left for `typing_cost`."""
    s = F.regexp_replace(plain(c), r"\([^)]*\)|\[[^\]]*\]", " ")
    s = F.regexp_replace(s, r"[/ ]+(?:MODEL|TYPE|VERSION|VER|REV)[ .]*[0-9A-Z]?(?![A-Z0-9])", " ")
    s = F.regexp_replace(s, r"(?:MARK|MK)[ ._-]*(?:II|2)(?![A-Z0-9])", "MKII")
    s = F.regexp_replace(s, r"[ ._-]*PLUS(?![A-Z0-9])", "+")
    s = F.regexp_replace(s, r"(?<![A-Z0-9+])[A-Z]{5,}(?![A-Z0-9+])", " ")
    return F.regexp_replace(s, r"[^A-Z0-9+]", "")


def read_marks(df: DataFrame, slack: int = 1, column: str = "mark") -> DataFrame:
    """`df` with one row per way to read a mark as letters, number and suffix: adds (letters, number, suffix, swapped, moved).

    The number runs from the first digit to the last; each end may lie up to `slack` letters off (`moved`), since a digit may have
    been mistyped as a letter there and a letter as a digit, or a letter and a digit may have changed places (`swapped` 1, read as
    if they hadn't). A mark without digits is all letters.
    """
    c = F.col(column)
    df = df.withColumn("_lead", F.length(F.regexp_extract(c, r"^([^0-9]*)[0-9]", 1))).withColumn("_last", F.length(F.regexp_extract(c, r"^(.*[0-9])", 1))).withColumn("_n", F.length(c))
    lead, last, n = F.col("_lead"), F.col("_last"), F.col("_n")
    cut_ = lambda start, size: F.substring(c, start, size)
    way = lambda letters, number, suffix, swapped, moved: F.struct(letters.alias("letters"), number.alias("number"), suffix.alias("suffix"), F.lit(swapped).alias("swapped"), F.lit(moved).alias("moved"))
    one, near = F.lit(1), sorted(range(-slack, slack + 1), key=abs)
    ways = []
    for a in near:
        for b in near:
            x, y = lead + a, last + b
            ways.append(F.when((x >= 0) & (y <= n) & (y > x), way(cut_(one, x), cut_(x + 1, y - x), cut_(y + 1, n), 0, bool(a or b))))
    if slack:
        head = way(F.concat(cut_(one, lead), cut_(lead + 2, one)), F.concat(cut_(lead + 1, one), cut_(lead + 3, last - lead - 2)), cut_(last + 1, n), 1, False)
        foot = way(cut_(one, lead), F.concat(cut_(lead + 1, last - lead - 2), cut_(last, one)), F.concat(cut_(last - 1, one), cut_(last + 1, n)), 1, False)
        inside = last - lead > 2
        ways += [F.when(inside & cut_(lead + 2, one).rlike("[^0-9]"), head), F.when(inside & cut_(last - 1, one).rlike("[^0-9]"), foot)]
    none = F.array(way(c, F.lit(""), F.lit(""), 0, False))
    every = F.when(last > 0, F.array_distinct(F.array_compact(F.array(*ways)))).otherwise(none)
    return df.withColumn("_ways", every).select(*[x for x in df.columns if not x.startswith("_")], F.inline("_ways"))


def map_models(entries: DataFrame, canon: DataFrame, id_col: str = "entry_id", maker_col: str = "match_manufacturer", model_col: str = "match_model", limit: float = 1.6) -> DataFrame:
    """(id, canon_id, score): the listed model each typed name stands for, -1 if none. Null and blank names give no row.

    A name is read as the tokens letters, number, suffix and maker. Each distinct token is repaired against the listed tokens of
    its kind; whole entries are ranked by soft TF-IDF over the repaired tokens, the repairs of one name costing at most `limit`
    together. A suffix that is listed stands for itself: it is a sibling's mark, never a misspelling. A name that reads exactly
    as a listed model is that model, whatever the maker (the maker decides between several). A misspelt one must not contradict
    the listed maker, and one entry must score higher than all others.
    """
    kinds = ("letters", "number", "suffix")
    ref = canon.select("canon_id", mark("model").alias("mark"), maker_key("manufacturer").alias("c_maker")).where("mark != ''")
    ref = cut(read_marks(ref, 0).select("canon_id", "c_maker", *[F.col(k).alias(f"c_{k}") for k in kinds]))
    size = ref.agg(F.count("*").alias("n"), *[F.max(F.length(f"c_{k}")).alias(k) for k in kinds]).first()
    n, longest = max(1, size.n), max(size[k] or 0 for k in kinds)
    idf = {k: ref.groupBy(f"c_{k}").agg(F.log(F.lit(float(n + 1)) / F.count("*")).alias(f"w_{k}")) for k in (*kinds, "maker")}
    weighed = ref
    for k, w in idf.items():
        weighed = weighed.join(small_side(w), f"c_{k}")
    weighed = cut(weighed)
    typed = entries.select(F.col(id_col).alias("id"), F.col(maker_col).alias("maker"), F.col(model_col).alias("model")).where(F.regexp_replace(F.coalesce("model", F.lit("")), r"(?U)\s", "") != "")
    keyed = typed.select("id", maker_key("maker").alias("maker"), mark("model").alias("mark"), plain("model").alias("name"))
    values = cut(keyed.select("maker", "mark", "name").distinct())
    read = cut(read_marks(values.where("mark != ''").select("mark").distinct()))
    each = lambda df, p, name: df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{p}{k}").alias(name)) for k in kinds]))).distinct()
    tokens, words = each(read, "", "token"), each(ref, "c_", "word")
    listed = words.where("kind = 'suffix'").withColumnRenamed("word", "token")
    # a listed suffix stands for itself; a token of which no letter is right is another one, as is one beside none at all
    free = repair(tokens.join(small_side(listed), ["kind", "token"], "left_anti"), words, limit, 1, ("kind",), longest)
    free = free.where((F.col("cost") == 0) | (F.col("cost") < F.greatest(F.length("token"), F.length("word"))))
    pairs = cut(free.unionByName(tokens.join(small_side(listed), ["kind", "token"]).select("kind", "token", F.col("token").alias("word"), F.lit(0.0).alias("cost"))))
    fixed = {k: pairs.where(F.col("kind") == k).select(F.col("token").alias(k), F.col("word").alias(f"c_{k}"), F.col("cost").alias(f"cost_{k}")) for k in kinds}
    # the number tells most: it finds the entries, the other tokens are held against theirs
    met = read.join(small_side(fixed["number"]), "number").join(small_side(weighed), "c_number")
    met = met.join(small_side(fixed["letters"]), ["letters", "c_letters"]).join(small_side(fixed["suffix"]), ["suffix", "c_suffix"])
    cost = sum((F.col(f"cost_{k}") for k in kinds), F.col("swapped").cast("double"))
    model = sum((F.col(f"w_{k}") * (1 - F.col(f"cost_{k}") / 4) for k in kinds), F.lit(0.0)) * (1 - F.col("swapped") / 4)
    met = met.withColumn("cost", cost).where((F.col("cost") <= limit) & (~F.col("moved") | (F.length("number") == F.length("c_number")))).withColumn("model", model)
    # of the ways to read a mark the one that fits an entry best
    best = met.groupBy("mark", "canon_id", "c_maker", "w_maker", sum((F.col(f"w_{k}") for k in kinds), F.lit(0.0)).alias("w_model")).agg(F.max("model").alias("model"), F.min("cost").alias("cost"))
    both = values.join(best, "mark")
    near = F.greatest(
        F.when(F.col("maker") == "", 0.5).otherwise(F.lit(1.0) - F.levenshtein("maker", "c_maker") / F.greatest(F.length("maker"), F.length("c_maker"), F.lit(1))),
        F.when((F.col("c_maker") != "") & F.contains("name", F.col("c_maker")), 1.0).otherwise(0.0),
    )
    score = (F.col("model") + F.col("w_maker") * F.col("near")) / (F.col("w_model") + F.col("w_maker"))
    sure = F.col("cost") < 0.5
    ok = sure | (F.col("mark").rlike("[0-9].*[0-9]") & (F.col("near") >= 0.5))
    ranked = both.withColumn("near", near).where(ok).select("maker", "mark", "name", F.struct(score.alias("score"), (-F.col("canon_id")).alias("first"), "cost").alias("x"))
    top = ranked.groupBy("maker", "mark", "name").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # as many as the entries one mark was repaired to
    top = top.select("maker", "mark", "name", F.element_at("xs", -1).alias("x"), F.size(F.filter("xs", lambda y: y["score"] == F.element_at(F.col("xs"), -1)["score"])).alias("n"))
    hit = values.join(top.where("n = 1 or x.cost < 0.5"), ["maker", "mark", "name"], "left")
    hit = cut(hit.select("maker", "mark", "name", F.coalesce(-F.col("x.first"), F.lit(-1).cast("long")).alias("canon_id"), F.coalesce("x.score", F.lit(0.0)).alias("score")))
    return join_hot(keyed, hit, ["maker", "mark", "name"], by=("id",)).select("id", "canon_id", "score")


def _fold(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(c, "’İ", "'i")), r"(?U)\s+", " "), r"^[ .'\"]+|[ .'\"?]+$", "")


def _notes(words: DataFrame, known: DataFrame, fixed: DataFrame, regions: int) -> DataFrame:
    """(t): words beside a name that name nothing: neither listed nor misspelt, and found in values that name `regions` or more
    different entries ('only', 'export version'). A word that goes with any name says nothing about which."""
    named = words.join(small_side(known.select(F.col("word").alias("t"), "canon_id").distinct()), "t").select("v", "canon_id").distinct()
    other = words.select("v", "t").distinct().join(small_side(known.select(F.col("word").alias("t")).distinct()), "t", "left_anti").join(small_side(fixed.select("t").distinct()), "t", "left_anti")
    # pairs of word and entry combine before the exchange: as many as the words times the list
    beside = other.join(named, "v").groupBy("t", "canon_id").agg(F.lit(1).alias("x"))
    return cut(beside.groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= regions).select("t"))


def map_regions(values: DataFrame, canon: DataFrame, id_col: str = "rec_id", value_col: str = "region", accept: float = 0.72, other_names: dict[str, tuple[str, ...]] = REGION_NAMES, note_regions: int = 3, shortest: int = 4) -> DataFrame:
    """(id, canon_id, score): one row per listed region a value names (it may name several), -1 if none.

    Lists are split, codes count only as a whole part, notes beside a name are found in the data and left out. Each part is repaired as
    a whole and word by word; parts whose best soft TF-IDF score is below `accept` name nothing. Words under `shortest` letters
    are never repaired: any two of them are an edit or two apart. `other_names`: by code, names that the list lacks. Null and
    blank values give no row.
    """
    pairs = [x for k, v in other_names.items() if v for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))]
    other = F.create_map(*pairs)[F.lower("code")] if pairs else F.lit(None).cast("array<string>")
    names = F.array_compact(F.array(_fold(F.col("region")), _fold(F.col("local_name"))))
    ref = canon.select(F.col("region_id").alias("canon_id"), F.explode(F.array_distinct(F.concat(names, F.coalesce(other, F.array().cast("array<string>"))))).alias("word"), F.lower("code").alias("code"))
    ref = cut(ref.select("canon_id", "code", _fold(F.col("word")).alias("word")).where("word != ''").distinct())
    size = ref.agg(F.count_distinct("canon_id").alias("n"), F.max(F.length("word")).alias("longest")).first()
    n, longest = max(1, size.n), size.longest or 0
    distinct = cut(values.select(F.col(value_col).alias("v")).where(F.regexp_replace(F.coalesce(F.col(value_col), F.lit("")), r"(?U)\s", "") != "").distinct())
    whole = _fold(F.regexp_replace(F.col("v"), r"^\s*\(([^()]*)\)\s*$", "$1"))
    noted = F.regexp_extract_all(whole, F.lit(r"\(([^()]*)\)"), F.lit(1))
    bare = F.regexp_replace(whole, r"\([^()]*\)|\[[^\]]*\]|[?*]", " ")
    split = F.split(bare, r"\s*[/;,&|+]\s*|\s+(?:and|und|et|y|e|-)\s+")
    # a note in brackets counts where it is a code or a name itself: 'America (US)'
    raw = cut(distinct.select("v", F.posexplode(F.array_distinct(F.concat(split, noted))).alias("k", "s")).select("v", "k", _fold(F.trim(F.col("s"))).alias("token")).where("token != ''"))
    ref_words = ref.select("canon_id", F.col("word").alias("name"), F.explode(F.array_distinct(F.split("word", "[ '.-]+"))).alias("word")).where("word != ''")
    # words with the weight of each and of the whole name; short ones are only known, they weigh nothing
    idf = ref_words.where(F.length("word") >= shortest).groupBy("word").agg(F.log(F.lit(float(n + 1)) / F.count_distinct("canon_id")).alias("idf"))
    ref_words = cut(ref_words.join(small_side(idf), "word", "left").withColumn("norm", F.sum("idf").over(Window.partitionBy("canon_id", "name"))))  # the words of one name
    long_ = ref_words.where("idf is not null")
    words = raw.select("v", "k", "token", F.posexplode(F.split("token", " ")).alias("at", "t")).where("t != ''")
    pieces = words.select("v", F.explode(F.split("t", "['.-]+")).alias("t")).where("t != ''").distinct()
    fixed = cut(repair(pieces.where(F.length("t") >= shortest).select(F.col("t").alias("token")), long_, longest=longest).withColumnRenamed("token", "t"))
    notes = _notes(pieces, ref_words, fixed, note_regions)
    kept = words.join(small_side(notes), "t", "left_anti").groupBy("v", "k").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("ws"))
    seg = kept.select("v", _fold(F.array_join(F.transform("ws", lambda x: x["t"]), " ")).alias("token"))
    # a name may hold a word that elsewhere is a note: parts that are names as they stand stay as they are
    exact = raw.join(small_side(ref.select(F.col("word").alias("token")).unionByName(ref.select(F.col("code").alias("token"))).distinct()), "token", "left_semi").select("v", "token")
    seg = cut(seg.unionByName(exact).where("token != ''").distinct())
    by_code = seg.join(small_side(ref.select("canon_id", F.col("code").alias("token")).distinct()), "token").select("v", "token", "canon_id", F.lit(1.0).alias("score"))
    # whole parts against whole names
    as_whole = repair(seg.where(F.length("token") >= shortest).select("token").unionByName(seg.join(small_side(ref.select(F.col("word").alias("token")).distinct()), "token", "left_semi").select("token")), ref, longest=longest)
    by_name = seg.join(as_whole, "token").join(small_side(ref), "word").select("v", "token", "canon_id", (1 - F.col("cost") / F.greatest(F.lit(4.0), F.length("word").cast("double"))).alias("score"))
    # word by word
    seg_words = seg.select("v", "token", F.explode(F.array_distinct(F.split("token", "[ '.-]+"))).alias("t")).where(F.length("t") >= shortest)
    repaired = cut(fixed.join(small_side(long_), "word").select("t", "canon_id", "name", "word", "norm", "idf", ((1 - F.col("cost") / 4) * F.col("idf")).alias("w")))
    own = F.coalesce("own", F.lit(0.5) * F.log(F.lit(float(n + 1))))
    weight = repaired.groupBy("t").agg(F.max("idf").alias("own"))
    seg_norm = seg_words.join(small_side(weight), "t", "left").groupBy("v", "token").agg(F.sum(own).alias("seg_norm"))
    soft = (
        seg_words.join(small_side(repaired), "t")
        .groupBy("v", "token", "canon_id", "name", "norm", "word").agg(F.max("w").alias("w"))
        .groupBy("v", "token", "canon_id", "name", "norm").agg(F.sum("w").alias("w"))
        .join(seg_norm, ["v", "token"])
        .select("v", "token", "canon_id", (0.97 * F.col("w") / F.greatest("norm", "seg_norm")).alias("score"))
    )
    scored = by_code.unionByName(by_name).unionByName(soft).groupBy("v", "token", "canon_id").agg(F.max("score").alias("score"))
    best = scored.where(F.col("score") >= accept).groupBy("v", "token").agg(F.max_by("canon_id", F.struct("score", -F.col("canon_id"))).alias("canon_id"), F.max("score").alias("score"))
    named = best.groupBy("v", "canon_id").agg(F.max("score").alias("score"))
    out = cut(distinct.join(named, "v", "left").select("v", F.coalesce("canon_id", F.lit(-1).cast("long")).alias("canon_id"), F.coalesce("score", F.lit(0.0)).alias("score")))
    return join_hot(values.select(F.col(id_col).alias("id"), F.col(value_col).alias("v")), out, ["v"], by=("id",)).select("id", "canon_id", "score")
