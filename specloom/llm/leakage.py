"""Evaluation items that leaked into a corpus.

The items form an inverted index of word pairs with BM25 weights. Every passage of every document queries it with block-max
WAND and retrieves all items that score at least what a passage with a leak must score; the retrieved pairs are then
verified exactly. The threshold of an item is a lower bound over everything that counts as a leak of it, so retrieval loses
nothing. Letters of scripts without blanks are words of their own.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import pickle
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from specloom.llm.sentences import sentence_spans
from specloom.session import cut, join_hot, spread

#: fixed values: Cyrillic and Greek letters that look like Latin ones (lower case)
LOOKALIKES = str.maketrans(
    "аеорсухіјѕһкмтвнԁԛԝɡѵүґ" + "αεορυνικτχηγ",
    "aeopcyxijshkmtbhdqwgvyr" + "aeopuviktxny",
)
_TAG = re.compile(r"<[^<>\n]{1,80}>|&(?:#\d{1,6}|#x[0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});")
#: tags that `_TAG` doesn't hold: longer ones and ones over several lines. Without any attribute value it is prose
_LONG = re.compile(r"""<(?![^<>\n]{1,80}>)(?=[^<>]*=|[^<>]{1,80}>)/?[a-zA-Z][\w:-]*+(?:\s++[\w:@.-]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>]++))?+)*+\s*+/?>""")
_NONE = re.compile("[­​-‏⁠﻿̀-゙゚ͯ︎️]+")
_WORD = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W_぀-ヿ㐀-鿿豈-﫿]+")
_ASCII = re.compile("[a-z0-9]+")
_LIKE = re.compile("[" + "".join(map(chr, LOOKALIKES)) + "]")
_ASKS = re.compile(r"(?:[?？؟]|か[。．]?)[\s\"'”’»」』)]*\Z")
_IDEO = re.compile(r"[぀-ヿ㐀-鿿]")


def words(text: str) -> list[str]:
    """Words without case, accents, look-alikes, punctuation, spacing and mark-up."""
    t = _LONG.sub(" ", text) if "<" in text else text
    t = _TAG.sub(" ", t) if "<" in t or "&" in t else t
    if t.isascii():
        return _ASCII.findall(t.lower())
    t = _NONE.sub("", unicodedata.normalize("NFKD", t)).casefold()
    return _WORD.findall(t.translate(LOOKALIKES) if _LIKE.search(t) else t)


def sentence_key(ws: list[str]) -> int:
    """64-bit key of a sentence's words."""
    return int.from_bytes(hashlib.blake2b(" ".join(ws).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class ItemIndex:
    """The inverted index of a block of items, small enough for one process.

    run, ideo_run: consecutive words (or letters of scripts without blanks) that count as a leak; edits: share of a
    sentence's words that may differ. Sentences shorter than `run` that several items share (instructions, stock questions)
    give none of them away and are left out, unless `stock`: then each of them counts for every item that has it. `shared`: keys
    of the sentences that several items share, of all blocks; by default they are counted among `items`. k1, b: BM25.
    """

    def __init__(self, items: list[tuple[int, str]], run: int = 12, ideo_run: int = 30, edits: float = 0.25, k1: float = 1.2, b: float = 0.75, block: int = 64, shared: set[int] | None = None, stock: bool = False):
        self.ids = [i for i, _ in items]
        self.block = block
        texts = [words(t or "") for _, t in items]
        self.vocabulary: dict[str, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for ws in texts]
        ideo = [len(_IDEO.findall(t or "")) * 2 > len("".join(ws)) for (_, t), ws in zip(items, texts, strict=True)]
        self.run = [ideo_run if x else run for x in ideo]
        plain = [_LONG.sub(" ", t) for _, t in items]
        texts_of = [[words(t[a:e]) for a, e in sentence_spans(t)] for t in plain]
        keys = [[sentence_key(s) for s in own] for own in texts_of]
        if shared is None:
            shared = {k for k, n in Counter(k for own in keys for k in set(own)).items() if n > 1}
        sents = [[[self.vocabulary[w] for w in s] for s in own] for own in texts_of]
        pairs = [Counter(zip(c, c[1:])) for c in coded]
        df = Counter(p for c in pairs for p in c)
        n, mean = len(items), max(1.0, sum(map(len, coded)) / max(1, len(items)))
        #: per item: sentences as (words, distinct pairs, edits allowed, places of each word)
        self.sentences: list[list[tuple[list[int], frozenset, int, dict[int, int]]]] = []
        self.postings: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.runs: dict[tuple[int, ...], list[int]] = {}
        #: word pairs of which whatever counts as a leak holds at least one
        self.probes: set[tuple[int, int]] = set()
        #: per item: word pairs of its passage and of its question, the last sentence if that asks
        self.sides: list[tuple[frozenset, frozenset]] = []
        longest = max([ideo_run, run])
        #: word pairs that the least of all leaks holds
        self.least = longest
        for k, c in enumerate(coded):
            asks = bool(sents[k]) and _ASKS.search((items[k][1] or "").rstrip()) is not None
            body = sents[k][:-1] if asks else sents[k]
            told = [s for s, at_key in zip(body, keys[k]) if at_key not in shared]
            self.sides.append((frozenset(p for s in told for p in zip(s, s[1:])), frozenset(zip(sents[k][-1], sents[k][-1][1:])) if asks else frozenset()))
            norm = k1 * (1 - b + b * len(c) / mean)
            weight = {p: math.log(1 + (n - df[p] + 0.5) / (df[p] + 0.5)) * f * (k1 + 1) / (f + norm) for p, f in pairs[k].items()}
            own, bounds = [], []
            for s, at_key in zip(sents[k], keys[k], strict=True):
                if len(s) < 2 or (not stock and len(s) < self.run[k] and at_key in shared):
                    continue
                e = int(len(s) * edits)
                distinct = frozenset(zip(s, s[1:]))
                masks: dict[int, int] = {}
                for i, w in enumerate(s):
                    masks[w] = masks.get(w, 0) | 1 << i
                own.append((s, distinct, e, masks))
                self.probes.update(sorted(distinct, key=lambda p: (df[p], p))[: 2 * e + 1])
                kept = sorted(weight.get(p, 0.0) for p in distinct)[: max(0, len(distinct) - 2 * e)]
                bounds.append(sum(kept))
                longest = max(longest, len(s) + e)
                self.least = min(self.least, max(1, len(distinct) - 2 * e))
            r = self.run[k]
            for i in range(len(c) - r + 1):
                g = tuple(c[i : i + r])
                bounds.append(sum(weight[p] for p in set(zip(g, g[1:]))))
                self.least = min(self.least, max(1, len(set(zip(g, g[1:])))))
                if len(g) > 1:
                    self.probes.add(min(zip(g, g[1:]), key=lambda p: (df[p], p)))
                if k not in (at := self.runs.setdefault(g, [])):
                    at.append(k)
            self.sentences.append(own)
            least = min(bounds, default=0.0)
            if bounds:
                least = max(least, 1e-9) * (1 - 1e-9)
                for p, w in weight.items():
                    self.postings.setdefault(p, []).append((k, w / least))
        self.blocks = {}
        for p, posting in self.postings.items():
            tops: dict[int, float] = {}
            for k, w in posting:
                tops[k // block] = max(tops.get(k // block, 0.0), w)
            self.blocks[p] = (tops, max(tops.values()))
        #: passages overlap by the longest thing that may count
        self.overlap = longest + 2
        self.window = 3 * self.overlap

    def retrieve(self, terms: list[tuple[int, int]]) -> list[int]:
        """Block-max WAND: all items whose score over `terms`, in units of their threshold, is at least 1."""
        lists = [[posting[0][0], 0, *self.blocks[t], posting] for t in terms for posting in (self.postings[t],)]
        if sum(x[3] for x in lists) < 1:
            return []
        out, size, current = [], self.block, itemgetter(0)
        lists.sort(key=current)
        while lists:
            bound, pivot = 0.0, -1
            for j, x in enumerate(lists):
                bound += x[3]
                if bound >= 1:
                    pivot = j
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            near, bound = item // size, 0.0
            for j in range(pivot + 1):
                bound += lists[j][2].get(near, 0.0)
                if bound >= 1:
                    break
            if bound >= 1:
                if lists[0][0] == item:
                    if sum(x[4][x[1]][1] for x in lists[: pivot + 1]) >= 1:
                        out.append(item)
                    goal = item + 1
                else:
                    goal = item
            else:
                # no item of this block can score enough with these lists: skip to the next block or list
                goal = (near + 1) * size
                if pivot + 1 < len(lists):
                    goal = min(goal, lists[pivot + 1][0])
                goal = max(goal, item + 1)
            over = False
            for x in lists[: pivot + 1]:
                if x[0] < goal:
                    posting, k = x[4], x[1] + 1
                    if k < len(posting) and posting[k][0] < goal:
                        k = bisect_left(posting, (goal,), k)
                    if k < len(posting):
                        x[0], x[1] = posting[k][0], k
                    else:
                        x[0], over = -1, True
            if over:
                lists = [x for x in lists if x[0] >= 0]
            lists.sort(key=current)
        return out

    def probe_words(self) -> list[str]:
        names = list(self.vocabulary)
        return sorted(f"{names[a]} {names[b]}" for a, b in self.probes)

    def overlaps(self, ws: list[str], item: int) -> tuple[float | None, float | None]:
        """Shares of the word pairs of an item's passage and of its question that a text of words `ws` holds; None if there is
        no such part."""
        ids = [self.vocabulary.get(w, -1) for w in ws]
        held = set(zip(ids, ids[1:]))
        return tuple(len(side & held) / len(side) if side else None for side in self.sides[item])

    def leaks(self, text: str | list[str] | None) -> set[int]:
        """Positions of the items that `text`, or its words, gives away."""
        found: set[int] = set()
        get = self.vocabulary.get
        ids = [get(w, -1) for w in (words(text) if isinstance(text, str) else text)] if text else []
        n = len(ids)
        if n < 2:
            return found
        postings = self.postings
        hits = [p if p in postings else None for p in zip(ids, ids[1:])]
        at = [i for i, p in enumerate(hits) if p is not None]
        least, overlap = self.least, self.overlap
        close = [k for k in range(len(at) - least + 1) if at[k + least - 1] - at[k] <= overlap]
        j = 0
        while j < len(close):
            # a stretch of places that stand close enough for a leak: a leak's word pairs all lie in one
            first, last = close[j], close[j] + least - 1
            while j < len(close) and close[j] <= last:
                last = close[j] + least - 1
                j += 1
            lo, stop = at[first], at[last] + 1
            while True:
                hi = min(stop, lo + self.window)
                terms = set(hits[lo:hi])
                terms.discard(None)
                cands = [k for k in self.retrieve(list(terms)) if k not in found] if len(terms) >= least else []
                if cands:
                    a, b = max(0, lo - overlap), min(n, hi + 1 + overlap)
                    self._verify(ids[a:b], hits[a : b - 1], terms, cands, found)
                if hi == stop:
                    break
                lo = hi - overlap
        return found

    def _verify(self, ids: list[int], part: list, terms: set, cands: list[int], found: set[int]) -> None:
        left = set(cands)
        for r in {self.run[k] for k in cands}:
            streak = 0
            for i, p in enumerate(part):
                streak = streak + 1 if p is not None else 0
                if streak >= r - 1:
                    hit = left.intersection(self.runs.get(tuple(ids[i + 2 - r : i + 2]), ()))
                    found |= hit
                    left -= hit
        places: dict[tuple, list[int]] = {}
        for i, p in enumerate(part):
            if p is not None:
                places.setdefault(p, []).append(i)
        for k in left:
            for s, distinct, e, masks in self.sentences[k]:
                need = len(distinct) - 2 * e
                both = distinct & terms
                if len(both) >= need and within(len(s), masks, ids, sorted(i for p in both for i in places[p]), need, e):
                    found.add(k)
                    break


def within(m: int, masks: dict[int, int], ids: list[int], at: list[int], need: int, limit: int) -> bool:
    """Is a sentence of `m` words somewhere in `ids` with at most `limit` words changed, dropped or added?

    `masks`: word -> bits of its places in the sentence; `at`: where `ids` has one of the sentence's word pairs. At least
    `need` of these must lie within the length of a match; around such places the bit-parallel distance is run, which takes
    one step per word of text whatever the sentence's length.
    """
    need = max(1, need)
    close = [k for k in range(len(at) - need + 1) if at[k + need - 1] - at[k] <= m + limit]
    if not close:
        return False
    lo, hi = max(0, at[close[0]] - m - limit), min(len(ids), at[close[-1] + need - 1] + 2 + m + limit)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    get = masks.get
    for x in ids[lo:hi]:
        eq = get(x, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score <= limit:
                return True
        ph <<= 1
        plus = ((mh << 1) | ~(xv | ph)) & full
        minus = ph & xv & full
    return False


_LOADED: dict[str, ItemIndex] = {}


def _load(key: str, held: bytes) -> ItemIndex:
    """The index of one search, unpacked once per process."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = pickle.loads(held)  # noqa: S301 - written by this search
    return _LOADED[key]


def _stock(own: DataFrame, i_type: str) -> DataFrame:
    """(i, common): per item the keys of those of its sentences that other items have too, counted over all items."""

    def sentence_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, k = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = _LONG.sub(" ", text)
                keys = {sentence_key(words(text[a:e])) for a, e in sentence_spans(text)}
                i += [item] * len(keys)
                k += keys
            yield pa.RecordBatch.from_arrays([pa.array(i, batch.column(0).type), pa.array(k, pa.int64())], names=["i", "k"])

    keyed = own.mapInArrow(sentence_keys, f"i {i_type}, k long")
    many = keyed.groupBy("k").agg(F.count_distinct("i").alias("n")).where("n > 1").select("k")
    return join_hot(keyed, many, ["k"], by=("i",)).groupBy("i").agg(F.collect_set("k").alias("common"))


def _build(own: DataFrame, blocks: int, i_type: str, index: dict) -> DataFrame:
    """(block, held, probes): the indexes of all blocks, built side by side."""
    rows = own.join(_stock(own, i_type), "i", "left").withColumn("block", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"))

    def build(part: pa.Table) -> pa.Table:
        got = sorted(zip(*(part.column(c).to_pylist() for c in ("i", "t", "common")), strict=True), key=lambda r: (r[0], r[1]))
        at = ItemIndex([(i, t) for i, t, _ in got], shared={k for _, _, ks in got for k in ks or ()}, **index)
        return pa.table({"block": pa.array([part.column("block")[0].as_py()], pa.int32()), "held": pa.array([pickle.dumps(at, protocol=5)], pa.binary()), "probes": pa.array([at.probe_words()], pa.list_(pa.string()))})

    return rows.select("block", "i", "t", "common").groupBy("block").applyInArrow(build, "block int, held binary, probes array<string>")


def _search(docs: DataFrame, items: DataFrame, doc_id: str, text_col: str, item_id: str, item_text: str, block_bytes: int, index: dict, shares: bool) -> DataFrame:
    """(d, i[, passage, question]) of every document and the items it gives away."""
    spark = docs.sparkSession
    d_type, i_type = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    own = items.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull()).distinct()
    total = own.agg(F.sum(F.octet_length("t")).alias("n")).first().n or 0
    blocks = max(1, math.ceil(total / block_bytes))
    built = cut(_build(own, blocks, i_type, index))
    rows = spread(docs.select(F.col(doc_id).alias("d"), F.col(text_col).alias("t")))
    schema = f"d {d_type}, i {i_type}" + (", passage double, question double" if shares else "")
    names = [c.split()[0] for c in schema.split(", ")]
    key = f"{spark.sparkContext.applicationId}-{next(_COUNT)}"

    def found(at: ItemIndex, ids: list, texts: list, d_kind: pa.DataType, i_kind: pa.DataType) -> list[pa.Array]:
        out: list[tuple] = []
        for doc, ws in zip(ids, texts, strict=True):
            for k in sorted(at.leaks(ws)):
                out.append((doc, at.ids[k], *(at.overlaps(ws, k) if shares else ())))
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        return [pa.array(c, t) for c, t in zip(cols, (d_kind, i_kind, pa.float64(), pa.float64()))]

    d_kind, i_kind = to_arrow_type(docs.schema[doc_id].dataType), to_arrow_type(items.schema[item_id].dataType)
    if blocks == 1:
        held = [r.held for r in built.select("held").collect()]  # one row, bounded by `block_bytes` of items
        if not held:
            return spark.createDataFrame([], schema)
        shared = spark.sparkContext.broadcast(held[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = _load(key, shared.value)
                texts = [words(t) if (t := x.as_py()) else [] for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays(found(at, batch.column(0).to_pylist(), texts, d_kind, i_kind), names=names)

        return rows.mapInArrow(run, schema).distinct()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(words(t)) if (t := x.as_py()) else "" for x in batch.column(1)], pa.string())], names=["d", "ws"])

    # more items than one process should hold: each document, read and cut into words once, visits the blocks of which it holds a probe
    read = cut(rows.mapInArrow(tokens, f"d {d_type}, ws string").withColumn("row", F.monotonically_increasing_id()))
    ws = F.split("ws", " ")
    pairs = F.array_distinct(F.zip_with(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, F.lit(" "), b)))
    probes = cut(built.select("block", F.explode("probes").alias("p")).select("block", F.split("p", " ").alias("p")).select("block", F.xxhash64(F.col("p")[0], F.lit(" "), F.col("p")[1]).alias("h")))
    visits = join_hot(read.select("row", F.explode(pairs).alias("h")), probes, ["h"], by=("row",)).select("row", "block").distinct()
    size = read.agg(F.sum(F.octet_length("ws")).alias("n")).first().n or 0
    parts = max(1, math.ceil(size / (32 * 1024 * 1024)))
    sent = read.join(visits, "row").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    indexes = built.select("block", "held", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table(found(None, [], [], d_kind, i_kind), names=names)
        at = _load(f"{key}-{right.column('block')[0].as_py()}", right.column("held")[0].as_py())
        return pa.table(found(at, left.column("d").to_pylist(), [w.split(" ") for w in left.column("ws").to_pylist()], d_kind, i_kind), names=names)

    cols = sent.select("block", "part", "d", "ws").groupBy("block", "part").cogroup(indexes.groupBy("block", "part"))
    return cols.applyInArrow(both, schema).distinct()


_COUNT = itertools.count()


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4 * 1024 * 1024, **index: float) -> DataFrame:
    """(doc_id, item_id) of every document that holds a passage of an item.

    Documents are read and cut into words once. Items of up to `block_bytes` of text are one index that every process holds; more
    are indexed in blocks, and a document goes only to the blocks of which it holds a word pair that no leak of theirs can
    lack. Null and empty texts leak nothing; documents sent twice are reported under each of their ids; repeated rows of one id
    give one row. `index`: parameters of `ItemIndex`; `stock=True` also reports short sentences that several items share.
    """
    out = _search(docs, items, doc_id, text_col, item_id, item_text, block_bytes, index, False)
    return out.select(F.col("d").alias(doc_id), F.col("i").alias(item_id))


def leak_overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4 * 1024 * 1024, **index: float) -> DataFrame:
    """(doc_id, item_id, passage_share, question_share): `find_leaks` with what share of the word pairs of the item's passage and of
    its question, the last sentence if that asks, the document holds. Null where an item has no such part; of repeated rows of
    one id the highest shares."""
    out = _search(docs, items, doc_id, text_col, item_id, item_text, block_bytes, index, True)
    return out.groupBy(F.col("d").alias(doc_id), F.col("i").alias(item_id)).agg(F.max("passage").alias("passage_share"), F.max("question").alias("question_share"))
