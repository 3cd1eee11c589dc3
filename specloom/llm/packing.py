"""Filling containers of fixed capacity with items of varying length by minimum bin slack.

Only lengths matter for the fill, so the plan is made on the histogram of lengths, which has at most as many entries as the
capacity whatever the number of texts. The longest item left opens a container; a bitset subset-sum over the lengths left
finds the fullest combination for the rest; the same combination is repeated for as many containers as the counts allow.
The items are then ranked within their length and dealt to the planned places without gathering any group in one task.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.session import cut, spread

#: ranks of the tokenizer and the pattern that splits a text before them; SPECLOOM_TOKENIZER and SPECLOOM_TOKEN_PATTERN name others
TOKENIZER = os.environ.get("SPECLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
TOKEN_PATTERN = os.environ.get("SPECLOOM_TOKEN_PATTERN", "")
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of one ranks file, once per process."""
    if path not in _ENCODERS:
        import tiktoken

        pattern = TOKEN_PATTERN
        if not pattern:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of whole texts; null and empty texts have 0."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if (t := x.as_py()) else 0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))).mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of lengths (descending) that comes nearest to `room` from below, by bitset subset-sum. Stops as soon
    as the room can be filled exactly."""
    if room <= 0:
        return {}
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, trail = 1, []
    for size in lengths:
        if size > room:
            continue
        many = min(counts[size], room // size)
        take = 1
        while many > 0:
            k = min(take, many)
            nxt = reach | ((reach << (size * k)) & mask)
            if nxt != reach:
                trail.append((reach, size, k))
                reach = nxt
            many -= k
            take *= 2
        if reach & goal:
            break
    left = reach.bit_length() - 1
    out: dict[int, int] = {}
    for before, size, k in reversed(trail):
        if not (before >> left) & 1:
            out[size] = out.get(size, 0) + k
            left -= size * k
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(containers, {length: items per container})] that hold all items of the histogram (lengths 1..capacity)."""
    counts = {s: c for s, c in histogram.items() if c > 0 and 0 < s <= capacity}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        combo = fullest(lengths if counts[first] else lengths[1:], counts, capacity - first)
        counts[first] += 1
        combo[first] = combo.get(first, 0) + 1
        times = min(counts[s] // k for s, k in combo.items())
        out.append((times, combo))
        for s, k in combo.items():
            counts[s] -= k * times
        if any(counts[s] == 0 for s in combo):
            lengths = [s for s in lengths if counts[s]]
    return out


def _places(plans: dict[int, list[tuple[int, dict[int, int]]]]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pack, length) -> (first rank, items per container, first container) of each stretch of ranks."""
    rows: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for pack, combos in plans.items():
        base, used = 1, {}
        for times, combo in combos:
            for size, k in combo.items():
                rows.setdefault((pack, size), []).append((used.get(size, 0), k, base))
                used[size] = used.get(size, 0) + k * times
            base += times
    return {key: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for key, r in rows.items()}


def pack(sizes: DataFrame, capacities: DataFrame, id_col: str = "doc_id", per_salt: int = 100_000) -> DataFrame:
    """(pack_id, id, piece_no, start_token, n_tokens, container_no) for every text and capacity.

    `sizes`: (id, n_tokens). A text that fits is one piece, never split; a longer one is cut into full containers and one
    rest. Texts without tokens take no room and are put into container 1. Container numbers count from 1 per capacity. Pieces of
    one length are ranked in parts of about `per_salt`, as many as there need to be.
    """
    packs = capacities.select(F.col("pack_id").cast("long").alias("pack_id"), F.col("capacity_tokens").cast("long").alias("cap")).where("cap > 0").distinct()
    room = {r.pack_id: r.cap for r in packs.limit(1001).collect()}
    if len(room) > 1000:
        raise ValueError("more than 1,000 capacities")
    spark = sizes.sparkSession
    packs = spark.createDataFrame(pd.DataFrame(list(room.items()), columns=["pack_id", "cap"]), "pack_id long, cap long")
    whole = sizes.select(F.col(id_col).alias("id"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")).alias("n"))
    each = F.when(F.col("n") <= F.col("cap"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("cap")) - 1))
    pieces = whole.join(F.broadcast(packs), F.lit(True)).select("pack_id", "cap", "id", "n", F.explode(each).alias("piece_no"))
    pieces = pieces.select("pack_id", "id", "piece_no", (F.col("piece_no") * F.col("cap")).alias("start_token"), F.least(F.col("n") - F.col("piece_no") * F.col("cap"), "cap").alias("n_tokens"))
    # at most sum(capacity) rows: one per capacity and length
    hist: dict[int, dict[int, int]] = {p: {} for p in room}
    for r in pieces.groupBy("pack_id", "n_tokens").agg(F.count("*").alias("c")).collect():
        hist[r.pack_id][r.n_tokens] = r.c
    salts = max(1, -(-max((c for h in hist.values() for c in h.values()), default=1) // per_salt))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece_no"), F.lit(salts)))
    tally = cut(pieces.groupBy("pack_id", "n_tokens", "salt").agg(F.count("*").alias("c")))
    hist = {p: {n: c for n, c in h.items() if n > 0} for p, h in hist.items()}
    places = spark.sparkContext.broadcast(_places({p: plan(h, room[p]) for p, h in hist.items()}))
    over = Window.partitionBy("pack_id", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = tally.withColumn("before", F.coalesce(F.sum("c").over(over), F.lit(0).cast("long"))).drop("c")
    in_salt = Window.partitionBy("pack_id", "n_tokens", "salt").orderBy("id", "piece_no")
    ranked = pieces.withColumn("r", F.row_number().over(in_salt)).join(starts, ["pack_id", "n_tokens", "salt"])
    ranked = ranked.select("pack_id", "id", "piece_no", "start_token", "n_tokens", (F.col("before") + F.col("r") - 1).alias("rank"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places.value
        for batch in batches:
            pk, size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("pack_id", "n_tokens", "rank"))
            bins = np.ones(len(pk), dtype=np.int64)
            order = np.lexsort((size, pk))
            key = np.stack([pk[order], size[order]])
            edges = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1 if len(pk) else np.array([], dtype=np.int64)
            for rows in np.split(order, edges):
                if len(rows) and (got := at.get((int(pk[rows[0]]), int(size[rows[0]])))) is not None:
                    first, per, base = got
                    s = np.searchsorted(first, rank[rows], side="right") - 1
                    bins[rows] = base[s] + (rank[rows] - first[s]) // per[s]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("pack_id", "id", "piece_no", "start_token", "n_tokens")), pa.array(bins)], names=["pack_id", "id", "piece_no", "start_token", "n_tokens", "container_no"])

    kind = sizes.schema[id_col].dataType.simpleString()
    out = ranked.mapInArrow(deal, f"pack_id long, id {kind}, piece_no long, start_token long, n_tokens long, container_no long")
    return out.withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, capacities: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """`pack` of whole texts, measured once with the tokenizer at `tokenizer`."""
    return pack(cut(count_tokens(docs, id_col, text_col, tokenizer)), capacities, id_col)
