"""Filling windows of fixed capacity with documents measured in tokens (problem 8).

The plan is made over the length histogram, not over documents: best-fit decreasing on counts, with equal windows kept
as one run. Documents then take the planned slots by their rank within their length. The histogram has at most
``capacity`` rows and the plan at most ``capacity`` open runs at a time, whatever the number of documents, so both live
on the driver by a proven bound; documents never do.

Defined cases: a document longer than the capacity is cut into full windows and one remainder, nothing else is cut; null
and empty texts have no tokens and stand in window 1 at no cost; repeated rows of a document count once; an empty table
gives an empty result. Ties among documents of one length go by the document key.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import written

#: Rows of a block in which the rows of one length are ranked, so that a hot length is not one task.
BLOCK_ROWS = 200_000


def plan(histogram: dict[int, int], capacity: int) -> tuple[dict[int, np.ndarray], int]:
    """Best-fit decreasing over counts.

    Returns for each length its runs (first rank, first window, documents per window) in rank order, and the number of
    windows. Open windows are runs of consecutive numbers by free space; only the number of runs matters for time.
    """
    spaces: list[int] = []  # free spaces that have open windows, ascending
    open_runs: dict[int, list[tuple[int, int]]] = {}  # free space -> [(first window, count)]
    slots: dict[int, list[tuple[int, int, int]]] = {}
    windows = 0

    def give(space: int, first: int, count: int) -> None:
        if count and space:
            if space not in open_runs:
                open_runs[space] = []
                insort(spaces, space)
            open_runs[space].append((first, count))

    for length in sorted((x for x in histogram if 0 < x <= capacity), reverse=True):
        left, rank, mine = histogram[length], 0, []
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, count = open_runs[space].pop()
                if not open_runs[space]:
                    del open_runs[space], spaces[at]
            else:
                space, first, count = capacity, windows + 1, -(-left // (capacity // length))
                windows += count
            each = space // length
            full = min(count, left // each)
            if full:
                mine.append((rank, first, each))
                give(space - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count:
                if 0 < left:  # the last documents share one window
                    mine.append((rank, first + full, each))
                    give(space - left * length, first + full, 1)
                    full, rank, left = full + 1, rank + left, 0
                give(space, first + full, count - full)
        slots[length] = mine
    return {k: np.array(v, np.int64).reshape(-1, 3) for k, v in slots.items()}, windows


def _place(capacity: int, slots: dict[int, np.ndarray], packed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.ones(len(pdf), np.int64)
            rest, rank = pdf["rest"].to_numpy(), pdf["rank"].to_numpy()
            for length, at in pdf.groupby("rest").indices.items():
                if length:
                    runs = slots[int(length)]
                    k = np.searchsorted(runs[:, 0], rank[at], "right") - 1
                    out[at] = runs[k, 1] + (rank[at] - runs[k, 0]) // runs[k, 2]
            yield pdf[["key", "n_tokens"]].assign(window_no=out, rest=rest, rank=rank)

    return run


def ranked(sizes: DataFrame, key: str, by: str, blocks: int) -> DataFrame:
    """``rank`` of each row among the rows of equal ``by``, from 0, in ``blocks`` blocks: a row's rank in its block plus the
    rows of the blocks before it. No task holds all rows of a hot value."""
    rows = sizes.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    before = W.partitionBy(by).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    start = rows.groupBy(by, "block").agg(F.count("*").alias("n")).select(by, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = F.row_number().over(W.partitionBy(by, "block").orderBy(key)) - 1
    return rows.withColumn("inner", inner).join(start, [by, "block"]).withColumn("rank", F.col("inner") + F.col("start")).drop("inner", "start", "block")


def pack(sizes: DataFrame, capacities: dict[int, int], key: str = "doc_id") -> DataFrame:
    """(window_id, key, piece_no, first_token, n_tokens, window_no) for each window_id -> capacity of ``capacities``.

    ``sizes`` has key and n_tokens. Runs one job that counts lengths; the rows' ranks are computed once for each capacity.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a capacity must be 1 token at least")
    kind = sizes.schema[key].dataType.simpleString()
    rows = written(sizes.select(F.col(key).alias("key"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).distinct(), "sizes")
    blocks = rows.count() // BLOCK_ROWS + 8
    parts = []
    for window_id, capacity in sorted(capacities.items()):
        rest = rows.withColumn("rest", F.col("n_tokens") % capacity).withColumn("rest", F.when((F.col("rest") == 0) & (F.col("n_tokens") > 0), capacity).otherwise(F.col("rest")))
        # whole windows come before the packed ones' numbers are known, so they are numbered behind them by their own rank
        counted = rest.groupBy("rest").agg(F.count("*").alias("n")).collect()  # at most capacity + 1 rows
        slots, packed = plan({r["rest"]: r["n"] for r in counted}, capacity)
        packed = max(packed, 1)
        placed = ranked(rest, "key", "rest", blocks).mapInPandas(_place(capacity, slots, packed), f"key {kind}, n_tokens int, window_no bigint, rest int, rank bigint")
        last = F.floor((F.col("n_tokens") - F.col("rest")) / capacity).cast("int")
        one = placed.select(F.lit(window_id).alias("window_id"), F.col("key").alias(key), (last + 1).alias("piece_no"), (last * capacity).alias("first_token"), F.col("rest").alias("n_tokens"), F.col("window_no").cast("bigint").alias("window_no"))
        long = rest.where(F.col("n_tokens") > capacity).withColumn("full", F.floor((F.col("n_tokens") - F.col("rest")) / capacity).cast("int"))
        block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
        long = long.withColumn("block", block)
        start = long.groupBy("block").agg(F.sum("full").alias("n")).select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # as many rows as blocks
        own = F.sum("full").over(W.partitionBy("block").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("full")
        cut = long.withColumn("own", own).join(F.broadcast(start), "block").select("*", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("piece_no"))
        whole = cut.select(F.lit(window_id).alias("window_id"), F.col("key").alias(key), "piece_no", ((F.col("piece_no") - 1) * capacity).alias("first_token"), F.lit(capacity).alias("n_tokens"), (F.col("start") + F.col("own") + F.col("piece_no") + packed).cast("bigint").alias("window_no"))
        parts += [one, whole]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
