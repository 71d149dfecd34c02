"""Cosines of sparse unit vectors in blocks: a pair of blocks is worked in one task, and only the pairs that are asked for leave it.

``pairs_above`` meets two vectors by terms they share. If their rarest shared term is ``t``, their cosine is at most the product
of what is left of either from ``t`` on, in order of rarity; only pairs that this bound lets pass are multiplied. ``best_pairs``
is for thresholds that most pairs pass: frequent terms are multiplied as dense matrices, the others by their postings. Both are
exact; neither writes candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import ship_code, written

_ROWS, _CELLS, _DENSE = 2_000_000, 4_000_000, 1024


class Block(NamedTuple):
    """Vectors one after the other: ``ends`` has where each begins and ends; terms are in order of rarity."""

    nodes: np.ndarray
    ends: np.ndarray
    term: np.ndarray
    w: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.nodes)), np.diff(self.ends))


def tails(b: Block) -> np.ndarray:
    """The length of each vector from each of its terms on."""
    before = np.concatenate([[0.0], np.cumsum(b.w * b.w)])
    return np.sqrt(np.maximum(before[b.ends[1:]][b.owner()] - before[:-1], 0.0))


def _shared(x: Block, y: Block) -> tuple[Block, Block, int]:
    """Both with the terms that both have, numbered from 0."""
    names = np.intersect1d(x.term, y.term)

    def some(b: Block) -> Block:
        at = np.minimum(np.searchsorted(names, b.term), max(len(names) - 1, 0))
        ok = names[at] == b.term if len(names) else np.zeros(len(b.term), bool)
        return Block(b.nodes, np.concatenate([[0], np.cumsum(ok)])[b.ends], at[ok], b.w[ok])

    return some(x), some(y), len(names)


def runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def above(x: Block, y: Block, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of the pairs from ``threshold`` on; of one block with itself i < j."""
    slack = threshold * (1 - 1e-6)
    tx, ty, ox = tails(x), tails(y), x.owner()
    rare = np.flatnonzero(ty >= slack)
    rare = rare[np.lexsort((-ty[rare], y.term[rare]))]
    terms, post = y.term[rare], y.owner()[rare]
    asks = np.flatnonzero(tx >= slack)
    start = np.searchsorted(terms, x.term[asks])
    names, at = np.unique(terms, return_inverse=True)
    where = np.minimum(np.searchsorted(names, x.term[asks]), max(len(names) - 1, 0))
    met = names[where] == x.term[asks] if len(names) else np.zeros(len(asks), bool)
    order = at * 4.0 - ty[rare]  # ascends: within a term the longest tails come first
    stop = np.searchsorted(order, where * 4.0 - slack / np.maximum(tx[asks], 1e-300) + 1e-6, "right")
    count = np.where(met, np.maximum(stop - start, 0), 0)
    asks, start, count = asks[count > 0], start[count > 0], count[count > 0]
    sx, sy, size = _shared(x, y)
    if not len(asks):
        return
    per_row = np.bincount(ox[asks], count, len(x.nodes)).astype(np.int64)
    first, ends = np.searchsorted(ox[asks], np.arange(len(x.nodes) + 1)), np.cumsum(per_row)
    some, a, width = max(1, min(1024, _CELLS // max(size, 1))), 0, np.diff(sy.ends)
    dense = np.zeros(some * size)
    while a < len(x.nodes):
        b = min(a + some, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _ROWS, "right"))))
        part = slice(first[a], first[b])
        i, j = np.repeat(ox[asks[part]], count[part]), post[runs(start[part], count[part])]
        one = np.unique((i * len(y.nodes) + j)[i < j] if same else i * len(y.nodes) + j)
        i, j = one // len(y.nodes), one % len(y.nodes)
        entries = slice(sx.ends[a], sx.ends[b])
        filled = np.repeat(np.arange(b - a), np.diff(sx.ends[a : b + 1])) * size + sx.term[entries]
        dense[filled] = sx.w[entries]
        for lo in range(0, len(i), _ROWS // 16):
            p, q = i[lo : lo + _ROWS // 16], j[lo : lo + _ROWS // 16]
            of, n = runs(sy.ends[q], width[q]), width[q]
            dot = np.bincount(np.repeat(np.arange(len(p)), n), dense[np.repeat((p - a) * size, n) + sy.term[of]] * sy.w[of], len(p))
            ok = dot >= threshold
            yield p[ok], q[ok], dot[ok]
        dense[filled] = 0.0
        a = b


def best(x: Block, y: Block, threshold: float, k: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine rounded to 9 digits) of the ``k`` best of y for each of x, from ``threshold`` on; ties by the greater node."""
    sx, sy, size = _shared(x, y)
    ny = len(y.nodes)
    place = np.empty(ny, np.int64)
    place[np.argsort(y.nodes, kind="stable")[::-1]] = np.arange(ny)  # the greater node first
    df = np.bincount(sy.term, minlength=size)
    often = np.sort(np.argsort(-df, kind="stable")[:_DENSE])
    often = often[df[often] * 100 > ny]
    number = np.full(size, -1)
    number[often] = np.arange(len(often))
    oy = sy.owner()
    hot = number[sy.term] >= 0
    head = np.zeros((len(often), ny))
    head[number[sy.term[hot]], place[oy[hot]]] = sy.w[hot]
    cold = np.flatnonzero(~hot)
    cold = cold[np.argsort(sy.term[cold], kind="stable")]
    post, weight = place[oy[cold]], sy.w[cold]
    first = np.searchsorted(sy.term[cold], np.arange(size + 1))
    back = np.argsort(place)
    some = max(1, min(1024, _ROWS // max(ny, 1)))
    for a in range(0, len(x.nodes), some):
        b = min(a + some, len(x.nodes))
        part = slice(sx.ends[a], sx.ends[b])
        row, term, w = np.repeat(np.arange(b - a), np.diff(sx.ends[a : b + 1])), sx.term[part], sx.w[part]
        dense = np.zeros((b - a, len(often)))
        frequent = number[term] >= 0
        dense[row[frequent], number[term[frequent]]] = w[frequent]
        s = dense @ head
        row, term, w = row[~frequent], term[~frequent], w[~frequent]
        count = first[term + 1] - first[term]
        sums = np.cumsum(count)
        lo = 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + _ROWS, "right")))
            at, n = runs(first[term[lo:hi]], count[lo:hi]), count[lo:hi]
            s.ravel()[:] += np.bincount(np.repeat(row[lo:hi] * ny, n) + post[at], np.repeat(w[lo:hi], n) * weight[at], s.size)
            lo = hi
        if same:
            s[np.arange(b - a), place[a:b]] = -1.0
        least = np.full(b - a, threshold)
        if ny > k:
            least = np.maximum(least, np.partition(s, ny - k, axis=1)[:, ny - k] - 2e-9)
        i, j = np.nonzero(s >= least[:, None])
        v = np.round(s[i, j], 9)
        o = np.lexsort((j, -v, i))
        i, j, v = i[o], j[o], v[o]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        yield i[keep] + a, back[j[keep]], v[keep]


def _read(block: pa.StructArray) -> Block:
    nodes, terms, ws = (block.field(n) for n in ("node", "terms", "ws"))
    names = np.empty(len(nodes), object) if pa.types.is_string(nodes.type) or pa.types.is_large_string(nodes.type) else np.empty(len(nodes), np.int64)
    names[:] = nodes.to_pylist()
    return Block(names, np.concatenate([[0], np.cumsum(np.diff(terms.offsets.to_numpy()))]), terms.flatten().to_numpy(zero_copy_only=False), ws.flatten().to_numpy(zero_copy_only=False))


def _numbered(vectors: DataFrame) -> DataFrame:
    """(node, terms, ws): each vector in one row, its terms as numbers, the rarest first. A term of one vector is left out, as it
    can't be shared. Terms are numbered by a hash without collisions, which is checked, so that they needn't be joined."""
    entries = F.array_sort(F.collect_list(F.struct("df", "term", "w")))
    whole = written(vectors.where("df > 1").groupBy("node").agg(entries.alias("v")), "vectors")
    number = lambda t, seed: F.xxhash64(t, F.lit(seed))
    terms, seed = whole.select(F.explode("v.term").alias("t")).distinct(), 0
    while terms.select(number("t", seed).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        seed += 1
    return whole.select("node", F.transform("v", lambda e: number(e["term"], seed)).alias("terms"), F.col("v.w").alias("ws"))


def _in_blocks(vectors: DataFrame, rows: int, work: Callable[[Block, Block, bool], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> DataFrame:
    """(src, dst, weight): what ``work`` finds for each pair of blocks of about ``rows`` of the vectors (node, term, w, df)."""
    ship_code(vectors.sparkSession)
    kind = vectors.schema["node"].dataType.simpleString()
    whole = _numbered(vectors)
    n = max(1, -(-whole.count() // rows))
    placed = whole.withColumn("b", F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    p, q, vector = F.least("b", "o"), F.greatest("b", "o"), F.struct("node", "terms", "ws")
    side = lambda first: F.collect_list(F.when((F.col("b") <= F.col("o")) if first else (F.col("b") > F.col("o")), vector))
    cells = placed.groupBy(p.alias("p"), q.alias("q")).agg(side(True).alias("x"), side(False).alias("y")).select((F.col("p") == F.col("q")).alias("same"), "x", "y")
    held = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind]
    schema = pa.schema([("src", held), ("dst", held), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, xs, ys in zip(batch.column("same").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                x = _read(xs.values)
                for src, dst, weight in work(x, x if same else _read(ys.values), same):
                    if len(src):
                        yield pa.RecordBatch.from_arrays([pa.array(src, held), pa.array(dst, held), pa.array(weight)], schema=schema)

    return cells.mapInArrow(run, f"src {kind}, dst {kind}, weight double")


def pairs_above(vectors: DataFrame, threshold: float, rows: int = 100_000) -> DataFrame:
    """(src, dst, weight), src < dst: all pairs of unit vectors (node, term, w, df) with a cosine from ``threshold`` on."""

    def work(x: Block, y: Block, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i, j, v in above(x, y, threshold, same):
            a, b = x.nodes[i], y.nodes[j]
            less = (a < b).astype(bool)
            yield np.where(less, a, b), np.where(less, b, a), v

    return _in_blocks(vectors, rows, work)


def best_pairs(vectors: DataFrame, threshold: float, k: int, rows: int = 8192) -> DataFrame:
    """(src, dst, weight), src < dst: pairs with a cosine, rounded to 9 digits, from ``threshold`` on that is among the ``k`` best
    of either; ties by the greater partner. It is ``topk_symmetric`` of ``pairs_above``."""

    def work(x: Block, y: Block, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a, b in ((x, y),) if same else ((x, y), (y, x)):
            for i, j, v in best(a, b, threshold, k, same):
                yield a.nodes[i], b.nodes[j], v

    w = W.partitionBy("src").orderBy(F.desc("weight"), F.desc("dst"))
    kept = _in_blocks(vectors, rows, work).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return kept.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("weight")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
