"""Similarity layers: pairs above a threshold and the symmetric union of each node's top k.

Pairs with no common element have similarity 0, so for a threshold above 0 an inverted index is exact; thresholds must be
positive. Frequent elements do not make the join quadratic: a prefix filter keeps, of each set, only its rarest elements,
as many as any pair above the threshold must meet in; the overlap of the candidates is then counted on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import ship_code, written
from . import cosine
from .cosine import pairs_above


def _positive(threshold: float) -> None:
    if not threshold > 0:
        raise ValueError("the threshold must be above 0")


def _sets(members: DataFrame, node: str, item: str) -> DataFrame:
    """(node, items): each node's distinct items, the rarest first."""
    rows = members.select(F.col(node).alias("node"), F.col(item).alias("item")).where("node is not null and item is not null").distinct()
    rated = rows.join(rows.groupBy("item").agg(F.count("*").alias("df")), "item")
    sets = rated.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("items"))
    return sets.withColumn("items", F.transform("items", lambda x: x["item"]))


def set_classes(members: DataFrame, node: str, item: str) -> DataFrame:
    """(node, representative): nodes of equal sets have the least of them as their representative."""
    sets = _sets(members, node, item)
    return sets.join(sets.groupBy("items").agg(F.min("node").alias("representative")), "items").select("node", "representative")


def set_pairs(members: DataFrame, node: str, item: str, measure: str, threshold: float, min_shared: int = 1, plan: str | None = None) -> DataFrame:
    """(src, dst, shared, weight), src < dst, for sets given as rows (node, item).

    Of nodes with equal sets only the least takes part; ``set_classes`` has the others and ``expand_pairs`` gives the pairs of
    all nodes. Copies so never make pairs of all with all here.
    ``measure``: ``jaccard`` (shared over union) or ``coupling`` (shared over the geometric mean of the sizes).
    Two exact plans: ``prefix`` joins the rarest items and counts the overlap of the candidates on the whole sets, ``count``
    joins all items and counts the rows. Without ``plan`` one job compares the rows that either would join.
    """
    _positive(threshold)
    sets = written(_sets(members, node, item).groupBy("items").agg(F.min("node").alias("node")), "sets")
    n = F.size("items")
    share = threshold if measure == "jaccard" else threshold * threshold
    least = F.greatest(F.lit(min_shared), F.ceil(n * share - 1e-9).cast("int"), F.lit(1))  # any partner shares so many
    sized = sets.where(n >= min_shared).select("node", n.alias("n"), "items", F.explode(F.slice("items", 1, n - least + 1)).alias("key"))
    every = sets.where(n >= min_shared).select("node", n.alias("n"), F.explode("items").alias("key"))
    if plan is None:
        cost = lambda df: df.groupBy("key").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0
        plan = "prefix" if 3 * cost(sized) < cost(every) else "count"
    source = sized if plan == "prefix" else every
    a = source.select("key", F.col("node").alias("src"), F.col("n").alias("n1"))
    b = source.select("key", F.col("node").alias("dst"), F.col("n").alias("n2"))
    low, high = F.least("n1", "n2"), F.greatest("n1", "n2")
    sizes_fit = low >= high * share - 1e-9
    met = a.join(b, "key").where("src < dst").where(sizes_fit)
    if plan == "prefix":
        pairs = met.select("src", "dst", "n1", "n2").distinct()
        left = sets.select(F.col("node").alias("src"), F.col("items").alias("x"))
        right = sets.select(F.col("node").alias("dst"), F.col("items").alias("y"))
        counted = pairs.join(left, "src").join(right, "dst").select("src", "dst", "n1", "n2", F.size(F.array_intersect("x", "y")).cast("bigint").alias("shared"))
    else:
        counted = met.groupBy("src", "dst", "n1", "n2").agg(F.count("*").alias("shared"))
    weight = F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared")) if measure == "jaccard" else F.col("shared") / F.sqrt(F.col("n1") * F.col("n2"))
    return counted.withColumn("weight", weight).where((F.col("shared") >= min_shared) & (F.col("weight") >= threshold)).select("src", "dst", "shared", "weight")


def expand_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(src, dst, weight), src < dst, of all nodes: each pair of ``set_pairs`` for all members of both classes, and the members
    of one class with each other by weight 1. ``classes`` are the ``set_classes`` of the same rows. The result is as long as
    there are such pairs, so classes of many nodes make many.
    """
    a = classes.select(F.col("node").alias("a"), F.col("representative").alias("src"))
    b = classes.select(F.col("node").alias("b"), F.col("representative").alias("dst"))
    across = pairs.select("src", "dst", "weight").join(a, "src").join(b, "dst").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight")
    within = a.join(b.withColumnRenamed("dst", "src"), "src").where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight"))
    return across.unionByName(within)


def topk_symmetric(pairs: DataFrame, k: int) -> DataFrame:
    """(src, dst, weight), src < dst: pairs that are among the ``k`` heaviest of either end; ties by greater partner."""
    both = pairs.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"), "weight").select("e.*", "weight")  # a union would compute the pairs twice
    w = W.partitionBy("src").orderBy(F.desc("weight"), F.desc("dst"))
    kept = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return kept.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("weight")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")


def topk_then_shared(pairs: DataFrame, k: int, min_shared: int) -> DataFrame:
    """Symmetric top k of pairs (src, dst, shared, weight), of which those that share too little are left out afterwards, so that
    they take up places."""
    kept = topk_symmetric(pairs, k)
    return kept.join(pairs.select("src", "dst", "shared"), ["src", "dst"]).where(F.col("shared") >= min_shared).select("src", "dst", "shared", "weight")


def terms_of(texts: DataFrame, node: str, text: str, n_max: int = 1, stop: tuple[str, ...] = ()) -> DataFrame:
    """(node, term, tf): words of two letters or digits at least, and runs of up to ``n_max`` of them."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\b[a-z0-9_]{2,}\b)"), F.lit(1))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(*stop))
    base = texts.select(F.col(node).alias("node"), words.alias("w"))

    def runs(n: int) -> Column:
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))

    grams = F.concat(F.col("w"), *[runs(n) for n in range(2, n_max + 1)])
    return base.select("node", F.explode(grams).alias("term")).groupBy("node", "term").agg(F.count("*").alias("tf"))


def tfidf(terms: DataFrame, sublinear: bool = True, max_terms: int | None = None) -> DataFrame:
    """(node, term, w, df): smoothed TF-IDF, each node's vector of length 1. ``max_terms`` keeps the most frequent terms of
    the corpus, ties in order of the term."""
    n = terms.select("node").distinct().agg(F.count("*").alias("n_docs"))
    stats = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if max_terms is not None:
        stats = stats.orderBy(F.desc("total"), F.asc("term")).limit(max_terms)
    tf = (1 + F.log("tf")) if sublinear else F.col("tf").cast("double")
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    raw = terms.join(stats.select("term", "df"), "term").crossJoin(F.broadcast(n)).select("node", "term", "df", (tf * idf).alias("w"))  # n has one row
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("node")))
    return raw.select("node", "term", "df", (F.col("w") / length).alias("w"))


def sparse_cosine_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, weight), src < dst, of unit vectors given as rows (node, term, w, df): all pairs from ``threshold`` on, worked in
    blocks, so that candidates stay in their task."""
    _positive(threshold)
    return pairs_above(vectors, threshold)


def dense_search(vectors: DataFrame, queries: DataFrame, node: str, vector: str, k: int, threshold: float, block_rows: int = 4096) -> DataFrame:
    """(src, dst, weight): for each query (src) the ``k`` nearest other rows (dst) by the cosine of unit vectors, from ``threshold``
    on; ties by greater id.

    Queries are a stated set against all rows, in blocks of bounded size: a pair of blocks is one matrix product, and only the
    best ``k`` of each query leave the worker. The work grows as queries times rows, so the set should be small beside them.
    """
    kind = vectors.schema[node].dataType.simpleString()

    def packed(df: DataFrame, names: tuple[str, str]) -> tuple[DataFrame, int]:
        blocks = max(1, -(-df.count() // block_rows))
        rows = df.select(F.col(node).alias("id"), F.col(vector).cast("array<float>").alias("v"), F.pmod(F.xxhash64(node), F.lit(blocks)).cast("int").alias("block"))
        return rows.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("r")).select("block", F.transform("r", lambda x: x["id"]).alias(names[0]), F.transform("r", lambda x: x["v"]).alias(names[1])), blocks

    q, _ = packed(queries, ("q_ids", "q_vs"))
    c, blocks = packed(vectors, ("ids", "vs"))
    grid = q.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, y = (np.array([np.asarray(v, np.float32) for v in vs]) for vs in (r.q_vs, r.vs))
                qi, ci = np.asarray(r.q_ids), np.asarray(r.ids)
                order = np.argsort(ci, kind="stable")[::-1]  # of equal cosines the greater id is first
                ci, y = ci[order], y[order]
                out = []
                for lo in range(0, len(qi), 512):
                    s = (x[lo : lo + 512] @ y.T).astype(np.float64)
                    for i, row in enumerate(s):
                        ok = np.flatnonzero((row >= threshold) & (ci != qi[lo + i]))
                        best = ok[np.argsort(-row[ok], kind="stable")][:k]
                        out += [(qi[lo + i], ci[j], row[j]) for j in best]
                yield pd.DataFrame(out, columns=["src", "dst", "weight"])

    near = grid.join(c, "block").select("q_ids", "q_vs", "ids", "vs").mapInPandas(run, f"src {kind}, dst {kind}, weight double")
    w = W.partitionBy("src").orderBy(F.desc("weight"), F.desc("dst"))
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("src", "dst", "weight")


def dense_topk(vectors: DataFrame, node: str, vector: str, k: int, threshold: float, block_rows: int = 4096) -> DataFrame:
    """(src, dst, weight), src < dst: symmetric top k with all rows as queries: for a layer over a library whose size is known to
    be small; the work grows as the square of the rows."""
    kept = dense_search(vectors, vectors, node, vector, k, threshold, block_rows)
    return kept.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("weight")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")


def dense_pairs(vectors: DataFrame, node: str, vector: str, threshold: float, block_rows: int = 2048) -> DataFrame:
    """(src, dst, weight), src < dst: all pairs of unit vectors whose cosine is ``threshold`` or more.

    Blocks of bounded size are multiplied, each pair of blocks once, so the work grows as the square of the rows: meant for
    vocabularies, which grow slowly, not for documents; those use ``dense_search`` with a stated query set."""
    blocks = max(1, -(-vectors.count() // block_rows))
    rows = vectors.select(F.col(node).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(node), F.lit(blocks)).cast("int").alias("b"))
    packed = rows.groupBy("b").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"))
    grid = packed.select(F.col("b").alias("qb"), F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"), F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))).alias("b"))
    kind = vectors.schema[node].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, y = (np.array([np.asarray(v, float) for v in vs]) for vs in (r.q_vs, r.vs))
                a, b = np.asarray(r.q_ids, object), np.asarray(r.ids, object)
                for lo in range(0, len(a), 256):
                    s = x[lo : lo + 256] @ y.T
                    i, j = np.nonzero(s >= threshold)
                    p, q = a[lo : lo + 256][i], b[j]
                    keep = p < q if r.same else p != q
                    if not keep.any():
                        continue  # a frame of empty lists has no strings, which Arrow refuses
                    low = [min(u, w) for u, w in zip(p[keep], q[keep], strict=True)]
                    high = [max(u, w) for u, w in zip(p[keep], q[keep], strict=True)]
                    yield pd.DataFrame({"src": low, "dst": high, "weight": s[i, j][keep]})

    met = grid.join(packed, "b").select("q_ids", "q_vs", "ids", "vs", (F.col("qb") == F.col("b")).alias("same"))
    return met.mapInPandas(run, f"src {kind}, dst {kind}, weight double")


def item_number(items: DataFrame) -> Callable[[Column | str], Column]:
    """A number for each item of a table: a hash without collisions among them, which is checked."""
    seed, keys = 0, items.select("item").distinct()
    while keys.groupBy(F.xxhash64("item", F.lit(seed)).alias("h")).agg(F.count("*").alias("k")).where("k > 1").limit(1).count():
        seed += 1
    return lambda c: F.xxhash64(c, F.lit(seed))


class _Soft(NamedTuple):
    """Sets one after the other, their items and what their items are related to with the best score, as numbers, and the place in
    its block of the set that holds each."""

    nodes: np.ndarray
    n: np.ndarray
    items: np.ndarray
    owner: np.ndarray
    others: np.ndarray
    scores: np.ndarray
    reached: np.ndarray


def _soft(rows: pa.StructArray) -> _Soft:
    nodes, items, others, scores = (rows.field(c) for c in ("node", "items", "others", "scores"))
    names = np.empty(len(nodes), object)
    names[:] = nodes.to_pylist()
    n, m = np.diff(items.offsets.to_numpy()), np.diff(others.offsets.to_numpy())
    flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
    return _Soft(names, n, flat(items), np.repeat(np.arange(len(n)), n), flat(others), flat(scores), np.repeat(np.arange(len(m)), m))


def soft_block(x: _Soft, y: _Soft, threshold: float, same: bool, cells: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, weight) of the pairs of sets from ``threshold`` on; of one block with itself i < j. What a set reaches, times what the
    other holds, sums the best relations of the other's items."""
    ny = len(y.nodes)

    def product(at: np.ndarray, key: np.ndarray, w: np.ndarray | None, keys: np.ndarray, owner: np.ndarray, v: np.ndarray | None) -> tuple:
        """Entries of x (at, key, w) that meet those of y: their places in x, where their partners begin and how many they are."""
        order = np.argsort(keys, kind="stable")
        first, last = np.searchsorted(keys[order], key, "left"), np.searchsorted(keys[order], key, "right")
        met = np.flatnonzero(last > first)
        return at[met], first[met], (last - first)[met], None if w is None else w[met], owner[order], None if v is None else v[order]

    sides = product(x.owner, x.items, None, y.others, y.reached, y.scores), product(x.reached, x.others, x.scores, y.items, y.owner, None)
    some = max(1, cells // max(ny, 1))
    for a in range(0, len(x.nodes), some):
        b, sums = min(a + some, len(x.nodes)), []
        for at, first, count, w, owner, v in sides:
            lo, end = np.searchsorted(at, [a, b])
            ends, total, start = np.cumsum(count[lo:end]), np.zeros((b - a) * ny), lo
            while lo < end:  # as many entries at once as their partners allow
                done = ends[lo - start - 1] if lo > start else 0
                hi = max(lo + 1, start + int(np.searchsorted(ends, done + cells, "right")))
                post = cosine.runs(first[lo:hi], count[lo:hi])
                cell = np.repeat((at[lo:hi] - a) * ny, count[lo:hi]) + owner[post]
                total += np.bincount(cell, v[post] if w is None else np.repeat(w[lo:hi], count[lo:hi]), len(total))
                lo = hi
            sums.append(total.reshape(b - a, ny))
        weight = (sums[0] / x.n[a:b, None] + sums[1] / y.n[None, :]) / 2
        i, j = np.nonzero(weight >= threshold)
        if same:
            i, j = i[o := i + a < j], j[o]
        yield i + a, j, weight[i, j]


def soft_set_pairs(members: DataFrame, node: str, item: str, relations: DataFrame, threshold: float, rows: int = 8192) -> DataFrame:
    """(src, dst, weight): mean over both directions of the best relation of each item to the other set's items.

    ``relations`` has (left, right, score), left < right; equal items are not counted, they belong to the exact layer. A pair of
    blocks of about ``rows`` sets is worked in one task, so that no candidates are written.
    """
    _positive(threshold)
    ship_code(members.sparkSession)
    held = written(members.select(F.col(node).alias("node"), F.col(item).alias("item")).where("node is not null and item is not null").distinct(), "members")
    kind = held.schema["node"].dataType.simpleString()
    both = relations.select(F.explode(F.array(F.struct("left", "right", "score"), F.struct(F.col("right").alias("left"), F.col("left").alias("right"), "score"))).alias("e")).select("e.*")
    number = item_number(held)
    sets = held.groupBy("node").agg(F.collect_list(number("item")).alias("items"))
    best = held.join(both, F.col("item") == F.col("left")).groupBy("node", "right").agg(F.max("score").alias("score"))
    reach = best.groupBy("node").agg(F.collect_list(F.struct(number("right").alias("other"), "score")).alias("r"))
    none = F.array().cast("array<struct<other: bigint, score: double>>")
    whole = written(sets.join(reach, "node", "left").withColumn("r", F.coalesce("r", none)).select("node", "items", F.col("r.other").alias("others"), F.col("r.score").alias("scores")), "reach")
    n = max(1, -(-whole.count() // rows))
    placed = whole.withColumn("b", F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    a_set = F.struct("node", "items", "others", "scores")
    side = lambda first: F.collect_list(F.when((F.col("b") <= F.col("o")) if first else (F.col("b") > F.col("o")), a_set))
    cells = placed.groupBy(F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q")).agg(side(True).alias("x"), side(False).alias("y")).select((F.col("p") == F.col("q")).alias("same"), "x", "y")
    name = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind]
    schema = pa.schema([("src", name), ("dst", name), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, xs, ys in zip(batch.column("same").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                x = _soft(xs.values)
                y = x if same else _soft(ys.values)
                for i, j, weight in soft_block(x, y, threshold, same):
                    if len(i):
                        u, v = x.nodes[i], y.nodes[j]
                        less = (u < v).astype(bool)
                        yield pa.RecordBatch.from_arrays([pa.array(np.where(less, u, v), name), pa.array(np.where(less, v, u), name), pa.array(weight)], schema=schema)

    return cells.mapInArrow(run, f"src {kind}, dst {kind}, weight double")


def relation_scores(candidates: DataFrame, equivalent: float = 1.0, related: float = 0.55) -> DataFrame:
    """(left, right, score) from term pairs with lexical and context similarity: equivalent or related by fixed bounds."""
    lexical, context = F.col("lexical"), F.col("context")
    relation: Column = F.when(lexical >= 0.82, "equivalent").when((lexical >= 0.45) | (context >= 0.82), "related")
    sure = F.when(relation == "equivalent", F.least(F.lit(0.94), 0.72 + 0.25 * lexical)).otherwise(F.least(F.lit(0.88), 0.58 + 0.25 * F.greatest(lexical, context)))
    rated = candidates.withColumn("relation", relation).where("relation is not null").withColumn("confidence", F.round(sure, 4))
    score = F.when(F.col("relation") == "equivalent", equivalent).otherwise(related) * F.col("confidence")
    return rated.groupBy(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).agg(F.max(score).alias("score")).select(F.col("a").alias("left"), F.col("b").alias("right"), "score")
