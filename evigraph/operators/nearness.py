"""Pairs of strings within a number of edits, none left out.

A string that ``t`` edits change keeps one of any ``t`` + 1 disjoint runs of letters whole, moved by ``t`` places at most. Of each
left string those disjoint runs are taken that the fewest right strings have; the right strings that have one about its place are
its candidates, and those go out whose letters differ by more than the edits can change. Blocks of left strings meet blocks of
right strings, so memory is bounded; a run is never left out for being frequent. Where a share is allowed, strings are put into
bands of lengths, so wide that near strings are of the same band or of neighbours, and only those bands' blocks meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_code, written

_BASE, _RUN, _POSTINGS = np.uint64(0x9E3779B97F4A7C15), 8, 2_000_000
_PAIRS = 20_000_000  # of strings that a task compares, at which it takes longer than it takes to begin one


def _flat(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all strings one after the other, where each begins and its length."""
    lengths = np.array([len(s) for s in strings], np.int64)
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(lengths) - lengths, lengths


def _runs(letters: np.ndarray, q: int) -> np.ndarray:
    """A number for each run of ``q`` letters along the last axis; two runs may share one at the cost of a candidate more."""
    n = max(letters.shape[-1] - q + 1, 0)
    out = np.zeros((*letters.shape[:-1], n), np.uint64)
    for j in range(q):
        out = (out + letters[..., j : j + n].astype(np.uint64) + np.uint64(1)) * _BASE
        out ^= out >> np.uint64(29)
    return out


def _placed(runs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Run and place in one number, so that a run's places from one to another lie together; places beyond 65,535 count as that."""
    return runs & ~np.uint64(0xFFFF) | np.clip(places, 0, 0xFFFF).astype(np.uint64)


def _letters(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often each string has each letter, by its code modulo 32, up to 127: a bound makes two strings no more unlike."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return np.minimum(np.bincount(owner * 32 + letters % 32, minlength=len(lengths) * 32), 127).reshape(-1, 32).astype(np.int8)


def _rarest(df: np.ndarray, q: int, count: int) -> np.ndarray:
    """Of each row the first places of ``count`` disjoint runs of ``q`` letters that are the rarest together."""
    rows, places = df.shape
    n = places + q - 1
    best, ways = np.zeros((rows, n + 1)), []
    for _ in range(count):
        now = np.full((rows, n + 1), np.inf)
        now[:, q:] = best[:, :places] + df
        low = np.minimum.accumulate(now, axis=1)
        new = np.concatenate([np.zeros((rows, 1), bool), low[:, 1:] < low[:, :-1]], axis=1)
        ways.append(np.maximum.accumulate(np.where(new, np.arange(n + 1), 0), axis=1))
        best = low
    at, out = np.full(rows, n), np.empty((rows, count), np.int64)
    for j in range(count - 1, -1, -1):
        at = ways[j][np.arange(rows), at] - q
        out[:, j] = at
    return out


def close(xs: list[str], ys: list[str], share: float | None = None, most: int = 0, swaps: bool = False, begun: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs that may be within ``share`` of the greater length in edits, or within ``most``; all that are come.

    ``swaps``: two neighbours that change places count as one edit. ``begun``: xs may be the beginning of ys instead of the whole."""
    allowed = (lambda n: np.floor(n * share + 1e-9).astype(np.int64)) if share is not None else (lambda n: np.full(np.shape(n), most))
    edits = (lambda n: int(n * share / (1 - share) + 1e-9)) if share is not None else (lambda n: most)
    (xl, xa, xn), (yl, ya, yn) = _flat(xs), _flat(ys)
    x_letters, y_letters = (None, None) if begun else (_letters(xl, xn), _letters(yl, yn))
    owner = np.repeat(np.arange(len(ys)), yn)
    index: dict[int, tuple] = {}

    def indexed(q: int) -> tuple:
        """All runs, by their number and then their place, and whose they are."""
        if q not in index:
            h = _runs(yl, q)
            place = np.arange(len(yl)) - ya[owner] if len(yl) else np.zeros(0, np.int64)
            valid = np.flatnonzero(place[: len(h)] + q <= yn[owner[: len(h)]])
            keys = _placed(h[valid], place[valid])
            order = np.argsort(keys)
            index[q] = keys[order], owner[valid[order]].astype(np.int32)
        return index[q]

    def kept(i: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not begun and len(i):
            ok = [np.abs(x_letters[i[lo : lo + 200_000]] - y_letters[j[lo : lo + 200_000]]).sum(1, dtype=np.int16) <= 2 * most[j[lo : lo + 200_000]] for lo in range(0, len(i), 200_000)]
            i, j = i[o := np.concatenate(ok)], j[o]
        return i, j

    for n in np.unique(xn).tolist():
        rows, t = np.flatnonzero(xn == n), edits(n)
        count = (2 * t if swaps else t) + 1
        q = min(_RUN, n // count)
        may = allowed(np.maximum(n, yn))
        fits = n - yn <= most if begun else np.abs(n - yn) <= may
        if not q:  # edits can change all its letters
            every = np.flatnonzero(fits)
            for r in rows.tolist():
                yield kept(np.full(len(every), r), every, may)
            continue
        keys, posts = indexed(q)
        if not len(keys):
            continue
        some = max(1, min(4096, _POSTINGS // (n * count)))
        for lo in range(0, len(rows), some):
            part = rows[lo : lo + some]
            h = _runs(xl[xa[part][:, None] + np.arange(n)], q)
            place = np.broadcast_to(np.arange(h.shape[1]), h.shape)
            low, high = _placed(h, place - t).ravel(), _placed(h, place + t).ravel()
            first, df = np.empty(h.shape, np.int64), np.empty(h.shape, np.int64)
            order = np.argsort(low)  # sorted ones are found faster, as neighbours lie in the cache
            first.ravel()[order] = now = np.searchsorted(keys, low[order])
            df.ravel()[order] = np.searchsorted(keys, high[order], "right") - now
            start = _rarest(df, q, count)
            many, at = np.take_along_axis(df, start, 1), np.take_along_axis(first, start, 1)
            ends = np.cumsum(many.sum(1))
            a = 0
            while a < len(part):  # as many rows at once as their postings allow
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _POSTINGS, "right")))
                k = many[a:b].ravel()
                post = np.repeat(at[a:b].ravel() - (np.cumsum(k) - k), k) + np.arange(k.sum())
                i, j = np.repeat(np.repeat(part[a:b], count), k), posts[post]
                o = fits[j]
                one = np.sort(i[o] * len(ys) + j[o])  # a sort takes less than np.unique, which hashes
                one = one[np.append(True, one[1:] != one[:-1])] if len(one) else one
                yield kept(one // len(ys), one % len(ys), may)
                a = b


def band(length: Column, share: float | None) -> Column:
    """A number for lengths: of two that ``share`` of the greater allows for near strings, it differs by 1 at most."""
    if share is None or share >= 1:
        return F.lit(0)
    return F.floor(F.log(length) / F.lit(max(-math.log(1 - share), 0.05) + 1e-6)).cast("int")


def blocks(df: DataFrame, names: str, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(band, block, names): the strings ``k`` of each band in lists of about ``rows``; how many strings each band has."""
    strings = dict(df.groupBy("band").count().collect())  # some hundred bands at most
    lists = _of(_lists(strings, rows), F.col("band"))
    return df.groupBy("band", F.pmod(F.xxhash64("k"), lists).cast("int").alias("block")).agg(F.collect_list("k").alias(names)), strings


def _lists(strings: dict[int, int], rows: int) -> dict[int, int]:
    return {b: -(-n // rows) for b, n in strings.items()}


def _of(counts: dict[int, int], b: Column) -> Column:
    """What ``counts`` has for a band; there is no band -9, a map may not be empty."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in ({-9: 0} | counts).items() for x in pair]), b)


def _for_each(df: DataFrame, own: str, names: str, other: str, counts: dict[int, int]) -> DataFrame:
    """(pair, names): the lists once for each list of the other side that is in their band or next to it."""
    bands = df.select(F.col("band").alias(own), F.col("block").alias(f"{own}_no"), names, F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias(other))
    n = _of(counts, F.col(other))
    pairs = bands.where(n > 0).withColumn(f"{other}_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return pairs.select(F.concat_ws(" ", "l", "l_no", "r", "r_no").alias("pair"), names)


def close_pairs(left: DataFrame, right: DataFrame, share: float | None = None, most: int = 0, swaps: bool = False, begun: bool = False, left_rows: int = 8192, right_rows: int = 32768) -> DataFrame:
    """(k, c): the pairs that ``close`` finds among the distinct strings ``k`` of both tables."""
    ship_code(left.sparkSession)
    once = lambda df, name: written(df.select("k").where("k is not null and k != ''").distinct(), name).withColumn("band", band(F.length("k"), share))
    (a, xn), (b, yn) = blocks(once(left, "left"), "xs", left_rows), blocks(once(right, "right"), "ys", right_rows)
    m, n = _lists(xn, left_rows), _lists(yn, right_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for xs, ys in zip(pdf["xs"], pdf["ys"], strict=True):
                x, y = np.asarray(xs, object), np.asarray(ys, object)
                for i, j in close(list(xs), list(ys), share, most, swaps, begun):
                    if len(i):
                        yield pd.DataFrame({"k": x[i], "c": y[j]})

    met = [(x, y) for x in m for y in (x - 1, x, x + 1) if y in n]
    work = sum(xn[x] * yn[y] for x, y in met) // _PAIRS
    # a number that is given stays as it is, however few bytes the tasks get
    parts = max(1, min(2 * sum(m[x] * n[y] for x, y in met), max(work, 12), 2000))
    even = [df.repartition(parts, "pair") for df in (_for_each(a, "l", "xs", "r", n), _for_each(b, "r", "ys", "l", m))]
    return even[0].join(even[1], "pair").select("xs", "ys").mapInPandas(run, "k string, c string")
