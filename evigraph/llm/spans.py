"""Long exact spans shared between documents (problem 9).

A span of at least ``k`` code points shared verbatim is a union of shared windows of ``k`` code points. Windows are
grouped into super-k-mers: runs of consecutive windows with the same minimiser, the least hash among the ``m``-grams of
the window. Equal windows have equal minimisers, so each bucket (minimiser) can be settled on its own:

1. Every super-k-mer travels as (minimiser, 128-bit fingerprint of its string, document, start, windows), without its string.
2. A minimiser seen in one document only has no shared window. If all super-k-mers of a minimiser have one fingerprint,
   all their windows are shared. Both are settled by one pre-aggregated group-by, however hot the minimiser is.
3. Only where a minimiser has several documents and several strings, the strings travel packed to their bucket, where the
   windows are sorted and counted, and windows of equal hash are compared code point for code point. Equal strings are
   first reduced to one, by the minimiser and 128 bits of hash. A bucket of more than ``bucket_strings``
   strings is divided again by a second, longer minimiser, and what then still is large by the window itself.
4. The shared runs of a document are united and measured.

Positions and lengths are code points. Defined cases: null, empty and short texts share nothing; repeats within one
document do not count, nor do repeated rows of one document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written

#: Code points hashed at a time, so that a worker's arrays stay small.
BATCH_POINTS = 1 << 19
BUCKET_STRINGS = 4096

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, BATCH_POINTS + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[name] = np.cumprod(steps)
    return have[:n]


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ np.uint64((seed * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _prefix(points: np.ndarray, offset: int = 0x51) -> np.ndarray:
    """p with p[j] - p[i] = sum of points[i:j] times powers of the base."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(offset)) * _power("base", _BASE, len(points)), out=out[1:])
        return out


def _hash(prefix: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice, seed: int) -> np.ndarray:
    inverse = _power("inverse", _INVERSE, len(prefix))
    with np.errstate(over="ignore"):
        return _mix((prefix[stop] - prefix[start]) * inverse[start], seed)


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` consecutive values, in linear time (block prefix and suffix minima)."""
    n = len(h) - w + 1
    if w == 1:
        return h
    padded = np.full(-(-len(h) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(h)] = h
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), lengths


def super_kmers(texts: list[str], k: int, m: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, minimiser, two fingerprints) of each super-k-mer of each text."""
    points, lengths = _points(texts)
    if len(points) < k:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    prefix = _prefix(points)
    grams = _hash(prefix, slice(0, len(points) - m + 1), slice(m, None), seed)
    least = _sliding_min(grams, k - m + 1)
    first = np.concatenate([[0], np.cumsum(lengths)])
    of = np.repeat(np.arange(len(texts)), lengths)[: len(least)]
    inside = np.arange(len(least)) + k <= first[of + 1]
    new = np.ones(len(least), bool)
    if m < k:  # else each window stands alone, its equal neighbours too
        new[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(least)))
    keep = inside[at]
    at, count = at[keep], count[keep]
    stop, n = at + count + (k - 1), len(points)
    again = _hash(_prefix(points[::-1], 0x2F), n - stop, n - at, seed + 102)  # read backwards, so the two never collide together
    return of[at], at - first[of[at]], count, least[at], _hash(prefix, at, stop, seed + 101), again


def _chunks(batch: pa.RecordBatch, k: int) -> Iterator[tuple[list, list[str]]]:
    keys, texts, size = [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if text is None or len(text) < k:
            continue
        if texts and size + len(text) > BATCH_POINTS:
            yield keys, texts
            keys, texts, size = [], [], 0
        keys.append(key)
        texts.append(text)
        size += len(text)
    if texts:
        yield keys, texts


def _scan(k: int, m: int, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _chunks(batch, k):
                of, start, count, h, s, t = super_kmers(texts, k, m, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, key_type).take(pa.array(of)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(t.view(np.int64))],
                    names=["doc", "start", "n", "h", "s", "t"],
                )

    return run


def _cut_strings(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(h, doc, r["start"], r["n"], text[r["start"] : r["start"] + r["n"] + k - 1]) for doc, text, runs in pdf[["doc", "text", "runs"]].itertuples(index=False) for r in runs for h in (r["h"],)]
        yield pd.DataFrame(rows, columns=["h", "doc", "start", "n", "packed"])


def _shared_windows(texts: list[str], lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shared windows of distinct packed strings, each held by documents from lo to hi: (string, first window, windows).

    Windows are sorted by a 128-bit hash of their code points, and neighbours of equal hash compared by the points themselves;
    a window is shared if its documents differ.
    """
    points, lengths = _points(texts)
    prefix, other = _prefix(points), _prefix(points[::-1], 0x2F)
    first = np.concatenate([[0], np.cumsum(lengths)])
    counts = np.maximum(lengths - k + 1, 0)
    of = np.repeat(np.arange(len(texts)), counts)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first[of] + inner
    a = _hash(prefix, at, at + k, 7)
    b = _hash(other, len(points) - at - k, len(points) - at, 8)
    order = np.lexsort((b, a))
    head = np.ones(len(order), bool)
    head[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    if len(order):
        windows, alike = np.lib.stride_tricks.sliding_window_view(points, k), np.flatnonzero(~head)
        for lo_ in range(0, len(alike), 2048):
            part = alike[lo_ : lo_ + 2048]
            head[part] = (windows[at[order[part]]] != windows[at[order[part - 1]]]).any(axis=1)
    starts = np.flatnonzero(head)
    shared = np.zeros(len(order), bool)
    if len(order):
        differ = np.minimum.reduceat(lo[of[order]], starts) != np.maximum.reduceat(hi[of[order]], starts)
        shared[order] = np.repeat(differ, np.diff(np.append(starts, len(order))))
    change = np.ones(len(of), bool)
    change[1:] = (of[1:] != of[:-1]) | (shared[1:] != shared[:-1])
    begin = np.flatnonzero(change)
    n = np.diff(np.append(begin, len(of)))
    keep = shared[begin] if len(begin) else np.zeros(0, bool)
    return of[begin][keep], inner[begin][keep], n[keep]


def _count_bucket(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pd.factorize(pd.concat([pdf["lo"], pdf["hi"]]), sort=True)[0]
        of, start, n = _shared_windows(pdf["packed"].tolist(), ids[: len(pdf)], ids[len(pdf) :], k)
        return pd.DataFrame({"h": pdf["h"].to_numpy()[of], "sid": pdf["sid"].to_numpy()[of], "at": start.astype(np.int32), "n": n.astype(np.int32)})

    return run


def _divide(k: int, m: int):
    """Packed strings -> their sub-super-k-mers under a longer minimiser."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                of, start, n, h, *_ = super_kmers(part["packed"].tolist(), k, m, 2)
                texts = part["packed"].tolist()
                yield pd.DataFrame({"of_h": part["h"].to_numpy()[of], "sid": part["sid"].to_numpy()[of], "at": start.astype(np.int32), "lo": part["lo"].to_numpy()[of], "hi": part["hi"].to_numpy()[of], "h": h.view(np.int64), "packed": [texts[i][a : a + c + k - 1] for i, a, c in zip(of, start, n, strict=True)]})

    return run


def _settle(strings: DataFrame, k: int, bucket_strings: int, kind: str, m_next: int | None, groups: int) -> DataFrame:
    """(h, sid, at, n): shared windows of distinct strings (h, sid, lo, hi, packed), which h and sid name; lo and hi are the least and the greatest
    document with the string. Usual buckets are counted ``groups`` batches at a time, whole buckets together."""
    size = strings.groupBy("h").agg(F.count("*").alias("strings"))
    sized = strings.join(size, "h")
    usual = sized.where(F.col("strings") <= bucket_strings).select("sid", "h", "lo", "hi", "packed")
    out = usual.groupBy(F.pmod(F.xxhash64("h"), F.lit(groups)).alias("batch")).applyInPandas(_count_bucket(k), "h bigint, sid bigint, at int, n int")
    hot = sized.where(F.col("strings") > bucket_strings).select("sid", "h", "lo", "hi", "packed")
    m = m_next or k
    parts = hot.mapInPandas(_divide(k, m), f"of_h bigint, sid bigint, at int, lo {kind}, hi {kind}, h bigint, packed string")
    if m == k:  # each part is one window, which is its own bucket: a pre-aggregated group-by settles it
        wins = parts.withColumn("key", F.sha2("packed", 256))
        two = wins.groupBy("key").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a < b").select("key")
        found = wins.join(two, "key", "left_semi").select(F.col("of_h").alias("h"), "sid", "at", F.lit(1).alias("n"))
    else:
        grouped = parts.withColumn("key", F.sha2("packed", 256))
        one = grouped.groupBy("h", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.struct("sid", "at")).alias("first"), F.first("packed").alias("packed"))
        several = one.groupBy("h").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a < b").select("h")
        inner = one.join(several, "h", "left_semi").select(F.xxhash64("h", "key").alias("sid"), "h", "lo", "hi", "packed")
        settled = _settle(inner, k, bucket_strings, kind, None, groups).withColumnsRenamed({"at": "inner", "sid": "part"})
        back = grouped.select("h", F.xxhash64("h", "key").alias("part"), "of_h", "sid", "at")
        found = settled.join(back, ["h", "part"]).select(F.col("of_h").alias("h"), "sid", (F.col("at") + F.col("inner")).alias("at"), "n")
    return out.unionByName(found)


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 200, m: int = 64, bucket_strings: int = BUCKET_STRINGS) -> DataFrame:
    """(key, start, stop): maximal runs of code points that lie in a span of at least ``k`` shared with another document."""
    if not 1 <= m <= k:
        raise ValueError("1 <= m <= k is needed")
    from pyspark.sql.pandas.types import to_arrow_type

    field = docs.schema[key].dataType
    kind = field.simpleString()
    source = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= k))
    runs = written(source.mapInArrow(_scan(k, m, to_arrow_type(field)), f"doc {kind}, start int, n int, h bigint, s bigint, t bigint"), "runs")
    buckets = runs.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), ((F.min("s") != F.max("s")) | (F.min("t") != F.max("t"))).alias("mixed")).where("a < b").select("h", "mixed")
    recurring = written(runs.drop("s", "t").join(buckets, "h"), "recurring")
    plain = recurring.where(~F.col("mixed")).select("doc", "start", "n")
    # strings of the buckets that must be counted
    wanted = recurring.where("mixed").groupBy("doc").agg(F.collect_list(F.struct("start", "n", "h")).alias("runs"))
    strings = written(source.join(wanted, "doc").mapInPandas(lambda it: _cut_strings(it, k), f"h bigint, doc {kind}, start int, n int, packed string").withColumn("sid", F.xxhash64("h", "packed")), "strings")
    distinct = strings.groupBy("h", "sid").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.first("packed").alias("packed"))
    settled = _settle(distinct, k, bucket_strings, kind, k - k // 8, strings.count() // BUCKET_STRINGS + 1)
    counted = strings.select("h", "sid", "doc", "start").join(settled, ["h", "sid"]).select("doc", (F.col("start") + F.col("at")).alias("start"), "n")
    spans = plain.unionByName(counted).select("doc", "start", (F.col("start") + F.col("n") + (k - 1)).alias("stop")).distinct()
    ordered = spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    merged = ordered.select(
        "doc",
        F.expr(
            "aggregate(slice(spans, 2, size(spans)), struct(spans[0] AS last, filter(spans, x -> false) AS done), (acc, x) -> "
            "if(x.start <= acc.last.stop, struct(struct(acc.last.start AS start, greatest(acc.last.stop, x.stop) AS stop) AS last, acc.done AS done), "
            "struct(x AS last, concat(acc.done, array(acc.last)) AS done)), acc -> concat(acc.done, array(acc.last)))"
        ).alias("spans"),
    )
    return merged.select(F.col("doc").alias(key), F.inline("spans"))


def shared_chars(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 200, **options) -> DataFrame:
    """(key, shared_chars bigint) for each document with shared spans."""
    return shared_spans(docs, key, text, k, **options).groupBy(key).agg(F.sum(F.col("stop") - F.col("start")).cast("bigint").alias("shared_chars"))
