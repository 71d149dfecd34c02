"""Linking references to the documents of a library: exact keys first, then scores with a margin."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrow import sequence_ratio
from ..functions.text import surname, title_key, year_score
from ..runtime import ship_code, written


def unique_exact(left: DataFrame, right: DataFrame, key: str, right_id: str) -> DataFrame:
    """Left rows joined to the only right id that has their key; keys of several ids match nothing."""
    one = right.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(right_id).alias(right_id), F.max(right_id).alias("other"))
    return left.join(one.where(F.col(right_id) == F.col("other")).drop("other"), key)


def _letters(keys: list[str], most: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 for each key, so that the product of two rows is the number of characters the keys share."""
    counts = _counts(keys)
    return np.concatenate([counts[:, [c]] > np.arange(most[c]) for c in range(counts.shape[1])], axis=1).astype(np.float32)


def _counts(keys: list[str]) -> np.ndarray:
    """How often each key has each character, by its code modulo 64."""
    out = np.zeros((len(keys), 64), np.int32)
    for i, k in enumerate(keys):
        np.add.at(out[i], np.frombuffer(k.encode("utf-32-le"), np.uint32) % 64, 1)
    return out


def near_keys(left: DataFrame, right: DataFrame, key: str, least: float, block_rows: int = 4096) -> DataFrame:
    """(key, c_key): all pairs of distinct keys whose ``sequence_ratio`` is ``least`` or more, none left out.

    The ratio can't be above twice the characters that two keys share, whatever their places, over the sum of their lengths;
    only pairs that this bound lets pass are compared. It is a matrix product for each pair of blocks, so the work grows
    as the distinct keys of one side times those of the other, in blocks of bounded size.
    """
    ship_code(left.sparkSession)

    def packed(df: DataFrame, names: str) -> tuple[DataFrame, int]:
        keys = written(df.select(key).where(F.col(key) != "").distinct(), "keys")
        blocks = max(1, -(-keys.count() // block_rows))
        return keys.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")).agg(F.collect_list(key).alias(names)), blocks

    (a, m), (b, n) = packed(left, "xs"), packed(right, "ys")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for xs, ys in zip(pdf["xs"], pdf["ys"], strict=True):
                xs, ys, out = list(xs), list(ys), []
                most = np.minimum(_counts(xs).max(axis=0), _counts(ys).max(axis=0))
                right_letters, right_lengths = _letters(ys, most).T, np.array([len(y) for y in ys])
                for lo in range(0, len(xs), 512):
                    part = xs[lo : lo + 512]
                    lengths = np.array([len(x) for x in part])[:, None] + right_lengths
                    for i, j in zip(*np.nonzero(2 * (_letters(part, most) @ right_letters) >= least * lengths - 1e-3), strict=True):
                        if part[i] == ys[j] or difflib.SequenceMatcher(None, part[i], ys[j]).ratio() >= least:
                            out.append((part[i], ys[j]))
                yield pd.DataFrame(out, columns=[key, f"c_{key}"])

    grid = a.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))).join(b, "block").select("xs", "ys")
    return grid.repartition(min(m * n, 2000)).mapInPandas(run, f"{key} string, c_{key} string")


def match_scores(pairs: DataFrame) -> DataFrame:
    """Pairs (title, author, year, journal and c_title, ...) with the parts and the overall score, each rounded to 6."""
    title = sequence_ratio(title_key(F.col("title")), title_key(F.col("c_title")))
    mine, theirs = surname(F.col("author")), surname(F.col("c_author"))
    author = F.when((mine == "") | (theirs == ""), 0.45).when(mine == theirs, 1.0).otherwise(sequence_ratio(mine, theirs))
    a, b = title_key(F.col("journal")), title_key(F.col("c_journal"))
    journal = F.when((a == "") | (b == ""), 0.45).otherwise(sequence_ratio(a, b))
    parts = pairs.withColumns({"title_score": title, "author_score": author, "year_score": year_score(F.col("year"), F.col("c_year")), "journal_score": journal})
    overall = 0.72 * F.col("title_score") + 0.12 * F.col("author_score") + 0.10 * F.col("year_score") + 0.06 * F.col("journal_score")
    return parts.withColumns({c: F.round(c, 6) for c in ("title_score", "author_score", "year_score", "journal_score")}).withColumn("overall", F.round(overall, 6))


def best_with_margin(scored: DataFrame, keys: list[str], score: str, candidate: str) -> DataFrame:
    """The best candidate of each key, with the margin to the next; no next counts as 0."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), F.asc(candidate))
    ranked = scored.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead(score).over(w))
    return ranked.where("rank = 1").withColumn("margin", F.col(score) - F.coalesce("next", F.lit(0.0))).drop("rank", "next")


def accepted(title: Column, overall: Column, margin: Column, least_title: float = 0.90, least_overall: float = 0.89, least_margin: float = 0.02) -> Column:
    return (title >= least_title) & (overall >= least_overall) & (margin >= least_margin)


def cascade(records: DataFrame, keys: list[str], stages: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """Records with the value of the first stage that has one, and its name as ``method``."""
    out = records
    for name, df in stages:
        out = out.join(df.select(*keys, F.col(value).alias(f"__{name}")), keys, "left")
    first = F.coalesce(*[F.col(f"__{n}") for n, _ in stages])
    method = F.coalesce(*[F.when(F.col(f"__{n}").isNotNull(), n) for n, _ in stages])
    return out.select(*records.columns, first.alias(value), method.alias("method"))
