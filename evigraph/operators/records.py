"""Keyed records: latest wins, first wins, merges, upserts, and terms counted with a stable order.

Order is always a column (``pos``), never the order of rows, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest ``order``; ties by the other columns. Pre-aggregates, so hot keys are no task."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("top")).select(*keys, "top.*").select(*df.columns)


def first_wins(df: DataFrame, keys: list[str], pos: list[str]) -> DataFrame:
    """The row of each key with the least position."""
    rest = [c for c in df.columns if c not in keys and c not in pos]
    return df.groupBy(*keys).agg(F.min(F.struct(*pos, *rest)).alias("top")).select(*keys, "top.*").select(*df.columns)


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``source`` put in or in place of rows of equal keys."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source)


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with those rows of ``source`` whose keys it lacks."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"))


def duplicates_of_first(df: DataFrame, keys: list[str], pos: list[str], ident: str) -> DataFrame:
    """Later rows of a key with the ``ident`` of its first row as ``duplicate_of``; rows with an empty key are left out."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*pos, ident)).alias("first"), F.count("*").alias("k")).where("k > 1")
    hit = df.join(first, keys).where(F.struct(*pos, ident) > F.struct(*[F.col(f"first.{c}") for c in (*pos, ident)]))
    return hit.select(*df.columns, F.col(f"first.{ident}").alias("duplicate_of"))


def mode_first_seen(df: DataFrame, keys: list[str], value: str, pos: str, ignore: tuple[str, ...] = (), default: str | None = None) -> DataFrame:
    """The most frequent value of each key, the one seen first among equals; ``default`` where there is none."""
    known = df.where(F.col(value).isNotNull() & ~F.col(value).isin(*ignore)) if ignore else df.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(pos).alias("seen"))
    best = counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", (-F.col("seen")).alias("early"))).alias(value))
    return df.select(*keys).distinct().join(best, keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def top_terms(df: DataFrame, keys: list[str], term: str, pos: str, k: int) -> DataFrame:
    """The ``k`` most frequent terms of each key, earlier seen first among equals: keys, term, n, rank."""
    counts = df.groupBy(*keys, term).agg(F.count("*").alias("n"), F.min(pos).alias("seen"))
    w = W.partitionBy(*keys).orderBy(F.desc("n"), F.asc("seen"), F.asc(term))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("seen")


def union_lists(df: DataFrame, keys: list[str], lists: list[str], scalars: list[str], pos: list[str]) -> DataFrame:
    """One row a key: lists united, sorted and distinct; scalars the first that is not empty, in order of ``pos``."""
    first = lambda c: F.min(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct(*pos, c)))[c].alias(c)
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast(df.schema[c].dataType)))))).alias(c)
    return df.groupBy(*keys).agg(*map(united, lists), *map(first, scalars), F.min(F.struct(*pos)).alias("seen"))


def fill_from(base: dict[str, Column], over: dict[str, Column]) -> dict[str, Column]:
    """Fields of ``over`` where they are not empty, else of ``base``."""
    return {k: F.coalesce(F.when(F.coalesce(over[k].cast("string"), F.lit("")) != "", over[k]), v) if k in over else v for k, v in base.items()}
