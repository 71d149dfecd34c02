"""Extraction chunks merged into one record a paper: entries of equal keys fall together, the first holds, and get numbers in
the order in which they were first seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, owner: str, order: list[str], prefix: str, width: int, name: str) -> DataFrame:
    """``df`` with ids ``prefix`` and a running number for each ``owner``, in ``order``."""
    w = W.partitionBy(owner).orderBy(*order)
    return df.withColumn(name, F.concat(F.lit(prefix), F.lpad(F.row_number().over(w).cast("string"), width, "0")))


def merged(items: DataFrame, owner: str, keys: dict[str, Column], order: list[str], prefix: str, width: int, name: str = "item_id") -> DataFrame:
    """The first item of each (owner, keys) with its number. Keys pre-aggregate, so repeated items are no task."""
    keyed = items.withColumns(keys)
    rest = [c for c in items.columns if c not in order and c != owner]
    first = keyed.groupBy(owner, *keys).agg(F.min(F.struct(*order, *rest)).alias("top")).select(owner, *keys, "top.*")
    return numbered(first, owner, order, prefix, width, name)


def sids_key(sids: Column) -> Column:
    """Evidence ids as part of a key, whatever their order."""
    return F.array_join(F.array_sort(F.array_compact(F.coalesce(sids, F.array().cast("array<string>")))), ",")


def merged_systems(items: DataFrame, owner: str, key: Column, content: Column, order: list[str], lists: list[str], scalars: list[str]) -> DataFrame:
    """Systems of one key united: lists sorted and distinct, scalars the first that is not empty. A system without a key stands
    for itself, under the hash of its ``content``."""
    own = F.when(key != "", key).otherwise(F.substring(F.sha2(content, 256), 1, 16))
    keyed = items.withColumn("system_key", own)
    united = [F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))).alias(c) for c in lists]
    first = [F.min(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct(*order, c)))[c].alias(c) for c in scalars]
    g = keyed.groupBy(owner, "system_key").agg(F.min(F.struct(*order)).alias("seen"), *united, *first)
    return numbered(g, owner, ["seen"], "SYS", 3, "system_id").drop("seen")
