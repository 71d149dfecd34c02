"""Joins that keep their partitions even."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Left join to a table with unique, non-null keys, whatever the skew of ``key`` on the left.

    Keys that hold more than 1/``share`` of the left rows are at most ``share``: their right rows are broadcast by that
    bound. All other rows are joined by shuffle. Null keys, which can match nothing, are never shuffled. Runs one small
    aggregation to find the hot keys.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("n") * share > total).where("n > 1000").select(key).collect()]
    columns = [c for c in right.columns if c != key]
    blank = left.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns])
    rest = left.where(F.col(key).isNotNull())
    if not hot:
        return rest.join(right, key, "left").select(*left.columns, *columns).unionByName(blank)
    some = right.where(F.col(key).isin(hot))
    rows = rest.where(F.col(key).isin(hot)).join(F.broadcast(some), key, "left")
    other = rest.where(~F.col(key).isin(hot)).join(right, key, "left")
    return rows.select(*left.columns, *columns).unionByName(other.select(*left.columns, *columns)).unionByName(blank)
