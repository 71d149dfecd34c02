"""Ordered folds over the units of a document: packing into chunks, budgets, splits.

A unit is a paragraph in document order. Packing is a fold over one document's ordered array inside the JVM, so a document
is the unit of parallel work and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pack_units(units: DataFrame, keys: list[str], pos: str, length: Column, role: Column, most: int) -> DataFrame:
    """``units`` with chunk_no from 1: a new chunk where the role changes or the length would pass ``most``; a unit longer
    than ``most`` is a chunk of its own."""
    rows = units.select(*keys, pos, length.cast("bigint").alias("len"), F.coalesce(role, F.lit("")).alias("role"))
    docs = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(pos, "len", "role"))).alias("u"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("bigint").alias("used"), F.lit("").alias("role"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["chunk"] == 0) | (acc["role"] != x["role"]) | (acc["used"] + x["len"] > most)
        chunk = F.when(new, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(new, x["len"]).otherwise(acc["used"] + x["len"]).alias("used"), x["role"].alias("role"), F.array_append(acc["out"], chunk).alias("out"))

    folded = docs.select(*keys, "u", F.aggregate("u", start, step, lambda acc: acc["out"]).alias("c"))
    placed = folded.select(*keys, F.explode(F.arrays_zip(F.transform("u", lambda x: x[pos]).alias("p"), F.col("c").alias("c"))).alias("z"))
    names = [f.name for f in placed.schema["z"].dataType.fields]
    at = placed.select(*keys, F.col(f"z.{names[0]}").alias(pos), F.col(f"z.{names[1]}").alias("chunk_no"))
    return units.join(at, [*keys, pos])


def within_budget(rows: DataFrame, keys: list[str], pos: str, text: str, most_rows: int, most_chars: int) -> DataFrame:
    """The first rows of each key whose texts fit a budget together; the one that passes it is cut short."""
    w = W.partitionBy(*keys).orderBy(pos)
    before = F.coalesce(F.sum(F.length(text)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("before", before).withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= most_rows) & (F.col("before") < most_chars))
    return kept.withColumn(text, F.substring(F.col(text), F.lit(1), F.lit(most_chars) - F.col("before").cast("int"))).drop("before")


def split_near_half(text: Column) -> Column:
    """array of two parts of a long text, divided at a line end or else a blank near its middle, or else in the middle."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    tail = F.substring(text, half + 1, n)
    line, blank = F.instr(tail, "\n"), F.instr(tail, " ")
    at = F.when(line > 0, half + line).when(blank > 0, half + blank).otherwise(half)
    return F.array(F.trim(F.substring(text, F.lit(1), at)), F.trim(F.substring(text, at + 1, n)))
