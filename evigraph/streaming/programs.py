"""Structured Streaming programs: curation replay, debounced rebuilds, windowed counts, orphan ledger."""

from __future__ import annotations

import secrets
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.orphans import RECORDS, OrphanLedger, parent_rows
from ..operators.records import latest
from ..sources.files import EVENT_SCHEMA


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).json(folder)


def debounced(events: DataFrame, key: str, ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): one row for each burst of events, given out once ``gap`` has passed without another."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, key: str, ts: str, width: str, late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), key, "n")


#: Parts of a log table, by paper; a batch reads those its papers fall into.
LOG_PARTS = 64


def replay(events: DataFrame, log: str, rebuild: Callable[[DataFrame, DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Appends each batch to the log table and calls ``rebuild`` with the whole log of the papers the batch touches, in any
    batch the same result as replaying the log at once. The log is parted by paper, and only the parts that the batch touches
    are read. Batches are idempotent: a batch is one folder of each part."""

    def batch(df: DataFrame, n: int) -> None:
        part = F.pmod(F.xxhash64("paper_id"), F.lit(LOG_PARTS)).cast("int")
        spark = df.sparkSession
        df.withColumn("part", part).withColumn("batch", F.lit(n)).write.partitionBy("part", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(log)
        touched = spark.read.option("basePath", log).parquet(f"{log}/part=*/batch={n}").select("paper_id", "part").distinct()
        parts = sorted(r[0] for r in touched.select("part").distinct().collect())  # LOG_PARTS at most
        if parts:
            whole = spark.read.schema(df.schema).parquet(*[f"{log}/part={p}" for p in parts])
            rebuild(whole.join(touched.select("paper_id"), "paper_id", "left_semi"), touched.select("paper_id"))

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def orphan_stream(papers: DataFrame, ledger: OrphanLedger, checkpoint: str, source: str = "papers") -> StreamingQuery:
    """Arriving parents resolve the orphans of a ledger that wait for them. A batch that was committed before a failure is not
    applied again: the ledger keeps the number of its last batch of each source."""

    def batch(df: DataFrame, n: int) -> None:
        ledger.apply(parent_rows(df), ledger.spark.createDataFrame([], RECORDS), source, n)

    return papers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_into(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the row of the greatest ``order`` of each key in a table, of the batch and of what is
    held. A batch writes a new version and then names it in ``path``/current; until it is named the old one holds, so a batch
    that fails can come again. A table that can't be read is an error; only one that isn't there is empty."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        held = current(spark, path)
        if held is not None and held[0] >= n:
            return  # this batch is in the table
        rows = df if held is None else spark.read.schema(df.schema).parquet(held[1]).unionByName(df)
        new = f"{path}/v{n}"
        latest(rows, keys, order).write.mode("overwrite").parquet(new)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/current/{n:012}")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(at.getParent())
        fs.create(at).close()

    return batch


def current(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(number, folder) of the version of a table of ``merge_into`` that holds."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().isdigit()] if fs.exists(at) else []
    return (int(max(names)), f"{path}/v{int(max(names))}") if names else None


class Tokens:
    """Names that may be used once and until a time, for downloads: kept by the process that gives them out."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.held = seconds, clock, {}

    def give(self, value) -> str:
        now = self.clock()
        self.held = {k: (v, until) for k, (v, until) in self.held.items() if until > now}
        name = secrets.token_urlsafe(24)
        self.held[name] = value, now + self.seconds
        return name

    def take(self, name: str):
        """The value, once; None if the name is unknown, used or too old."""
        value, until = self.held.pop(name, (None, 0.0))
        return value if until > self.clock() else None
