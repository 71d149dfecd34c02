"""References to records that do not exist, kept incrementally (problem 4).

The ledger is keyed state in buckets: the parent index (number, whether it is active, when it was first seen), the
references by number with their verdict, null where the parent is usable, and where each record's reference now stands. A
batch reads and writes only the buckets its keys fall into: new references probe the index; parents that arrive or change
touch the references of their bucket, so an arrival resolves orphans and a deletion reopens them; a record that comes again
leaves its old number. Rows may come in any batches and any order and give the same ledger: of several rows of one record
or parent the latest holds, and deletions are rows too. Each batch commits a manifest that names the folder of every
bucket; a ledger opened on a path goes on from the last one, and a batch that was committed is not applied again.

Defined cases: a null id is no reference; an id that denotes no number is ``missing``; a record without a time is never
``late`` and has a null month; of several rows of one record or parent the latest holds, ties go to the greater values;
repeated rows count once; a deleted parent that comes again keeps its earliest first sight; empty tables give an empty ledger.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import own_folder, written

PARENTS = "num string, active int, last timestamp_ntz, seen timestamp_ntz, gone boolean"
RECORDS = "child_table string, child_column string, record string, record_key string, num string, at timestamp_ntz, gone boolean"
REFS = "child_table string, child_column string, record string, record_key string, num string, at timestamp_ntz, kind string"
_RECORD = ["child_table", "child_column", "record"]


def paper_number(value: Column) -> Column:
    """The digits of a paper id without leading zeros, however it is written; null for an id of another kind."""
    wide = "Ｐｐ＃０１２３４５６７８９－"
    plain = F.translate(value, wide, "Pp#0123456789-")
    number = F.regexp_extract(plain, r"(?U)^[\s#]*[Pp][\s\-_#:.‐-―−]*0*([0-9]+)\s*$", 1)
    return F.when(number != "", number)


def verdict(num: Column, active: Column, seen: Column, at: Column) -> Column:
    return F.when(num.isNull() | seen.isNull(), "missing").when(active == 0, "inactive").when(seen > at, "late")


def parent_rows(papers: DataFrame, gone: bool = False) -> DataFrame:
    """``papers`` as parents; ``gone`` for rows that tell of a deletion at their last_seen_at."""
    rows = papers.select(paper_number(F.col("paper_id")).alias("num"), F.col("active").cast("int").alias("active"), F.col("last_seen_at").cast("timestamp_ntz").alias("last"), F.col("first_seen_at").cast("timestamp_ntz").alias("seen"), F.lit(gone).alias("gone"))
    return rows.where("num is not null")


def _parents(rows: DataFrame) -> DataFrame:
    """The parents as their rows together tell."""
    return rows.groupBy("num").agg(F.max(F.struct("last", "gone", "active")).alias("top"), F.min("seen").alias("seen")).select("num", "top.active", "top.last", F.coalesce("seen", "top.last", F.lit("0001-01-01").cast("timestamp_ntz")).alias("seen"), "top.gone")


def reference_rows(child: DataFrame, child_table: str, column: str, record: list[str], key: list[Column], at: str, gone: bool = False) -> DataFrame:
    """``child`` as references of one column: ``record`` names the columns that identify a record, ``key`` its parts as
    reported. A row with a null id takes its record's reference away, as do all rows if ``gone``."""
    return child.select(
        F.lit(child_table).alias("child_table"),
        F.lit(column).alias("child_column"),
        F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in key]).alias("record_key"),
        F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in record])).alias("record"),
        paper_number(F.col(column)).alias("num"),
        F.col(at).cast("timestamp_ntz").alias("at"),
        (F.col(column).isNull() | F.lit(gone)).alias("gone"),
    )


@dataclass
class OrphanLedger:
    """State in ``path`` of the shared folder. A bucket's older folders are left to be removed."""

    spark: SparkSession
    path: str | None = None
    buckets: int = 16
    version: int = 0
    folders: dict[str, dict[int, int]] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.path = self.path or f"{own_folder(self.spark)}/ledger-{uuid.uuid4().hex}"
        names = self._names("commits")
        if names:
            text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/commits/{max(names)}", wholetext=True).collect())
            last = json.loads(text)
            self.version, self.buckets, self.applied = last["version"], last["buckets"], last["applied"]
            self.folders = {t: {int(b): v for b, v in f.items()} for t, f in last["folders"].items()}

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at, fs = self._fs(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in fs.listStatus(at) if not f.getPath().getName().startswith((".", "_"))] if fs.exists(at) else []

    def _commit(self) -> None:
        """The manifest appears whole, by a rename, once all its folders are written."""
        body = json.dumps({"version": self.version, "buckets": self.buckets, "applied": self.applied, "folders": self.folders})
        draft, fs = self._fs(f"{self.path}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(body.encode()))
        out.close()
        to, _ = self._fs(f"{self.path}/commits/{self.version:012}.json")
        fs.mkdirs(to.getParent())
        if not fs.rename(draft, to):
            raise OSError(f"version {self.version} of {self.path} was committed by another writer")

    def _read(self, name: str, schema: str, only: list[int] | None = None) -> DataFrame:
        held = self.folders.get(name, {})
        paths = [f"{self.path}/{name}/v={v}/bucket={b}" for b, v in sorted(held.items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(*map(F.col, columns))), F.lit(self.buckets)).cast("int")

    def _touched(self, *keyed: DataFrame) -> list[int]:
        """The buckets that rows with a column ``bucket`` fall into: at most ``buckets`` numbers."""
        out: set[int] = set()
        for df in keyed:
            out |= {r[0] for r in df.select("bucket").distinct().collect()}
        return sorted(out)

    def _write(self, name: str, df: DataFrame, touched: list[int]) -> None:
        """Puts ``df``, which holds all rows of the ``touched`` buckets, in their place."""
        folder = f"{name}/v={self.version + 1}"
        df.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{folder}")
        there = {int(n.split("=")[1]) for n in self._names(folder)}
        held = {b: v for b, v in self.folders.get(name, {}).items() if b not in touched}
        self.folders[name] = held | {b: self.version + 1 for b in there}

    @property
    def parents(self) -> DataFrame:
        return self._read("parents", PARENTS)

    @property
    def references(self) -> DataFrame:
        return self._read("refs", REFS)

    def apply(self, parents: DataFrame, references: DataFrame, source: str | None = None, batch: int = 0) -> bool:
        """Applies a batch of parent rows (``parent_rows``) and reference rows (``reference_rows``); False if the batch of
        this number of ``source`` has been applied before."""
        if source is not None and self.applied.get(source, -1) >= batch:
            return False
        came = written(_parents(parents).withColumn("bucket", self._bucket("num")), "came")
        top = F.max(F.struct("at", "gone", "num", "record_key"))
        new = written(references.groupBy(*_RECORD).agg(top.alias("top")).select(*_RECORD, "top.*").withColumn("bucket", self._bucket("record")), "new")
        # where the records of the batch stood before
        mine = self._touched(new)
        old = self._read("records", RECORDS, mine).withColumn("bucket", self._bucket("record"))
        both = old.withColumn("held", F.lit(True)).unionByName(new.withColumn("held", F.lit(False)))
        merged = both.groupBy("bucket", *_RECORD).agg(top.alias("top"), F.max(F.when(F.col("held"), F.struct("at", "gone", "num", "record_key"))).alias("was"))
        told = merged.select(*_RECORD, "top.record_key", "top.num", "top.at", "top.gone", "was", (~F.col("top").eqNullSafe(F.col("was"))).alias("moved"), "bucket")
        self._write("records", told, mine)
        moved = self._read("records", RECORDS + ", was struct<at timestamp_ntz, gone boolean, num string, record_key string>, moved boolean", mine).where("moved")
        added = moved.where("not gone").select(*_RECORD, "record_key", "num", "at").withColumn("bucket", self._bucket("num", "record"))
        left = moved.where("was is not null and not was.gone").select(*_RECORD, "was.num").withColumn("bucket", self._bucket("num", "record"))
        # the index, then the references of all buckets that a reference entered or left, or a parent changed
        theirs = self._touched(came)
        index = self._read("parents", PARENTS, theirs).withColumn("bucket", self._bucket("num")).unionByName(came)
        self._write("parents", _parents(index).withColumn("bucket", self._bucket("num")), theirs)
        touched = self._touched(came, added, left)
        stay = self._read("refs", REFS, touched).drop("kind").join(left.select(*_RECORD), _RECORD, "left_anti")
        now = stay.unionByName(added.drop("bucket"))
        usable = self._read("parents", PARENTS, touched).where("not gone").select("num", "active", "seen")
        judged = now.join(usable, "num", "left").withColumn("kind", verdict(F.col("num"), F.col("active"), F.col("seen"), F.col("at")))
        self._write("refs", judged.select(*[c.split()[0] for c in REFS.split(", ")], self._bucket("num", "record").alias("bucket")), touched)
        if source is not None:
            self.applied[source] = batch
        self.version += 1
        self._commit()
        return True

    def open(self) -> DataFrame:
        """The open orphans: (child_table, child_column, record_key, kind, year_month)."""
        return self.references.where("kind is not null").select("child_table", "child_column", "record_key", "kind", F.date_format("at", "yyyy-MM").alias("year_month"))

    def snapshot(self) -> DataFrame:
        """Open orphans counted by table, column, kind and month."""
        return self.open().groupBy("child_table", "child_column", "kind", "year_month").agg(F.count("*").alias("n_orphans"))


def orphan_ledger(papers: DataFrame, matches: DataFrame, projects: DataFrame, snapshots: bool = False) -> tuple[OrphanLedger, DataFrame | None]:
    """A ledger fed with the rows of the three tables year by year, as they arrived, updates of records included.

    Also, if asked for, the snapshots: orphans open after each year, by table, column and kind. As many batches as there are
    years; a row without a time comes before all."""
    match_key, record = [F.col("citing_paper_id"), F.col("ref_id")], ["citing_paper_id", "ref_id"]
    rows = matches.select("citing_paper_id", "ref_id", "target_paper_id", "updated_at")
    year = lambda at: F.coalesce(F.year(at), F.lit(0))
    # of a record's rows of one year the latest holds before it becomes references, one for each column
    own = rows.withColumn("period", year(F.col("updated_at")))
    held = own.groupBy("period", *record).agg(F.max(F.struct("updated_at", "target_paper_id")).alias("top")).select("period", *record, "top.*")
    mine = projects.select("paper_id", "project_slug", "assigned_at").withColumn("period", year(F.col("assigned_at")))
    mine = mine.groupBy("period", "paper_id", "project_slug").agg(F.max("assigned_at").alias("assigned_at"))
    parts = [
        (held, "reference_matches_v4", "citing_paper_id", record, match_key, "updated_at"),
        (held, "reference_matches_v4", "target_paper_id", record, match_key, "updated_at"),
        (mine, "paper_projects", "paper_id", ["paper_id", "project_slug"], [F.col("paper_id"), F.col("project_slug")], "assigned_at"),
    ]
    refs = None
    for df, *how in parts:
        one = reference_rows(df, *how)
        refs = one if refs is None else refs.unionByName(one)
    refs = written(refs.withColumn("period", year(F.col("at"))), "references")
    parents = written(parent_rows(papers).withColumn("period", year(F.col("last"))), "parents")
    periods = sorted({r[0] for df in (refs, parents) for r in df.select("period").distinct().collect()})  # one for each year
    ledger, taken = OrphanLedger(papers.sparkSession), None
    for period in periods:
        ledger.apply(parents.where(F.col("period") == period).drop("period"), refs.where(F.col("period") == period).drop("period"))
        if snapshots:
            now = ledger.open().groupBy("child_table", "child_column", "kind").agg(F.count("*").alias("n_open")).select(F.lit(period).alias("year"), "child_table", "child_column", "kind", "n_open")
            taken = now if taken is None else taken.unionByName(now)
    return ledger, taken
