"""The registry of source files and the state of processing: reconcile a scan, skip what is done, projects and their papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(registered: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, sha, paper_id, change) of a scan (path, sha) against the registry (paper_id, path, sha, active).

    change: ``unchanged`` (same path and bytes), ``duplicate`` (bytes kept under another path that is still there),
    ``renamed`` (bytes known, their old path is gone), ``changed`` (known path, new bytes), ``added``; registered paths that
    are gone come as ``vanished``. No file is ever deleted.
    """
    scan = scanned.select("path", "sha").distinct()
    by_path = registered.select("path", F.col("paper_id").alias("path_id"), F.col("sha").alias("old_sha"))
    by_sha = registered.join(scan.select("path", F.lit(True).alias("there")), "path", "left").groupBy("sha").agg(F.min(F.struct((-F.col("active")).alias("a"), "paper_id", F.coalesce("there", F.lit(False)).alias("there"))).alias("kept"))
    s = scan.join(by_path, "path", "left").join(by_sha, "sha", "left")
    same = F.col("old_sha") == F.col("sha")
    known = F.col("kept").isNotNull() & (F.coalesce("path_id", F.lit("")) != F.col("kept.paper_id"))
    change = F.when(same, "unchanged").when(known & F.col("kept.there"), "duplicate").when(known, "renamed").when(F.col("path_id").isNotNull(), "changed").otherwise("added")
    out = s.select("path", "sha", F.when(F.col("path_id").isNotNull() & (same | ~known), F.col("path_id")).otherwise(F.col("kept.paper_id")).alias("paper_id"), change.alias("change"))
    moved = out.where("change = 'renamed'").select("paper_id")
    gone = registered.where("active = 1").join(scan.select("path"), "path", "left_anti").join(moved, "paper_id", "left_anti").select("path", "sha", "paper_id", F.lit("vanished").alias("change"))
    return out.unionByName(gone)


def pending(inputs: DataFrame, done: DataFrame, keys: list[str], input_hash: str = "input_hash") -> DataFrame:
    """Inputs whose hash differs from that of their last successful run: the micro-batch of an incremental stage."""
    return inputs.join(done.where("status = 'success'").select(*keys, input_hash), [*keys, input_hash], "left_anti")


def project_summary(projects: DataFrame, members: DataFrame, papers: DataFrame) -> DataFrame:
    """(project_slug, n_papers, n_active): distinct papers of each project, projects without papers included."""
    known = papers.select("paper_id", F.col("active").alias("a"))
    joined = projects.select("project_slug").distinct().join(members.select("project_slug", "paper_id"), "project_slug", "left").join(known, "paper_id", "left")
    return joined.groupBy("project_slug").agg(F.count_distinct("paper_id").alias("n_papers"), F.count_distinct(F.when(F.col("a") == 1, F.col("paper_id"))).alias("n_active"))


def change_membership(members: DataFrame, chosen: DataFrame, action: str, source: str, target: str | None = None) -> DataFrame:
    """Memberships (paper_id, project_slug) after ``add``, ``remove``, ``copy`` or ``move`` of the chosen papers."""
    ids = chosen.select("paper_id").distinct()
    base = members.select("paper_id", "project_slug").distinct()
    if action in ("copy", "move") and not target:
        raise ValueError("copy and move need a target")
    if action not in ("add", "remove", "copy", "move"):
        raise ValueError(f"no such action: {action}")
    here = base.where(F.col("project_slug") == source).join(ids, "paper_id", "left_semi")
    if action == "add":
        return base.unionByName(ids.select("paper_id", F.lit(source).alias("project_slug"))).distinct()
    if action == "remove":
        return base.exceptAll(here)
    more = here.select("paper_id", F.lit(target).alias("project_slug"))
    return (base if action == "copy" else base.exceptAll(here)).unionByName(more).distinct()


def master_library(papers: DataFrame, members: DataFrame) -> DataFrame:
    """Each paper with the sorted list of its projects."""
    m = members.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_set("project_slug")), ",").alias("projects"))
    return papers.join(m, "paper_id", "left").withColumn("projects", F.coalesce("projects", F.lit("")))


def paper_order(year: Column, *rest: Column, descending: bool = False) -> list[Column]:
    """Sort order of listings: by year, unknown years last either way, then the rest."""
    return [year.desc_nulls_last() if descending else year.asc_nulls_last(), *[c.asc() for c in rest]]
