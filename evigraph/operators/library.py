"""The library of papers and the state of its stages as tables: selections, gates, counts, queues and staleness.

Tables (column types as in ``SCHEMAS``) are Parquet folders with keyed rows; ``upserted`` gives a table's next state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import latest, upsert

#: The keyed tables of the library, by name: (schema, keys).
SCHEMAS: dict[str, tuple[str, list[str]]] = {
    "papers": ("paper_id string, source_relpath string, original_filename string, source_sha256 string, file_size bigint, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, active int, title string, doi string, year int, journal string, article_type string", ["paper_id"]),
    "stages": ("paper_id string, stage string, status string, input_hash string, output_path string, error string, started_at timestamp_ntz, finished_at timestamp_ntz", ["paper_id", "stage"]),
    "llm_runs": ("run_id string, paper_id string, stage string, chunk_id string, prompt_version string, schema_version string, model string, input_hash string, status string, error string, started_at timestamp_ntz, finished_at timestamp_ntz", ["run_id"]),
    "human_reviews": ("paper_id string, decision string, reviewer string, notes string, reviewed_at timestamp_ntz", ["paper_id"]),
    "api_cache": ("provider string, request_key string, status int, response string, fetched_at timestamp_ntz", ["provider", "request_key"]),
    "paper_metadata": ("paper_id string, title string, doi string, year int, journal string, openalex_id string, confidence double, match_status string, canonical_source string, metadata_json string, updated_at timestamp_ntz", ["paper_id"]),
    "reference_matches": ("citing_paper_id string, ref_id string, target_paper_id string, match_method string, match_score double, resolved_title string, resolved_doi string, resolved_year int, resolved_journal string, resolved_openalex_id string, status string, record_json string, updated_at timestamp_ntz", ["citing_paper_id", "ref_id"]),
    "doi_overrides": ("citing_paper_id string, ref_id string, doi string, note string, updated_at timestamp_ntz", ["citing_paper_id", "ref_id"]),
    "claim_relations": ("source_uid string, target_uid string, relation string, confidence double, rationale string, project_slug string", ["source_uid", "target_uid"]),
    "curation_events": ("event_id string, created_at timestamp_ntz, actor string, paper_id string, event_type string, entity_type string, entity_uid string, old_json string, new_json string, reason string", ["event_id"]),
    "projects": ("project_slug string, name string, created_at timestamp_ntz, updated_at timestamp_ntz", ["project_slug"]),
    "paper_projects": ("paper_id string, project_slug string, assigned_at timestamp_ntz", ["paper_id", "project_slug"]),
}


def empty(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name][0])


def upserted(name: str, held: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """The table with ``rows`` put in, of several rows of a key the one of the greatest ``order``."""
    keys = SCHEMAS[name][1]
    return upsert(held, latest(rows, keys, order), keys)


def selected(papers: DataFrame, ids: list[str] | None = None, first: int | None = None) -> DataFrame:
    """Active papers, of a list if one is given, in order of their id; ``first`` asks for a report's length."""
    rows = papers.where("active = 1")
    if ids:
        rows = rows.where(F.col("paper_id").isin(ids))
    rows = rows.orderBy("paper_id")
    return rows.limit(first) if first else rows


def gated(papers: DataFrame, status: DataFrame, allowed: list[str]) -> DataFrame:
    """Papers whose validation status is allowed; an empty list lets all pass."""
    return papers.join(status.where(F.col("overall_status").isin(allowed)).select("paper_id").distinct(), "paper_id", "left_semi") if allowed else papers


def complete(papers: DataFrame, artifacts: DataFrame, kinds: list[str]) -> DataFrame:
    """Papers that have all the ``kinds`` of artifacts (paper_id, kind)."""
    n = artifacts.where(F.col("kind").isin(kinds)).groupBy("paper_id").agg(F.count_distinct("kind").alias("n")).where(F.col("n") == len(kinds))
    return papers.join(n, "paper_id", "left_semi")


def blocked(papers: DataFrame, stages: DataFrame, stage: str, mark: str) -> DataFrame:
    """(paper_id, error): papers whose stage failed with an error that begins with ``mark``."""
    bad = stages.where((F.col("stage") == stage) & (F.col("status") == "error") & F.col("error").startswith(mark))
    return papers.select("paper_id").join(bad.select("paper_id", "error"), "paper_id")


def change_key(runs: DataFrame) -> DataFrame:
    """(n, last): a table's size and latest time, which change whenever it does."""
    return runs.agg(F.count("*").alias("n"), F.coalesce(F.max("finished_at").cast("string"), F.lit("")).alias("last"))


def run_seconds(runs: DataFrame) -> DataFrame:
    """Runs with ``seconds`` from start to finish, not below 0; null while a run goes on."""
    gap = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return runs.withColumn("seconds", F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0))))


def pending_chunks(chunks: DataFrame, done: DataFrame, phases: list[str]) -> DataFrame:
    """(phase, n_chunks, n_papers): chunks (paper_id, n) of the papers without the artifact (paper_id, phase) of each phase."""
    asked = chunks.select("paper_id", "n", F.explode(F.array(*map(F.lit, phases))).alias("phase"))
    return asked.join(done.select("paper_id", "phase").distinct(), ["paper_id", "phase"], "left_anti").groupBy("phase").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_papers"))


def reset(stages: DataFrame, reviews: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stages and reviews without those of the ``changed`` papers (paper_id)."""
    ids = changed.select("paper_id").distinct()
    return stages.join(ids, "paper_id", "left_anti"), reviews.join(ids, "paper_id", "left_anti")


def reviewed(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviews after decisions (paper_id, decision, reviewer, notes, reviewed_at); the decision ``pending`` takes a review away."""
    last = latest(decisions, ["paper_id"], "reviewed_at")
    return upsert(reviews, last, ["paper_id"]).where("decision != 'pending'")


def saved_override(overrides: DataFrame, references: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(overrides, refused): DOIs set by hand (citing_paper_id, ref_id, doi, note, updated_at) for references that exist; the
    others are refused. An empty DOI takes the override away."""
    known = references.select(F.col("paper_id").alias("citing_paper_id"), "ref_id").distinct()
    keys = ["citing_paper_id", "ref_id"]
    good = latest(wanted.join(known, keys, "left_semi"), keys, "updated_at")
    return upsert(overrides, good, keys).where("doi != ''"), wanted.join(known, keys, "left_anti")


def membership_counts(members: DataFrame, papers: DataFrame, asked: DataFrame, action: str, current: str, target: str | None = None) -> DataFrame:
    """(requested, added, removed, skipped) of a batch of paper ids; unknown and inactive papers are asked for in vain."""
    if action not in ("add", "remove", "copy", "move"):
        raise ValueError(f"no such action: {action}")
    if action in ("copy", "move") and (not target or target == current):
        raise ValueError("the target must be another project")
    ids = asked.select(F.trim("paper_id").alias("paper_id")).where("paper_id != ''")
    to = current if action == "add" else target
    have = members.groupBy("paper_id").agg(F.max(F.col("project_slug") == current).alias("here"), F.max(F.col("project_slug") == F.lit(to)).alias("there"))
    live = ids.distinct().join(papers.where("active = 1").select("paper_id"), "paper_id", "left_semi").join(have, "paper_id", "left").na.fill(False, ["here", "there"])
    added = {"add": ~F.col("there"), "remove": F.lit(False), "copy": ~F.col("there"), "move": F.col("here") & ~F.col("there")}[action]
    removed = F.col("here") if action in ("remove", "move") else F.lit(False)
    skipped = ~F.col("here") if action == "move" else F.lit(False)
    n = live.agg(F.count_if(added).alias("added"), F.count_if(removed).alias("removed"), F.count_if(skipped).alias("skipped"))
    return ids.agg(F.count("*").alias("requested")).crossJoin(n)  # one row and one row


def project_list(projects: DataFrame, summary: DataFrame, default: str = "default") -> DataFrame:
    """Projects (project_slug, name) with their counts, the default one first, then by name, and their place."""
    from pyspark.sql import Window as W

    rows = projects.join(summary, "project_slug", "left").na.fill(0, ["n_papers", "n_active"])
    w = W.orderBy(F.when(F.col("project_slug") == default, 0).otherwise(1), F.lower("name"), "project_slug")  # a list that people read
    return rows.select("project_slug", "name", "n_papers", "n_active", F.row_number().over(w).alias("place"))


def affected_projects(members: DataFrame, events: DataFrame, projects: DataFrame) -> DataFrame:
    """Projects to be rebuilt after events (paper_id): those of its papers, all of them if an event is of no paper."""
    of = members.join(events.where("paper_id is not null").select("paper_id").distinct(), "paper_id", "left_semi").select("project_slug")
    everywhere = projects.select("project_slug").join(events.where("paper_id is null").limit(1).select(F.lit(True).alias("all")), F.lit(True))  # one row at most
    return of.unionByName(everywhere.select("project_slug")).distinct()


def stale(built: DataFrame, projects: DataFrame, weights: dict[str, float], resolution: float) -> DataFrame:
    """(project_slug, stale): built artifacts (project_slug, built_at, weights map, resolution) that are older than their project
    or were built with other settings."""
    own = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    differ = F.exists(F.map_keys(own), lambda k: F.abs(F.coalesce(F.try_element_at("weights", k), F.lit(-1.0)) - F.element_at(own, k)) > 1e-9)
    old = F.col("built_at") < F.col("updated_at")
    return built.join(projects.select("project_slug", "updated_at"), "project_slug").select("project_slug", (old | differ | F.coalesce(F.abs(F.col("resolution") - resolution) > 1e-9, F.lit(False))).alias("stale"))


def raw_files(papers: DataFrame, uploads: DataFrame) -> DataFrame:
    """(path, file_name, registered): the registered files and uploads (path, file_name) besides them."""
    known = papers.select(F.col("source_relpath").alias("path"), F.col("original_filename").alias("file_name"), F.lit(True).alias("registered"))
    fresh = uploads.join(known.select("path"), "path", "left_anti").select("path", "file_name", F.lit(False).alias("registered"))
    return known.unionByName(fresh).orderBy(F.lower("file_name"), "path")


def first_given(base: DataFrame, over: list[DataFrame], key: str, fields: list[str], blank_too: bool = False) -> DataFrame:
    """``base`` with each field from the last of ``over`` that has a row for the key; a null there counts unless ``blank_too`` is
    set, when only fields that are not empty replace."""
    out = base
    for i, df in enumerate(over):
        named = df.select(key, *[F.col(f).alias(f"__{i}_{f}") for f in fields], F.lit(True).alias(f"__{i}"))
        out = out.join(named, key, "left")

        def pick(f: str, i: int) -> Column:
            new = F.col(f"__{i}_{f}")
            given = F.coalesce(F.col(f"__{i}"), F.lit(False))
            return F.when(given & ((F.coalesce(new.cast("string"), F.lit("")) != "") if blank_too else F.lit(True)), new).otherwise(F.col(f)).alias(f)

        out = out.select(*[pick(c, i) if c in fields else F.col(c) for c in base.columns])
    return out


def replaced_relations(held: DataFrame, new: DataFrame, project: str | None) -> DataFrame:
    """Claim relations after a run: of a run over all papers only the new ones stay; a run of a project replaces its own pairs."""
    keys = SCHEMAS["claim_relations"][1]
    return new if project is None else upsert(held, new.dropDuplicates(keys), keys)


def preferred_source(papers: DataFrame, stages: DataFrame, derivatives: DataFrame, folder: str) -> DataFrame:
    """(paper_id, path, derived): the file to be read of each paper: a derivative (paper_id, path, source_sha256) only if its stage
    ended well, it lies in ``folder`` and was made of the bytes that the paper has now; else the source itself."""
    well = stages.where((F.col("stage") == "ocr") & (F.col("status") == "success")).select("paper_id").distinct()
    good = derivatives.where(F.col("path").startswith(folder.rstrip("/") + "/") & ~F.col("path").contains("/../")).join(well, "paper_id", "left_semi")
    one = good.groupBy("paper_id", "source_sha256").agg(F.min("path").alias("derived_path"))
    met = papers.join(one, ["paper_id", "source_sha256"], "left")
    return met.select("paper_id", F.coalesce("derived_path", "source_relpath").alias("path"), F.col("derived_path").isNotNull().alias("derived"))


def image_only(pages: DataFrame, first: int = 5) -> DataFrame:
    """(paper_id, image_only): whether the ``first`` pages (paper_id, page, n_chars, n_images) have no text and an image each."""
    head = pages.where(F.col("page") <= first)
    return head.groupBy("paper_id").agg(((F.sum("n_chars") == 0) & (F.min("n_images") > 0)).alias("image_only"))


def ocr_status(papers: DataFrame, stages: DataFrame, derivatives: DataFrame) -> DataFrame:
    """(n_blocked, n_derived): papers that wait for their text to be recognised, and those whose has been."""
    b = blocked(papers, stages, "parse", "OCR_REQUIRED:").agg(F.count_distinct("paper_id").alias("n_blocked"))
    return b.crossJoin(papers.join(derivatives, "paper_id", "left_semi").agg(F.count_distinct("paper_id").alias("n_derived")))  # one row and one row


def cluster_rows(sizes: DataFrame, labels: DataFrame, names: DataFrame) -> DataFrame:
    """(cluster, name, size): a cluster's given name, else its label, at most 160 characters."""
    j = sizes.join(labels, "cluster", "left").join(names, "cluster", "left")
    said = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif(F.trim("label"), F.lit("")), F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
    return j.select("cluster", F.substring(said, 1, 160).alias("name"), F.greatest("size", F.lit(0)).alias("size")).orderBy("cluster")
