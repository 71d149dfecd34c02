"""Checks of extracted facts against their source; each returns issue rows (paper_id, severity, issue, item_id, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import numeric_tokens, plain_key
from .records import duplicates_of_first


def _issue(df: DataFrame, severity: str, issue: str, item: Column, detail: Column) -> DataFrame:
    return df.select("paper_id", F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), item.cast("string").alias("item_id"), detail.cast("string").alias("detail"))


def missing_evidence(items: DataFrame, valid: DataFrame) -> DataFrame:
    """Evidence ids (paper_id, item_id, evidence_id) that are not among ``valid`` (paper_id, evidence_id)."""
    lost = items.join(valid.select("paper_id", "evidence_id").distinct(), ["paper_id", "evidence_id"], "left_anti")
    return _issue(lost, "error", "missing_evidence_id", F.col("item_id"), F.col("evidence_id"))


def unknown_systems(refs: DataFrame, systems: DataFrame) -> DataFrame:
    lost = refs.join(systems.select("paper_id", "system_id").distinct(), ["paper_id", "system_id"], "left_anti")
    return _issue(lost, "error", "unknown_system_ref", F.col("item_id"), F.col("system_id"))


def numbers_not_found(measurements: DataFrame) -> DataFrame:
    """Explicit measurements (item_id, status, value_raw, evidence_text) with a number that their evidence lacks."""
    wanted, there = numeric_tokens(F.col("value_raw")), numeric_tokens(F.col("evidence_text"))
    missing = F.filter(wanted, lambda x: ~F.array_contains(there, x))
    bad = measurements.withColumn("missing", missing).where("status = 'explicitly_reported' and size(missing) > 0")
    return _issue(bad, "warning", "measurement_number_not_found_verbatim", F.col("item_id"), F.array_join("missing", ","))


def visual_marked_explicit(measurements: DataFrame) -> DataFrame:
    bad = measurements.where((F.col("status") == "explicitly_reported") & F.exists("evidence_sids", lambda x: x.startswith("vis:")))
    return _issue(bad, "warning", "visual_measurement_marked_explicit", F.col("item_id"), F.lit(""))


def background_only(claims: DataFrame) -> DataFrame:
    """Results claimed by primary research (article_type, claim_origin, roles) whose evidence stands in the background only."""
    bad = claims.where((F.col("article_type") == "primary_research") & (F.col("claim_origin") == "this_paper_result") & (F.size("roles") > 0) & F.forall("roles", lambda r: r == "background"))
    return _issue(bad, "error", "primary_result_supported_only_by_background", F.col("item_id"), F.array_join("roles", ","))


def citation_contexts(contexts: DataFrame, sentences: DataFrame, references: DataFrame) -> DataFrame:
    """Contexts (paper_id, item_id, sid, ref_ids) against sentences (paper_id, sid, citation_ref_ids) and references (paper_id, ref_id)."""
    s = sentences.select("paper_id", "sid", F.coalesce("citation_ref_ids", F.array().cast("array<string>")).alias("own"), F.lit(True).alias("there"))
    met = contexts.join(s, ["paper_id", "sid"], "left")
    lost = _issue(met.where("there is null"), "error", "citation_context_requires_text_sentence", F.col("item_id"), F.col("sid"))
    each = met.where("there").select("paper_id", "item_id", "own", F.explode("ref_ids").alias("ref_id"))
    unlisted = each.join(references.select("paper_id", "ref_id").distinct(), ["paper_id", "ref_id"], "left_anti")
    absent = each.where(~F.array_contains("own", F.col("ref_id")))
    return lost.unionByName(_issue(unlisted, "warning", "citation_ref_not_in_reference_list", F.col("item_id"), F.col("ref_id"))).unionByName(
        _issue(absent, "error", "citation_ref_not_present_in_evidence_sentence", F.col("item_id"), F.col("ref_id"))
    )


def duplicate_statements(claims: DataFrame) -> DataFrame:
    """Claims (paper_id, item_id, pos, statement) that say what an earlier one of the paper says."""
    keyed = claims.withColumn("said", plain_key(F.col("statement"))).where("said != ''")
    again = duplicates_of_first(keyed.select("paper_id", "said", "pos", "item_id"), ["paper_id", "said"], ["pos"], "item_id")
    return _issue(again, "warning", "possible_duplicate_claim", F.col("item_id"), F.col("duplicate_of"))


def status(papers: DataFrame, issues: DataFrame) -> DataFrame:
    """(paper_id, n_errors, n_warnings, overall_status) of all papers."""
    n = issues.groupBy("paper_id").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    out = papers.select("paper_id").distinct().join(n, "paper_id", "left").na.fill(0, ["n_errors", "n_warnings"])
    return out.withColumn("overall_status", F.when(F.col("n_errors") + F.col("n_warnings") > 0, "review_required").otherwise("pass"))
