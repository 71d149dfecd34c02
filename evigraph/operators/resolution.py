"""References resolved to the documents of a library: candidates by letter runs, scores, acceptance, further edges, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import surname, title_key, year_score
from ..runtime import written
from .nearness import close_pairs


def edit_ratio(a: Column, b: Column) -> Column:
    """1 less the edits over the greater length; 0 where one is empty."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def near_titles(left: DataFrame, right: DataFrame, key: str, least: float) -> DataFrame:
    """(key, c_key, ratio): all pairs of distinct keys whose ``edit_ratio`` is ``least`` or more, none left out.

    ``close_pairs`` finds the pairs that may be so near, by runs of letters that a near pair shares whatever is edited; the
    edits of those are then counted."""
    pairs = close_pairs(left.select(F.col(key).alias("k")), right.select(F.col(key).alias("k")), share=1 - least, left_rows=32768)
    longest = F.greatest(F.length("k"), F.length("c"))
    few = F.call_function("levenshtein", F.col("k"), F.col("c"), F.ceil((1 - least) * longest + 1e-9).cast("int"))  # -1 if there are more
    rated = pairs.withColumn("few", few).where("few >= 0").withColumn("ratio", 1 - F.col("few") / longest).where(F.col("ratio") >= least)
    return rated.select(F.col("k").alias(key), F.col("c").alias(f"c_{key}"), "ratio")


def best_titles(left: DataFrame, right: DataFrame, key: str, least: float, candidate: str) -> DataFrame:
    """(key, ratio, candidate): of each distinct left key the nearest right row of an ``edit_ratio`` of ``least`` or more, the
    greatest candidate of those alike to six places.

    A key that the right side has needs no search: no other is as near, but for keys so long that an edit is lost in rounding."""
    held = right.groupBy(key).agg(F.max(candidate).alias(candidate))
    keys = written(left.select(key).distinct().join(held, key, "left"), "keys")
    exact = F.col(candidate).isNotNull() & (F.length(key) < 1_000_000)
    near = near_titles(keys.where(~exact), held, key, least).join(held.withColumnRenamed(key, f"c_{key}"), f"c_{key}")
    best = near.groupBy(key).agg(F.max(F.struct(F.round("ratio", 6).alias("ratio"), candidate)).alias("top"))
    return keys.where(exact).select(key, F.lit(1.0).alias("ratio"), candidate).unionByName(best.select(key, "top.ratio", f"top.{candidate}"))


def scored(pairs: DataFrame, title: Column) -> DataFrame:
    """Pairs (author, year, journal and c_author, ...) with ``overall``; ``title`` is their title score."""
    mine, theirs = surname(F.col("author")), surname(F.col("c_author"))
    author = F.when((mine == "") | (theirs == ""), 0.45).when(mine == theirs, 1.0).otherwise(edit_ratio(mine, theirs))
    a, b = title_key(F.col("journal")), title_key(F.col("c_journal"))
    journal = F.when((a == "") | (b == ""), 0.45).otherwise(edit_ratio(a, b))
    overall = 0.72 * title + 0.12 * author + 0.10 * year_score(F.col("year"), F.col("c_year")) + 0.06 * journal
    return pairs.withColumn("title_score", F.round(title, 6)).withColumn("overall", F.round(overall, 6))


def local_match(scores: DataFrame, keys: list[str], candidate: str, bonus: Column, least_title: float = 0.90, least: float = 0.89, margin: float = 0.02) -> DataFrame:
    """The accepted candidate of each key: by overall score and ``bonus``, with a lead over the next; method tells of the bonus."""
    own = scores.withColumn("adjusted", F.round(F.col("overall") + bonus, 6)).withColumn("helped", bonus > 0)
    w = W.partitionBy(*keys).orderBy(F.desc("adjusted"), F.asc(candidate))
    best = own.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("adjusted").over(w)).where("r = 1")
    lead = F.round(F.col("adjusted") - F.coalesce("next", F.lit(0.0)), 6)
    kept = best.withColumn("lead", lead).where((F.col("title_score") >= least_title) & (F.col("adjusted") >= least) & (F.col("lead") >= margin))
    return kept.select(*keys, candidate, "adjusted", "lead", F.when(F.col("helped"), "title_author_year_plus_openalex_edge").otherwise("title_author_year").alias("method"))


def referenced_edges(referenced: DataFrame, library: DataFrame, matched: DataFrame) -> DataFrame:
    """(citing, target): works of the library (paper_id, work) that a paper refers to (citing, work), besides itself and those
    it is ``matched`` to (citing, target)."""
    met = referenced.where("work != ''").distinct().join(library.where("work != ''").select(F.col("paper_id").alias("target"), "work"), "work").where("citing != target")
    return met.select("citing", "target").distinct().join(matched.select("citing", "target").distinct(), ["citing", "target"], "left_anti")


def chosen_metadata(rows: DataFrame, least: float = 0.85) -> DataFrame:
    """Rows (paper_id, a_doi, a_score, b_doi, b_score) of two providers' answers (null score: no answer) with accepted sources,
    status (conflict, resolved, manual_review, unresolved), source and confidence; the first provider goes before."""
    ok = lambda s: F.coalesce(F.col(s) >= least, F.lit(False))
    a, b = ok("a_score"), ok("b_score")
    differ = a & b & (F.coalesce("a_doi", F.lit("")) != "") & (F.coalesce("b_doi", F.lit("")) != "") & (F.col("a_doi") != F.col("b_doi"))
    status = F.when(differ, "conflict").when(a | b, "resolved").when(F.col("a_score").isNotNull() | F.col("b_score").isNotNull(), "manual_review").otherwise("unresolved")
    source = F.when(differ, "original").when(a, "crossref").when(b, "openalex").otherwise("original")
    sure = F.greatest(F.when(a, F.col("a_score")).otherwise(0.0), F.when(b, F.col("b_score")).otherwise(0.0))
    doi = F.when(differ, None).when(a, F.col("a_doi")).when(b, F.col("b_doi"))
    return rows.select("paper_id", status.alias("status"), source.alias("source"), doi.alias("doi"), sure.alias("confidence"))


def reference_issues(references: DataFrame, records: DataFrame, failures: DataFrame, overrides: DataFrame) -> DataFrame:
    """(paper_id, ref_id, reason) of references that a person should look at, in that order.

    ``references`` (paper_id, ref_id, searchable), ``records`` (paper_id, ref_id, provider_error, recommended), ``failures``
    (paper_id, searched) of papers whose run failed, ``overrides`` (paper_id, ref_id). A failed search meets the references of
    its text, or where it tells none all; if it meets none, all references of the paper come up."""
    named = references.join(failures, "paper_id", "left")
    long = (F.length("searched") > 100) & (F.length("searchable") > 100) & (F.col("searched").contains(F.col("searchable")) | F.col("searchable").contains(F.col("searched")))
    hit = F.col("searched").isNotNull() & ((F.col("searched") == "") | (F.col("searched") == F.col("searchable")) | long)
    full = named.withColumn("failed", F.coalesce(hit, F.lit(False))).join(records, ["paper_id", "ref_id"], "left").join(overrides.select("paper_id", "ref_id", F.lit(True).alias("override")).distinct(), ["paper_id", "ref_id"], "left")
    reason = F.when(F.col("failed"), "stage_error").when(F.coalesce("provider_error", F.lit("")) != "", "provider_error").when(F.coalesce("recommended", F.lit(False)), "manual_recommended").when(F.col("override"), "override")
    told = full.withColumn("reason", reason)
    some = told.groupBy("paper_id").agg(F.count("reason").alias("n"))
    lost = told.join(some, "paper_id").withColumn("reason", F.when((F.col("n") == 0) & F.col("searched").isNotNull(), "unmapped_failure").otherwise(F.col("reason")))
    return lost.where("reason is not null").select("paper_id", "ref_id", "reason").orderBy("paper_id", "ref_id")
