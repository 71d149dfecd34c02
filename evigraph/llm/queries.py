"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import authors, bpe, canonical, matching, packing, scans, sentences, spans


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_terms(canonical.entered_values(table(spark, d, "inventory")), table(spark, d, "terms"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("inventory_id", "term_type", "item_no", "canonical")


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that have no term, with how often each was entered."""
    values = canonical.entered_values(table(spark, d, "inventory"))
    return canonical.map_values(values, table(spark, d, "terms")).where("canonical = ''").select("term_type", "raw", "n")


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return authors.link_names(authors.author_strings(table(spark, d, "reference"), table(spark, d, "paper_metadata_v4")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return authors.variant_pairs(_linked(spark, d))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with its entity and the number of its links."""
    return authors.classes(_linked(spark, d))


def _repaired(spark: SparkSession, d: str, found: bool) -> DataFrame:
    blocks, refs = table(spark, d, "paper_json"), table(spark, d, "reference")
    journals = refs.select(F.col("journal").alias("title")).unionByName(table(spark, d, "papers").select(F.col("journal").alias("title"))).distinct()
    prose = blocks.where("kind = 'paragraph'").select("text")
    return scans.repair(scans.scan_records(blocks, refs), prose, journals, found)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d, True)


def p3_text(spark: SparkSession, d: str) -> DataFrame:
    """The scanned records as continuous paragraphs."""
    return _repaired(spark, d, False)


def _matched(spark: SparkSession, d: str) -> DataFrame:
    records = matching.open_records(table(spark, d, "reference_matches_v4"))
    return matching.match(records, matching.held_papers(table(spark, d, "papers")), ["citing_paper_id", "ref_id"], "citing")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).select("citing_paper_id", "ref_id", F.col("entity").alias("paper_id"))


def p5_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The matches with the marginal probability of each."""
    return _matched(spark, d).select("citing_paper_id", "ref_id", F.col("entity").alias("paper_id"), F.round("confidence", 4).alias("confidence"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "paper_json").where("kind = 'paragraph'").select("block_id", "text").distinct()
    return sentences.split_sentences(blocks).select("block_id", "end_char")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text"))


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    windows = {r["window_id"]: r["capacity_tokens"] for r in table(spark, d, "context_windows").collect()}  # a fixed table of 3 rows
    return packing.pack(bpe.token_counts(table(spark, d, "documents").select("doc_id", "text")), windows)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_chars(table(spark, d, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_text": p3_text, "p5_found": p5_found, "p5_confidence": p5_confidence, "p6_found": p6_found, "p7_ids": p7_ids, "p8_windows": p8_windows, "p9_found": p9_found}

SQL: dict[str, str] = {}
