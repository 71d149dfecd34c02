"""Documents as rows of blocks with their sentences: statistics, sections, search texts, the sentences of a page, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import section_role


def sentence_rows(blocks: DataFrame) -> DataFrame:
    """(paper_id, block_id, n, heading, sid, page, text) of blocks (paper_id, block_id, heading, sentences), in document order."""
    x = blocks.select("paper_id", "block_id", "heading", F.posexplode("sentences").alias("n", "s"))
    return x.select("paper_id", "block_id", "n", "heading", F.col("s.sid").alias("sid"), F.col("s.page").alias("page"), F.col("s.text").alias("text"), F.col("s.citation_ref_ids").alias("refs"))


def statistics(blocks: DataFrame, references: DataFrame) -> DataFrame:
    """(paper_id, sentences, sections, blocks, pages, n_references)."""
    n = blocks.groupBy("paper_id").agg(F.sum(F.coalesce(F.size("sentences"), F.lit(0))).alias("sentences"), F.count_distinct("section_id").alias("sections"), F.count("*").alias("blocks"), F.count_distinct("page").alias("pages"))
    r = references.select("paper_id", "ref_id").distinct().groupBy("paper_id").agg(F.count("*").alias("n_references"))
    return n.join(r, "paper_id", "left").na.fill(0, ["n_references"])


def locations(sentences: DataFrame) -> DataFrame:
    """(paper_id, sid, heading, role): where a sentence id stands; of several places the last holds."""
    at = F.struct("block_id", "n")
    g = sentences.where("sid is not null").groupBy("paper_id", "sid").agg(F.max(F.struct(at.alias("at"), F.coalesce("heading", F.lit("")).alias("heading")))["heading"].alias("heading"))
    return g.select("paper_id", "sid", "heading", section_role(F.col("heading")).alias("role"))


#: Words of the headings of closing sections.
CLOSING = ("conclusion", "concluding", "summary", "outlook")


def closing(heading: Column) -> Column:
    key = F.regexp_replace(F.lower(F.coalesce(heading, F.lit(""))), "[^a-z]+", " ")
    return F.exists(F.array(*map(F.lit, CLOSING)), lambda w: key.contains(w))


def section_texts(sentences: DataFrame, closing_only: bool) -> DataFrame:
    """(paper_id, text, sids): the sentences of a paper's closing sections, or of all, in order, and their ids."""
    rows = sentences.where(closing(F.col("heading"))) if closing_only else sentences
    g = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("block_id", "n", F.trim(F.coalesce("text", F.lit(""))).alias("t"), "sid"))).alias("s"))
    texts = F.array_join(F.filter(F.transform("s", lambda x: x["t"]), lambda t: t != ""), " ")
    return g.select("paper_id", texts.alias("text"), F.array_sort(F.array_distinct(F.array_compact(F.transform("s", lambda x: x["sid"])))).alias("sids"))


def on_page(sentences: DataFrame, most: int = 12) -> DataFrame:
    """(paper_id, page, line, rank): the first sentences of each page as '[sid] text'."""
    w = W.partitionBy("paper_id", "page").orderBy("block_id", "n")
    top = sentences.where("page is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return top.select("paper_id", "page", F.concat(F.lit("["), F.coalesce("sid", F.lit("")), F.lit("] "), F.coalesce("text", F.lit(""))).alias("line"), "rank")


def search_text(parts: list[Column]) -> Column:
    """What a paper is found by: its parts joined, blanks left out."""
    return F.lower(F.concat_ws(" ", *[F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts]))


def text_or_memory(abstract: Column, memory: list[Column]) -> Column:
    """The abstract, or where it is blank what the memory of the paper says."""
    own = F.trim(F.coalesce(abstract, F.lit("")))
    return F.when(own != "", own).otherwise(F.concat_ws(" ", *[F.nullif(F.trim(m), F.lit("")) for m in memory]))


def revealed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, year): the year from which an edge shows, that of the later of its papers (node, year); edges of a paper
    without a year never show."""
    a = nodes.select(F.col("node").alias("src"), F.col("year").alias("y1"))
    b = nodes.select(F.col("node").alias("dst"), F.col("year").alias("y2"))
    return edges.join(a, "src").join(b, "dst").where("y1 is not null and y2 is not null").select("src", "dst", F.greatest("y1", "y2").alias("year"))
