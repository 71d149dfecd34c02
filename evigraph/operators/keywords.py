"""Pairs of terms that may mean the same: by their letters and by the papers they stand in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cosine import best_pairs
from .similarity import tfidf


def letter_grams(terms: DataFrame, term: str, low: int = 3, high: int = 5) -> DataFrame:
    """(node, term, tf): runs of ``low`` to ``high`` characters within the words of each term, words with a blank at either
    end; a word shorter than a run counts once as it is."""
    words = F.transform(F.filter(F.split(F.lower(F.col(term)), r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def runs(w: Column, k: int) -> Column:
        n = F.length(w)
        several = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(w, i, F.lit(k)))
        whole = (n <= k) & (n > (k - 1 if k > low else 0))
        return F.when(n > k, several).when(whole, F.array(w)).otherwise(F.array().cast("array<string>"))

    def grams(w: Column) -> Column:
        return F.concat(*[runs(w, k) for k in range(low, high + 1)])

    rows = terms.select(F.col(term).alias("node"), F.explode(F.flatten(F.transform(words, grams))).alias("term"))
    return rows.groupBy("node", "term").agg(F.count("*").alias("tf"))


def lexical_pairs(terms: DataFrame, term: str, least: float, k: int) -> DataFrame:
    """(src, dst, weight): cosine of letter runs from ``least`` on, among the ``k`` best of either term."""
    return best_pairs(tfidf(letter_grams(terms, term), sublinear=False), least, k)  # equal up to rounding is equal


def centroids(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(term, v, papers, only): unit mean of the vectors (paper, v) of each term's papers (term, paper); ``only`` is the paper of
    a term that has one."""
    held = members.select("term", "paper").distinct()
    spread = held.join(vectors, "paper").select("term", "paper", F.posexplode("v").alias("i", "x"))
    mean = spread.groupBy("term", "i").agg(F.avg("x").alias("x"))
    v = mean.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    unit = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n = held.groupBy("term").agg(F.count("*").alias("papers"), F.min("paper").alias("only"))
    return v.where(unit > 0).select("term", F.transform("v", lambda x: x / unit).alias("v")).join(n, "term").withColumn("only", F.when(F.col("papers") == 1, F.col("only")))


def context_pairs(terms: DataFrame, near: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """(src, dst, weight), src < dst: of the pairs that ``near`` finds among the centroids, the ``k`` best of each lesser term;
    two terms of one and the same paper say nothing of each other."""
    pairs = near(terms)
    a, b = (terms.select(F.col("term").alias(n), F.col("only").alias(f"{n}_only")) for n in ("src", "dst"))
    told = pairs.join(a, "src").join(b, "dst").where("src_only is null or dst_only is null or src_only != dst_only")
    w = W.partitionBy("src").orderBy(F.desc("weight"), F.desc("dst"))
    return told.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("src", "dst", "weight")


def candidate_terms(lexical: DataFrame, context: DataFrame, most: int) -> DataFrame:
    """(pair_id, left, right, lexical, context): the union of both, the ``most`` best by the greater of the two, which is the
    report's length; ties by the pair."""
    rows = lexical.select(F.col("src").alias("left"), F.col("dst").alias("right"), F.col("weight").alias("lexical"), F.lit(0.0).alias("context"))
    rows = rows.unionByName(context.select(F.col("src").alias("left"), F.col("dst").alias("right"), F.lit(0.0).alias("lexical"), F.col("weight").alias("context")))
    one = rows.groupBy("left", "right").agg(F.round(F.max("lexical"), 6).alias("lexical"), F.round(F.max("context"), 6).alias("context"))
    top = one.orderBy(F.greatest("lexical", "context").desc(), "left", "right").limit(most)
    return top.select(F.concat(F.lit("KW"), F.substring(F.sha2(F.concat("left", F.lit("\0"), "right"), 256), 1, 12)).alias("pair_id"), "left", "right", "lexical", "context")
