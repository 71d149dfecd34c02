"""What a cluster of papers is about: its most frequent terms, titles and a label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .records import top_terms


def listed(df: DataFrame, group: str, order: list, value: str, most: int, name: str) -> DataFrame:
    """(group, name): the first ``most`` values of each group joined by ' | '."""
    w = W.partitionBy(group).orderBy(*order)
    top = df.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", value))), lambda x: x[value]), " | ").alias(name))


def cluster_summary(members: DataFrame, terms: dict[str, tuple[DataFrame, int]], titles: DataFrame, most_titles: int = 20) -> DataFrame:
    """(cluster, size, the lists of each kind of term, titles): ``members`` (cluster, paper_id), ``terms`` by kind (paper_id, key,
    inventory_id) and how many to list, ``titles`` (paper_id, title)."""
    out = members.groupBy("cluster").agg(F.count_distinct("paper_id").alias("size"))
    for kind, (df, most) in terms.items():
        top = top_terms(df.join(members, "paper_id"), ["cluster"], "key", "inventory_id", most)
        out = out.join(listed(top, "cluster", ["rank"], "key", most, f"top_{kind}"), "cluster", "left")
    named = members.join(titles.where("title is not null and title != ''"), "paper_id")
    return out.join(listed(named, "cluster", ["paper_id"], "title", most_titles, "titles"), "cluster", "left")


#: Words that tell nothing of a cluster.
GENERIC = ("polyethylene", "glycol", "peg", "polymer", "polymers", "water", "aqueous", "solution", "solutions")


def cluster_labels(members: DataFrame, terms: DataFrame, vectors: DataFrame, most: int = 3) -> DataFrame:
    """(cluster, label): the most frequent terms (paper_id, key, inventory_id), or where there is none the words of greatest mean
    weight (node, term, w) that are not generic, or 'Cluster n'."""
    top = top_terms(terms.join(members, "paper_id"), ["cluster"], "key", "inventory_id", most)
    by_term = listed(top, "cluster", ["rank"], "key", most, "by_term")
    size = members.groupBy("cluster").agg(F.count_distinct("paper_id").alias("size"))
    own = vectors.join(members.select(F.col("paper_id").alias("node"), "cluster").distinct(), "node")
    plain = ~F.exists(F.split("term", " "), lambda t: t.isin(*GENERIC))
    mean = own.where(plain).groupBy("cluster", "term").agg(F.round(F.sum("w"), 9).alias("w"))
    by_word = listed(mean, "cluster", [F.desc("w"), F.asc("term")], "term", most, "by_word")
    out = size.join(by_term, "cluster", "left").join(by_word, "cluster", "left")
    label = F.coalesce(F.nullif(F.replace("by_term", F.lit(" | "), F.lit(" / ")), F.lit("")), F.nullif(F.replace("by_word", F.lit(" | "), F.lit(" / ")), F.lit("")), F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
    return out.select("cluster", label.alias("label"))
