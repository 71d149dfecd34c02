"""A typed property graph built from extraction tables: nodes and edges as unions of projections.

Where several rows name one node or edge the first holds, in the order of a column ``ord`` that callers give (a struct of
paper, record and position), never in the order of rows; empty attributes are filled from later rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import node_slug, plain_key


def term_id(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), node_slug(value))


def paper_id(value: Column) -> Column:
    return F.concat(F.lit("paper:"), value)


def edge_rows(df: DataFrame, source: Column, target: Column, relation: str, weight: Column | None = None, directed: bool = True) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    a, b = (source, target) if directed else (F.least(source, target), F.greatest(source, target))
    order = F.col("ord") if "ord" in df.columns else F.struct(source.cast("string").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("c"))
    return df.select(a.alias("source"), b.alias("target"), F.lit(relation).alias("relation"), w.cast("double").alias("weight"), F.lit(directed).alias("directed"), order.alias("ord")).where("source is not null and target is not null")


def build_edges(parts: list[DataFrame]) -> DataFrame:
    """One edge for each (source, target, relation), of the weight seen first, to 6 digits."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("source", "target", "relation", "directed").agg(F.round(F.min(F.struct("ord", "weight"))["weight"], 6).alias("weight"))


def node_rows(df: DataFrame, ident: Column, kind: str, label: Column, size: int) -> DataFrame:
    return df.select(ident.alias("node_id"), F.lit(kind).alias("node_type"), label.alias("label"), F.lit(size).alias("node_size"), "ord").where("node_id is not null")


def build_nodes(parts: list[DataFrame]) -> DataFrame:
    """One node for each id (node_id, node_type, label, node_size): the first label that is not empty."""
    rows = reduce(DataFrame.unionByName, parts)
    named = F.when(F.coalesce("label", F.lit("")) != "", F.struct("ord", "label"))
    return rows.groupBy("node_id").agg(F.min(F.struct("ord", "node_type"))["node_type"].alias("node_type"), F.min(named)["label"].alias("label"), F.min(F.struct("ord", "node_size"))["node_size"].alias("node_size"))


def term_edges(items: DataFrame, kind: str, relation: str, value: str, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) from papers to their terms; terms without a key are left out."""
    keyed = items.where(plain_key(F.col(value)) != "")
    if "ord" not in keyed.columns:
        keyed = keyed.withColumn("ord", F.struct(F.col("paper_id").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("c")))
    return edge_rows(keyed, paper_id(F.col("paper_id")), term_id(kind, F.col(value)), relation), node_rows(keyed, term_id(kind, F.col(value)), kind, F.col(value), size)


def evidence_id(paper: Column, sid: Column) -> Column:
    return F.concat(F.lit("visual:"), paper, F.lit(":"), F.replace(sid, F.lit(":"), F.lit("_")))


def visual_support(items: DataFrame, uid: Column) -> DataFrame:
    """Edges from facts (paper_id, evidence_sids) to the pictures and tables among their evidence."""
    each = items.select("paper_id", "ord", uid.alias("uid"), F.explode("evidence_sids").alias("sid")).where(F.col("sid").startswith("vis:"))
    return edge_rows(each, F.col("uid"), evidence_id(F.col("paper_id"), F.col("sid")), "SUPPORTED_BY_VISUAL")


def measurement_parts(m: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(edges, nodes) of measurements (paper_id, measurement_id, property, value_raw, systems, evidence_sids, ord): the property
    measured becomes a node even where no paper lists it."""
    uid = F.concat(F.lit("measurement:"), F.col("paper_id"), F.lit(":"), F.col("measurement_id"))
    known = m.where("measurement_id is not null")
    of = known.where(plain_key(F.col("property")) != "")
    on = known.select("paper_id", "measurement_id", "ord", F.explode("systems").alias("system")).where(plain_key(F.col("system")) != "")
    edges = [
        edge_rows(known, paper_id(F.col("paper_id")), uid, "REPORTS_MEASUREMENT"),
        edge_rows(of, uid, term_id("property", F.col("property")), "MEASURES_PROPERTY"),
        edge_rows(on, uid, term_id("system", F.col("system")), "MEASURED_ON"),
        visual_support(known, uid),
    ]
    label = F.concat(F.coalesce("property", F.lit("None")), F.lit(": "), F.coalesce("value_raw", F.lit("None")))
    return edges, [node_rows(known, uid, "measurement", label, 8), node_rows(of, term_id("property", F.col("property")), "property", F.col("property"), 10)]


def says(statement: Column, term: Column) -> Column:
    """Whether a normalised statement holds a normalised term, or the first three of its longer words."""
    long = F.slice(F.filter(F.split(term, " "), lambda t: F.length(t) >= 4), 1, 3)
    return (term != "") & (statement.contains(term) | ((F.size(long) > 0) & F.forall(long, lambda t: statement.contains(t))))


def claim_uid() -> Column:
    return F.concat(F.lit("claim:"), F.col("paper_id"), F.lit(":"), F.col("claim_id"))


def claim_parts(claims: DataFrame, terms: dict[str, DataFrame]) -> tuple[list[DataFrame], list[DataFrame]]:
    """(edges, nodes) of claims (paper_id, claim_id, statement, said, systems, evidence_sids, ord), ``said`` being what the claim
    says in full; ``terms`` has the papers' terms (paper_id, key, shown) of each kind. A claim meets the terms of its paper."""
    known = claims.where("claim_id is not null")
    about = known.select("paper_id", "claim_id", "ord", F.explode("systems").alias("system")).where(plain_key(F.col("system")) != "")
    edges = [edge_rows(known, paper_id(F.col("paper_id")), claim_uid(), "HAS_CLAIM"), edge_rows(about, claim_uid(), term_id("system", F.col("system")), "CLAIM_ABOUT_SYSTEM"), visual_support(known, claim_uid())]
    text = known.select("paper_id", "claim_id", "ord", plain_key(F.col("said")).alias("text"))
    for kind, df in terms.items():
        met = text.join(df.select("paper_id", "key").distinct(), "paper_id").where(says(F.col("text"), F.col("key")))
        edges.append(edge_rows(met, claim_uid(), term_id(kind, F.col("key")), f"CLAIM_ABOUT_{kind.upper()}"))
    return edges, [node_rows(known, claim_uid(), "claim", F.coalesce(F.nullif(F.col("statement"), F.lit("")), claim_uid()), 8)]


def visual_parts(visuals: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(edges, nodes) of pictures and tables (paper_id, evidence_id, caption, ord)."""
    known = visuals.where("evidence_id is not null")
    uid = evidence_id(F.col("paper_id"), F.col("evidence_id"))
    return [edge_rows(known, paper_id(F.col("paper_id")), uid, "HAS_VISUAL")], [node_rows(known, uid, "visual", F.coalesce(F.nullif(F.col("caption"), F.lit("")), F.col("evidence_id")), 7)]


def cites(citations: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges of citations (citing, cited) whose both ends are among the ``selected`` papers (paper_id)."""
    ids = selected.select("paper_id").distinct()
    kept = citations.join(ids.withColumnRenamed("paper_id", "citing"), "citing", "left_semi").join(ids.withColumnRenamed("paper_id", "cited"), "cited", "left_semi")
    return edge_rows(kept, paper_id(F.col("citing")), paper_id(F.col("cited")), "CITES")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select(F.col("node_id"))
    a = edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_anti")
    b = edges.join(ids.withColumnRenamed("node_id", "target"), "target", "left_anti")
    return a.unionByName(b).distinct()


def kind_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes by type and edges by relation."""
    a = nodes.groupBy(F.lit("node").alias("what"), F.col("node_type").alias("kind")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.lit("edge").alias("what"), F.col("relation").alias("kind")).agg(F.count("*").alias("n")))


def best_nodes(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, node_id, score): the node a search text means most: its id 8, a label that begins with it 4, one that holds it 2, a
    paper a quarter more; the first by id among equals. ``queries`` is a short stated list (query) and is broadcast."""
    asked = F.broadcast(queries.select(F.lower(F.trim("query")).alias("q"), "query").where("q != ''").limit(1000))
    label = F.lower(F.coalesce("label", F.lit("")))
    text = F.when(F.lower("node_id") == F.col("q"), 8.0).when(label.startswith(F.col("q")), 4.0).when(label.contains(F.col("q")), 2.0)
    met = nodes.select("node_id", "node_type", "label").join(asked, text.isNotNull())
    rated = met.select("query", "node_id", (text + F.when(F.col("node_type") == "paper", 0.25).otherwise(0.0)).alias("score"))
    return rated.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("less"), "node_id")).alias("best")).select("query", "best.node_id", (-F.col("best.less")).alias("score"))


def visible(nodes: DataFrame, edges: DataFrame, kinds: list[str], relations: list[str]) -> DataFrame:
    """Edges of the chosen relations between nodes of the chosen types."""
    ids = nodes.where(F.col("node_type").isin(kinds)).select("node_id")
    kept = edges.where(F.col("relation").isin(relations))
    return kept.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")


#: Which relations a view opens first.
PRIORITY = {"STUDIES_PROPERTY": 0, "USES_METHOD": 1, "STUDIES_SYSTEM": 2, "HAS_KEYWORD": 3, "HAS_CLAIM": 4, "REPORTS_MEASUREMENT": 5, "HAS_VISUAL": 6, "CITES": 7}


def expand_node(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(seed, node, relation, rank): what opens around each seed (node_id): by priority of the relation, weight, label and id."""
    both = edges.select(F.explode(F.array(F.struct(F.col("source").alias("seed"), F.col("target").alias("node")), F.struct(F.col("target").alias("seed"), F.col("source").alias("node")))).alias("e"), "relation", "weight").select("e.*", "relation", "weight")
    near = both.join(seeds.select(F.col("node_id").alias("seed")), "seed", "left_semi").join(nodes.select(F.col("node_id").alias("node"), "label"), "node")
    first = F.coalesce(F.element_at(F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))]), F.col("relation")), F.lit(99))
    w = W.partitionBy("seed").orderBy(first, F.desc("weight"), F.asc("label"), F.asc("node"), F.asc("relation"))
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("seed", "node", "relation", "rank")
