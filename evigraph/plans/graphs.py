"""Queries on the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse, plain_key
from ..operators import knowledge
from ..runtime import table, written
from .layers import _HELD, _MATCHES, _citations, _flat, _held, _key, _number


def _selected(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d).where("active = 1")


def _entries(spark: SparkSession, d: str, array: str, fields: dict[str, str]) -> DataFrame:
    """Entries of an array of the inventories of active papers: paper_id, inventory_id, pos, the fields, systems of the chunk and
    ``ord``."""
    extra = ["systems"] if array != "systems" else []
    inv = table(spark, d, "inventory").select("inventory_id", "paper_id", array, *extra).distinct().join(_selected(spark, d).select("paper_id"), "paper_id", "left_semi")
    x = inv.select("inventory_id", "paper_id", *extra, F.posexplode(array).alias("pos", "x"))
    named = lambda s: F.coalesce(F.nullif(collapse(s["normalized_name"]), F.lit("")), collapse(s["system_name_raw"]))
    systems = [F.transform(F.coalesce("systems", F.array().cast(inv.schema["systems"].dataType)), named).alias("systems")] if extra else []
    sids = F.coalesce(F.array_compact("x.evidence_sids"), F.array().cast("array<string>")).alias("evidence_sids")
    return x.select("inventory_id", "paper_id", "pos", *[F.col(f"x.{f}").alias(n) for n, f in fields.items()], sids, *systems, F.struct(F.col("paper_id").alias("a"), F.col("inventory_id").alias("b"), F.col("pos").alias("c")).alias("ord"))


def _shown(df: DataFrame) -> DataFrame:
    shown = F.coalesce(F.nullif(collapse(F.col("norm")), F.lit("")), collapse(F.col("raw")))
    return df.withColumn("shown", shown).withColumn("key", plain_key(F.col("shown"))).where("key != ''")


_KINDS = {
    "property": ("STUDIES_PROPERTY", "studied_properties", {"norm": "property_normalized", "raw": "property_raw"}, 10),
    "method": ("USES_METHOD", "methods", {"norm": "method_normalized", "raw": "method_raw"}, 10),
    "keyword": ("HAS_KEYWORD", "systems", {"norm": "system_type", "raw": "system_type"}, 9),
    "system": ("STUDIES_SYSTEM", "systems", {"norm": "normalized_name", "raw": "system_name_raw"}, 10),
}


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the active papers: objectives stand for claims, global conditions for measurements, system types for
    keywords; facts are about the systems of their chunk."""
    sel = _selected(spark, d).select("paper_id", F.coalesce("title", F.lit("")).alias("title"), F.struct(F.col("paper_id").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("c")).alias("ord"))
    nodes, edges, terms = [knowledge.node_rows(sel, knowledge.paper_id(F.col("paper_id")), "paper", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("paper_id")), 18)], [], {}
    for kind, (relation, array, fields, size) in _KINDS.items():
        items = _shown(_entries(spark, d, array, fields))
        e, n = knowledge.term_edges(items, kind, relation, "shown", size)
        nodes.append(n)
        edges.append(e)
        terms[kind] = items
    m = _entries(spark, d, "global_conditions", {"property": "condition_type", "value_raw": "value_raw"}).withColumn("measurement_id", F.concat_ws("-", "inventory_id", "pos"))
    c = _entries(spark, d, "objectives", {"statement": "text"}).withColumn("claim_id", F.concat_ws("-", "inventory_id", "pos")).withColumn("said", F.col("statement"))
    for e, n in (knowledge.measurement_parts(m), knowledge.claim_parts(c, {k: terms[k] for k in ("property", "keyword")})):
        nodes += n
        edges += e
    own = _citations(spark, d)
    numbered = _selected(spark, d).select(F.regexp_extract("paper_id", r"^P0*(\d+)$", 1).alias("n"), "paper_id")
    named = own.join(numbered.select(F.col("n").alias("citing"), F.col("paper_id").alias("a")), "citing").join(numbered.select(F.col("n").alias("cited"), F.col("paper_id").alias("b")), "cited")
    edges.append(knowledge.cites(named.select(F.col("a").alias("citing"), F.col("b").alias("cited")), sel))
    return written(knowledge.build_nodes(nodes), "nodes"), written(knowledge.build_edges(edges), "edges")


def q60_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1]


def q61_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[0]


def q62_graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.kind_counts(*_graph(spark, d))


def q63_dangling(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the graph left without an end once the measurements are hidden."""
    nodes, edges = _graph(spark, d)
    return knowledge.dangling(edges, nodes.where("node_type != 'measurement'")).select("source", "target", "relation")


_SEARCHES = ("micelle", "paper:P0003", "glass", "storage modulus")


def q64_best_node(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.best_nodes(_graph(spark, d)[0], spark.createDataFrame([(q,) for q in _SEARCHES], "query string"))


def q65_visible(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return knowledge.visible(nodes, edges, ["paper", "claim", "property"], ["HAS_CLAIM", "CLAIM_ABOUT_PROPERTY", "STUDIES_PROPERTY", "CITES"]).select("source", "target", "relation")


def q66_expand_node(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return knowledge.expand_node(edges, nodes, nodes.where("node_type = 'paper'").select("node_id"), 50)


QUERIES = {f.__name__: f for f in (q60_graph_edges, q61_graph_nodes, q62_graph_counts, q63_dangling, q64_best_node, q65_visible, q66_expand_node)}


def _unnested(array: str, fields: dict[str, str], name: str, systems: bool) -> str:
    extra = ", systems" if systems and array != "systems" else ""
    shown = ", ".join(f"{array}[i].{f} AS {n}" for n, f in fields.items())
    named = ", list_transform(coalesce(systems, []), lambda s: coalesce(nullif(" + _flat("s.normalized_name") + ", ''), " + _flat("s.system_name_raw") + ")) AS systems" if extra else ""
    return f"{name} AS (SELECT paper_id, inventory_id, i - 1 AS pos, {shown}{named}, (paper_id, inventory_id, i - 1) AS ord FROM (SELECT DISTINCT inventory_id, paper_id, {array}{extra} FROM inventory WHERE paper_id IN (SELECT paper_id FROM sel)), unnest(range(1, len({array}) + 1)) AS u(i))"


def _named(source: str, name: str) -> str:
    shown = f"coalesce(nullif({_flat('norm')}, ''), {_flat('raw')})"
    return f"{name} AS (SELECT *, {_key('shown')} AS key FROM (SELECT *, {shown} AS shown FROM {source}) WHERE {_key('shown')} <> '')"


def _slug(kind: str, value: str) -> str:
    return f"concat('{kind}:', sha1({_key(value)})[1:16])"


_SAYS = "(contains(text, key) OR (len(long) > 0 AND list_aggregate(list_transform(long, lambda t: contains(text, t)), 'bool_and')))"
_LONG = "list_filter(string_split(key, ' '), lambda t: length(t) >= 4)[1:3] AS long"


def _about(kind: str) -> str:
    return f"SELECT concat('claim:', paper_id, ':', claim_id) AS source, {_slug(kind, 'key')} AS target, 'CLAIM_ABOUT_{kind.upper()}' AS relation FROM (SELECT c.paper_id, claim_id, {_key('statement')} AS text, t.key, {_LONG} FROM claims c JOIN (SELECT DISTINCT paper_id, key FROM t_{kind}) t USING (paper_id)) WHERE {_SAYS}"


_GRAPH = (
    f"WITH {_HELD}, sel AS (SELECT * FROM held WHERE active = 1), "
    + ", ".join(_unnested(a, f, f"e_{k}", False) + ", " + _named(f"e_{k}", f"t_{k}") for k, (_, a, f, _) in _KINDS.items())
    + ", "
    + _unnested("global_conditions", {"property": "condition_type", "value_raw": "value_raw"}, "meas0", True)
    + ", meas AS (SELECT *, concat(inventory_id, '-', pos) AS measurement_id FROM meas0), "
    + _unnested("objectives", {"statement": "text"}, "claims0", True)
    + f", claims AS (SELECT *, concat(inventory_id, '-', pos) AS claim_id FROM claims0), {_MATCHES}, "
    + f"cites AS (SELECT DISTINCT a.paper_id AS citing, b.paper_id AS cited FROM m JOIN sel a ON {_number('citing_paper_id')} = regexp_extract(a.paper_id, '^P0*(\\d+)$', 1) JOIN sel b ON {_number('target_paper_id')} = regexp_extract(b.paper_id, '^P0*(\\d+)$', 1)), "
    + "edges AS (SELECT DISTINCT source, target, relation, 1.0::DOUBLE AS weight, true AS directed FROM ("
    + " UNION ALL ".join(f"SELECT concat('paper:', paper_id) AS source, {_slug(k, 'shown')} AS target, '{r}' AS relation FROM t_{k}" for k, (r, *_) in _KINDS.items())
    + " UNION ALL SELECT concat('paper:', paper_id), concat('measurement:', paper_id, ':', measurement_id), 'REPORTS_MEASUREMENT' FROM meas"
    + f" UNION ALL SELECT concat('measurement:', paper_id, ':', measurement_id), {_slug('property', 'property')}, 'MEASURES_PROPERTY' FROM meas WHERE {_key('property')} <> ''"
    + f" UNION ALL SELECT concat('measurement:', paper_id, ':', measurement_id), {_slug('system', 's')}, 'MEASURED_ON' FROM meas, unnest(systems) AS v(s) WHERE {_key('s')} <> ''"
    + " UNION ALL SELECT concat('paper:', paper_id), concat('claim:', paper_id, ':', claim_id), 'HAS_CLAIM' FROM claims"
    + f" UNION ALL SELECT concat('claim:', paper_id, ':', claim_id), {_slug('system', 's')}, 'CLAIM_ABOUT_SYSTEM' FROM claims, unnest(systems) AS v(s) WHERE {_key('s')} <> ''"
    + f" UNION ALL {_about('property')} UNION ALL {_about('keyword')}"
    + " UNION ALL SELECT concat('paper:', citing), concat('paper:', cited), 'CITES' FROM cites)), "
    + "n0 AS (SELECT concat('paper:', paper_id) AS node_id, 'paper' AS node_type, coalesce(nullif(title, ''), paper_id) AS label, 18 AS node_size, (paper_id, 0, 0) AS ord FROM sel"
    + "".join(f" UNION ALL SELECT {_slug(k, 'shown')}, '{k}', shown, {s}, ord FROM t_{k}" for k, (_, _, _, s) in _KINDS.items())
    + " UNION ALL SELECT concat('measurement:', paper_id, ':', measurement_id), 'measurement', concat(coalesce(property, 'None'), ': ', coalesce(value_raw, 'None')), 8, ord FROM meas"
    + f" UNION ALL SELECT {_slug('property', 'property')}, 'property', property, 10, ord FROM meas WHERE {_key('property')} <> ''"
    + " UNION ALL SELECT concat('claim:', paper_id, ':', claim_id), 'claim', coalesce(nullif(statement, ''), concat('claim:', paper_id, ':', claim_id)), 8, ord FROM claims), "
    + "nodes AS (SELECT node_id, arg_min(node_type, (ord, node_type)) AS node_type, arg_min(label, (ord, label)) FILTER (coalesce(label, '') <> '') AS label, arg_min(node_size, (ord, node_size)) AS node_size FROM n0 GROUP BY node_id) "
)
_FIRST = "CASE relation " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in knowledge.PRIORITY.items()) + " ELSE 99 END"

SQL = {
    "q60_graph_edges": _GRAPH + "SELECT * FROM edges",
    "q61_graph_nodes": _GRAPH + "SELECT * FROM nodes",
    "q62_graph_counts": _GRAPH + "SELECT 'node' AS what, node_type AS kind, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', relation, count(*) FROM edges GROUP BY ALL",
    "q63_dangling": _GRAPH + ", ids AS (SELECT node_id FROM nodes WHERE node_type <> 'measurement') SELECT source, target, relation FROM edges WHERE source NOT IN (SELECT node_id FROM ids) OR target NOT IN (SELECT node_id FROM ids)".replace(", ids", ", ids", 1),
    "q64_best_node": _GRAPH + "SELECT query, arg_min(node_id, (-score, node_id)) AS node_id, max(score) AS score FROM (SELECT query, node_id, CASE WHEN lower(node_id) = lower(query) THEN 8.0 WHEN starts_with(lower(coalesce(label, '')), lower(query)) THEN 4.0 WHEN contains(lower(coalesce(label, '')), lower(query)) THEN 2.0 END::DOUBLE + CASE WHEN node_type = 'paper' THEN 0.25 ELSE 0 END AS score FROM nodes, (VALUES " + ", ".join(f"('{q}')" for q in _SEARCHES) + ") AS q(query)) WHERE score IS NOT NULL GROUP BY query",
    "q65_visible": _GRAPH + ", ids AS (SELECT node_id FROM nodes WHERE node_type IN ('paper', 'claim', 'property')) SELECT source, target, relation FROM edges WHERE relation IN ('HAS_CLAIM', 'CLAIM_ABOUT_PROPERTY', 'STUDIES_PROPERTY', 'CITES') AND source IN (SELECT node_id FROM ids) AND target IN (SELECT node_id FROM ids)",
    "q66_expand_node": _GRAPH + f", b AS (SELECT source AS seed, target AS node, relation, weight FROM edges UNION ALL SELECT target, source, relation, weight FROM edges) SELECT seed, node, relation, row_number() OVER (PARTITION BY seed ORDER BY {_FIRST}, weight DESC, label, node, relation) AS rank FROM b JOIN nodes ON node_id = node WHERE seed IN (SELECT node_id FROM nodes WHERE node_type = 'paper') QUALIFY rank <= 50",
}
SQL = {k: v.replace(") , ids", "), ids").replace(") , b AS", "), b AS") for k, v in SQL.items()}
