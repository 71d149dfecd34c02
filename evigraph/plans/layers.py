"""Queries on similarity layers, graphs and the knowledge graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse, doi_key, openalex_key, plain_key, title_key
from ..operators import graph, knowledge, records, similarity
from ..operators.orphans import paper_number
from ..runtime import table, written


def _customer_parts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("node"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item")).join(orders, "o_orderkey").select("node", "item")


def q01_coupling_topk(spark: SparkSession, d: str) -> DataFrame:
    """Bibliographic coupling: customers stand for citing papers, parts for cited works."""
    pairs = similarity.set_pairs(_customer_parts(spark, d), "node", "item", "coupling", 0.08, min_shared=2)
    return similarity.topk_symmetric(pairs, 6).withColumn("weight", F.round("weight", 6))


def q02_jaccard_topk(spark: SparkSession, d: str) -> DataFrame:
    pairs = similarity.set_pairs(_customer_parts(spark, d), "node", "item", "jaccard", 0.04)
    return similarity.topk_symmetric(pairs, 6).withColumn("weight", F.round("weight", 6))


def _held(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers").distinct()
    return records.latest(papers, ["paper_id"], "last_seen_at")


def q03_tfidf_pairs(spark: SparkSession, d: str) -> DataFrame:
    terms = similarity.terms_of(_held(spark, d), "paper_id", "title")
    return similarity.sparse_cosine_pairs(similarity.tfidf(terms), 0.6).withColumn("weight", F.round("weight", 6))


def q04_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 8 nearest of all rows to each of the query set, the rows whose id is divisible by 100."""
    v = table(spark, d, "embeddings")
    return similarity.dense_search(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", 8, 0.25).withColumn("weight", F.round("weight", 4))


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    m = records.latest(table(spark, d, "reference_matches_v4").select("citing_paper_id", "ref_id", "updated_at", "resolved_doi", "resolved_openalex_id", "resolved_title").distinct(), ["citing_paper_id", "ref_id"], "updated_at")
    doi, oa, title = doi_key(F.col("resolved_doi")), openalex_key(F.col("resolved_openalex_id")), title_key(F.col("resolved_title"))
    sig = F.when(doi != "", F.concat(F.lit("doi:"), doi)).when(oa != "", F.concat(F.lit("oa:"), oa)).when(F.length(title) >= 18, F.concat(F.lit("title:"), title))
    return m.select("citing_paper_id", "ref_id", sig.alias("signature")).where("signature is not null")


def q44_signature_precedence(spark: SparkSession, d: str) -> DataFrame:
    return _signatures(spark, d)


def _items(spark: SparkSession, d: str, array: str, norm: str, raw: str) -> DataFrame:
    """Papers' terms: (paper_id, inventory_id, pos, shown, key)."""
    inv = table(spark, d, "inventory").select("inventory_id", "paper_id", array).distinct()
    x = inv.select("inventory_id", "paper_id", F.posexplode(array).alias("pos", "x"))
    shown = F.coalesce(F.nullif(collapse(F.col(f"x.{norm}")), F.lit("")), collapse(F.col(f"x.{raw}")))
    return x.select("inventory_id", "paper_id", "pos", shown.alias("shown")).withColumn("key", plain_key(F.col("shown"))).where("key != ''")


def _whole_layer(members: DataFrame, threshold: float) -> DataFrame:
    """Edges of all papers, those with equal sets too."""
    pairs = similarity.set_pairs(members, "paper_id", "key", "jaccard", threshold)
    return similarity.expand_pairs(pairs, similarity.set_classes(members, "paper_id", "key"))


def _property_layer(spark: SparkSession, d: str) -> DataFrame:
    p = _items(spark, d, "studied_properties", "property_normalized", "property_raw")
    return _whole_layer(p, 0.18)


def q49_set_classes(spark: SparkSession, d: str) -> DataFrame:
    """Papers with equal sets of properties, which are worked once and share their edges."""
    p = _items(spark, d, "studied_properties", "property_normalized", "property_raw")
    return similarity.set_classes(p, "paper_id", "key")


def _method_layer(spark: SparkSession, d: str) -> DataFrame:
    return _whole_layer(_items(spark, d, "methods", "method_normalized", "method_raw"), 0.18)


def q56_customer_classes(spark: SparkSession, d: str) -> DataFrame:
    """Customers with equal sets of parts, of which q01 and q02 hold the representative only."""
    return similarity.set_classes(_customer_parts(spark, d), "node", "item")


def _combined(spark: SparkSession, d: str) -> DataFrame:
    return graph.combine_layers({"property": _property_layer(spark, d), "method": _method_layer(spark, d)})


def q05_combined_edges(spark: SparkSession, d: str) -> DataFrame:
    e = _combined(spark, d)
    part = lambda n: F.round(F.coalesce(F.col("components")[n], F.lit(0.0)), 6).alias(n)
    return e.select("src", "dst", part("property"), part("method"), F.round("weight", 6).alias("weight"), graph.dominant_layer(F.col("components")).alias("layer"))


def q06_weighted_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.weighted_degree(_combined(spark, d)).select("node", F.round("degree", 5).alias("degree"), "n_edges", F.round("size", 5).alias("size"))


def _citations(spark: SparkSession, d: str) -> DataFrame:
    m = records.latest(table(spark, d, "reference_matches_v4").select("citing_paper_id", "ref_id", "updated_at", "target_paper_id").distinct(), ["citing_paper_id", "ref_id"], "updated_at")
    return m.select(paper_number(F.col("citing_paper_id")).alias("citing"), paper_number(F.col("target_paper_id")).alias("cited")).where("citing is not null and cited is not null").distinct()


def q46_citation_arrows(spark: SparkSession, d: str) -> DataFrame:
    return graph.directions(_citations(spark, d))


def _citation_edges(spark: SparkSession, d: str) -> DataFrame:
    """All citations between two papers, whichever cites the other."""
    c = _citations(spark, d).where("citing != cited")
    return c.groupBy(F.least("citing", "cited").alias("src"), F.greatest("citing", "cited").alias("dst")).agg((F.count("*") + F.lit(0.0)).alias("weight"))


def q28_expand_one_hop(spark: SparkSession, d: str) -> DataFrame:
    seeds = _held(spark, d).where("active = 1").select(F.col("paper_id").alias("node"))
    return graph.expand(_combined(spark, d).select("src", "dst", F.round("weight", 6).alias("weight")), seeds, 5)


def q29_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_citation_edges(spark, d))


def q30_spanning_forest(spark: SparkSession, d: str) -> DataFrame:
    return graph.spanning_forest(_combined(spark, d).select("src", "dst", F.round("weight", 6).alias("weight")))


def q47_sparsified(spark: SparkSession, d: str) -> DataFrame:
    return graph.sparsify(_combined(spark, d).select("src", "dst", F.round("weight", 6).alias("weight")), 6, 2000)


def _projected(spark: SparkSession, d: str) -> DataFrame:
    """Layer edges within each project."""
    m = table(spark, d, "paper_projects").select(paper_number(F.col("paper_id")).alias("n"), "project_slug").where("n is not null").distinct()
    e = _combined(spark, d).select(paper_number(F.col("src")).alias("a"), paper_number(F.col("dst")).alias("b"), "src", "dst", "weight")
    left = m.select(F.col("n").alias("a"), "project_slug")
    right = m.select(F.col("n").alias("b"), "project_slug")
    return e.join(left, "a").join(right, ["b", "project_slug"]).select("project_slug", "src", "dst", "weight")


def _project_sets(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Keys of each project's papers, from which the project's task makes the edges of ``_projected``, and the layers' bounds."""
    kinds = {"property": _items(spark, d, "studied_properties", "property_normalized", "property_raw"), "method": _items(spark, d, "methods", "method_normalized", "method_raw")}
    held = written(reduce(DataFrame.unionByName, [x.select("paper_id", F.lit(k).alias("kind"), F.col("key").alias("item")) for k, x in kinds.items()]).where("paper_id is not null").distinct(), "sets")
    number = similarity.item_number(held)
    sets = held.groupBy(F.col("paper_id").alias("node")).agg(*[F.collect_list(F.when(F.col("kind") == k, number("item"))).alias(k) for k in kinds])
    m = table(spark, d, "paper_projects").select(paper_number(F.col("paper_id")).alias("n"), "project_slug").where("n is not null").distinct()
    placed = written(sets.withColumn("n", paper_number(F.col("node"))).join(m, "n").drop("n"), "project_sets")
    return placed, {k: (0.18, graph.LAYER_WEIGHTS[k]) for k in kinds}


def q31_clusters(spark: SparkSession, d: str) -> DataFrame:
    sets, layers = _project_sets(spark, d)
    return graph.cluster_sets(sets, "project_slug", layers)


def q48_layout(spark: SparkSession, d: str) -> DataFrame:
    sets, layers = _project_sets(spark, d)
    return graph.layout_sets(sets, "project_slug", layers)


def q32_circle_layout(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "paper_projects").select("project_slug", "paper_id").distinct()
    return graph.circle(m, "project_slug", "paper_id", 850.0)


def q33_statement_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Statements of different papers: cosine, raised to .38 where their papers share a property, 5 of each statement."""
    inv = table(spark, d, "inventory").select("inventory_id", "paper_id", "objectives").distinct()
    s = inv.select("paper_id", F.posexplode("objectives").alias("pos", "o"), "inventory_id").select("paper_id", F.concat_ws(":", "inventory_id", "pos").alias("uid"), F.col("o.text").alias("text")).where("text is not null")
    cos = similarity.sparse_cosine_pairs(similarity.tfidf(similarity.terms_of(s, "uid", "text"), sublinear=False), 0.5)
    paper = s.select("uid", "paper_id")
    met = cos.join(paper.select(F.col("uid").alias("src"), F.col("paper_id").alias("p1")), "src").join(paper.select(F.col("uid").alias("dst"), F.col("paper_id").alias("p2")), "dst").where("p1 != p2")
    met = written(met, "statement_pairs")
    props = _items(spark, d, "studied_properties", "property_normalized", "property_raw").groupBy("paper_id").agg(F.collect_set("key").alias("props"))
    x, y = props.select(F.col("paper_id").alias("p1"), F.col("props").alias("x")), props.select(F.col("paper_id").alias("p2"), F.col("props").alias("y"))
    low = met.where("weight < 0.38").join(x, "p1", "left").join(y, "p2", "left")  # only these can be raised
    raised = low.select("src", "dst", F.greatest("weight", F.when(F.arrays_overlap("x", "y"), 0.38).otherwise(0.0)).alias("weight"))
    rated = met.where("weight >= 0.38").select("src", "dst", "weight").unionByName(raised).withColumn("weight", F.round("weight", 6))
    return similarity.topk_symmetric(rated, 5)


def _term_relations(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of property keys that share a word, by the share of words they share; keys of the same words in another order share all."""
    keys = _items(spark, d, "studied_properties", "property_normalized", "property_raw").select("key").distinct()
    words = keys.select("key", F.explode(F.split("key", " ")).alias("word"))
    lex = similarity.expand_pairs(similarity.set_pairs(words, "key", "word", "jaccard", 0.45), similarity.set_classes(words, "key", "word"))
    return similarity.relation_scores(lex.select(F.col("src").alias("left"), F.col("dst").alias("right"), F.col("weight").alias("lexical"), F.lit(0.0).alias("context")))


def q34_soft_keyword(spark: SparkSession, d: str) -> DataFrame:
    p = _items(spark, d, "studied_properties", "property_normalized", "property_raw")
    pairs = similarity.soft_set_pairs(p, "paper_id", "key", _term_relations(spark, d), 0.1)
    return pairs.select("src", "dst", F.round("weight", 4).alias("weight"))


def q35_knowledge_edges(spark: SparkSession, d: str) -> DataFrame:
    p, _ = knowledge.term_edges(_items(spark, d, "studied_properties", "property_normalized", "property_raw"), "property", "STUDIES_PROPERTY", "shown")
    m, _ = knowledge.term_edges(_items(spark, d, "methods", "method_normalized", "method_raw"), "method", "USES_METHOD", "shown")
    c = _citations(spark, d)
    cites = knowledge.edge_rows(c, knowledge.paper_id(F.col("citing")), knowledge.paper_id(F.col("cited")), "CITES")
    return knowledge.build_edges([p, m, cites])


QUERIES = {f.__name__: f for f in (q01_coupling_topk, q02_jaccard_topk, q03_tfidf_pairs, q04_cosine_topk, q05_combined_edges, q06_weighted_degree, q28_expand_one_hop, q29_components, q30_spanning_forest, q31_clusters, q32_circle_layout, q33_statement_pairs, q34_soft_keyword, q35_knowledge_edges, q44_signature_precedence, q46_citation_arrows, q47_sparsified, q48_layout, q49_set_classes, q56_customer_classes)}

_SETS = "s0 AS (SELECT DISTINCT o_custkey AS node, l_partkey AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey), s AS (SELECT min(node) AS node, unnest(items) AS item FROM (SELECT node, list(item ORDER BY item) AS items FROM s0 GROUP BY node) GROUP BY items), n AS (SELECT node, count(*) AS n FROM s GROUP BY node), o AS (SELECT a.node AS src, b.node AS dst, count(*) AS shared FROM s a JOIN s b ON a.item = b.item AND a.node < b.node GROUP BY ALL)"


def _topk(k: int, source: str = "p") -> str:
    return f"b AS (SELECT src, dst, weight FROM {source} UNION ALL SELECT dst, src, weight FROM {source}), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst DESC) AS r FROM b) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight FROM r WHERE r <= {k} GROUP BY 1, 2"


def _key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _flat(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[\\s\\x{{00A0}}\\x{{3000}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{1680}}\\x{{0085}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g'), '^ | $', '', 'g'))"


def _terms(array: str, norm: str, raw: str, name: str) -> str:
    shown = f"coalesce(nullif({_flat(f'x.{norm}')}, ''), {_flat(f'x.{raw}')})"
    return f"{name} AS (SELECT inventory_id, paper_id, shown, {_key('shown')} AS key FROM (SELECT inventory_id, paper_id, {shown} AS shown FROM (SELECT DISTINCT inventory_id, paper_id, {array} AS a FROM inventory), unnest(a) AS u(x)) WHERE {_key('shown')} <> '')"


_PROPS = _terms("studied_properties", "property_normalized", "property_raw", "props")
_METHODS = _terms("methods", "method_normalized", "method_raw", "meths")


def _layer(source: str, name: str) -> str:
    return f"{name}_s AS (SELECT DISTINCT paper_id AS node, key AS item FROM {source}), {name}_n AS (SELECT node, count(*) AS n FROM {name}_s GROUP BY node), {name} AS (SELECT src, dst, shared / (x.n + y.n - shared) AS weight FROM (SELECT a.node AS src, b.node AS dst, count(*) AS shared FROM {name}_s a JOIN {name}_s b ON a.item = b.item AND a.node < b.node GROUP BY ALL) JOIN {name}_n x ON src = x.node JOIN {name}_n y ON dst = y.node WHERE shared / (x.n + y.n - shared) >= 0.18)"


_COMBINED = f"{_PROPS}, {_METHODS}, {_layer('props', 'lp')}, {_layer('meths', 'lm')}, combined AS (SELECT src, dst, coalesce(lp.weight, 0) AS property, coalesce(lm.weight, 0) AS method, 0.45 * coalesce(lp.weight, 0) + 0.35 * coalesce(lm.weight, 0) AS weight FROM lp FULL JOIN lm USING (src, dst))"
_HELD = "held AS (SELECT * FROM (SELECT DISTINCT * FROM papers) QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY last_seen_at DESC, active DESC) = 1)"
_MATCHES = "m AS (SELECT * FROM reference_matches_v4 QUALIFY row_number() OVER (PARTITION BY citing_paper_id, ref_id ORDER BY updated_at DESC, target_paper_id DESC NULLS LAST) = 1)"


def _number(column: str) -> str:
    return f"nullif(regexp_extract(translate({column}, 'Ｐｐ＃０１２３４５６７８９－', 'Pp#0123456789-'), '^[\\s#]*[Pp][\\s\\-_#:.]*0*([0-9]+)\\s*$', 1), '')"


_CITES = f"{_MATCHES}, cites AS (SELECT DISTINCT {_number('citing_paper_id')} AS citing, {_number('target_paper_id')} AS cited FROM m WHERE {_number('citing_paper_id')} IS NOT NULL AND {_number('target_paper_id')} IS NOT NULL)"


def _doi(x: str) -> str:
    return f"trim(trim(regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), '^https?://(?:dx\\.)?doi\\.org/', ''), '^doi:\\s*', '')), '.,;()[]{{}}<>')"


def _title(x: str) -> str:
    return f"trim(regexp_replace(replace(regexp_replace(lower({_flat(x)}), '<[^>]+>', ' ', 'g'), '&amp;', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def _tfidf(source: str, node: str, text: str, tf: str) -> str:
    return f"w AS (SELECT {node} AS node, unnest(regexp_extract_all(lower(coalesce({text}, '')), '\\b[a-z0-9_]{{2,}}\\b')) AS term FROM {source}), t AS (SELECT node, term, count(*) AS tf FROM w GROUP BY ALL), nd AS (SELECT count(DISTINCT node) AS n FROM t), df AS (SELECT term, count(*) AS df FROM t GROUP BY term), raw AS (SELECT node, term, {tf} * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN df USING (term), nd), len AS (SELECT node, sqrt(sum(w * w)) AS len FROM raw GROUP BY node), v AS (SELECT node, term, w / len AS w FROM raw JOIN len USING (node)), cosine AS (SELECT a.node AS src, b.node AS dst, sum(a.w * b.w) AS weight FROM v a JOIN v b ON a.term = b.term AND a.node < b.node GROUP BY ALL)"


#: An edge is in the forest unless its ends are joined by heavier edges.
_FOREST = "ranked AS (SELECT src, dst, round(weight, 6) AS weight, row_number() OVER (ORDER BY round(weight, 6) DESC, src DESC, dst DESC) AS id FROM combined), ways AS (SELECT src AS a, dst AS b, id FROM ranked UNION ALL SELECT dst, src, id FROM ranked), reach AS (SELECT id, src AS node FROM ranked UNION SELECT reach.id, ways.b FROM reach JOIN ways ON ways.a = reach.node AND ways.id < reach.id), forest AS (SELECT src, dst, weight FROM ranked WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.id = ranked.id AND reach.node = ranked.dst))"

SQL = {
    "q01_coupling_topk": f"WITH {_SETS}, p AS (SELECT src, dst, shared / sqrt(x.n * y.n) AS weight FROM o JOIN n x ON src = x.node JOIN n y ON dst = y.node WHERE shared >= 2 AND shared / sqrt(x.n * y.n) >= 0.08), " + _topk(6).replace("max(weight)", "round(max(weight), 6)"),
    "q02_jaccard_topk": f"WITH {_SETS}, p AS (SELECT src, dst, shared / (x.n + y.n - shared) AS weight FROM o JOIN n x ON src = x.node JOIN n y ON dst = y.node WHERE shared / (x.n + y.n - shared) >= 0.04), " + _topk(6).replace("max(weight)", "round(max(weight), 6)"),
    "q03_tfidf_pairs": f"WITH {_HELD}, {_tfidf('held', 'paper_id', 'title', '(1 + ln(tf))')} SELECT src, dst, round(weight, 6) AS weight FROM cosine WHERE weight >= 0.6",
    "q04_cosine_topk": "SELECT src, dst, round(weight, 4) AS weight FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.embedding, b.embedding)::DOUBLE AS weight FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id WHERE list_dot_product(a.embedding, b.embedding) >= 0.25 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding, b.embedding) DESC, b.vec_id DESC) <= 8)",
    "q05_combined_edges": f"WITH {_COMBINED} SELECT src, dst, round(property, 6) AS property, round(method, 6) AS method, round(weight, 6) AS weight, CASE WHEN 0.45 * property >= 0.35 * method THEN 'property' ELSE 'method' END AS layer FROM combined",
    "q06_weighted_degree": f"WITH {_COMBINED}, e AS (SELECT src AS node, weight FROM combined UNION ALL SELECT dst, weight FROM combined) SELECT node, round(sum(weight), 5) AS degree, count(*) AS n_edges, round(8 + least(24.0, 6 * ln(1 + sum(weight))), 5) AS size FROM e GROUP BY node",
    "q28_expand_one_hop": f"WITH {_COMBINED}, {_HELD}, e AS (SELECT src AS seed, dst AS node, round(weight, 6) AS weight FROM combined UNION ALL SELECT dst, src, round(weight, 6) FROM combined) SELECT seed, node, weight, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, node) AS rank FROM e WHERE seed IN (SELECT paper_id FROM held WHERE active = 1) QUALIFY rank <= 5",
    "q29_components": f"WITH RECURSIVE {_CITES}, e AS (SELECT citing AS a, cited AS b FROM cites WHERE citing <> cited UNION SELECT cited, citing FROM cites WHERE citing <> cited), reach AS (SELECT a AS node, a AS other FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.other) SELECT node, min(other) AS component FROM reach GROUP BY node",
    "q30_spanning_forest": f"WITH RECURSIVE {_COMBINED}, {_FOREST} SELECT src, dst, weight FROM forest",
    "q47_sparsified": f"WITH RECURSIVE {_COMBINED}, {_FOREST}, near AS (SELECT src, dst FROM (SELECT node, src, dst, row_number() OVER (PARTITION BY node ORDER BY weight DESC, src DESC, dst DESC) AS r FROM (SELECT unnest([src, dst]) AS node, src, dst, weight FROM ranked)) WHERE r <= 6), keep AS (SELECT src, dst FROM near UNION SELECT src, dst FROM forest), rest AS (SELECT src, dst, weight, row_number() OVER (ORDER BY weight DESC, src, dst) AS r FROM ranked WHERE (src, dst) NOT IN (SELECT (src, dst) FROM keep)) SELECT src, dst, weight FROM ranked WHERE (src, dst) IN (SELECT (src, dst) FROM keep) UNION ALL SELECT src, dst, weight FROM rest WHERE r <= greatest(0, 2000 - (SELECT count(*) FROM keep))",
    "q32_circle_layout": "SELECT project_slug, paper_id, round(850.0 * cos(angle), 3) AS x, round(850.0 * sin(angle), 3) AS y FROM (SELECT project_slug, paper_id, 2 * pi() * (row_number() OVER (PARTITION BY project_slug ORDER BY paper_id) - 1) / count(*) OVER (PARTITION BY project_slug) AS angle FROM (SELECT DISTINCT project_slug, paper_id FROM paper_projects))",
    "q33_statement_pairs": f"WITH {_PROPS}, s AS (SELECT paper_id, concat(inventory_id, ':', i - 1) AS uid, objectives[i].text AS text FROM (SELECT DISTINCT inventory_id, paper_id, objectives FROM inventory), unnest(range(1, len(objectives) + 1)) AS u(i) WHERE objectives[i].text IS NOT NULL), {_tfidf('s', 'uid', 'text', 'tf')}, p AS (SELECT src, dst, round(greatest(weight, CASE WHEN EXISTS (SELECT 1 FROM props x JOIN props y ON x.key = y.key WHERE x.paper_id = a.paper_id AND y.paper_id = b.paper_id) THEN 0.38 ELSE 0 END), 6) AS weight FROM cosine JOIN s a ON a.uid = src JOIN s b ON b.uid = dst WHERE weight >= 0.5 AND a.paper_id <> b.paper_id), " + _topk(5),
    "q34_soft_keyword": f"WITH {_PROPS}, w AS (SELECT DISTINCT key AS node, unnest(string_split(key, ' ')) AS item FROM props), wn AS (SELECT node, count(*) AS n FROM w GROUP BY node), lex AS (SELECT src, dst, shared / (x.n + y.n - shared) AS v FROM (SELECT a.node AS src, b.node AS dst, count(*) AS shared FROM w a JOIN w b ON a.item = b.item AND a.node < b.node GROUP BY ALL) JOIN wn x ON src = x.node JOIN wn y ON dst = y.node), rel AS (SELECT src AS l, dst AS r, CASE WHEN v >= 0.82 THEN round(least(0.94, 0.72 + 0.25 * v), 4) ELSE 0.55 * round(least(0.88, 0.58 + 0.25 * v), 4) END AS score FROM lex WHERE v >= 0.45), bothways AS (SELECT l, r, score FROM rel UNION ALL SELECT r, l, score FROM rel), s AS (SELECT DISTINCT paper_id AS node, key AS item FROM props), sn AS (SELECT node, count(*) AS n FROM s GROUP BY node), met AS (SELECT a.node AS src, b.node AS dst, a.item, max(score) AS score FROM s a JOIN bothways ON a.item = l JOIN s b ON b.item = r WHERE a.node <> b.node GROUP BY ALL), d AS (SELECT src, dst, sum(score) / any_value(n) AS m FROM met JOIN sn ON sn.node = src GROUP BY 1, 2) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(sum(m) / 2, 4) AS weight FROM d GROUP BY 1, 2 HAVING sum(m) / 2 >= 0.1",
    "q35_knowledge_edges": f"WITH {_PROPS}, {_METHODS}, {_CITES}, e AS (SELECT concat('paper:', paper_id) AS source, concat('property:', sha1(key)[1:16]) AS target, 'STUDIES_PROPERTY' AS relation, true AS directed, 1.0::DOUBLE AS weight FROM props UNION ALL SELECT concat('paper:', paper_id), concat('method:', sha1(key)[1:16]), 'USES_METHOD', true, 1.0 FROM meths UNION ALL SELECT concat('paper:', citing), concat('paper:', cited), 'CITES', true, 1.0 FROM cites) SELECT source, target, relation, directed, round(max(weight), 6) AS weight FROM e GROUP BY ALL",
    "q44_signature_precedence": f"WITH {_MATCHES}, k AS (SELECT citing_paper_id, ref_id, {_doi('resolved_doi')} AS doi, upper(regexp_extract(rtrim(trim(coalesce(resolved_openalex_id, '')), '/'), '([^/]*)$', 1)) AS oa, {_title('resolved_title')} AS title FROM m) SELECT citing_paper_id, ref_id, CASE WHEN doi <> '' THEN 'doi:' || doi WHEN oa <> '' THEN 'oa:' || oa ELSE 'title:' || title END AS signature FROM k WHERE doi <> '' OR oa <> '' OR length(title) >= 18",
    "q49_set_classes": f"WITH {_PROPS}, c AS (SELECT paper_id AS node, list(DISTINCT key ORDER BY key) AS items FROM props GROUP BY paper_id) SELECT node, min(node) OVER (PARTITION BY items) AS representative FROM c",
    "q46_citation_arrows": f"WITH {_CITES} SELECT least(citing, cited) AS src, greatest(citing, cited) AS dst, CASE WHEN bool_or(citing < cited) AND bool_or(citing > cited) THEN 'both' WHEN bool_or(citing < cited) THEN 'to' ELSE 'from' END AS arrows FROM cites WHERE citing <> cited GROUP BY 1, 2",
}
