"""Queries on the state of the library, documents, clusters and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import documents, graph, keywords, library, linkage, registry, similarity, summaries, validation
from ..operators.orphans import paper_number
from ..runtime import table
from ..settings import PROFILES, profile
from .layers import _CITES, _HELD, _METHODS, _PROPS, _citation_edges, _citations, _combined, _COMBINED, _held, _items, _key, _number, _property_layer, _topk
from .extraction import _ROLE, _WORKS, _grams, _older_match, q76_referenced_edges
from .tables import _DUPS, _EVID, _MISS, _OBJ, _SENT, _objectives, q13_missing_evidence, q14_duplicate_statements, q51_citation_contexts, q52_numbers_not_found
from .extraction import SQL as _EXTRACTED
from .tables import SQL as _TABLES


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paper_projects").select("paper_id", "project_slug").distinct()


def _stages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs of a stage: an urgent order is a failed run, the number of its clerk tells the cause."""
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("P"), F.lpad(F.col("o_custkey").cast("string"), 4, "0")).alias("paper_id"), F.lit("ocr").alias("stage"), F.when(F.col("o_orderpriority") == "1-URGENT", "error").otherwise("success").alias("status"), F.concat(F.when(F.col("o_orderstatus") == "F", "OCR_REQUIRED:").otherwise("OTHER:"), F.col("o_orderkey").cast("string")).alias("error"), "o_orderkey")


def q81_selected(spark: SparkSession, d: str) -> DataFrame:
    """Active papers whose metadata is verified or probable."""
    status = table(spark, d, "paper_metadata_v4").select("paper_id", F.col("match_status").alias("overall_status")).distinct()
    return library.selected(library.gated(_held(spark, d), status, ["verified", "probable"])).select("paper_id", "title", "year")


def q82_blocked(spark: SparkSession, d: str) -> DataFrame:
    return library.blocked(_held(spark, d), _stages(spark, d), "ocr", "OCR_REQUIRED:")


def q83_complete(spark: SparkSession, d: str) -> DataFrame:
    """Papers that have metadata, blocks, an inventory and references."""
    parts = [table(spark, d, t).select(F.col(c).alias("paper_id"), F.lit(t).alias("kind")) for t, c in (("paper_metadata_v4", "paper_id"), ("paper_json", "paper_id"), ("inventory", "paper_id"), ("reference", "paper_id"))]
    kinds = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return library.complete(_held(spark, d), kinds, ["paper_metadata_v4", "paper_json", "inventory", "reference"]).select("paper_id", "active")


def q84_change_key(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("finished_at"))
    return library.change_key(e)


def q85_run_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Seconds from the first sight of a paper to the last."""
    p = _held(spark, d).select("paper_id", F.col("first_seen_at").alias("started_at"), F.col("last_seen_at").alias("finished_at"))
    return library.run_seconds(p).select("paper_id", F.round("seconds", 3).alias("seconds"))


def q86_pending_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph chunks of the papers that lack an inventory or metadata."""
    n = table(spark, d, "paper_json").where("kind = 'paragraph'").select("block_id", "paper_id").distinct().groupBy("paper_id").agg(F.count("*").alias("n"))
    done = table(spark, d, "inventory").select("paper_id", F.lit("inventory").alias("phase")).unionByName(table(spark, d, "paper_metadata_v4").select("paper_id", F.lit("metadata").alias("phase")))
    return library.pending_chunks(n, done, ["inventory", "metadata"])


def q87_membership_counts(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "reference").select("paper_id")
    parts = []
    for action in ("add", "remove", "copy", "move"):
        parts.append(library.membership_counts(_members(spark, d), _held(spark, d), asked, action, "hydrogel-survey", "archive" if action in ("copy", "move") else None).withColumn("action", F.lit(action)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def q88_project_list(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    p = m.select("project_slug").distinct().withColumn("name", F.initcap(F.replace("project_slug", F.lit("-"), F.lit(" "))))
    return library.project_list(p, registry.project_summary(m, m, _held(spark, d)), "hydrogel-survey")


def q89_document_stats(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "paper_json").select("block_id", "paper_id", "section_id", "page", "sentences").distinct()
    return documents.statistics(b, table(spark, d, "reference"))


def _sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    return documents.sentence_rows(table(spark, d, "paper_json").where("sentences is not null").select("block_id", "paper_id", "heading", "sentences").distinct())


def q90_locations(spark: SparkSession, d: str) -> DataFrame:
    return documents.locations(_sentence_rows(spark, d))


def q91_closing_texts(spark: SparkSession, d: str) -> DataFrame:
    t = documents.section_texts(_sentence_rows(spark, d), True)
    return t.select("paper_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), F.array_join("sids", ",").alias("sids"))


def q92_on_page(spark: SparkSession, d: str) -> DataFrame:
    return documents.on_page(_sentence_rows(spark, d)).select("paper_id", "page", F.md5("line").alias("digest"), "rank")


def q93_revealed(spark: SparkSession, d: str) -> DataFrame:
    """Property edges by the year from which both papers are known."""
    nodes = _held(spark, d).select(F.col("paper_id").alias("node"), "year")
    return documents.revealed(nodes, _property_layer(spark, d))


def q94_cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d).select(F.col("project_slug").alias("cluster"), "paper_id")
    p = _items(spark, d, "studied_properties", "property_normalized", "property_raw").select("paper_id", "key", "inventory_id")
    x = _items(spark, d, "methods", "method_normalized", "method_raw").select("paper_id", "key", "inventory_id")
    return summaries.cluster_summary(m, {"properties": (p, 10), "methods": (x, 10)}, _held(spark, d).select("paper_id", "title"))


def q95_cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels by the properties of a year's papers, else by the words of their titles."""
    m = _held(spark, d).where("year is not null").select(F.col("year").alias("cluster"), "paper_id")
    own = _items(spark, d, "studied_properties", "property_normalized", "property_raw").select("paper_id", "key", "inventory_id")
    v = similarity.tfidf(similarity.terms_of(_held(spark, d), "paper_id", "title", 2))
    return summaries.cluster_labels(m, own, v)


def q96_audit_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Term pairs that a person should look at: alike in their letters, the most alike first."""
    pairs = keywords.lexical_pairs(_items(spark, d, "methods", "method_normalized", "method_raw").select("key").distinct(), "key", 0.72, 10)
    return pairs.select("src", "dst", F.round("weight", 6).alias("weight")).orderBy(F.desc("weight"), "src", "dst")


def q97_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Edges that each view keeps of the citation graph."""
    e = _citation_edges(spark, d)
    n = graph.ends(e).agg(F.count_distinct("node")).first()[0] or 0
    return spark.createDataFrame([(name, n, *profile(name, n)) for name in PROFILES], "profile string, nodes bigint, top_k int, most_edges bigint")


def q98_citation_targets(spark: SparkSession, d: str) -> DataFrame:
    """Citations of the references and of OpenAlex alone, between papers of the library that are active."""
    more = q76_referenced_edges(spark, d).select("citing", F.col("target").alias("cited"), F.lit("openalex").alias("source"))
    both = _citations(spark, d).select("citing", "cited", F.lit("reference").alias("source")).unionByName(more)
    live = _held(spark, d).where("active = 1").select(paper_number(F.col("paper_id")).alias("n"))
    return both.join(live.withColumnRenamed("n", "citing"), "citing", "left_semi").join(live.withColumnRenamed("n", "cited"), "cited", "left_semi").select("citing", "cited", "source")


def q99_full_validation(spark: SparkSession, d: str) -> DataFrame:
    """The status of all papers by all rules that their data can break."""
    o = _objectives(spark, d)
    loc = documents.locations(_sentence_rows(spark, d)).select("paper_id", F.col("sid").alias("s"), "role")
    roles = o.select("paper_id", "article_type", "item_id", F.explode("evidence_sids").alias("s")).join(loc, ["paper_id", "s"]).groupBy("paper_id", "article_type", "item_id").agg(F.collect_set("role").alias("roles"))
    claims = roles.withColumn("claim_origin", F.lit("this_paper_result"))
    inv = table(spark, d, "inventory").select("inventory_id", "paper_id", "global_conditions", "systems").distinct()
    c = inv.select("paper_id", "inventory_id", F.posexplode("global_conditions").alias("i", "c")).select("paper_id", F.concat_ws(":", "inventory_id", "i").alias("item_id"), F.lit("explicitly_reported").alias("status"), F.coalesce("c.evidence_sids", F.array().cast("array<string>")).alias("evidence_sids"), F.col("c.condition_type").alias("system_id"))
    known = inv.select("paper_id", F.explode("systems").alias("s")).select("paper_id", F.col("s.system_type").alias("system_id"))
    rules = [q13_missing_evidence(spark, d), q14_duplicate_statements(spark, d), q51_citation_contexts(spark, d), q52_numbers_not_found(spark, d), validation.background_only(claims), validation.visual_marked_explicit(c), validation.unknown_systems(c.where("system_id = 'solvent'"), known)]
    issues = rules[0]
    for r in rules[1:]:
        issues = issues.unionByName(r)
    return validation.status(table(spark, d, "inventory"), issues)


def q100_upserted(spark: SparkSession, d: str) -> DataFrame:
    """The metadata table after the registry's newer rows."""
    columns = ["paper_id", "title", "doi", "year", "journal"]
    held = table(spark, d, "paper_metadata_v4").select(*columns, "updated_at").distinct()
    rows = table(spark, d, "papers").where("active = 1").select(*columns, F.col("last_seen_at").alias("updated_at")).distinct()
    return library.upserted("paper_metadata", held, rows, "updated_at")


def q101_metadata_layers(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the registry, filled from the enriched record where that has them."""
    base = _held(spark, d).select("paper_id", "title", "doi", "year", "journal")
    more = table(spark, d, "paper_metadata_v4").select("paper_id", "title", "doi", "year", "journal").distinct()
    return library.first_given(base, [more], "paper_id", ["title", "doi", "year", "journal"], blank_too=True)


def q102_raw_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of the active papers, and those of all as uploads."""
    p = _held(spark, d)
    return library.raw_files(p.where("active = 1"), p.select(F.col("source_relpath").alias("path"), F.col("original_filename").alias("file_name")).distinct())


def q103_overrides(spark: SparkSession, d: str) -> DataFrame:
    """DOIs set by hand for references: those of records found by hand, with resolved DOIs; the refused ones marked."""
    m = table(spark, d, "reference_matches_v4").where("match_method = 'manual'").select("citing_paper_id", "ref_id", F.coalesce("resolved_doi", F.lit("")).alias("doi"), F.lit("by hand").alias("note"), "updated_at").distinct()
    kept, refused = library.saved_override(library.empty(spark, "doi_overrides"), table(spark, d, "reference"), m)
    return kept.select("citing_paper_id", "ref_id", "doi", F.lit(True).alias("kept")).unionByName(refused.select("citing_paper_id", "ref_id", "doi", F.lit(False).alias("kept")))


def q104_selected_layers(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the method layer alone."""
    score = graph.selected_score(F.col("components"), ["method"])
    return _combined(spark, d).select("src", "dst", F.round(score, 6).alias("score")).where("score > 0")


def q105_cascade(spark: SparkSession, d: str) -> DataFrame:
    """References resolved by DOI, else by title in the older way."""
    refs = table(spark, d, "reference").select("reference_no").distinct()
    rows = table(spark, d, "reference").select("reference_no", text.doi_key(F.col("doi")).alias("doi")).where("doi != ''")
    papers = _held(spark, d).select("paper_id", text.doi_key(F.col("doi")).alias("doi"))
    by_doi = linkage.unique_exact(rows, papers, "doi", "paper_id").groupBy("reference_no").agg(F.min("paper_id").alias("paper_id"))
    by_title = _older_match(spark, d)[1]
    return linkage.cascade(refs, ["reference_no"], [("doi", by_doi), ("title", by_title)], "paper_id")


def q106_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The box around each sentence that has coordinates, two points wider on all sides, and its page."""
    b = table(spark, d, "paper_json").where("sentences is not null").select("block_id", "sentences").distinct()
    x = b.select("block_id", F.posexplode("sentences").alias("n", "s")).where("s.coords is not null")
    box = text.union_box(text.boxes(F.col("s.coords")), 2.0)
    return x.select("block_id", "n", text.page_of(F.col("s.coords")).alias("page"), *[F.round(box[c], 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


def q107_topk_then_shared(spark: SparkSession, d: str) -> DataFrame:
    """Papers alike in their properties: the best 3 of each, of which those that share 2 or more."""
    p = _items(spark, d, "studied_properties", "property_normalized", "property_raw")
    pairs = similarity.set_pairs(p, "paper_id", "key", "jaccard", 0.1)
    return similarity.topk_then_shared(pairs, 3, 2).withColumn("weight", F.round("weight", 6))


QUERIES = {f.__name__: f for f in (q81_selected, q82_blocked, q83_complete, q84_change_key, q85_run_seconds, q86_pending_chunks, q87_membership_counts, q88_project_list, q89_document_stats, q90_locations, q91_closing_texts, q92_on_page, q93_revealed, q94_cluster_summary, q95_cluster_labels, q96_audit_suggestions, q97_profiles, q98_citation_targets, q99_full_validation, q100_upserted, q101_metadata_layers, q102_raw_files, q103_overrides, q104_selected_layers, q105_cascade, q106_boxes, q107_topk_then_shared)}

_MEM = "members AS (SELECT DISTINCT paper_id, project_slug FROM paper_projects)"
_ROWS = "srow AS (SELECT paper_id, block_id, heading, i - 1 AS n, sentences[i].sid AS sid, sentences[i].page AS page, sentences[i].text AS text FROM (SELECT DISTINCT block_id, paper_id, heading, sentences FROM paper_json WHERE sentences IS NOT NULL), unnest(range(1, len(sentences) + 1)) AS u(i))"
_LOC = f"loc AS (SELECT paper_id, sid, heading, {_ROLE} AS role FROM (SELECT paper_id, sid, arg_max(coalesce(heading, ''), (block_id, n, coalesce(heading, ''))) AS heading FROM srow WHERE sid IS NOT NULL GROUP BY ALL))"
_LAYER_P = f"{_PROPS}, ps AS (SELECT DISTINCT paper_id AS node, key AS item FROM props), pn AS (SELECT node, count(*) AS n FROM ps GROUP BY node), lay AS (SELECT src, dst FROM (SELECT a.node AS src, b.node AS dst, count(*) AS shared FROM ps a JOIN ps b ON a.item = b.item AND a.node < b.node GROUP BY ALL) JOIN pn x ON src = x.node JOIN pn y ON dst = y.node WHERE shared / (x.n + y.n - shared) >= 0.18)"
_TOP = "SELECT cluster, array_to_string(list(key ORDER BY r), ' | ') AS {name} FROM (SELECT cluster, key, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, min(inventory_id), key) AS r FROM {source} JOIN mem USING (paper_id) GROUP BY cluster, key QUALIFY r <= {n}) GROUP BY cluster"
_W2 = "wv AS (SELECT paper_id AS node, unnest(w || CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS term FROM (SELECT paper_id, regexp_extract_all(lower(coalesce(title, '')), '\\b[a-z0-9_]{2,}\\b') AS w FROM held)), t AS (SELECT node, term, count(*) AS tf FROM wv GROUP BY ALL), nd AS (SELECT count(DISTINCT node) AS n FROM t), df AS (SELECT term, count(*) AS df FROM t GROUP BY term), raw AS (SELECT node, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN df USING (term), nd), len_ AS (SELECT node, sqrt(sum(w * w)) AS len FROM raw GROUP BY node), v AS (SELECT node, term, w / len AS w FROM raw JOIN len_ USING (node))"
_GENERIC = ", ".join(f"'{w}'" for w in summaries.GENERIC)


def _counts(action: str, to: str) -> str:
    there, here = f"coalesce(bool_or(project_slug = '{to}'), false)", "coalesce(bool_or(project_slug = 'hydrogel-survey'), false)"
    added = {"add": "NOT there", "remove": "false", "copy": "NOT there", "move": "here AND NOT there"}[action]
    removed = "here" if action in ("remove", "move") else "false"
    skipped = "NOT here" if action == "move" else "false"
    return f"SELECT '{action}' AS action, (SELECT count(*) FROM reference WHERE trim(paper_id) <> '') AS requested, count(*) FILTER ({added}) AS added, count(*) FILTER ({removed}) AS removed, count(*) FILTER ({skipped}) AS skipped FROM (SELECT x.paper_id, {here} AS here, {there} AS there FROM (SELECT DISTINCT paper_id FROM reference WHERE paper_id IN (SELECT paper_id FROM held WHERE active = 1)) x LEFT JOIN members m USING (paper_id) GROUP BY 1)"


_FULL = (
    f"{_SENT}, {_EVID}, {_OBJ}, {_ROWS}, {_LOC}, "
    "oe AS (SELECT paper_id, article_type, concat(inventory_id, ':', i - 1) AS item_id, unnest(objectives[i].evidence_sids) AS sid FROM (SELECT DISTINCT inventory_id, paper_id, article_type, objectives FROM inventory), unnest(range(1, len(objectives) + 1)) AS u(i)), "
    "bg AS (SELECT paper_id, 'error' AS severity FROM oe JOIN loc USING (paper_id, sid) WHERE article_type = 'primary_research' GROUP BY paper_id, article_type, item_id HAVING bool_and(role = 'background')), "
    "gc AS (SELECT paper_id, inventory_id, global_conditions[i] AS c FROM (SELECT DISTINCT inventory_id, paper_id, global_conditions FROM inventory), unnest(range(1, len(global_conditions) + 1)) AS u(i)), "
    "vi AS (SELECT paper_id, 'warning' AS severity FROM gc WHERE len(list_filter(coalesce(c.evidence_sids, []), lambda s: starts_with(s, 'vis:'))) > 0), "
    "us AS (SELECT paper_id, 'error' AS severity FROM gc WHERE c.condition_type = 'solvent' AND NOT EXISTS (SELECT 1 FROM (SELECT paper_id, unnest(systems) AS s FROM inventory) k WHERE k.paper_id = gc.paper_id AND k.s.system_type = 'solvent')), "
    f"x AS (SELECT paper_id, severity FROM ({_MISS}) UNION ALL SELECT paper_id, severity FROM ({_DUPS}) UNION ALL SELECT paper_id, severity FROM q51 UNION ALL SELECT paper_id, severity FROM q52 UNION ALL SELECT * FROM bg UNION ALL SELECT * FROM vi UNION ALL SELECT * FROM us)"
)

_CASCADE = f"doi_ AS ({_TABLES['q21_unique_exact']}), old_ AS ({_EXTRACTED['q77_doi_or_title']})"
_REPS = "s0 AS (SELECT DISTINCT paper_id AS node, key AS item FROM props), s AS (SELECT min(node) AS node, unnest(items) AS item FROM (SELECT node, list(item ORDER BY item) AS items FROM s0 GROUP BY node) GROUP BY items), n AS (SELECT node, count(*) AS n FROM s GROUP BY node), p AS (SELECT src, dst, shared, shared / (x.n + y.n - shared) AS weight FROM (SELECT a.node AS src, b.node AS dst, count(*) AS shared FROM s a JOIN s b ON a.item = b.item AND a.node < b.node GROUP BY ALL) JOIN n x ON src = x.node JOIN n y ON dst = y.node WHERE shared / (x.n + y.n - shared) >= 0.1)"

SQL = {
    "q104_selected_layers": f"WITH {_COMBINED} SELECT src, dst, round(0.35 * method, 6) AS score FROM combined WHERE method > 0",
    "q105_cascade": f"WITH {_CASCADE} SELECT r.reference_no, coalesce(a.paper_id, b.paper_id) AS paper_id, CASE WHEN a.paper_id IS NOT NULL THEN 'doi' WHEN b.paper_id IS NOT NULL THEN 'title' END AS method FROM (SELECT DISTINCT reference_no FROM reference) r LEFT JOIN (SELECT reference_no, min(paper_id) AS paper_id FROM doi_ GROUP BY 1) a USING (reference_no) LEFT JOIN (SELECT reference_no, paper_id FROM old_ WHERE method = 'title') b USING (reference_no)",
    "q106_boxes": "WITH x AS (SELECT block_id, i - 1 AS n, sentences[i].coords AS c FROM (SELECT DISTINCT block_id, sentences FROM paper_json WHERE sentences IS NOT NULL), unnest(range(1, len(sentences) + 1)) AS u(i) WHERE sentences[i].coords IS NOT NULL), b AS (SELECT block_id, n, c, list_filter(list_transform(string_split(c, ';'), lambda p: list_transform(string_split(p, ','), lambda v: try_cast(trim(v) AS DOUBLE))), lambda v: len(v) >= 5) AS b FROM x) SELECT block_id, n, nullif(regexp_extract(c, '^\\s*(\\d+)\\s*,', 1), '')::INT AS page, round(list_min(list_transform(b, lambda v: v[2])) - 2, 4) AS x0, round(list_min(list_transform(b, lambda v: v[3])) - 2, 4) AS y0, round(list_max(list_transform(b, lambda v: v[2] + v[4])) + 2, 4) AS x1, round(list_max(list_transform(b, lambda v: v[3] + v[5])) + 2, 4) AS y1 FROM b",
    "q107_topk_then_shared": f"WITH {_PROPS}, {_REPS}, k AS (WITH {_topk(3)}) SELECT src, dst, shared, round(k.weight, 6) AS weight FROM k JOIN p USING (src, dst) WHERE shared >= 2",
    "q81_selected": f"WITH {_HELD} SELECT paper_id, title, year FROM held WHERE active = 1 AND paper_id IN (SELECT paper_id FROM paper_metadata_v4 WHERE match_status IN ('verified', 'probable'))",
    "q82_blocked": f"WITH {_HELD} SELECT paper_id, concat('OCR_REQUIRED:', o_orderkey) AS error FROM held JOIN orders ON paper_id = concat('P', lpad(o_custkey::VARCHAR, 4, '0')) WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'",
    "q83_complete": f"WITH {_HELD} SELECT paper_id, active FROM held WHERE paper_id IN (SELECT paper_id FROM paper_metadata_v4) AND paper_id IN (SELECT paper_id FROM paper_json) AND paper_id IN (SELECT paper_id FROM inventory) AND paper_id IN (SELECT paper_id FROM reference)",
    "q84_change_key": "SELECT count(*) AS n, max(m)::VARCHAR AS last FROM (SELECT event_type, max(ts) AS m FROM events GROUP BY 1)",
    "q85_run_seconds": f"WITH {_HELD} SELECT paper_id, round(greatest((epoch_us(last_seen_at) - epoch_us(first_seen_at)) / 1e6, 0), 3) AS seconds FROM held",
    "q86_pending_chunks": "WITH n AS (SELECT paper_id, count(*) AS n FROM (SELECT DISTINCT block_id, paper_id FROM paper_json WHERE kind = 'paragraph') GROUP BY 1) SELECT 'inventory' AS phase, sum(n)::BIGINT AS n_chunks, count(*) AS n_papers FROM n WHERE paper_id NOT IN (SELECT paper_id FROM inventory) HAVING count(*) > 0 UNION ALL SELECT 'metadata', sum(n)::BIGINT, count(*) FROM n WHERE paper_id NOT IN (SELECT paper_id FROM paper_metadata_v4) HAVING count(*) > 0",
    "q87_membership_counts": f"WITH {_HELD}, {_MEM} " + " UNION ALL ".join(_counts(a, t) for a, t in (("add", "hydrogel-survey"), ("remove", "hydrogel-survey"), ("copy", "archive"), ("move", "archive"))),
    "q88_project_list": f"WITH {_HELD}, {_MEM}, c AS (SELECT project_slug, count(DISTINCT members.paper_id) AS n_papers, count(DISTINCT members.paper_id) FILTER (active = 1) AS n_active FROM members LEFT JOIN held USING (paper_id) GROUP BY 1), n AS (SELECT *, array_to_string(list_transform(string_split(project_slug, '-'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM c) SELECT project_slug, name, n_papers, n_active, row_number() OVER (ORDER BY CASE WHEN project_slug = 'hydrogel-survey' THEN 0 ELSE 1 END, lower(name), project_slug) AS place FROM n",
    "q89_document_stats": "WITH b AS (SELECT DISTINCT block_id, paper_id, section_id, page, sentences FROM paper_json), r AS (SELECT paper_id, count(DISTINCT ref_id) AS n_references FROM reference GROUP BY 1) SELECT b.paper_id, sum(coalesce(len(sentences), 0))::BIGINT AS sentences, count(DISTINCT section_id) AS sections, count(*) AS blocks, count(DISTINCT page) AS pages, coalesce(any_value(n_references), 0) AS n_references FROM b LEFT JOIN r USING (paper_id) GROUP BY 1",
    "q90_locations": f"WITH {_ROWS}, {_LOC} SELECT * FROM loc",
    "q91_closing_texts": f"WITH {_ROWS}, g AS (SELECT paper_id, array_to_string(list(trim(text) ORDER BY block_id, n) FILTER (trim(coalesce(text, '')) <> ''), ' ') AS t, array_to_string(list_sort(list_distinct(list(sid) FILTER (sid IS NOT NULL))), ',') AS sids FROM srow WHERE regexp_matches(regexp_replace(lower(coalesce(heading, '')), '[^a-z]+', ' ', 'g'), 'conclusion|concluding|summary|outlook') GROUP BY 1) SELECT paper_id, length(coalesce(t, '')) AS n_chars, md5(coalesce(t, '')) AS digest, coalesce(sids, '') AS sids FROM g",
    "q92_on_page": f"WITH {_ROWS} SELECT paper_id, page, md5('[' || coalesce(sid, '') || '] ' || coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY paper_id, page ORDER BY block_id, n) AS rank FROM srow WHERE page IS NOT NULL QUALIFY rank <= 12",
    "q93_revealed": f"WITH {_HELD}, {_LAYER_P} SELECT src, dst, greatest(a.year, b.year) AS year FROM lay JOIN held a ON a.paper_id = src JOIN held b ON b.paper_id = dst WHERE a.year IS NOT NULL AND b.year IS NOT NULL",
    "q94_cluster_summary": f"WITH {_HELD}, {_PROPS}, {_METHODS}, mem AS (SELECT DISTINCT project_slug AS cluster, paper_id FROM paper_projects), s AS (SELECT cluster, count(DISTINCT paper_id) AS size FROM mem GROUP BY 1), p AS ({_TOP.format(name='top_properties', source='props', n=10)}), m AS ({_TOP.format(name='top_methods', source='meths', n=10)}), t AS (SELECT cluster, array_to_string(list(title ORDER BY paper_id), ' | ') AS titles FROM (SELECT cluster, paper_id, title FROM mem JOIN held USING (paper_id) WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY paper_id) <= 20) GROUP BY 1) SELECT * FROM s LEFT JOIN p USING (cluster) LEFT JOIN m USING (cluster) LEFT JOIN t USING (cluster)",
    "q95_cluster_labels": f"WITH {_HELD}, {_PROPS}, mem AS (SELECT year AS cluster, paper_id FROM held WHERE year IS NOT NULL), {_W2}, bt AS ({_TOP.format(name='by_term', source='props', n=3)}), bw AS (SELECT cluster, array_to_string(list(term ORDER BY r), ' / ') AS by_word FROM (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY round(sum(w), 9) DESC, term) AS r FROM v JOIN mem ON mem.paper_id = node WHERE NOT list_has_any(string_split(term, ' '), [{_GENERIC}]) GROUP BY cluster, term QUALIFY r <= 3) GROUP BY 1) SELECT cluster, coalesce(nullif(replace(by_term, ' | ', ' / '), ''), nullif(by_word, ''), 'Cluster ' || cluster) AS label FROM (SELECT DISTINCT cluster FROM mem) LEFT JOIN bt USING (cluster) LEFT JOIN bw USING (cluster)",
    "q96_audit_suggestions": f"WITH {_METHODS}, {_grams('(SELECT DISTINCT key FROM meths)', 'key')}, b AS (SELECT src, dst, weight FROM cosine WHERE weight >= 0.72 UNION ALL SELECT dst, src, weight FROM cosine WHERE weight >= 0.72), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst DESC) AS r FROM b) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(weight), 6) AS weight FROM r WHERE r <= 10 GROUP BY 1, 2",
    "q97_profiles": f"WITH {_CITES}, n AS (SELECT count(DISTINCT x) AS nodes FROM (SELECT citing AS x FROM cites WHERE citing <> cited UNION SELECT cited FROM cites WHERE citing <> cited)) SELECT profile, nodes, top_k, most_edges FROM (SELECT 'fast' AS profile, nodes, 3 AS top_k, greatest(nodes - 1, 4 * nodes) AS most_edges FROM n UNION ALL SELECT 'balanced', nodes, 6, greatest(nodes - 1, 8 * nodes) FROM n UNION ALL SELECT 'full', nodes, 1000000, 1000000000 FROM n)",
    "q98_citation_targets": f"WITH {_HELD}, {_WORKS}, lib AS (SELECT DISTINCT {_number('paper_id')} AS target, upper(regexp_extract(rtrim(trim(coalesce(openalex_id, '')), '/'), '([^/]*)$', 1)) AS work FROM paper_metadata_v4 WHERE upper(regexp_extract(rtrim(trim(coalesce(openalex_id, '')), '/'), '([^/]*)$', 1)) <> ''), c AS (SELECT DISTINCT citing, target AS cited, 'reference' AS source FROM works WHERE target IS NOT NULL UNION ALL SELECT DISTINCT w.citing, lib.target, 'openalex' FROM works w JOIN lib USING (work) WHERE w.work <> '' AND w.citing <> lib.target AND NOT EXISTS (SELECT 1 FROM works x WHERE x.citing = w.citing AND x.target = lib.target)), live AS (SELECT {_number('paper_id')} AS n FROM held WHERE active = 1) SELECT * FROM c WHERE citing IN (SELECT n FROM live) AND cited IN (SELECT n FROM live)",
    "q99_full_validation": f"WITH q51 AS ({_TABLES['q51_citation_contexts']}), q52 AS ({_TABLES['q52_numbers_not_found']}), {_FULL}, c AS (SELECT paper_id, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings FROM x GROUP BY 1) SELECT p.paper_id, coalesce(n_errors, 0) AS n_errors, coalesce(n_warnings, 0) AS n_warnings, CASE WHEN coalesce(n_errors, 0) + coalesce(n_warnings, 0) > 0 THEN 'review_required' ELSE 'pass' END AS overall_status FROM (SELECT DISTINCT paper_id FROM inventory) p LEFT JOIN c USING (paper_id)",
    "q100_upserted": "WITH n AS (SELECT DISTINCT paper_id, title, doi, year, journal, last_seen_at AS updated_at FROM papers WHERE active = 1), l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY updated_at DESC, title DESC NULLS LAST, doi DESC NULLS LAST, year DESC NULLS LAST, journal DESC NULLS LAST) = 1) SELECT * FROM l UNION ALL SELECT DISTINCT paper_id, title, doi, year, journal, updated_at FROM paper_metadata_v4 WHERE paper_id NOT IN (SELECT paper_id FROM l)",
    "q101_metadata_layers": f"WITH {_HELD} SELECT held.paper_id, coalesce(nullif(m.title, ''), held.title) AS title, coalesce(nullif(m.doi, ''), held.doi) AS doi, coalesce(m.year, held.year) AS year, coalesce(nullif(m.journal, ''), held.journal) AS journal FROM held LEFT JOIN (SELECT DISTINCT paper_id, title, doi, year, journal FROM paper_metadata_v4) m USING (paper_id)",
    "q102_raw_files": f"WITH {_HELD}, k AS (SELECT source_relpath AS path, original_filename AS file_name, true AS registered FROM held WHERE active = 1) SELECT * FROM k UNION ALL SELECT DISTINCT source_relpath, original_filename, false FROM held WHERE source_relpath NOT IN (SELECT path FROM k)",
    "q103_overrides": "WITH m AS (SELECT DISTINCT citing_paper_id, ref_id, coalesce(resolved_doi, '') AS doi, updated_at FROM reference_matches_v4 WHERE match_method = 'manual'), k AS (SELECT * FROM m WHERE EXISTS (SELECT 1 FROM reference r WHERE r.paper_id = m.citing_paper_id AND r.ref_id = m.ref_id)), l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY citing_paper_id, ref_id ORDER BY updated_at DESC, doi DESC) = 1) SELECT citing_paper_id, ref_id, doi, true AS kept FROM l WHERE doi <> '' UNION ALL SELECT citing_paper_id, ref_id, doi, false FROM m WHERE NOT EXISTS (SELECT 1 FROM reference r WHERE r.paper_id = m.citing_paper_id AND r.ref_id = m.ref_id)",
}
