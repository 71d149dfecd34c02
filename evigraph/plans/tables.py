"""Queries on records, registries, curation, validation, estimates, text keys and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations, text
from ..operators import chunks, curation, estimate, linkage, ranking, records, registry, resolution, validation
from ..runtime import table
from .layers import _HELD, _PROPS, _doi, _flat, _held, _items, _key, _title


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paper_json").where("kind = 'paragraph' and text is not null").select("block_id", "paper_id", "heading", "page", "text").distinct()


def q07_greedy_chunks(spark: SparkSession, d: str) -> DataFrame:
    u = _paragraphs(spark, d).withColumn("role", text.section_role(F.col("heading")))
    size = F.length("text") + F.length(F.coalesce("heading", F.lit(""))) + 64
    packed = chunks.pack_units(u, ["paper_id"], "block_id", size, F.col("role"), 1200)
    return packed.groupBy("paper_id", "chunk_no").agg(F.count("*").alias("n_units"), F.min("block_id").alias("first_block"), F.min("role").alias("role"))


def q08_dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return records.first_wins(docs, ["sha"], ["doc_id"])


def q09_mode_first_seen(spark: SparkSession, d: str) -> DataFrame:
    inv = table(spark, d, "inventory").select("inventory_id", "paper_id", "article_type").distinct()
    return records.mode_first_seen(inv, ["paper_id"], "article_type", "inventory_id", ("unclear",), "unclear")


def q10_top_terms(spark: SparkSession, d: str) -> DataFrame:
    p = _items(spark, d, "studied_properties", "property_normalized", "property_raw")
    m = table(spark, d, "paper_projects").select("paper_id", "project_slug").distinct()
    return records.top_terms(p.join(m, "paper_id"), ["project_slug"], "key", "inventory_id", 10).select("project_slug", "key", "n", "rank")


def q11_normal_keys(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").select("reference_no", "title", "doi", "journal").distinct()
    return r.select("reference_no", text.collapse(F.col("title")).alias("flat"), text.title_key(F.col("title")).alias("title_key"), text.plain_key(F.col("journal")).alias("journal_key"), text.doi_key(F.col("doi")).alias("doi_key"), text.is_doi(text.doi_key(F.col("doi"))).alias("is_doi"), text.entity_key(F.col("title")).alias("entity_key"))


def q12_numeric_tokens(spark: SparkSession, d: str) -> DataFrame:
    p = _paragraphs(spark, d)
    return p.select("block_id", F.array_join(text.numeric_tokens(F.col("text")), " ").alias("numbers"), text.token_estimate(F.col("text")).cast("bigint").alias("tokens"), text.year_in(F.col("text")).alias("year"), text.section_role(F.col("heading")).alias("role"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "paper_json").where("sentences is not null").select("block_id", "paper_id", "heading", "sentences").distinct()
    return b.select("block_id", "paper_id", "heading", F.inline("sentences"))


_GROUPS = ("objectives", "systems", "methods", "studied_properties", "global_conditions")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    inv = table(spark, d, "inventory").select("inventory_id", "paper_id", *_GROUPS).distinct()

    def part(g: str):
        return F.transform(F.coalesce(F.col(g)["evidence_sids"], F.array().cast("array<array<string>>")), lambda e, i: F.struct(F.concat(F.lit(f"{g}:"), i).alias("item"), e.alias("sids")))

    rows = inv.select("inventory_id", "paper_id", F.inline(F.concat(*map(part, _GROUPS))))
    return rows.select("paper_id", F.concat_ws(":", F.col("inventory_id"), F.col("item")).alias("item_id"), F.explode("sids").alias("evidence_id")).where("evidence_id is not null")


def q13_missing_evidence(spark: SparkSession, d: str) -> DataFrame:
    valid = _sentences(spark, d).select("paper_id", F.col("sid").alias("evidence_id"))
    return validation.missing_evidence(_evidence(spark, d), valid)


def _objectives(spark: SparkSession, d: str) -> DataFrame:
    inv = table(spark, d, "inventory").select("inventory_id", "paper_id", "article_type", "objectives").distinct()
    return inv.select("inventory_id", "paper_id", "article_type", F.posexplode("objectives").alias("i", "o")).select("paper_id", "article_type", (F.col("inventory_id") * 1000 + F.col("i")).alias("pos"), F.concat_ws(":", "inventory_id", "i").alias("item_id"), F.col("o.text").alias("statement"), F.col("o.evidence_sids").alias("evidence_sids"))


def q14_duplicate_statements(spark: SparkSession, d: str) -> DataFrame:
    return validation.duplicate_statements(_objectives(spark, d))


def q50_validation_status(spark: SparkSession, d: str) -> DataFrame:
    issues = q13_missing_evidence(spark, d).unionByName(q14_duplicate_statements(spark, d))
    return validation.status(table(spark, d, "inventory"), issues)


def q51_citation_contexts(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d).where("sid is not null")
    contexts = s.where(F.size("citation_ref_ids") > 0).select("paper_id", F.concat_ws(":", "block_id", "sid").alias("item_id"), "sid", F.col("citation_ref_ids").alias("ref_ids")).distinct()
    one = s.groupBy("paper_id", "sid").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("citation_ref_ids", F.array().cast("array<string>"))))).alias("citation_ref_ids"))
    return validation.citation_contexts(contexts, one, table(spark, d, "reference").select("paper_id", "ref_id"))


def q52_numbers_not_found(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of global conditions that their paper's sentences lack."""
    inv = table(spark, d, "inventory").select("inventory_id", "paper_id", "global_conditions").distinct()
    c = inv.select("inventory_id", "paper_id", F.posexplode("global_conditions").alias("i", "c"))
    texts = _sentences(spark, d).groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("evidence_text"))
    m = c.join(texts, "paper_id", "left").select("paper_id", F.concat_ws(":", "inventory_id", "i").alias("item_id"), F.lit("explicitly_reported").alias("status"), F.col("c.value_raw").alias("value_raw"), F.coalesce("evidence_text", F.lit("")).alias("evidence_text"))
    return validation.numbers_not_found(m)


def _patches(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    fields = {"value": F.when(F.col("event_type").isin("click", "view"), F.col("value")), "note": F.when(F.col("event_type") == "purchase", F.col("props"))}
    return curation.last_patch(e, ["user_id"], ["ts", "event_id"], fields, F.col("event_type") == "error")


def q15_overlay_latest(spark: SparkSession, d: str) -> DataFrame:
    return _patches(spark, d)


def q16_sticky_delete(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"), F.col("c_name").alias("note"))
    return curation.overlay(base, _patches(spark, d), ["user_id"], ["value", "note"])


def q17_debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of events of a user, closed by 30 minutes of silence."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return g.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


def q18_tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "total")


def q19_project_rollup(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "paper_projects").select("paper_id", "project_slug").distinct()
    return registry.project_summary(m, m, _held(spark, d))


def q20_manifest(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "paper_metadata_v4").select("paper_id", "match_status", "confidence").distinct()
    p = _held(spark, d).join(meta, "paper_id", "left")
    return p.select("paper_id", "source_relpath", text.path_slug(F.col("source_relpath")).alias("project"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("match_status", F.lit("")).alias("match_status"), F.round(F.coalesce("confidence", F.lit(0.0)), 6).alias("confidence"), text.file_name(F.col("original_filename")).alias("file_name"))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reference").select("reference_no", "title", F.get("authors", F.lit(0)).alias("author"), "journal", "year", text.doi_key(F.col("doi")).alias("doi")).distinct()


def q21_unique_exact(spark: SparkSession, d: str) -> DataFrame:
    papers = _held(spark, d).select("paper_id", text.doi_key(F.col("doi")).alias("doi"))
    return linkage.unique_exact(_refs(spark, d).where("doi != ''").select("reference_no", "doi"), papers, "doi", "paper_id").select("reference_no", "doi", "paper_id")


def q22_best_and_margin(spark: SparkSession, d: str) -> DataFrame:
    """Journals of the references against those of the papers of an edit ratio of .6 or more; no such next one counts as 0."""
    a = table(spark, d, "reference").select(F.col("journal").alias("name"), text.plain_key(F.col("journal")).alias("k")).where("k != ''").distinct()
    b = _held(spark, d).select(F.col("journal").alias("candidate"), text.plain_key(F.col("journal")).alias("k")).where("k != ''").distinct()
    met = a.join(resolution.near_titles(a, b, "k", 0.6), "k").join(b.withColumnRenamed("k", "c_k"), "c_k")
    return linkage.best_with_margin(met.select("name", "candidate", F.round("ratio", 6).alias("score")), ["name"], "score", "candidate").select("name", "candidate", "score", F.round("margin", 6).alias("margin"))


#: A paper of a lower title score neither is accepted nor comes within the margin of one that is: without authors the other
#: parts add .12 * .45 + .10 + .06 at most, and (.89 - .02 - .214) / .72 is .9111.
NEAR_TITLE = 0.91


def q23_scored_match(spark: SparkSession, d: str) -> DataFrame:
    """References scored against the papers of near titles, accepted by title, overall score and margin as if scored against
    all papers; papers below NEAR_TITLE don't count as the next in the margin shown."""
    refs = _refs(spark, d).withColumn("k", text.title_key(F.col("title"))).where("length(k) >= 18")
    papers = _held(spark, d).select("paper_id", F.col("title").alias("c_title"), F.lit(None).cast("string").alias("c_author"), F.col("journal").alias("c_journal"), F.col("year").alias("c_year"), text.title_key(F.col("title")).alias("k"))
    near = linkage.near_keys(refs, papers, "k", NEAR_TITLE)
    scored = linkage.match_scores(refs.join(near, "k").join(papers.withColumnRenamed("k", "c_k"), "c_k"))
    best = linkage.best_with_margin(scored, ["reference_no"], "overall", "paper_id")
    return best.where(linkage.accepted(F.col("title_score"), F.col("overall"), F.col("margin"))).select("reference_no", "paper_id", "overall", "title_score", F.round("margin", 6).alias("margin"))


def q24_median_seconds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median_value"), F.count("*").alias("n"))


def _models(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("phase"), "l_linestatus", F.col("l_quantity").cast("double").alias("s"))
    return estimate.call_models(calls, "phase", F.col("l_linestatus") == "F", F.col("s"))


def q25_call_model(spark: SparkSession, d: str) -> DataFrame:
    return _models(spark, d).select("phase", "sample_count", *[F.round(c, 6).alias(c) for c in ("seconds_per_chunk", "sigma_per_chunk", "retry_factor")])


def q26_remaining(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").where("l_linestatus = 'O'")
    backlog = line.groupBy(F.col("l_returnflag").alias("phase")).agg(F.count_distinct("l_suppkey").alias("chunks"), F.count_distinct("l_suppkey").alias("papers"))
    known = _models(spark, d).where("phase != 'A'")
    waiting = spark.createDataFrame([("memory", 0, 7), ("inventory", 5, 3)], "phase string, chunks bigint, papers bigint")
    return estimate.remaining(backlog.unionByName(waiting), known, "phase", 6)


def q27_history(spark: SparkSession, d: str) -> DataFrame:
    """Papers known by each year; a paper without a year never shows."""
    from pyspark.sql import Window as W

    n = _held(spark, d).where("year is not null").groupBy("year").agg(F.count("*").alias("n"))  # as many rows as years
    return n.select("year", "n", F.sum("n").over(W.orderBy("year").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("known"))


def q36_text_search(spark: SparkSession, d: str) -> DataFrame:
    p = _held(spark, d)
    hay = F.lower(F.concat_ws(" ", "title", "journal", "doi", "paper_id"))
    return p.where(hay.contains("micelle")).select("paper_id", "title", "year").orderBy(*registry.paper_order(F.col("year"), F.col("title"), F.col("paper_id")))


def q38_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return chunks.within_budget(_paragraphs(spark, d).select("paper_id", "block_id", "text"), ["paper_id"], "block_id", "text", 4, 1800).select("paper_id", "block_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def q39_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """The papers seen by a date against all rows as a later scan, in which some paths are gone."""
    p = table(spark, d, "papers").distinct()
    cols = ["paper_id", F.col("source_relpath").alias("path"), F.col("source_sha256").alias("sha"), "active"]
    reg = records.latest(p.where("first_seen_at < timestamp_ntz'2025-06-01'"), ["paper_id"], "last_seen_at").select(*cols)
    scan = _held(spark, d).where("active = 1").select(F.col("source_relpath").alias("path"), F.col("source_sha256").alias("sha"))
    return registry.reconcile(reg, scan)


def q40_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Blocks still to be worked, if those of the first pages were done."""
    p = _paragraphs(spark, d).withColumn("input_hash", F.sha2("text", 256))
    blocks, done = p.select("block_id", "paper_id", "input_hash"), p.where("page < 8").select("block_id", "input_hash", F.lit("success").alias("status"))
    return registry.pending(blocks, done, ["block_id"])


def q41_ranked_statements(spark: SparkSession, d: str) -> DataFrame:
    s = _objectives(spark, d)
    title = _held(spark, d).select("paper_id", "title")
    lead = _paragraphs(spark, d).groupBy("paper_id").agg(F.min_by("text", "block_id").alias("abstract"))
    rows = s.join(title, "paper_id", "left").join(lead, "paper_id", "left").select("paper_id", "pos", "statement", F.lit("this_paper_result").alias("origin"), F.size(F.coalesce("evidence_sids", F.array().cast("array<string>"))).alias("n_evidence"), F.lit(0.0).alias("section_evidence"), F.lit(False).alias("rejected"), "abstract", F.lit(None).cast("string").alias("conclusion"), "title", F.lit(None).cast("string").alias("summary"))
    return ranking.rank_statements(rows)


def q42_citations(spark: SparkSession, d: str) -> DataFrame:
    doc = F.from_json("metadata_json", "canonical struct<title:string,authors:array<struct<full_name:string,given:string,family:string>>,journal:string,year:int,doi:string>")["canonical"]
    m = table(spark, d, "paper_metadata_v4").select("paper_id", doc.alias("c")).distinct()
    nothing = F.lit("")
    r = {"authors": F.col("c.authors"), "title": F.col("c.title"), "journal": F.col("c.journal"), "journal_abbreviation": nothing, "year": F.col("c.year"), "volume": nothing, "issue": nothing, "pages": nothing, "doi": F.col("c.doi")}
    return m.select("paper_id", *[citations.citation(r, s).alias(s) for s in citations.STYLES])


def q43_audit_terms(spark: SparkSession, d: str) -> DataFrame:
    aliases = curation.alias_map(table(spark, d, "terms"))
    p = _items(spark, d, "studied_properties", "property_raw", "property_raw").select("paper_id", "shown")
    r = curation.resolve(p, aliases, "property", "shown")
    return r.groupBy("canonical", "canonical_source").agg(F.count("*").alias("mentions"), F.count_distinct("shown").alias("raw_forms"), F.count_distinct("paper_id").alias("papers"))


def q45_membership_move(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "paper_projects").select("paper_id", "project_slug").distinct()
    chosen = _held(spark, d).where("active = 0").select("paper_id")
    return registry.change_membership(m, chosen, "move", "hydrogel-survey", "archive")


def q53_master_library(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "paper_projects").select("paper_id", "project_slug").distinct()
    return registry.master_library(_held(spark, d).select("paper_id", "title", "year"), m)


def q54_merged_systems(spark: SparkSession, d: str) -> DataFrame:
    inv = table(spark, d, "inventory").select("inventory_id", "paper_id", "systems").distinct()
    s = inv.select("inventory_id", "paper_id", F.posexplode("systems").alias("i", "s"))
    name = F.coalesce(F.nullif(F.col("s.normalized_name"), F.lit("")), F.col("s.system_name_raw"))
    rows = s.select("paper_id", text.plain_key(name).alias("key"), "inventory_id", "i", F.col("s.system_name_raw").alias("raw"), F.col("s.system_type").alias("kind"), F.array_compact(F.col("s.evidence_sids")).alias("sids")).where("key != ''")
    g = records.union_lists(rows, ["paper_id", "key"], ["sids"], ["raw", "kind"], ["inventory_id", "i"])
    return g.select("paper_id", "key", F.array_join("sids", ",").alias("sids"), "raw", "kind")


def q55_status_counts(spark: SparkSession, d: str) -> DataFrame:
    m = records.latest(table(spark, d, "reference_matches_v4").select("citing_paper_id", "ref_id", "updated_at", "status", "match_score").distinct(), ["citing_paper_id", "ref_id"], "updated_at")
    return m.groupBy("citing_paper_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("matched_local", "resolved_external", "unresolved")], F.sum(F.round(F.col("match_score") * 10000).cast("bigint")).alias("score_sum"))


QUERIES = {f.__name__: f for f in (q07_greedy_chunks, q08_dedupe_first_wins, q09_mode_first_seen, q10_top_terms, q11_normal_keys, q12_numeric_tokens, q13_missing_evidence, q14_duplicate_statements, q15_overlay_latest, q16_sticky_delete, q17_debounce_sessions, q18_tumbling_counts, q19_project_rollup, q20_manifest, q21_unique_exact, q22_best_and_margin, q23_scored_match, q24_median_seconds, q25_call_model, q26_remaining, q27_history, q36_text_search, q38_excerpts, q39_reconcile, q40_incremental, q41_ranked_statements, q42_citations, q43_audit_terms, q45_membership_move, q50_validation_status, q51_citation_contexts, q52_numbers_not_found, q53_master_library, q54_merged_systems, q55_status_counts)}

_ROLE = f"CASE WHEN regexp_matches({_key('coalesce(heading, $$$$)')}, 'introduction|background|literature review') THEN 'background' WHEN regexp_matches({_key('coalesce(heading, $$$$)')}, 'method|experimental|computational detail') THEN 'methods' WHEN regexp_matches({_key('coalesce(heading, $$$$)')}, 'result|discussion|finding') THEN 'results_discussion' WHEN regexp_matches({_key('coalesce(heading, $$$$)')}, 'conclusion|summary|perspective|outlook') THEN 'conclusion' ELSE 'other' END"
_PARA = "para AS (SELECT DISTINCT block_id, paper_id, heading, page, text FROM paper_json WHERE kind = 'paragraph' AND text IS NOT NULL)"
_SENT = "sent AS (SELECT block_id, paper_id, s.sid AS sid, s.citation_ref_ids AS citation_ref_ids, s.text AS text FROM (SELECT DISTINCT block_id, paper_id, sentences FROM paper_json WHERE sentences IS NOT NULL), unnest(sentences) AS u(s))"
_OBJ = "obj AS (SELECT inventory_id, paper_id, i - 1 AS i, objectives[i].text AS statement FROM (SELECT DISTINCT inventory_id, paper_id, objectives FROM inventory), unnest(range(1, len(objectives) + 1)) AS u(i))"
_EVID = "ev AS (" + " UNION ALL ".join(f"SELECT paper_id, concat(inventory_id, ':{g}:', i - 1) AS item_id, unnest({g}[i].evidence_sids) AS evidence_id FROM (SELECT DISTINCT inventory_id, paper_id, {g} FROM inventory), unnest(range(1, len({g}) + 1)) AS u(i)" for g in _GROUPS) + ")"
_MISS = "SELECT ev.paper_id, 'error' AS severity, 'missing_evidence_id' AS issue, item_id, evidence_id AS detail FROM ev WHERE evidence_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sent WHERE sent.paper_id = ev.paper_id AND sent.sid = ev.evidence_id)"
_DUPS = f"SELECT paper_id, 'warning' AS severity, 'possible_duplicate_claim' AS issue, item_id, first AS detail FROM (SELECT paper_id, concat(inventory_id, ':', i) AS item_id, first_value(concat(inventory_id, ':', i)) OVER w AS first, row_number() OVER w AS r FROM obj WHERE {_key('coalesce(statement, $$$$)')} <> '' WINDOW w AS (PARTITION BY paper_id, {_key('coalesce(statement, $$$$)')} ORDER BY inventory_id * 1000 + i)) WHERE r > 1"
_NUM = "regexp_extract_all(replace({x}, ',', ''), '\\d+(?:\\.\\d+)?(?:[eE][+-]?\\d+)?')"
_PATCH = "patch AS (SELECT user_id, arg_max(value, (ts, event_id)) FILTER (event_type IN ('click', 'view') AND value IS NOT NULL) AS value, arg_max(props, (ts, event_id)) FILTER (event_type = 'purchase' AND props IS NOT NULL) AS note, bool_or(event_type = 'error') AS deleted, count(*) AS n_events FROM events GROUP BY user_id)"
_LATEST = "m AS (SELECT * FROM (SELECT DISTINCT citing_paper_id, ref_id, updated_at, status, match_score FROM reference_matches_v4) QUALIFY row_number() OVER (PARTITION BY citing_paper_id, ref_id ORDER BY updated_at DESC, status DESC NULLS LAST, match_score DESC NULLS LAST) = 1)"
_MODEL = "model AS (SELECT phase, ok AS sample_count, total / ok AS seconds_per_chunk, greatest(1.0, CASE WHEN n > 1 THEN spread ELSE total / ok * 0.25 END * sqrt(n / ok)) AS sigma_per_chunk, n / ok AS retry_factor FROM (SELECT l_returnflag AS phase, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS ok, sum(l_quantity) AS total, stddev_pop(l_quantity) AS spread FROM lineitem WHERE l_quantity BETWEEN 0 AND 1800 GROUP BY 1) WHERE ok > 0)"
_MEMBERS = "members AS (SELECT DISTINCT paper_id, project_slug FROM paper_projects)"

_AUTHOR_LIST = f"""au AS (SELECT paper_id, title, journal, year, doi, list_transform(coalesce(authors, []), lambda a: struct_pack(family := {_flat('a.family')}, given := {_flat('a.given')}, named := {_flat('a.full_name')})) AS l FROM
 (SELECT DISTINCT paper_id, j.title AS title, j.journal AS journal, j.year AS year, j.doi AS doi, j.authors AS authors FROM (SELECT paper_id, from_json(metadata_json, '{{"canonical": {{"title": "VARCHAR", "authors": [{{"full_name": "VARCHAR", "given": "VARCHAR", "family": "VARCHAR"}}], "journal": "VARCHAR", "year": "INTEGER", "doi": "VARCHAR"}}}}').canonical AS j FROM paper_metadata_v4))),
pa AS (SELECT * EXCLUDE (l), list_transform(l, lambda a: struct_pack(f := CASE WHEN a.family <> '' THEN a.family ELSE list_last(string_split(a.named, ' ')) END,
 i := array_to_string(list_transform(regexp_extract_all(CASE WHEN a.family = '' THEN array_to_string(string_split(a.named, ' ')[1:-2], ' ') WHEN a.given <> '' THEN a.given WHEN ends_with(lower(a.named), lower(a.family)) THEN trim(left(a.named, length(a.named) - length(a.family)), ' ,') ELSE a.named END, '\\p{{L}}+'), lambda w: upper(w[1]) || '.'), ' '))) AS p FROM au),
li AS (SELECT * EXCLUDE (p), list_transform(p, lambda a: concat_ws(', ', nullif(a.f, ''), nullif(a.i, ''))) AS inv, list_transform(p, lambda a: concat_ws(' ', nullif(a.i, ''), nullif(a.f, ''))) AS str, len(p) AS n FROM pa),
st AS (SELECT paper_id, coalesce(nullif(array_to_string(CASE WHEN n > 10 THEN inv[1:10] || ['et al.'] ELSE inv END, '; '), ''), 'Unknown author') AS a_acs,
 CASE WHEN n = 0 THEN 'Unknown author' ELSE array_to_string(str, ', ') END AS a_plain,
 CASE WHEN n > 5 THEN inv[1] || ' et al.' WHEN n = 0 THEN 'Unknown author' WHEN n = 1 THEN inv[1] ELSE array_to_string(inv[1:-2], ', ') || ' & ' || inv[-1] END AS a_nature,
 CASE WHEN n > 10 THEN array_to_string(str[1:10], ', ') || ', et al.' WHEN n = 0 THEN 'Unknown author' ELSE array_to_string(str, ', ') END AS a_science,
 coalesce(nullif(rtrim({_flat('title')}, '.'), ''), 'Untitled') AS t, coalesce(nullif({_flat('journal')}, ''), 'Unknown journal') AS jn, coalesce(year::VARCHAR, 'n.d.') AS y, rtrim({_flat('doi')}, '.') AS d FROM li)"""


def _ended(x: str) -> str:
    return f"CASE WHEN ends_with({x}, '.') THEN {x} ELSE {x} || '.' END"


def _cited(x: str) -> str:
    return f"rtrim({_flat(x)}, '.') || '.'"


_DOI_PART, _URL_PART = "CASE WHEN d = '' THEN '' ELSE '{0}DOI: ' || d END", "CASE WHEN d = '' THEN '' ELSE '{0}https://doi.org/' || d END"

SQL = {
    "q42_citations": f"WITH {_AUTHOR_LIST} SELECT paper_id, {_cited('(' + _ended('a_acs') + chr(32) + '|| chr(32) || t || chr(46) || chr(32) || jn || chr(32) || y || ' + _DOI_PART.format('. ') + ')')} AS acs, {_cited('(a_plain || chr(44) || chr(32) || jn || chr(44) || chr(32) || y || ' + _DOI_PART.format(', ') + ')')} AS rsc, {_cited('(a_plain || chr(44) || chr(32) || jn || chr(32) || y || ' + _URL_PART.format(', ') + ')')} AS wiley, {_cited('(' + _ended('a_nature') + ' || chr(32) || t || chr(46) || chr(32) || jn || chr(32) || chr(40) || y || chr(41) || ' + _URL_PART.format('. ') + ')')} AS nature, {_cited('(a_science || chr(44) || chr(32) || t || chr(46) || chr(32) || jn || chr(32) || chr(40) || y || chr(41) || ' + _DOI_PART.format('. ') + ')')} AS science FROM st",
    "q07_greedy_chunks": f"WITH RECURSIVE {_PARA}, u AS (SELECT paper_id, block_id, {_ROLE} AS role, length(text) + length(coalesce(heading, '')) + 64 AS len, row_number() OVER (PARTITION BY paper_id ORDER BY block_id) AS r FROM para), f AS (SELECT paper_id, block_id, role, r, len AS used, 1 AS chunk_no FROM u WHERE r = 1 UNION ALL SELECT u.paper_id, u.block_id, u.role, u.r, CASE WHEN u.role <> f.role OR f.used + u.len > 1200 THEN u.len ELSE f.used + u.len END, CASE WHEN u.role <> f.role OR f.used + u.len > 1200 THEN f.chunk_no + 1 ELSE f.chunk_no END FROM f JOIN u ON u.paper_id = f.paper_id AND u.r = f.r + 1) SELECT paper_id, chunk_no, count(*) AS n_units, min(block_id) AS first_block, min(role) AS role FROM f GROUP BY 1, 2",
    "q08_dedupe_first_wins": "SELECT sha256(text) AS sha, min(doc_id) AS doc_id, arg_min_null(source, doc_id) AS source FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "q09_mode_first_seen": "WITH i AS (SELECT DISTINCT inventory_id, paper_id, article_type FROM inventory), c AS (SELECT paper_id, article_type, count(*) AS n, min(inventory_id) AS seen FROM i WHERE article_type IS NOT NULL AND article_type <> 'unclear' GROUP BY 1, 2), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, seen) = 1) SELECT p.paper_id, coalesce(b.article_type, 'unclear') AS article_type FROM (SELECT DISTINCT paper_id FROM i) p LEFT JOIN b ON b.paper_id IS NOT DISTINCT FROM p.paper_id",
    "q10_top_terms": f"WITH {_PROPS}, {_MEMBERS}, c AS (SELECT project_slug, key, count(*) AS n, min(inventory_id) AS seen FROM props JOIN members USING (paper_id) GROUP BY 1, 2) SELECT project_slug, key, n, row_number() OVER (PARTITION BY project_slug ORDER BY n DESC, seen, key) AS rank FROM c QUALIFY rank <= 10",
    "q11_normal_keys": f"SELECT DISTINCT reference_no, {_flat('title')} AS flat, {_title('title')} AS title_key, {_key('coalesce(journal, $$$$)')} AS journal_key, {_doi('doi')} AS doi_key, regexp_matches({_doi('doi')}, '^10\\.\\d{{4,9}}/\\S+$') AS is_doi, trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '&[a-z]+;', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS entity_key FROM reference",
    "q12_numeric_tokens": f"WITH {_PARA} SELECT block_id, array_to_string({_NUM.format(x='text')}, ' ') AS numbers, ceil(length(text) / 3)::BIGINT AS tokens, nullif(regexp_extract(text, '\\b((?:18|19|20|21)\\d{{2}})\\b', 1), '')::INT AS year, {_ROLE} AS role FROM para",
    "q13_missing_evidence": f"WITH {_SENT}, {_EVID} {_MISS}",
    "q14_duplicate_statements": f"WITH {_OBJ} {_DUPS}",
    "q15_overlay_latest": f"WITH {_PATCH} SELECT * FROM patch",
    "q16_sticky_delete": f"WITH {_PATCH} SELECT c_custkey AS user_id, coalesce(p.value, c_acctbal) AS value, coalesce(p.note, c_name) AS note, c_acctbal AS value_original, c_name AS note_original FROM customer LEFT JOIN patch p ON p.user_id = c_custkey WHERE NOT coalesce(deleted, false)",
    "q17_debounce_sessions": "WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(t) AS start_us, max(t) AS last_us, count(*) AS n FROM s GROUP BY user_id, k",
    "q18_tumbling_counts": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "q19_project_rollup": f"WITH {_HELD}, {_MEMBERS} SELECT project_slug, count(DISTINCT members.paper_id) AS n_papers, count(DISTINCT members.paper_id) FILTER (active = 1) AS n_active FROM members LEFT JOIN held USING (paper_id) GROUP BY 1",
    "q20_manifest": f"WITH {_HELD} SELECT held.paper_id, source_relpath, CASE WHEN len(string_split(source_relpath, '/')) >= 3 AND string_split(source_relpath, '/')[1] = 'projects' THEN string_split(source_relpath, '/')[2] ELSE 'default' END AS project, coalesce(held.title, '') AS title, coalesce(match_status, '') AS match_status, round(coalesce(confidence, 0), 6) AS confidence, coalesce(nullif(trim(regexp_replace(original_filename, '[^A-Za-z0-9._-]+', '_', 'g'), '._')[1:120], ''), 'download') AS file_name FROM held LEFT JOIN (SELECT DISTINCT paper_id, match_status, confidence FROM paper_metadata_v4) m USING (paper_id)",
    "q21_unique_exact": f"WITH {_HELD}, r AS (SELECT DISTINCT reference_no, title, authors[1] AS author, journal, year, {_doi('doi')} AS doi FROM reference), p AS (SELECT {_doi('doi')} AS doi, min(paper_id) AS paper_id FROM held GROUP BY 1 HAVING count(DISTINCT paper_id) = 1) SELECT reference_no, doi, p.paper_id FROM r JOIN p USING (doi) WHERE doi <> ''",
    "q22_best_and_margin": f"WITH {_HELD}, a AS (SELECT DISTINCT journal AS name, {_key('journal')} AS x FROM reference WHERE {_key('coalesce(journal, $$$$)')} <> ''), b AS (SELECT DISTINCT journal AS candidate, {_key('journal')} AS y FROM held WHERE {_key('coalesce(journal, $$$$)')} <> ''), s AS (SELECT name, candidate, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) AS score FROM a JOIN b ON 1 - levenshtein(x, y) / greatest(length(x), length(y)) >= 0.6), r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY name ORDER BY score DESC, candidate)) SELECT name, candidate, score, round(score - coalesce(next, 0), 6) AS margin FROM r WHERE k = 1",
    "q24_median_seconds": "SELECT event_type, round(median(value), 6) AS median_value, count(*) AS n FROM events GROUP BY 1",
    "q25_call_model": f"WITH {_MODEL} SELECT phase, sample_count, round(seconds_per_chunk, 6) AS seconds_per_chunk, round(sigma_per_chunk, 6) AS sigma_per_chunk, round(retry_factor, 6) AS retry_factor FROM model",
    "q26_remaining": f"WITH {_MODEL}, b AS (SELECT l_returnflag AS phase, count(DISTINCT l_suppkey) AS chunks FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), s AS (SELECT coalesce(sum(chunks * seconds_per_chunk), 0) + 7 * 75.0 + 3 * 105.0 + 210.0 AS total, coalesce(sum(chunks * sigma_per_chunk * sigma_per_chunk), 0) + 7 * 26.25 * 26.25 + 3 * 36.75 * 36.75 + (18.0 * 18.0 * 2 + 9.0 * 9.0) + 900.0 AS var FROM b JOIN (SELECT * FROM model WHERE phase <> 'A') USING (phase)), t AS (SELECT total, greatest(120.0, sqrt(var), total * 0.1) AS doubt FROM s) SELECT round(total, 3) AS estimate_seconds, round(doubt, 3) AS uncertainty_seconds, round(greatest(30.0, total - doubt), 3) AS low_seconds, round(greatest(greatest(30.0, total - doubt) + 30, total + doubt), 3) AS high_seconds FROM t",
    "q27_history": f"WITH {_HELD}, c AS (SELECT year, count(*) AS n FROM held WHERE year IS NOT NULL GROUP BY 1) SELECT year, n, sum(n) OVER (ORDER BY year)::BIGINT AS known FROM c",
    "q36_text_search": f"WITH {_HELD} SELECT paper_id, title, year FROM held WHERE contains(lower(concat_ws(' ', title, journal, doi, paper_id)), 'micelle')",
    "q38_excerpts": f"WITH {_PARA}, r AS (SELECT paper_id, block_id, text, coalesce(sum(length(text)) OVER (PARTITION BY paper_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY paper_id ORDER BY block_id) AS k FROM para) SELECT paper_id, block_id, length(substring(text, 1, (1800 - before)::BIGINT)) AS n_chars, md5(substring(text, 1, (1800 - before)::BIGINT)) AS digest FROM r WHERE k <= 4 AND before < 1800",
    "q39_reconcile": f"WITH {_HELD}, reg AS (SELECT paper_id, source_relpath AS path, source_sha256 AS sha, active FROM (SELECT DISTINCT * FROM papers WHERE first_seen_at < TIMESTAMP '2025-06-01') QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY last_seen_at DESC, active DESC) = 1), scan AS (SELECT DISTINCT source_relpath AS path, source_sha256 AS sha FROM held WHERE active = 1), kept AS (SELECT reg.sha, paper_id AS kept_id, scan.path IS NOT NULL AS there FROM reg LEFT JOIN scan ON scan.path = reg.path QUALIFY row_number() OVER (PARTITION BY reg.sha ORDER BY active DESC, paper_id, there) = 1), s AS (SELECT scan.path, scan.sha, reg.paper_id AS path_id, reg.sha AS old_sha, kept_id, there, kept_id IS NOT NULL AND coalesce(reg.paper_id, '') <> kept_id AS known FROM scan LEFT JOIN reg ON reg.path = scan.path LEFT JOIN kept ON kept.sha = scan.sha), o AS (SELECT path, sha, CASE WHEN path_id IS NOT NULL AND (coalesce(old_sha = sha, false) OR NOT known) THEN path_id ELSE kept_id END AS paper_id, CASE WHEN old_sha = sha THEN 'unchanged' WHEN known AND there THEN 'duplicate' WHEN known THEN 'renamed' WHEN path_id IS NOT NULL THEN 'changed' ELSE 'added' END AS change FROM s) SELECT path, sha, paper_id, change FROM o UNION ALL SELECT path, sha, paper_id, 'vanished' FROM reg WHERE active = 1 AND NOT EXISTS (SELECT 1 FROM scan WHERE scan.path = reg.path) AND NOT EXISTS (SELECT 1 FROM o WHERE o.change = 'renamed' AND o.paper_id = reg.paper_id)",
    "q40_incremental": f"WITH {_PARA} SELECT block_id, paper_id, sha256(text) AS input_hash FROM para WHERE page IS NULL OR page >= 8",
    "q45_membership_move": f"WITH {_HELD}, {_MEMBERS} SELECT DISTINCT m.paper_id, CASE WHEN m.project_slug = 'hydrogel-survey' AND active = 0 THEN 'archive' ELSE m.project_slug END AS project_slug FROM members m LEFT JOIN held USING (paper_id)",
    "q50_validation_status": f"WITH {_SENT}, {_EVID}, {_OBJ}, x AS ({_MISS} UNION ALL {_DUPS}), c AS (SELECT paper_id, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings FROM x GROUP BY 1) SELECT p.paper_id, coalesce(n_errors, 0) AS n_errors, coalesce(n_warnings, 0) AS n_warnings, CASE WHEN coalesce(n_errors, 0) + coalesce(n_warnings, 0) > 0 THEN 'review_required' ELSE 'pass' END AS overall_status FROM (SELECT DISTINCT paper_id FROM inventory) p LEFT JOIN c USING (paper_id)",
    "q51_citation_contexts": f"WITH {_SENT}, s AS (SELECT paper_id, sid, flatten(list(coalesce(citation_ref_ids, []))) AS own FROM sent WHERE sid IS NOT NULL GROUP BY 1, 2), c AS (SELECT DISTINCT paper_id, concat(block_id, ':', sid) AS item_id, sid, citation_ref_ids AS refs FROM sent WHERE sid IS NOT NULL AND len(citation_ref_ids) > 0), e AS (SELECT c.paper_id, item_id, own, unnest(refs) AS ref_id FROM c JOIN s USING (paper_id, sid)) SELECT paper_id, 'warning' AS severity, 'citation_ref_not_in_reference_list' AS issue, item_id, ref_id AS detail FROM e WHERE NOT EXISTS (SELECT 1 FROM reference r WHERE r.paper_id = e.paper_id AND r.ref_id = e.ref_id) UNION ALL SELECT paper_id, 'error', 'citation_ref_not_present_in_evidence_sentence', item_id, ref_id FROM e WHERE NOT coalesce(list_contains(own, ref_id), false)",
    "q52_numbers_not_found": f"WITH {_SENT}, c AS (SELECT paper_id, concat(inventory_id, ':', i - 1) AS item_id, {_NUM.format(x='global_conditions[i].value_raw')} AS want FROM (SELECT DISTINCT inventory_id, paper_id, global_conditions FROM inventory), unnest(range(1, len(global_conditions) + 1)) AS u(i)), n AS (SELECT paper_id, flatten(list({_NUM.format(x='text')})) AS have FROM sent WHERE text IS NOT NULL GROUP BY 1), f AS (SELECT c.paper_id, item_id, list_filter(want, lambda x: NOT list_contains(coalesce(have, []), x)) AS missing FROM c LEFT JOIN n USING (paper_id)) SELECT paper_id, 'warning' AS severity, 'measurement_number_not_found_verbatim' AS issue, item_id, array_to_string(missing, ',') AS detail FROM f WHERE len(missing) > 0",
    "q54_merged_systems": f"WITH s AS (SELECT paper_id, inventory_id, i, systems[i] AS s FROM (SELECT DISTINCT inventory_id, paper_id, systems FROM inventory), unnest(range(1, len(systems) + 1)) AS u(i)), k AS (SELECT *, {_key('coalesce(coalesce(nullif(s.normalized_name, $$$$), s.system_name_raw), $$$$)')} AS key FROM s), g AS (SELECT paper_id, key, array_to_string(list_sort(list_distinct(flatten(list(list_filter(coalesce(s.evidence_sids, []), lambda x: x IS NOT NULL))))), ',') AS sids, arg_min(s.system_name_raw, (inventory_id, i)) FILTER (coalesce(s.system_name_raw, '') <> '') AS raw, arg_min(s.system_type, (inventory_id, i)) FILTER (coalesce(s.system_type, '') <> '') AS kind FROM k WHERE key <> '' GROUP BY 1, 2) SELECT * FROM g",
    "q53_master_library": f"WITH {_HELD}, {_MEMBERS} SELECT held.paper_id, title, year, coalesce(string_agg(DISTINCT project_slug, ',' ORDER BY project_slug), '') AS projects FROM held LEFT JOIN members USING (paper_id) GROUP BY 1, 2, 3",
    "q55_status_counts": f"WITH {_LATEST} SELECT citing_paper_id, count(*) AS n, count(*) FILTER (status = 'matched_local') AS matched_local, count(*) FILTER (status = 'resolved_external') AS resolved_external, count(*) FILTER (status = 'unresolved') AS unresolved, sum(round(match_score * 10000)::BIGINT)::BIGINT AS score_sum FROM m GROUP BY 1",
}
