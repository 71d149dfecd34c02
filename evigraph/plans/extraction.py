"""Queries on merged extractions, term candidates, resolved references and record forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import providers, text
from ..operators import curation, keywords, merging, records, resolution, similarity
from ..operators.orphans import paper_number
from ..runtime import table, written
from .layers import _HELD, _MATCHES, _PROPS, _doi, _flat, _held, _items, _key, _number, _title

_NO_SIDS = "array<string>"


def _entries(spark: SparkSession, d: str, array: str, **fields: str) -> DataFrame:
    inv = table(spark, d, "inventory").select("inventory_id", "paper_id", array).distinct()
    x = inv.select("inventory_id", "paper_id", F.posexplode(array).alias("pos", "x"))
    return x.select("paper_id", "inventory_id", "pos", *[F.col(f"x.{f}").alias(n) for n, f in fields.items()], F.coalesce("x.evidence_sids", F.array().cast(_NO_SIDS)).alias("sids"))


def q67_merged_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Objectives, methods, properties and conditions of a paper's chunks, the first of each key, numbered."""
    order, parts = ["inventory_id", "pos"], []
    for kind, array, keys in (
        ("objective", "objectives", [("text",)]),
        ("method", "methods", [("method_normalized", "method_raw"), ("target_property",)]),
        ("property", "studied_properties", [("property_normalized", "property_raw")]),
        ("condition", "global_conditions", [("condition_type",), ("value_raw",)]),
    ):
        items = _entries(spark, d, array, **{f: f for k in keys for f in k}).drop("sids")
        key = {f"k{i + 1}": text.plain_key(F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in k])) for i, k in enumerate(keys)}
        key |= {"k2": F.lit("")} if len(keys) == 1 else {}
        m = merging.merged(items, "paper_id", key, order, kind[0].upper(), 4)
        parts.append(m.select("paper_id", F.lit(kind).alias("kind"), "item_id", "k1", "k2", "inventory_id", "pos"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def q68_merged_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Conditions as measurements, objectives as claims and citing sentences as contexts: equal ones with equal evidence once."""
    order = ["inventory_id", "pos"]
    m = merging.merged(_entries(spark, d, "global_conditions", what="condition_type", value="value_raw"), "paper_id", {"k1": text.plain_key(F.col("what")), "k2": text.plain_key(F.col("value")), "k3": merging.sids_key(F.col("sids"))}, order, "M", 4)
    c = merging.merged(_entries(spark, d, "objectives", what="text"), "paper_id", {"k1": text.plain_key(F.col("what")), "k2": F.lit(""), "k3": merging.sids_key(F.col("sids"))}, order, "C", 4)
    b = table(spark, d, "paper_json").where("sentences is not null").select("block_id", "paper_id", "heading", "sentences").distinct()
    s = b.select("paper_id", F.col("block_id").alias("inventory_id"), "heading", F.posexplode("sentences").alias("pos", "s")).select("paper_id", "inventory_id", "pos", "heading", F.col("s.sid").alias("sid"), F.col("s.citation_ref_ids").alias("refs")).where("size(refs) > 0")
    x = merging.merged(s, "paper_id", {"k1": F.coalesce("sid", F.lit("")), "k2": merging.sids_key(F.col("refs")), "k3": text.section_role(F.col("heading"))}, order, "CIT", 4)
    cols = ["paper_id", "item_id", "k1", "k2", "k3"]
    return m.select(*cols).unionByName(c.select(*cols)).unionByName(x.select(*cols))


_LISTS, _SCALARS = ("end_groups", "other_descriptors"), ("peg_family", "dp_raw", "dp_min", "dp_max", "mn_raw", "mw_raw", "dispersity_raw", "topology", "architecture", "monodispersity_status")


def q69_merged_systems(spark: SparkSession, d: str) -> DataFrame:
    """Systems with all their attributes; those without a name stand for themselves."""
    inv = table(spark, d, "inventory").select("inventory_id", "paper_id", "systems").distinct()
    x = inv.select("inventory_id", "paper_id", F.posexplode("systems").alias("pos", "s"))
    rows = x.select("paper_id", "inventory_id", "pos", F.col("s.system_name_raw").alias("name"), F.col("s.system_type").alias("type"), F.col("s.normalized_name").alias("norm"), F.col("s.evidence_sids").alias("sids"), *[F.col(f"s.attributes.{c}").alias(c) for c in (*_LISTS, *_SCALARS)])
    key = text.plain_key(F.coalesce(F.nullif(F.col("norm"), F.lit("")), F.col("name")))
    content = F.concat_ws("|", F.coalesce("type", F.lit("")), merging.sids_key(F.col("sids")))
    g = merging.merged_systems(rows, "paper_id", key, content, ["inventory_id", "pos"], ["sids", *_LISTS], ["name", "type", *_SCALARS])
    return g.select("paper_id", "system_id", "system_key", "name", "type", *[F.array_join(c, "|").alias(c) for c in ("sids", *_LISTS)], *[F.col(c).cast("string").alias(c) if not c.startswith("dp_m") else F.col(c) for c in _SCALARS])


def _keyword_members(spark: SparkSession, d: str) -> DataFrame:
    p = _items(spark, d, "studied_properties", "property_normalized", "property_raw")
    return p.select(F.col("key").alias("term"), paper_number(F.col("paper_id")).cast("bigint").alias("paper")).distinct()


def q70_lexical_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Property keys alike in their letters: up to 7 of each."""
    return keywords.lexical_pairs(_keyword_members(spark, d).select("term").distinct(), "term", 0.12, 7).withColumn("weight", F.round("weight", 6))


def q71_context_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Property keys whose papers have like vectors: up to 4 of each."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("paper"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    c = written(keywords.centroids(_keyword_members(spark, d), vectors), "centroids")
    near = lambda t: similarity.dense_pairs(t.select("term", "v"), "term", "v", 0.72)
    return keywords.context_pairs(c, near, 4).withColumn("weight", F.round("weight", 4))


def q72_candidate_terms(spark: SparkSession, d: str) -> DataFrame:
    """The 220 term pairs that a person or a model should judge first."""
    lexical, context = q70_lexical_pairs(spark, d), q71_context_pairs(spark, d)
    return keywords.candidate_terms(lexical, context, 220)


def _author(x):
    return F.struct(x["full_name"].alias("full_name"), x["given"].alias("given"), x["family"].alias("family"))


def q73_author_forms(spark: SparkSession, d: str) -> DataFrame:
    doc = F.from_json("metadata_json", "canonical struct<authors:array<struct<full_name:string,given:string,family:string>>>, original struct<authors:array<string>>")
    m = table(spark, d, "paper_metadata_v4").select("paper_id", "year", doc.alias("j")).distinct()
    a = F.col("j.canonical.authors")
    family = text.first_family(a)
    listed = F.array_join(F.coalesce(F.col("j.original.authors"), F.array().cast("array<string>")), "; ")
    return m.select(
        "paper_id", text.first_surname(a).alias("surname"), F.coalesce(family, F.lit("")).alias("family"), text.label(family, F.col("year"), F.col("paper_id")).alias("label"), text.authors_text(a).alias("names"),
        F.array_join(F.transform(F.coalesce(a, F.array().cast("array<struct<full_name:string,given:string,family:string>>")), text.author_display), "\n").alias("lines"),
        F.size(text.listed_authors(listed)).alias("n_listed"), F.array_join(F.transform(text.authors_of(F.array_join(text.listed_authors(listed), "\n")), lambda x: x["family"]), "; ").alias("families"),
    )


def q74_text_forms(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").select("reference_no", "paper_id", "ref_id", "title", "raw_reference", "year", "doi").distinct()
    raw = F.coalesce("raw_reference", F.lit(""))
    return r.select(
        "reference_no", text.entity_key(raw).alias("entity_key"), text.legacy_doi(F.col("doi")).alias("legacy_doi"), text.cell(raw).alias("cell"), text.middle_cut(raw, 80).alias("cut"), text.ellipsis(raw, 60).alias("short"),
        text.file_name(F.col("title")).alias("file_name"), text.evidence_line(F.col("ref_id"), F.col("year"), text.collapse(F.col("title")), F.array("paper_id")).alias("line"), text.script_json(F.concat(F.lit("<"), raw, F.lit(">&"))).alias("script"),
        text.publication_year(F.col("year")).alias("year"), text.record_uid(F.col("paper_id"), F.lit("claim"), F.col("title"), F.array("ref_id", "paper_id")).alias("uid"), F.array_join(text.id_list(F.concat_ws(" , ", F.lower("paper_id"), F.lit(" "), "ref_id")), ",").alias("ids"),
        providers.search_issue(F.col("title"), F.col("raw_reference"), 60).alias("issue"), text.searched_text(F.concat(F.lit("503 for url: https://x.org/works?rows=5&search="), F.replace(text.plain_key(F.col("title")), F.lit(" "), F.lit("+")), F.lit("&mail=a"))).alias("searched"),
    )


def q75_local_match(spark: SparkSession, d: str) -> DataFrame:
    """References scored against the papers of near titles by title edits, author, year and journal; a paper whose OpenAlex id
    stands among the works resolved for the citing paper counts for .035 more. The lead is over the next near title."""
    r = table(spark, d, "reference").select("reference_no", "paper_id", text.title_key(F.col("title")).alias("k"), F.get("authors", F.lit(0)).alias("author"), "journal", "year").distinct().where("k != ''").withColumn("citing", paper_number(F.col("paper_id")))
    doc = F.from_json("metadata_json", "canonical struct<authors:array<struct<full_name:string>>>")
    meta = table(spark, d, "paper_metadata_v4").select("paper_id", "openalex_id", F.get(doc["canonical"]["authors"]["full_name"], F.lit(0)).alias("c_author")).distinct()
    p = _held(spark, d).select("paper_id", text.title_key(F.col("title")).alias("c_k"), F.col("journal").alias("c_journal"), F.col("year").alias("c_year")).where("c_k != ''").join(meta, "paper_id", "left").withColumnRenamed("paper_id", "candidate").withColumn("work", text.openalex_key(F.col("openalex_id")))
    pairs = resolution.near_titles(r, p.withColumnRenamed("c_k", "k"), "k", 0.90)
    m = r.join(pairs, "k").join(p, "c_k").where("citing is null or citing != coalesce(regexp_extract(candidate, '^P0*([0-9]+)$', 1), '')")
    scores = resolution.scored(m, F.col("ratio"))
    works = _works(spark, d).select(F.col("citing"), "work", F.lit(True).alias("edge")).where("work != ''").distinct()
    with_edge = scores.join(works, ["citing", "work"], "left")
    bonus = F.when(F.col("edge"), 0.035).otherwise(0.0)
    return resolution.local_match(with_edge, ["reference_no"], "candidate", bonus)


def _works(spark: SparkSession, d: str) -> DataFrame:
    """(citing, work): OpenAlex ids resolved for the references of a paper."""
    m = records.latest(table(spark, d, "reference_matches_v4").select("citing_paper_id", "ref_id", "updated_at", "target_paper_id", "resolved_openalex_id").distinct(), ["citing_paper_id", "ref_id"], "updated_at")
    return m.select(paper_number(F.col("citing_paper_id")).alias("citing"), text.openalex_key(F.col("resolved_openalex_id")).alias("work"), paper_number(F.col("target_paper_id")).alias("target")).where("citing is not null")


def q76_referenced_edges(spark: SparkSession, d: str) -> DataFrame:
    """Citations known by OpenAlex only."""
    works = _works(spark, d)
    library = table(spark, d, "paper_metadata_v4").select(paper_number(F.col("paper_id")).alias("paper_id"), text.openalex_key(F.col("openalex_id")).alias("work")).distinct()
    return resolution.referenced_edges(works.select("citing", "work"), library, works.where("target is not null").select("citing", "target"))


def _older_match(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(reference_no, paper_id) by DOI, where the last paper of a DOI holds, and of the other references by the nearest title."""
    r = table(spark, d, "reference").select("reference_no", text.legacy_doi(F.col("doi")).alias("doi"), text.entity_key(F.col("title")).alias("k"))
    p = written(_held(spark, d).select("paper_id", text.legacy_doi(F.col("doi")).alias("doi"), text.entity_key(F.col("title")).alias("k")), "papers")
    last = p.where("doi != ''").groupBy("doi").agg(F.max("paper_id").alias("paper_id"))
    by_doi = written(r.where("doi != ''").join(last, "doi").groupBy("reference_no").agg(F.max("paper_id").alias("paper_id")), "by_doi")
    rest = written(r.where("length(k) >= 22").join(by_doi, "reference_no", "left_anti").select("reference_no", "k"), "rest")
    best = resolution.best_titles(rest, p.where("length(k) >= 22"), "k", 0.92, "paper_id")
    top = rest.join(best, "k").groupBy("reference_no").agg(F.max(F.struct("ratio", "paper_id")).alias("top"))
    return by_doi, top.select("reference_no", "top.paper_id")


def q77_doi_or_title(spark: SparkSession, d: str) -> DataFrame:
    """The older match: by DOI, where the last paper of a DOI holds, else the nearest title from .92 on and 22 letters on."""
    by_doi, by_title = _older_match(spark, d)
    return by_doi.withColumn("method", F.lit("doi")).unionByName(by_title.withColumn("method", F.lit("title")))


def q78_chosen_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of a paper's metadata: the registry's DOI as the first provider's, that of the record as the second's."""
    m = table(spark, d, "paper_metadata_v4").select("paper_id", text.doi_key(F.col("doi")).alias("b_doi"), F.col("crossref_score").alias("a_score"), F.col("openalex_score").alias("b_score")).distinct()
    p = _held(spark, d).select("paper_id", text.doi_key(F.col("doi")).alias("a_doi"))
    return resolution.chosen_metadata(m.join(p, "paper_id", "left"), 0.5)


def q79_reference_issues(spark: SparkSession, d: str) -> DataFrame:
    """Runs count as failed on papers that have gone (inactive); the search that failed is the title of their first reference."""
    refs = table(spark, d, "reference").select("paper_id", "ref_id", F.coalesce(F.nullif(text.collapse(F.col("title")), F.lit("")), text.collapse(F.col("raw_reference"))).alias("searchable"), "reference_no").distinct()
    one = refs.groupBy("paper_id", "ref_id").agg(F.min(F.struct("reference_no", "searchable"))["searchable"].alias("searchable"))
    first = refs.groupBy("paper_id").agg(F.min(F.struct("reference_no", "searchable"))["searchable"].alias("searched"))
    failures = _held(spark, d).where("active = 0").select("paper_id").join(first, "paper_id", "left").select("paper_id", F.coalesce("searched", F.lit("")).alias("searched"))
    m = records.latest(table(spark, d, "reference_matches_v4").select(F.col("citing_paper_id").alias("paper_id"), "ref_id", "updated_at", "status", "match_method").distinct(), ["paper_id", "ref_id"], "updated_at")
    recs = m.select("paper_id", "ref_id", F.when((F.col("status") == "unresolved") & (F.col("match_method") == "openalex"), "openalex").alias("provider_error"), F.lit(False).alias("recommended"))
    return resolution.reference_issues(one, recs, failures, m.where("match_method = 'manual'").select("paper_id", "ref_id"))


def q80_term_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Events replayed over the properties: clicks override the first property of the inventory chunk of their user's number,
    errors delete it, purchases add one, views are edits of the one added last, signups delete it."""
    items = _entries(spark, d, "studied_properties", raw="property_raw", norm="property_normalized").select("paper_id", F.concat_ws(":", F.lit("property"), "inventory_id", "pos").alias("uid"), "raw", "norm", "inventory_id", "pos")
    e = table(spark, d, "events").select("event_id", F.col("ts").alias("created_at"), "user_id", "event_type", "props", "value")
    own = items.where("pos = 0").select(F.col("inventory_id").alias("user_id"), "paper_id", "uid").dropDuplicates(["user_id", "uid"])
    added = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("event_id", F.struct("created_at", "event_id")).alias("last"))
    at = e.join(own, "user_id").join(added, "user_id", "left")
    user = F.concat(F.lit("property:user:"), F.col("last").cast("string"))
    kind = F.when(F.col("event_type").isin("click", "view"), "term_override").when(F.col("event_type").isin("error", "signup"), "term_delete").otherwise("term_add")
    events = at.select("event_id", "created_at", "paper_id", kind.alias("event_type"), F.when(F.col("event_type").isin("view", "signup"), user).otherwise(F.col("uid")).alias("uid"), F.when(F.col("value") > 20, F.col("props")).alias("canonical"), F.concat(F.lit("loss tangent "), F.col("event_id").cast("string")).alias("value"))
    aliases = table(spark, d, "terms").where("term_type = 'property'").select("canonical", F.explode("aliases").alias("alias")).select(text.plain_key(F.col("alias")).alias("key"), "canonical").groupBy("key").agg(F.max("canonical").alias("canonical"))
    return curation.apply_terms(items.drop("inventory_id", "pos"), events.where("uid is not null"), aliases, "property", text.plain_key).select("paper_id", "uid", "raw", "canonical", "canonical_source")


QUERIES = {f.__name__: f for f in (q67_merged_inventory, q68_merged_evidence, q69_merged_systems, q70_lexical_pairs, q71_context_pairs, q72_candidate_terms, q73_author_forms, q74_text_forms, q75_local_match, q76_referenced_edges, q77_doi_or_title, q78_chosen_metadata, q79_reference_issues, q80_term_overlay)}


def _ent(array: str, **fields: str) -> str:
    shown = ", ".join(f"{array}[i].{f} AS {n}" for n, f in fields.items())
    return f"(SELECT paper_id, inventory_id, i - 1 AS pos, {shown}, coalesce({array}[i].evidence_sids, []) AS sids FROM (SELECT DISTINCT inventory_id, paper_id, {array} FROM inventory), unnest(range(1, len({array}) + 1)) AS u(i))"


def _k(*names: str) -> str:
    return _key("coalesce(" + ", ".join(f"nullif({n}, '')" for n in names) + ", '')")


def _merge(source: str, keys: list[str], prefix: str) -> str:
    named = ", ".join(f"{k} AS k{i + 1}" for i, k in enumerate(keys))
    ks = ", ".join(f"k{i + 1}" for i in range(len(keys)))
    return f"SELECT *, concat('{prefix}', lpad(row_number() OVER (PARTITION BY paper_id ORDER BY seen)::VARCHAR, 4, '0')) AS item_id FROM (SELECT paper_id, {ks}, min((inventory_id, pos)) AS seen FROM (SELECT *, {named} FROM {source}) GROUP BY ALL)"


_MERGED = " UNION ALL ".join(
    f"SELECT paper_id, '{kind}' AS kind, item_id, k1, k2, seen[1] AS inventory_id, seen[2]::INT AS pos FROM ({_merge(_ent(array, **{f: f for f in fields}), keys, kind[0].upper())})"
    for kind, array, fields, keys in (
        ("objective", "objectives", ["text"], [_k("text"), "''"]),
        ("method", "methods", ["method_normalized", "method_raw", "target_property"], [_k("method_normalized", "method_raw"), _k("target_property")]),
        ("property", "studied_properties", ["property_normalized", "property_raw"], [_k("property_normalized", "property_raw"), "''"]),
        ("condition", "global_conditions", ["condition_type", "value_raw"], [_k("condition_type"), _k("value_raw")]),
    )
)
_SIDS = "array_to_string(list_sort(list_filter(coalesce({x}, []), lambda s: s IS NOT NULL)), ',')"
_ROLE = f"CASE WHEN regexp_matches({_key('coalesce(heading, $$$$)')}, 'introduction|background|literature review') THEN 'background' WHEN regexp_matches({_key('coalesce(heading, $$$$)')}, 'method|experimental|computational detail') THEN 'methods' WHEN regexp_matches({_key('coalesce(heading, $$$$)')}, 'result|discussion|finding') THEN 'results_discussion' WHEN regexp_matches({_key('coalesce(heading, $$$$)')}, 'conclusion|summary|perspective|outlook') THEN 'conclusion' ELSE 'other' END"
_CONTEXTS = "(SELECT paper_id, block_id AS inventory_id, i - 1 AS pos, heading, sentences[i].sid AS sid, sentences[i].citation_ref_ids AS refs FROM (SELECT DISTINCT block_id, paper_id, heading, sentences FROM paper_json WHERE sentences IS NOT NULL), unnest(range(1, len(sentences) + 1)) AS u(i) WHERE len(sentences[i].citation_ref_ids) > 0)"


def _grams(source: str, column: str) -> str:
    runs = " || ".join(f"CASE WHEN length(w) > {k} THEN list_transform(range(1, length(w) - {k} + 2), lambda i: w[i:i + {k - 1}]) WHEN length(w) <= {k} AND length(w) > {k - 1 if k > 3 else 0} THEN [w] ELSE [] END" for k in (3, 4, 5))
    return f"gw AS (SELECT {column} AS node, unnest(list_transform(list_filter(string_split_regex(lower({column}), '\\s+'), lambda x: x <> ''), lambda x: ' ' || x || ' ')) AS w FROM {source}), gt AS (SELECT node, unnest({runs}) AS term FROM gw), t AS (SELECT node, term, count(*) AS tf FROM gt GROUP BY ALL), nd AS (SELECT count(DISTINCT node) AS n FROM t), df AS (SELECT term, count(*) AS df FROM t GROUP BY term), rw AS (SELECT node, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN df USING (term), nd), ln_ AS (SELECT node, sqrt(sum(w * w)) AS len FROM rw GROUP BY node), v AS (SELECT node, term, w / len AS w FROM rw JOIN ln_ USING (node)), cosine AS (SELECT a.node AS src, b.node AS dst, round(sum(a.w * b.w), 9) AS weight FROM v a JOIN v b ON a.term = b.term AND a.node < b.node GROUP BY ALL HAVING sum(a.w * b.w) >= 0.12)"


_LEXICAL = f"{_grams('(SELECT DISTINCT key FROM props)', 'key')}, lb AS (SELECT src, dst, weight FROM cosine UNION ALL SELECT dst, src, weight FROM cosine), lr AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst DESC) AS r FROM lb), lexical AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(weight), 6) AS weight FROM lr WHERE r <= 7 GROUP BY 1, 2)"
_CONTEXT = (
    f"mem AS (SELECT DISTINCT key AS term, {_number('paper_id')}::BIGINT AS paper FROM props), vec AS (SELECT vec_id AS paper, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), sp AS (SELECT term, i, avg(v[i]) AS x FROM mem JOIN vec USING (paper), unnest(range(1, len(v) + 1)) AS u(i) GROUP BY ALL), "
    "mn AS (SELECT term, list(x ORDER BY i) AS v FROM sp GROUP BY term), cn AS (SELECT term, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM mn WHERE list_dot_product(v, v) > 0), own AS (SELECT term, CASE WHEN count(*) = 1 THEN min(paper) END AS only FROM mem GROUP BY term), "
    "cc AS (SELECT a.term AS src, b.term AS dst, list_dot_product(a.v, b.v) AS weight FROM cn a JOIN cn b ON a.term < b.term WHERE list_dot_product(a.v, b.v) >= 0.72), "
    "context AS (SELECT src, dst, round(weight, 4) AS weight FROM cc JOIN own x ON x.term = src JOIN own y ON y.term = dst WHERE x.only IS NULL OR y.only IS NULL OR x.only <> y.only QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst DESC) <= 4)"
)
_AUTHORS = "(SELECT DISTINCT paper_id, year, from_json(metadata_json, '{\"canonical\": {\"authors\": [{\"full_name\": \"VARCHAR\", \"given\": \"VARCHAR\", \"family\": \"VARCHAR\"}]}, \"original\": {\"authors\": [\"VARCHAR\"]}}') AS j FROM paper_metadata_v4)"
_FULL, _FAM, _GIV = ("trim(coalesce({a}.%s, ''))" % f for f in ("full_name", "family", "given"))
_LAST = "trim(regexp_extract({x}, '(\\S+)$', 1), ' ,.;')"


def _sur(x: str) -> str:
    return f"coalesce(lower(list_last(regexp_extract_all(coalesce({x}, ''), '[A-Za-z][A-Za-z''\\-]+'))), '')"


def _first_family() -> str:
    full, fam = _FULL.format(a="f"), _FAM.format(a="f")
    return f"CASE WHEN {fam} <> '' AND {full} <> '' AND ends_with(lower({full}), lower({fam})) THEN trim(right({full}, length({fam}))) WHEN {fam} <> '' THEN {fam} ELSE {_LAST.format(x=full)} END"


_DISPLAY = "CASE WHEN {f} <> '' AND {g} <> '' THEN {f} || ', ' || {g} ELSE coalesce(nullif({n}, ''), nullif({f}, ''), {g}) END".format(f=_FAM.format(a="a"), g=_GIV.format(a="a"), n=_FULL.format(a="a"))
_NAME = "trim(coalesce(nullif(a.full_name, ''), concat_ws(' ', nullif({g}, ''), nullif({f}, ''))))".format(f=_FAM.format(a="a"), g=_GIV.format(a="a"))
_RATIO = "(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})))"
_PART = "CASE WHEN {a} = '' OR {b} = '' THEN 0.45 WHEN {a} = {b} THEN 1.0 ELSE " + _RATIO + " END"
_YEAR = "CASE WHEN coalesce(r.year, 0) = 0 OR coalesce(c_year, 0) = 0 THEN 0.45 WHEN r.year = c_year THEN 1.0 WHEN abs(r.year - c_year) = 1 THEN 0.72 WHEN abs(r.year - c_year) = 2 THEN 0.35 ELSE 0.0 END"


def _legacy(x: str) -> str:
    return f"rtrim(trim(regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), '^https?://doi\\.org/', ''), '^doi:', '')), '.,; ')"


def _entity(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '&[a-z]+;', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _oa(x: str) -> str:
    return f"upper(regexp_extract(rtrim(trim(coalesce({x}, '')), '/'), '([^/]*)$', 1))"


_WORKS = f"{_MATCHES}, works AS (SELECT {_number('citing_paper_id')} AS citing, {_oa('resolved_openalex_id')} AS work, {_number('target_paper_id')} AS target FROM m WHERE {_number('citing_paper_id')} IS NOT NULL)"
_OVERLAY = (
    "items AS (SELECT paper_id, concat('property:', inventory_id, ':', pos) AS uid, raw, norm, inventory_id, pos FROM " + _ent("studied_properties", raw="property_raw", norm="property_normalized") + "), "
    "own AS (SELECT inventory_id AS user_id, any_value(paper_id) AS paper_id, uid FROM items WHERE pos = 0 GROUP BY inventory_id, uid), added AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1), "
    "ev AS (SELECT event_id, ts, paper_id, CASE WHEN event_type IN ('click', 'view') THEN 'term_override' WHEN event_type IN ('error', 'signup') THEN 'term_delete' ELSE 'term_add' END AS kind, CASE WHEN event_type IN ('view', 'signup') THEN concat('property:user:', last) ELSE uid END AS uid, CASE WHEN value > 20 THEN props END AS canonical, concat('loss tangent ', event_id) AS value FROM events JOIN own USING (user_id) LEFT JOIN added USING (user_id)), "
    f"al AS (SELECT {_key('alias')} AS key, max(canonical) AS canonical FROM (SELECT canonical, unnest(aliases) AS alias FROM terms WHERE term_type = 'property') GROUP BY 1), "
    "pat AS (SELECT paper_id, uid, arg_max(canonical, (ts, event_id)) FILTER (kind = 'term_override' AND coalesce(trim(canonical), '') <> '') AS canonical, bool_or(kind = 'term_delete') AS gone FROM ev WHERE uid IS NOT NULL AND kind <> 'term_add' GROUP BY ALL), "
    "base AS (SELECT paper_id, uid, raw, coalesce(nullif(" + _flat("norm") + ", ''), " + _flat("raw") + ") AS shown, false AS user FROM items UNION ALL SELECT DISTINCT paper_id, concat('property:user:', event_id), value, value, true FROM ev WHERE kind = 'term_add'), "
    f"res AS (SELECT b.*, al.canonical AS hit, {_key('shown')} AS key FROM base b LEFT JOIN al ON al.key = {_key('shown')} AND {_key('shown')} <> '') "
    "SELECT res.paper_id, res.uid, raw, coalesce(pat.canonical, hit, shown) AS canonical, CASE WHEN pat.canonical IS NOT NULL THEN 'paper_override' WHEN user THEN 'user_added' WHEN res.key = '' THEN 'empty' WHEN hit IS NOT NULL THEN 'alias' ELSE 'passthrough' END AS canonical_source FROM res LEFT JOIN pat USING (paper_id, uid) WHERE NOT coalesce(gone, false)"
)

SQL = {
    "q67_merged_inventory": _MERGED,
    "q68_merged_evidence": "SELECT paper_id, item_id, k1, k2, k3 FROM ("
    + _merge(_ent("global_conditions", what="condition_type", value="value_raw"), [_k("what"), _k("value"), _SIDS.format(x="sids")], "M")
    + " UNION ALL "
    + _merge(_ent("objectives", what="text"), [_k("what"), "''", _SIDS.format(x="sids")], "C")
    + " UNION ALL "
    + _merge(_CONTEXTS, ["coalesce(sid, '')", _SIDS.format(x="refs"), _ROLE], "CIT")
    + ")",
    "q69_merged_systems": "WITH s AS (SELECT paper_id, inventory_id, i, systems[i] AS s FROM (SELECT DISTINCT inventory_id, paper_id, systems FROM inventory), unnest(range(1, len(systems) + 1)) AS u(i)), k AS (SELECT *, CASE WHEN "
    + _key("coalesce(nullif(s.normalized_name, ''), s.system_name_raw, '')")
    + " <> '' THEN "
    + _key("coalesce(nullif(s.normalized_name, ''), s.system_name_raw, '')")
    + " ELSE sha256(concat_ws('|', coalesce(s.system_type, ''), "
    + _SIDS.format(x="s.evidence_sids")
    + "))[1:16] END AS system_key FROM s), g AS (SELECT paper_id, system_key, min((inventory_id, i)) AS seen, arg_min(s.system_name_raw, (inventory_id, i)) FILTER (coalesce(s.system_name_raw, '') <> '') AS name, arg_min(s.system_type, (inventory_id, i)) FILTER (coalesce(s.system_type, '') <> '') AS type, "
    + ", ".join(f"array_to_string(list_sort(list_distinct(flatten(list(list_filter(coalesce(s.{f}, []), lambda x: x IS NOT NULL))))), '|') AS {n}" for n, f in (("sids", "evidence_sids"), *((c, f"attributes.{c}") for c in _LISTS)))
    + ", "
    + ", ".join(f"arg_min(s.attributes.{c}, (inventory_id, i)) FILTER (coalesce(s.attributes.{c}::VARCHAR, '') <> '') AS {c}" for c in _SCALARS)
    + " FROM k GROUP BY ALL) SELECT * EXCLUDE (seen), concat('SYS', lpad(row_number() OVER (PARTITION BY paper_id ORDER BY seen)::VARCHAR, 3, '0')) AS system_id FROM g",
    "q70_lexical_pairs": f"WITH {_PROPS}, {_LEXICAL} SELECT * FROM lexical",
    "q71_context_pairs": f"WITH {_PROPS}, {_CONTEXT} SELECT * FROM context",
    "q72_candidate_terms": f"WITH {_PROPS}, {_LEXICAL}, {_CONTEXT}, one AS (SELECT src AS \"left\", dst AS \"right\", max(l) AS lexical, max(c) AS context FROM (SELECT src, dst, weight AS l, 0.0::DOUBLE AS c FROM lexical UNION ALL SELECT src, dst, 0.0, weight FROM context) GROUP BY ALL) SELECT concat('KW', sha256(concat(\"left\", chr(0), \"right\"))[1:12]) AS pair_id, * FROM one ORDER BY greatest(lexical, context) DESC, \"left\", \"right\" LIMIT 220",
    "q73_author_forms": f"SELECT paper_id, {_sur('coalesce(nullif(f.family, $$$$), f.full_name)')} AS surname, coalesce({_first_family()}, '') AS family, concat(coalesce(nullif({_first_family()}, ''), paper_id), ', ', coalesce(year::VARCHAR, '?')) AS label, array_to_string(list_filter(list_transform(coalesce(authors, []), lambda a: {_NAME}), lambda x: x <> ''), '; ') AS names, array_to_string(list_transform(coalesce(authors, []), lambda a: {_DISPLAY}), chr(10)) AS lines, len(listed)::INT AS n_listed, array_to_string(list_transform(listed, lambda x: CASE WHEN contains(x, ',') THEN trim(string_split(x, ',')[1]) ELSE regexp_extract(x, '(\\S+)$', 1) END), '; ') AS families FROM (SELECT paper_id, year, j.canonical.authors AS authors, j.canonical.authors[1] AS f, list_filter(list_transform(string_split(array_to_string(coalesce(j.original.authors, []), '; '), ';'), lambda x: trim(x)), lambda x: x <> '') AS listed FROM {_AUTHORS})",
    "q74_text_forms": f"SELECT reference_no, {_entity('raw_reference')} AS entity_key, {_legacy('doi')} AS legacy_doi, replace(replace(raw, '|', '\\|'), chr(10), ' ') AS cell, CASE WHEN length(raw) > 80 THEN raw[1:54] || ' ... ' || right(raw, 21) ELSE raw END AS cut, CASE WHEN length(raw) > 60 THEN raw[1:57] || '...' ELSE raw END AS short, coalesce(nullif(trim(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '._')[1:120], ''), 'download') AS file_name, '[' || ref_id || coalesce(' page=' || year, '') || '] ' || {_flat('title')} || ' [CITES:' || paper_id || ']' AS line, replace(replace(replace('<' || raw || '>&', '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') AS script, CASE WHEN year BETWEEN 1000 AND 2100 THEN year END AS year, 'claim:' || sha256(concat_ws('|', paper_id, 'claim', {_key('coalesce(title, $$$$)')}, array_to_string(list_sort([ref_id, paper_id]), ',')))[1:20] AS uid, upper(paper_id) || ',' || upper(ref_id) AS ids, CASE WHEN said = '' THEN 'no searchable title or citation text' WHEN length(said) > 60 THEN 'text of ' || length(said) || ' characters, above 60' END AS issue, {_key('coalesce(title, $$$$)')} AS searched FROM (SELECT DISTINCT reference_no, paper_id, ref_id, title, raw_reference, year, doi, coalesce(raw_reference, '') AS raw, coalesce(nullif({_flat('title')}, ''), {_flat('raw_reference')}) AS said FROM reference)",
    "q75_local_match": f"WITH {_HELD}, {_WORKS}, r AS (SELECT DISTINCT reference_no, {_number('paper_id')} AS citing, {_title('title')} AS k, authors[1] AS author, journal, year FROM reference WHERE {_title('title')} <> ''), meta AS (SELECT DISTINCT paper_id, {_oa('openalex_id')} AS work, from_json(metadata_json, '{{\"canonical\": {{\"authors\": [{{\"full_name\": \"VARCHAR\"}}]}}}}').canonical.authors[1].full_name AS c_author FROM paper_metadata_v4), p AS (SELECT held.paper_id AS candidate, {_title('title')} AS c_k, journal AS c_journal, year AS c_year, work, c_author FROM held LEFT JOIN meta USING (paper_id) WHERE {_title('title')} <> ''), "
    f"s AS (SELECT reference_no, candidate, {_RATIO.format(a='k', b='c_k')} AS ratio, 0.72 * {_RATIO.format(a='k', b='c_k')} + 0.12 * {_PART.format(a=_sur('author'), b=_sur('c_author'))} + 0.10 * {_YEAR} + 0.06 * {_PART.format(a=_title('journal'), b=_title('c_journal'))} AS raw, EXISTS (SELECT 1 FROM works w WHERE w.citing = r.citing AND w.work = p.work AND w.work <> '') AS helped FROM r JOIN p ON {_RATIO.format(a='k', b='c_k')} >= 0.90 WHERE citing IS NULL OR citing <> regexp_extract(candidate, '^P0*([0-9]+)$', 1)), "
    "b AS (SELECT *, round(round(raw, 6) + CASE WHEN helped THEN 0.035 ELSE 0 END, 6) AS adjusted FROM s), o AS (SELECT *, row_number() OVER w AS n, lead(adjusted) OVER w AS next FROM b WINDOW w AS (PARTITION BY reference_no ORDER BY adjusted DESC, candidate)) SELECT reference_no, candidate, adjusted, round(adjusted - coalesce(next, 0), 6) AS lead, CASE WHEN helped THEN 'title_author_year_plus_openalex_edge' ELSE 'title_author_year' END AS method FROM o WHERE n = 1 AND round(ratio, 6) >= 0.9 AND adjusted >= 0.89 AND round(adjusted - coalesce(next, 0), 6) >= 0.02",
    "q76_referenced_edges": f"WITH {_WORKS}, lib AS (SELECT DISTINCT {_number('paper_id')} AS target, {_oa('openalex_id')} AS work FROM paper_metadata_v4 WHERE {_oa('openalex_id')} <> '') SELECT DISTINCT w.citing, lib.target FROM works w JOIN lib USING (work) WHERE w.work <> '' AND w.citing <> lib.target AND NOT EXISTS (SELECT 1 FROM works x WHERE x.citing = w.citing AND x.target = lib.target)",
    "q77_doi_or_title": f"WITH {_HELD}, r AS (SELECT DISTINCT reference_no, {_legacy('doi')} AS doi, {_entity('title')} AS k FROM reference), p AS (SELECT paper_id, {_legacy('doi')} AS doi, {_entity('title')} AS k FROM held), d AS (SELECT reference_no, max(p.paper_id) AS paper_id FROM r JOIN p USING (doi) WHERE doi <> '' GROUP BY 1), t AS (SELECT reference_no, arg_max(paper_id, (round({_RATIO.format(a='r.k', b='p.k')}, 6), paper_id)) AS paper_id FROM r JOIN p ON length(r.k) >= 22 AND length(p.k) >= 22 AND {_RATIO.format(a='r.k', b='p.k')} >= 0.92 WHERE reference_no NOT IN (SELECT reference_no FROM d) GROUP BY 1) SELECT *, 'doi' AS method FROM d UNION ALL SELECT *, 'title' FROM t",
    "q78_chosen_metadata": f"WITH {_HELD}, x AS (SELECT DISTINCT m.paper_id, {_doi('m.doi')} AS b_doi, {_doi('held.doi')} AS a_doi, held.paper_id AS h, crossref_score AS a, openalex_score AS b, coalesce(crossref_score >= 0.5, false) AS oka, coalesce(openalex_score >= 0.5, false) AS okb FROM paper_metadata_v4 m LEFT JOIN held USING (paper_id)), y AS (SELECT *, oka AND okb AND h IS NOT NULL AND a_doi <> '' AND b_doi <> '' AND a_doi <> b_doi AS differ FROM x) SELECT paper_id, CASE WHEN differ THEN 'conflict' WHEN oka OR okb THEN 'resolved' WHEN a IS NOT NULL OR b IS NOT NULL THEN 'manual_review' ELSE 'unresolved' END AS status, CASE WHEN differ THEN 'original' WHEN oka THEN 'crossref' WHEN okb THEN 'openalex' ELSE 'original' END AS source, CASE WHEN differ THEN NULL WHEN oka THEN CASE WHEN h IS NOT NULL THEN a_doi END WHEN okb THEN b_doi END AS doi, greatest(CASE WHEN oka THEN a ELSE 0 END, CASE WHEN okb THEN b ELSE 0 END) AS confidence FROM y",
    "q79_reference_issues": f"WITH {_HELD}, rr AS (SELECT DISTINCT paper_id, ref_id, reference_no, coalesce(nullif({_flat('title')}, ''), {_flat('raw_reference')}) AS said FROM reference), refs AS (SELECT paper_id, ref_id, arg_min(said, (reference_no, said)) AS said FROM rr GROUP BY ALL), f AS (SELECT held.paper_id, coalesce(s, '') AS searched FROM held LEFT JOIN (SELECT paper_id, arg_min(said, (reference_no, said)) AS s FROM rr GROUP BY 1) USING (paper_id) WHERE active = 0), m AS (SELECT * FROM (SELECT DISTINCT citing_paper_id, ref_id, updated_at, status, match_method FROM reference_matches_v4) QUALIFY row_number() OVER (PARTITION BY citing_paper_id, ref_id ORDER BY updated_at DESC, status DESC NULLS LAST, match_method DESC NULLS LAST) = 1), t AS (SELECT refs.paper_id, refs.ref_id, searched, CASE WHEN searched IS NOT NULL AND (searched = '' OR searched = said OR (length(searched) > 100 AND length(said) > 100 AND (contains(searched, said) OR contains(said, searched)))) THEN 'stage_error' WHEN status = 'unresolved' AND match_method = 'openalex' THEN 'provider_error' WHEN match_method = 'manual' THEN 'override' END AS reason FROM refs LEFT JOIN f USING (paper_id) LEFT JOIN m ON m.citing_paper_id = refs.paper_id AND m.ref_id = refs.ref_id), u AS (SELECT *, count(reason) OVER (PARTITION BY paper_id) AS n FROM t) SELECT paper_id, ref_id, CASE WHEN n = 0 AND searched IS NOT NULL THEN 'unmapped_failure' ELSE reason END AS reason FROM u WHERE reason IS NOT NULL OR (n = 0 AND searched IS NOT NULL)",
    "q80_term_overlay": f"WITH {_OVERLAY}",
}
