import json
import zipfile

import pytest
from pyspark.sql import functions as F

from evigraph import services as s
from evigraph import settings
from evigraph.functions import providers
from evigraph.functions.arrow import json_hash
from evigraph.operators import curation, graph, library, merging
from evigraph.sources import files
from evigraph.streaming import programs


def test_each_miss_is_asked_for_once_and_errors_are_kept(spark, tmp_path):
    log = str(tmp_path / "asked")

    def service(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        if "bad" in texts:
            raise ValueError("no answer")
        return [t.upper() for t in texts]

    req = spark.createDataFrame([("a",), ("bad",), ("c",), ("a",)], "request string").withColumn("key", s.request_key("request"))
    cache = req.where("request = 'c'").select("key", F.lit("old").alias("response")).distinct()
    out, grown = s.answered(req, cache, service)
    got = {r["request"]: (r["response"], r["error"]) for r in out.collect()}
    assert got == {"a": ("A", None), "c": ("old", None), "bad": (None, "ValueError: no answer")} and grown.count() == 2
    asked = open(log).read().split()
    assert asked.count("a") <= 2 and "c" not in asked
    runs = s.run_rows(req, out, F.current_timestamp(), F.current_timestamp())
    assert {r["status"] for r in runs.collect()} == {"success", "error"} and runs.count() == 3


def test_retries_budgets_and_schemas():
    calls, slept = [], []

    def later(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise s.Later(seconds=7 if len(calls) == 1 else None)
        return texts

    assert s.Retried(later, wait=2, sleep=slept.append)(["x"]) == ["x"] and slept == [7, 4]
    with pytest.raises(s.Later):
        s.Retried(lambda t: (_ for _ in ()).throw(s.Later()), attempts=2, sleep=slept.append)(["x"])
    with pytest.raises(ValueError, match="tokens"):
        s.Budgeted(s.Echo(), 3)(["x" * 10])
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "items": {"type": "integer", "minimum": 1}}}}
    assert s.schema_errors({"a": [1, 0, "x"], "b": 1}, schema) == ["<root>: 'b' is not allowed", "a/1: 0 is below 1", "a/2: 'x' is not of type integer"]
    assert s.schema_errors([], schema) == ["<root>: [] is not of type object"] and s.schema_errors({"a": [2]}, schema) == []
    answers = iter([["no json"], ['```json\n{"a": [1]}\n```']])
    assert s.Structured(lambda r: next(answers), schema)(["q"]) == ['{"a": [1]}']
    with pytest.raises(ValueError):
        s.Structured(lambda r: ["{}"] * len(r), schema, attempts=2)(["q"])


def test_memories_merge_to_one_text_a_paper(spark):
    rows = [("P", i, "w" * 300) for i in range(9)] + [("Q", 0, "alone")] + [("R", i, "z" * 5000) for i in range(3)]
    df = spark.createDataFrame(rows, "paper_id string, pos int, text string")
    out = {r["paper_id"]: r["text"] for r in s.merged_memories(df, lambda texts: [f"[{len(t)}]" for t in texts], 2000).collect()}
    assert set(out) == {"P", "Q", "R"} and out["Q"] == "alone" and out["R"].startswith("[")


def test_inferred_relations_are_kept_by_confidence(spark):
    def judge(texts):
        return [json.dumps({"relation": "equivalent" if json.loads(t)["left"] == "a" else "different", "confidence": 0.9, "rationale": "r"}) for t in texts]

    pairs = spark.createDataFrame([("1", "a", "b"), ("2", "c", "d")], "pair_id string, left string, right string")
    empty = spark.createDataFrame([], "key string, response string")
    kept, grown = s.inferred_relations(pairs, empty, judge, {"equivalent": 0.72, "related": 0.72})
    assert [r["pair_id"] for r in kept.collect()] == ["1"] and grown.count() == 2
    assert s.inferred_relations(pairs, empty, judge, {"equivalent": 0.95})[0].count() == 0


def test_provider_records(spark):
    crossref = {"title": ["A"], "DOI": "10.1000/X.", "container-title": ["J"], "issued": {"date-parts": [[2001]]}, "published-print": {"date-time": "in 1999-01-01"}, "author": [{"given": "Ann", "family": "Lee"}], "ISSN": ["1"]}
    openalex = {"id": "https://openalex.org/w5", "display_name": "B", "doi": "https://doi.org/10.1/b", "publication_year": 2003, "biblio": {"first_page": "1", "last_page": "9"}, "authorships": [{"raw_author_name": "Bo von Ek"}], "referenced_works": ["https://openalex.org/W7"]}
    df = spark.createDataFrame([(json.dumps(crossref), json.dumps(openalex), "no json")], "c string, o string, bad string")
    r = df.select(providers.crossref_candidate(F.col("c")).alias("c"), providers.openalex_candidate(F.col("o")).alias("o")).first()
    assert (r.c.title, r.c.doi, r.c.year, r.c.journal, r.c.authors[0].full_name, r.c.issn) == ("A", "10.1000/x", 1999, "J", "Ann Lee", ["1"])
    assert (r.o.title, r.o.pages, r.o.openalex_id, r.o.authors[0].family, r.o.authors[0].given, r.o.referenced_works) == ("B", "1-9", "W5", "Ek", "Bo von", ["W7"])
    q = df.select(providers.search_request("crossref", F.lit("On gels"), F.lit(""), F.lit("lee"), F.lit(2001)).alias("q"), providers.lookup_request("openalex", F.lit("10.1/b")).alias("d")).first()
    assert q.q.endswith("query.bibliographic=On+gels+lee+2001&rows=5") and q.d.endswith("10.1%2Fb")
    assert df.select((json_hash(F.lit('{"b": 1, "a": 2}')) == json_hash(F.lit('{"a":2,"b":1}'))).alias("x"), json_hash(F.lit("{")).alias("y")).first() == (True, None)


def test_claim_overlay(spark):
    claims = spark.createDataFrame([("P", "c1", "One", None), ("P", "c2", "Two", "x")], "paper_id string, uid string, statement string, subject string")
    for f in curation.CLAIM_FIELDS:
        if f not in claims.columns:
            claims = claims.withColumn(f, F.lit(None).cast("string"))
    ev = [
        (1, 1, "P", "claim_edit", "c1", {"statement": "Uno", "subject": "s"}), (2, 2, "P", "claim_edit", "c1", {"subject": None}), (3, 3, "P", "claim_delete", "c2", {}), (4, 4, "P", "claim_edit", "c2", {"statement": "back"}),
        (5, 5, "P", "claim_add", None, {"statement": " New  one "}), (6, 6, "P", "claim_edit", "claim:user:5", {"statement": "Newer"}), (7, 7, "P", "claim_add", None, {"statement": " "}),
    ]
    events = spark.createDataFrame(ev, "event_id int, created_at int, paper_id string, event_type string, uid string, patch map<string,string>")
    got = {r["uid"]: (r["statement"], r["subject"], r["statement_original"], r["curation_origin"]) for r in curation.apply_claims(claims, events).collect()}
    assert got == {"c1": ("Uno", None, "One", "user_edited"), "claim:user:5": ("Newer", None, "New one", "user_edited")}


def test_settings(tmp_path, monkeypatch):
    assert settings.load(None)["resolution"] == 1.0
    path = tmp_path / "s.json"
    path.write_text('{"match": {"bonus": 0.1}, "other": 1}')
    assert settings.load(path)["match"]["bonus"] == 0.1 and settings.load(path)["match"]["least_title"] == 0.9
    weights = dict(settings.LAYER_WEIGHTS)
    settings.save_network(path, weights | {"claim": "2"}, 3)
    assert json.loads(path.read_text())["weights"]["claim"] == 2.0 and json.loads(path.read_text())["other"] == 1
    for bad, resolution in ((weights | {"odd": 1}, 1), ({"claim": 1}, 1), (weights | {"claim": 6}, 1), (weights | {"claim": True}, 1), (dict.fromkeys(weights, 0), 1), (weights, 4), (weights, float("nan"))):
        with pytest.raises(ValueError):
            settings.checked_network(bad, resolution)
    assert settings.network({"weights": {"claim": float("inf")}, "resolution": 9})["weights"]["claim"] == 0.30 and settings.network({"resolution": 9})["resolution"] == 3.0
    monkeypatch.setenv("X_Y", " v ")
    assert settings.env_or("c", "X_Y") == "v" and settings.env_or("", "X_Z", "d") == "d"
    assert settings.profile("fast", 10) == (3, 40) and settings.profile("full", 10)[1] == 10**9


def test_library(spark):
    p = spark.createDataFrame([("P1", 1), ("P2", 0), ("P3", 1)], "paper_id string, active int")
    assert [r["paper_id"] for r in library.selected(p, ["P3", "P2"], 5).collect()] == ["P3"]
    assert library.gated(p, spark.createDataFrame([("P1", "pass")], "paper_id string, overall_status string"), []).count() == 3
    d = spark.createDataFrame([("P1", "accept", "a", None, 1), ("P1", "pending", "a", None, 2), ("P2", "reject", "b", None, 1)], "paper_id string, decision string, reviewer string, notes string, reviewed_at int")
    held = spark.createDataFrame([("P3", "accept", "c", None, 0)], d.schema)
    assert sorted((r["paper_id"], r["decision"]) for r in library.reviewed(held, d).collect()) == [("P2", "reject"), ("P3", "accept")]
    stages = spark.createDataFrame([("P1", "x"), ("P2", "x")], "paper_id string, stage string")
    a, b = library.reset(stages, held, p.where("paper_id in ('P1', 'P3')"))
    assert a.count() == 1 and b.count() == 0
    built = spark.createDataFrame([("s", 5, {"a": 1.0}, 1.0), ("t", 1, {"a": 1.0}, 1.0), ("u", 5, {"a": 2.0}, 1.0)], "project_slug string, built_at int, weights map<string,double>, resolution double")
    projects = spark.createDataFrame([(x, 3) for x in "stu"], "project_slug string, updated_at int")
    assert dict(library.stale(built, projects, {"a": 1.0}, 1.0).collect()) == {"s": False, "t": True, "u": True}
    m = spark.createDataFrame([("P1", "s"), ("P2", "t")], "paper_id string, project_slug string")
    ev = spark.createDataFrame([("P1",)], "paper_id string")
    assert [r[0] for r in library.affected_projects(m, ev, projects).collect()] == ["s"]
    assert library.affected_projects(m, spark.createDataFrame([(None,)], "paper_id string"), projects).count() == 3
    items = spark.createDataFrame([("P", 2, "b"), ("P", 1, "B"), ("P", 3, "c")], "paper_id string, pos int, t string")
    got = merging.merged(items, "paper_id", {"k": F.lower("t")}, ["pos"], "X", 3).orderBy("item_id").collect()
    assert [(r["item_id"], r["t"]) for r in got] == [("X001", "B"), ("X002", "c")]


def test_merge_into_keeps_the_latest_row_and_repeats_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, at int, v string"
    merge = programs.merge_into(path, ["k"], "at")
    merge(spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 1, "y")], schema), 0)
    merge(spark.createDataFrame([("a", 2, "late"), ("b", 2, "new")], schema), 1)
    merge(spark.createDataFrame([("b", 9, "again")], schema), 1)  # a batch that comes again changes nothing
    n, folder = programs.current(spark, path)
    assert n == 1 and {(r.k, r.v) for r in spark.read.parquet(folder).collect()} == {("a", "z"), ("b", "new")}


def test_tokens():
    now = [0.0]
    t = programs.Tokens(10, lambda: now[0])
    a, b = t.give("x"), t.give("y")
    assert t.take(a) == "x" and t.take(a) is None
    now[0] = 11.0
    assert t.take(b) is None and t.take("odd") is None


def test_clusters_are_named_or_keep_their_labels(spark):
    d = spark.createDataFrame([(0, 0, "about gels"), (0, 1, "about brushes"), (1, 0, "x")], "cluster int, pos int, text string")
    labels = spark.createDataFrame([(0, "L0"), (1, "L1"), (2, "L2")], "cluster int, label string")

    def service(texts):
        return [('{"name": "Soft matter"}' if "gels" in t else "no json") if t.startswith("NAME") else t for t in texts]

    got = {r["cluster"]: (r["name"], r["source"]) for r in s.named_clusters(d, labels, service, 4000).collect()}
    assert got == {0: ("Soft matter", "service"), 1: ("L1", "label"), 2: ("L2", "label")}


def test_sources_pages_and_relations(spark):
    p = spark.createDataFrame([("P1", "a.pdf", "h1"), ("P2", "b.pdf", "h2"), ("P3", "c.pdf", "h3")], "paper_id string, source_relpath string, source_sha256 string")
    st = spark.createDataFrame([("P1", "ocr", "success"), ("P2", "ocr", "success"), ("P3", "ocr", "error")], "paper_id string, stage string, status string")
    d = spark.createDataFrame([("P1", "ocr/1.pdf", "h1"), ("P2", "ocr/2.pdf", "old"), ("P3", "ocr/3.pdf", "h3")], "paper_id string, path string, source_sha256 string")
    assert {r["paper_id"]: (r["path"], r["derived"]) for r in library.preferred_source(p, st, d, "ocr/").collect()} == {"P1": ("ocr/1.pdf", True), "P2": ("b.pdf", False), "P3": ("c.pdf", False)}
    pages = spark.createDataFrame([("A", 1, 0, 1), ("A", 6, 9, 0), ("B", 1, 0, 0), ("C", 1, 5, 1)], "paper_id string, page int, n_chars int, n_images int")
    assert dict(library.image_only(pages).collect()) == {"A": True, "B": False, "C": False}
    rel = "source_uid string, target_uid string, relation string, confidence double, rationale string, project_slug string"
    held, new = spark.createDataFrame([("a", "b", "SUPPORTS", 0.9, "", "p"), ("c", "d", "SUPPORTS", 0.9, "", "p")], rel), spark.createDataFrame([("a", "b", "CONTRADICTS", 0.8, "", "p")], rel)
    assert library.replaced_relations(held, new, None).count() == 1 and library.replaced_relations(held, new, "p").count() == 2
    c = library.cluster_rows(spark.createDataFrame([(0, 5), (1, -1)], "cluster int, size int"), spark.createDataFrame([(0, "x" * 200)], "cluster int, label string"), spark.createDataFrame([(1, "N")], "cluster int, name string")).collect()
    assert [(r["cluster"], len(r["name"]), r["size"]) for r in c] == [(0, 160, 5), (1, 1, 0)]


def test_clusters_over_layers(spark):
    rows = [("g", layer, a, b, 1.0) for layer in ("property", "method") for a, b in (("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"))] + [("g", "claim", "c", "d", 0.1)]
    df = spark.createDataFrame(rows, "grp string, layer string, src string, dst string, weight double")
    got = {r["node"]: r["cluster"] for r in graph.cluster_multiplex(df, "grp").collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"] == got["e"] == got["f"]
    one = df.where("layer = 'property'")
    assert sorted(map(tuple, graph.cluster_multiplex(one, "grp", {"property": 1.0}).collect())) == sorted(map(tuple, graph.cluster_groups(one.drop("layer"), "grp").collect()))
    combined = graph.combine_layers({"property": one.select("src", "dst", "weight"), "claim": df.where("layer = 'claim'").select("src", "dst", "weight")})
    again = {r["node"]: r["cluster"] for r in graph.reclustered(combined, ["property"], resolution=99.0).collect()}
    assert set(again) == set("abcdef") and len(set(again.values())) == 6  # a resolution beyond the bound is clamped to 3


def test_cluster_archive(spark, tmp_path):
    papers = spark.createDataFrame([("P2", "b", "T", "B", None), ("P1", "a", "T", "A", 2001)], "paper_id string, path string, title string, authors string, year int")
    assert files.cluster_archive(papers, {"P1": "one", "P2": "two"}, str(tmp_path / "x.zip"), lambda path: path.encode()) == 2
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.namelist() == ["001_P1.pdf", "002_P2.pdf", "citations.txt", "citations.csv"] and z.read("citations.txt") == b"one\ntwo"
    with pytest.raises(ValueError):
        files.cluster_archive(papers, {}, str(tmp_path / "y.zip"), lambda path: b"", most=1)
