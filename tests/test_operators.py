import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from evigraph.functions import citations, text
from evigraph.functions.arrow import plain_text, sequence_ratio, slug, surface_key, token_set_ratio
from evigraph.operators import chunks, curation, estimate, graph, joins, linkage, ranking, records, registry, similarity, validation
from evigraph.operators.orphans import OrphanLedger, paper_number, parent_rows, reference_rows


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lookup_join_keeps_hot_and_null_keys(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).cast("long").alias("k"))
    right = spark.createDataFrame([(1, "a"), (3, "b")], "k long, v string")
    got = joins.lookup_join(left, right, "k")
    assert got.count() == 5000
    assert got.where("v = 'a'").count() == left.where("k = 1").count()
    assert rows(got.where("v = 'b'").select("id")) == [(3,)]


@pytest.mark.parametrize("measure", ["jaccard", "coupling"])
def test_set_pairs_match_brute_force_by_either_plan(spark, measure):
    rnd = random.Random(2)
    sets = {n: frozenset(rnd.choices(range(12), weights=[9, 7, 5, 4, 3, 3, 2, 2, 1, 1, 1, 1], k=rnd.randint(1, 6))) for n in range(40)}
    df = spark.createDataFrame([(n, i) for n, s in sets.items() for i in s] + [(None, 1), (99, None), (0, next(iter(sets[0])))], "node long, item long")
    least = {}
    for n, s in sets.items():
        least.setdefault(s, n)
    want = []
    for (a, x), (b, y) in itertools.combinations(sorted((n, s) for s, n in least.items()), 2):
        shared = len(x & y)
        w = shared / len(x | y) if measure == "jaccard" else shared / (len(x) * len(y)) ** 0.5
        if shared and w >= 0.4:
            want.append((a, b, shared, round(w, 9)))
    for plan in ("prefix", "count", None):
        got = [(a, b, s, round(w, 9)) for a, b, s, w in similarity.set_pairs(df, "node", "item", measure, 0.4, plan=plan).collect()]
        assert sorted(got) == sorted(want)
    assert {(n, r) for n, r in similarity.set_classes(df, "node", "item").collect()} == {(n, least[s]) for n, s in sets.items()}
    with pytest.raises(ValueError):
        similarity.set_pairs(df, "node", "item", measure, 0.0)


def test_sparse_cosine_matches_brute_force(spark):
    rnd = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta".split()
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 6)))) for i in range(25)] + [(90, None)]
    v = similarity.tfidf(similarity.terms_of(spark.createDataFrame(docs, "id long, t string"), "id", "t", n_max=2)).cache()
    by = {}
    for n, term, _, w in v.select("node", "term", "df", "w").collect():
        by.setdefault(n, {})[term] = w
    want = {(a, b): sum(w * by[b].get(t, 0) for t, w in by[a].items()) for a, b in itertools.combinations(sorted(by), 2)}
    got = {(a, b): w for a, b, w in similarity.sparse_cosine_pairs(v, 0.5).collect()}
    assert got.keys() == {k for k, w in want.items() if w >= 0.5}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_dense_topk_in_blocks(spark):
    rnd = random.Random(1)
    vs = []
    for i in range(30):
        v = [rnd.gauss(0, 1) for _ in range(8)]
        n = sum(x * x for x in v) ** 0.5
        vs.append((i, [x / n for x in v]))
    df = spark.createDataFrame(vs, "id long, v array<float>")
    one = rows(similarity.dense_topk(df, "id", "v", 3, 0.2).select("src", "dst", F.round("weight", 4)))
    assert one == rows(similarity.dense_topk(df, "id", "v", 3, 0.2, block_rows=7).select("src", "dst", F.round("weight", 4))) and one


def test_components_and_forest(spark):
    rnd = random.Random(3)
    e = {(a, b): rnd.randint(1, 5) for a in range(40) for b in range(a + 1, 40) if rnd.random() < 0.05}
    df = spark.createDataFrame([(a, b, float(w)) for (a, b), w in e.items()], "src long, dst long, weight double")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    want_weight = 0.0
    for (a, b), w in sorted(e.items(), key=lambda x: -x[1]):
        if find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
            want_weight += w
    got = dict(graph.components(df).collect())
    assert got == {n: find(n) for n in parent}
    forest = graph.spanning_forest(df).collect()
    assert len(forest) == len(parent) - len(set(got.values())) and sum(r["weight"] for r in forest) == want_weight
    kept = graph.sparsify(df, 1, 30)
    assert kept.count() <= max(30, len(forest) + len(parent))


def test_clusters_and_layout_are_partitions(spark):
    two = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    df = spark.createDataFrame([("p", a, b, 1.0) for a, b in two], "g string, src long, dst long, weight double")
    c = {r["node"]: r["cluster"] for r in graph.cluster_groups(df, "g").collect()}
    assert c[0] == c[1] == c[2] != c[3] == c[4] == c[5] and set(c.values()) == {0, 1}
    xy = graph.layout(df, "g").collect()
    assert len(xy) == 6 and max(abs(r["x"]) for r in xy) <= 850.001


def test_orphan_ledger_in_any_order(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    papers = spark.createDataFrame([("P0001", 1, t(1), t(2)), ("P0002", 0, t(1), t(3)), ("P0002", 1, t(1), t(2)), ("P0003", 1, t(9), t(9))], "paper_id string, active int, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")
    child = spark.createDataFrame([("p-1", "a", t(5)), ("#P0002", "b", t(5)), ("P03", "c", t(5)), ("X9", "d", t(5)), (None, "e", t(5)), ("P4", "f", None), ("P4", "f", None)], "pid string, r string, at timestamp_ntz")
    refs = reference_rows(child, "c", "pid", ["pid", "r"], [F.col("pid"), F.col("r")], "at")
    want = [("c", "pid", "#P0002|b", "inactive", "2024-01"), ("c", "pid", "P03|c", "late", "2024-01"), ("c", "pid", "P4|f", "missing", None), ("c", "pid", "X9|d", "missing", "2024-01")]
    parents = parent_rows(papers)
    one = OrphanLedger(spark)
    one.apply(parents, refs)
    assert rows(one.open()) == want
    two = OrphanLedger(spark)
    two.apply(parents.where("false"), refs.where("at is not null"))
    assert {r[3] for r in rows(two.open())} == {"missing"}
    two.apply(parents.where("last < timestamp_ntz'2024-01-03'"), refs.where("false"))
    two.apply(parents, refs.where("at is null"))
    assert rows(two.open()) == want
    assert two.snapshot().count() == 4
    empty = OrphanLedger(spark)
    empty.apply(parents.where("false"), refs.where("false"))
    assert empty.open().count() == 0


def test_orphan_ledger_with_deletions_restarts_and_repeated_batches(spark):
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    rng = random.Random(5)
    parents, refs = [], []
    for k in range(60):
        n = rng.randrange(12)
        seen, last = sorted((rng.randrange(40), rng.randrange(40)))
        parents.append((f"P{n:04}", rng.randrange(2), t(seen), t(last), rng.random() < 0.2))
        refs.append((rng.choice([f"P{rng.randrange(15)}", "X1", None]), f"r{rng.randrange(25)}", t(rng.randrange(40)), rng.random() < 0.15))
    held: dict = {}
    for pid, r, at, gone in refs:
        n = None if pid in (None, "X1") else pid[1:]
        held[r] = max(held.get(r, (t(-1), False, "", "")), (at, gone or pid is None, n or "", f"{pid or ''}|{r}"))
    index: dict = {}
    for pid, active, seen, last, gone in parents:
        top, first = index.get(pid.lstrip("P0") or "0", ((t(-1), False, 0), seen))
        index[pid.lstrip("P0") or "0"] = max(top, (last, gone, active)), min(first, seen)
    want = []
    for at, gone, n, key in held.values():
        (_, away, active), seen = index.get(n, ((None, True, 0), None))
        kind = "missing" if away else "inactive" if not active else "late" if seen > at else None
        if not gone and kind:
            want.append(("c", "pid", key, kind, "2024-01" if at < t(31) else "2024-02"))
    p = spark.createDataFrame(parents, "paper_id string, active int, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, gone boolean").withColumn("k", F.monotonically_increasing_id() % 7)
    c = spark.createDataFrame(refs, "pid string, r string, at timestamp_ntz, gone boolean").withColumn("k", F.monotonically_increasing_id() % 5)
    p_rows = lambda df: parent_rows(df.where("not gone")).unionByName(parent_rows(df.where("gone"), True))
    c_rows = lambda df: reference_rows(df.where("not gone"), "c", "pid", ["r"], [F.col("pid"), F.col("r")], "at").unionByName(reference_rows(df.where("gone"), "c", "pid", ["r"], [F.col("pid"), F.col("r")], "at", True))
    ledger = OrphanLedger(spark, buckets=4)
    for batch, (i, j) in enumerate([(3, 4), (0, 9), (9, 2), (6, 0), (1, 3), (5, 1), (2, 9), (4, 9)]):
        assert ledger.apply(p_rows(p.where(f"k = {i}")), c_rows(c.where(f"k = {j}")), "both", batch)
        ledger = OrphanLedger(spark, ledger.path)  # as after a restart
        assert not ledger.apply(p_rows(p), c_rows(c), "both", batch)
    assert rows(ledger.open()) == sorted(want, key=str)


def test_paper_numbers(spark):
    ids = ["P0042", " p-0042", "Ｐ0042", "#P0042\t", "P 42", "P00042", "TMP-42", "", None, "P", "42"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "s string").select(paper_number(F.col("s"))).collect()]
    assert got == ["42"] * 6 + [None] * 5


def test_pack_units_loses_nothing(spark):
    rnd = random.Random(4)
    u = [(d, i, rnd.randint(0, 60), rnd.choice("ab")) for d in range(5) for i in range(rnd.randint(0, 12))]
    got = {(r["d"], r["i"]): r["chunk_no"] for r in chunks.pack_units(spark.createDataFrame(u, "d long, i long, n long, role string"), ["d"], "i", F.col("n"), F.col("role"), 100).collect()}
    want, last = {}, {}
    for d, i, n, role in u:
        c, used, before = last.get(d, (0, 0, None))
        c, used = (c + 1, n) if c == 0 or before != role or used + n > 100 else (c, used + n)
        last[d], want[d, i] = (c, used, role), c
    assert got == want
    a, b = spark.sql("select 'one two\nthree four' t").select(chunks.split_near_half(F.col("t"))).first()[0]
    assert (a, b) == ("one two\nthree", "four") or a + " " + b == "one two three four"


def test_overlay_and_aliases(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    e = spark.createDataFrame([("1", t(1), "u", "edit", "x"), ("2", t(2), "u", "edit", None), ("3", t(1), "v", "delete", None), ("4", t(3), "v", "edit", "late")], "event_id string, created_at timestamp, uid string, event_type string, text string")
    p = curation.last_patch(e, ["uid"], ["created_at", "event_id"], {"text": F.col("text")}, F.col("event_type") == "delete")
    base = spark.createDataFrame([("u", "raw"), ("v", "raw"), ("w", "raw")], "uid string, text string")
    assert rows(curation.overlay(base, p, ["uid"], ["text"])) == [("u", "x", "raw"), ("w", "raw", "raw")]
    terms = spark.createDataFrame([("m", "Size Exclusion", ["SEC", "gel‐permeation"])], "term_type string, canonical string, aliases array<string>")
    r = curation.resolve(spark.createDataFrame([("Gel permeation",), ("other",), (None,)], "v string"), curation.alias_map(terms), "m", "v")
    assert {(x["canonical"], x["canonical_source"]) for x in r.collect()} == {("Size Exclusion", "alias"), ("other", "passthrough"), ("", "empty")}


def test_validation_rules(spark):
    m = spark.createDataFrame([("P", "M1", "explicitly_reported", "1,200 and 3.5", "about 1200", ["s1"]), ("P", "M2", "explicitly_reported", "5", "5", ["vis:fig1"])], "paper_id string, item_id string, status string, value_raw string, evidence_text string, evidence_sids array<string>")
    assert [r["detail"] for r in validation.numbers_not_found(m).collect()] == ["3.5"]
    assert [r["item_id"] for r in validation.visual_marked_explicit(m).collect()] == ["M2"]
    c = spark.createDataFrame([("P", "C1", "primary_research", "this_paper_result", ["background"]), ("P", "C2", "primary_research", "this_paper_result", ["background", "methods"]), ("P", "C3", "primary_research", "this_paper_result", [])], "paper_id string, item_id string, article_type string, claim_origin string, roles array<string>")
    assert [r["item_id"] for r in validation.background_only(c).collect()] == ["C1"]
    d = spark.createDataFrame([("P", "C1", 1, "Gels swell."), ("P", "C2", 2, "gels  SWELL"), ("P", "C3", 3, ""), ("Q", "C4", 1, "gels swell")], "paper_id string, item_id string, pos int, statement string")
    issues = validation.duplicate_statements(d)
    assert rows(issues.select("item_id", "detail")) == [("C2", "C1")]
    assert rows(validation.status(d, issues).select("paper_id", "overall_status")) == [("P", "review_required"), ("Q", "pass")]


def test_estimates(spark):
    log = ["=== run", "[Step 6] memory", "P0001 start", "done in 30.0 s", "done in 10.0 s", "P0002 start", "done in 9000.0 s", "[Step 7] inv", "P0001 start", "done in 80.0 s"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(log, 1)], "file string, line_no int, line string")
    got = dict(estimate.phase_seconds(lines, r"^\[Step (\d+)\]", r"^(P\d+) ", r"done in ([\d.]+) s").collect())
    assert got == {"memory": 40.0, "inventory": 80.0, "evidence": 105.0}
    calls = spark.createDataFrame([("inventory", "success", 10.0), ("inventory", "success", 20.0), ("inventory", "truncated", 30.0)], "phase string, status string, s double")
    m = estimate.call_models(calls, "phase", F.col("status") == "success", F.col("s")).first()
    assert (m["sample_count"], m["seconds_per_chunk"], m["retry_factor"]) == (2, 30.0, 1.5)
    done = spark.createDataFrame([("f", 1, "step 2 done 40"), ("f", 2, "step 2 done 60")], "file string, line_no int, line string")
    assert dict(estimate.step_seconds(done, r"step (\d+) done (\d+)").collect())[2] == 50.0
    assert estimate.latest_run(spark.createDataFrame([("f", 1, "run"), ("f", 2, "a"), ("f", 3, "run"), ("f", 4, "b")], "file string, line_no int, line string"), "^run").count() == 2


def test_citation_styles(spark):
    a = [("Ada M Lovelace", "Ada M", "Lovelace"), ("Grace B Hopper", None, None)]
    df = spark.createDataFrame([(a, "A title.", "Journal of Examples", "J. Ex.", 2026, "12", "3", "101-109", "10.1000/example")], "authors array<struct<full_name:string,given:string,family:string>>, title string, journal string, journal_abbreviation string, year int, volume string, issue string, pages string, doi string")
    r = {c: F.col(c) for c in df.columns}
    m = df.select(citations.citations(r)).first()[0]
    assert m["acs"] == "Lovelace, A. M.; Hopper, G. B. A title. J. Ex. 2026, 12(3), 101-109. DOI: 10.1000/example."
    assert m["rsc"].startswith("A. M. Lovelace, G. B. Hopper, J. Ex., 2026, 12(3), 101-109")
    assert "& Hopper, G. B." in m["nature"] and "(2026)" in m["science"]
    with pytest.raises(ValueError):
        citations.citation(r, "none")


def test_text_functions(spark):
    one = lambda e, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} {'int' if isinstance(x, int) else 'string'}" for k, x in v.items())).select(e).first()[0]
    c = F.col("x")
    assert one(text.collapse(c), x=" a\u00a0 b\n") == "a b"
    assert one(text.title_key(c), x="<i>Gels</i> &amp; Films!") == "gels and films"
    assert one(text.doi_key(c), x=" https://doi.org/10.1000/Example.1. ") == "10.1000/example.1"
    assert one(text.openalex_key(c), x="https://openalex.org/w12/") == "W12"
    assert one(text.surname(c), x="Ada O'Neil-Smith 3") == "o'neil-smith"
    assert one(text.section_role(c), x="2. Materials and Methods") == "methods"
    assert one(text.numeric_tokens(c), x="1,200 to 3.5e-2") == ["1200", "3.5e-2"]
    assert one(text.page_of(c), x="3,1,2,3,4;4,1,1,1,1") == 3 and len(one(text.boxes(c), x="3,1,2,3,4;bad;4,1,1,1,1")) == 2
    assert one(text.publication_year(c), x=" 1999 ") == 1999 and one(text.publication_year(c), x="99") is None
    assert one(text.script_json(c), x='{"a":"</script>&"}') == '{"a":"\\u003c/script\\u003e\\u0026"}'
    assert one(text.id_list(c), x="p1, ,p2") == ["P1", "P2"]
    assert one(text.middle_cut(c, 20), x="x" * 50).count("...") == 1
    assert one(surface_key(c), x="Gel‐Permeation / ΑΒ") == "gel permeation αβ"
    assert one(plain_text(c), x="a &lt;b&gt; <i>c</i>") == "a c" or one(plain_text(c), x="a <i>c</i>") == "a c"
    assert one(slug(c), x="Gélé & Co") == "gele-co" and one(slug(c), x=" ") == "default" and one(slug(c), x="All") is None and one(slug(c), x="漢").startswith("project-")
    assert one(sequence_ratio(c, F.lit("abc")), x="abc") == 1.0 and one(token_set_ratio(c, F.lit("b a")), x="a b") == 100.0
    assert one(text.year_score(F.lit(2000), F.lit(2001)), x="") == 0.72


def test_records_and_registry(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, pos int, v string")
    assert rows(records.latest(df, ["k"], "pos")) == [("a", 2, "y"), ("b", 1, "z")]
    assert rows(records.first_wins(df, ["k"], ["pos"])) == [("a", 1, "x"), ("b", 1, "z")]
    assert rows(records.upsert(df.where("pos = 1"), df.where("pos = 2"), ["k"])) == [("a", 2, "y"), ("b", 1, "z")]
    m = spark.createDataFrame([("p", 1, "u"), ("p", 2, "r"), ("p", 3, "r"), ("p", 4, "u"), ("q", 5, None)], "k string, pos int, v string")
    assert rows(records.mode_first_seen(m, ["k"], "v", "pos", (), "none")) == [("p", "u"), ("q", "none")]
    reg = spark.createDataFrame([("P1", "a", "s1", 1), ("P2", "b", "s2", 1), ("P3", "c", "s3", 1), ("P4", "d", "s4", 1)], "paper_id string, path string, sha string, active int")
    scan = spark.createDataFrame([("a", "s1"), ("b", "new"), ("moved", "s3"), ("copy", "s1"), ("e", "s9")], "path string, sha string")
    assert {(r["path"], r["change"], r["paper_id"]) for r in registry.reconcile(reg, scan).collect()} == {("a", "unchanged", "P1"), ("b", "changed", "P2"), ("moved", "renamed", "P3"), ("copy", "duplicate", "P1"), ("e", "added", None), ("d", "vanished", "P4")}
    refs = spark.createDataFrame([(1, "x"), (2, "y")], "r int, doi string")
    lib = spark.createDataFrame([("P1", "x"), ("P2", "y"), ("P3", "y")], "paper_id string, doi string")
    assert rows(linkage.unique_exact(refs, lib, "doi", "paper_id").select("r", "paper_id")) == [(1, "P1")]


def test_ranking_prefers_what_authors_stress(spark):
    s = "paper_id string, pos int, statement string, origin string, n_evidence int, section_evidence double, rejected boolean, abstract string, conclusion string, title string, summary string"
    texts = ("Swelling of gels grows with chain length", "Swelling grows", "Gels", None)
    df = spark.createDataFrame([("P", 1, "A balance was used", "cited_literature_summary", 1, 0.0, False, *texts), ("P", 2, "Swelling of gels grows with chain length", "this_paper_result", 2, 1.0, False, *texts), ("P", 3, "rejected", "x", 1, 0.0, True, *texts)], s)
    got = ranking.rank_statements(df).orderBy("rank").collect()
    assert [r["pos"] for r in got] == [2, 1] and got[0]["score"] > got[1]["score"]


def test_written_tables_survive_and_are_swept(spark):
    from evigraph import runtime

    df = runtime.written(spark.range(5), "five")
    assert df.count() == 5 and runtime.cut(df).count() == 5
    runtime.sweep(spark)
    assert runtime.written(spark.range(2), "two").count() == 2
