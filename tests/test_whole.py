"""Queries do the whole job on small tables, held against brute force."""

import datetime as dt
import difflib
import itertools

from evigraph.operators import linkage
from evigraph.plans import registry


def saved(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_components_take_all_citations(spark, tmp_path):
    links = [(2, 1), (3, 1), (1, 4), (5, 6), (7, 6), (8, 9), (9, 9), (11, 10), (4, 12)]
    at = dt.datetime(2026, 1, 1)
    rows = [(f"P{a:04}", str(i), at, f"P{b:04}") for i, (a, b) in enumerate(links)] + [("P0020", "x", at, None)]
    d = saved(spark, tmp_path, "reference_matches_v4", rows, "citing_paper_id string, ref_id string, updated_at timestamp, target_paper_id string")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(str(a)), find(str(b))))
            root[y] = x
    assert dict(registry.QUERIES["q29_components"](spark, d).collect()) == {n: find(n) for n in list(root)}


def inventory(spark, folder, papers):
    """The table of papers given as {paper: (properties, methods)}."""
    rows = [(i, p, [(None, x) for x in props], [(None, x) for x in meths]) for i, (p, (props, meths)) in enumerate(papers.items())]
    schema = "inventory_id long, paper_id string, studied_properties array<struct<property_raw: string, property_normalized: string>>, methods array<struct<method_raw: string, method_normalized: string>>"
    return saved(spark, folder, "inventory", rows, schema)


def jaccard(papers, part, least):
    out = {}
    for (a, x), (b, y) in itertools.combinations(sorted(papers.items()), 2):
        x, y = set(x[part]), set(y[part])
        if x & y and len(x & y) / len(x | y) >= least:
            out[a, b] = len(x & y) / len(x | y)
    return out


def test_combined_edges_of_papers_with_equal_sets(spark, tmp_path):
    papers = {
        "P1": (["gel", "flow"], ["nmr"]), "P2": (["gel", "flow"], ["saxs", "nmr"]), "P3": (["flow", "gel"], ["nmr"]), "P4": (["gel", "heat"], ["saxs", "nmr"]),
        "P5": (["heat", "gel"], ["dsc"]), "P6": (["heat"], []), "P7": ([], ["dsc"]), "P8": (["salt"], ["tem"]), "P9": (["salt"], ["afm"]),
    }
    d = inventory(spark, tmp_path, papers)
    props, meths = jaccard(papers, 0, 0.18), jaccard(papers, 1, 0.18)
    want = {e: (round(props.get(e, 0), 6), round(meths.get(e, 0), 6), round(0.45 * props.get(e, 0) + 0.35 * meths.get(e, 0), 6)) for e in props.keys() | meths.keys()}
    got = registry.QUERIES["q05_combined_edges"](spark, d).collect()
    assert len(got) == len(want) and {(r.src, r.dst): (r.property, r.method, r.weight) for r in got} == want
    degrees = {n: round(sum(w[2] for e, w in want.items() if n in e), 4) for n in papers if any(n in e for e in want)}
    assert {r.node: round(r.degree, 4) for r in registry.QUERIES["q06_weighted_degree"](spark, d).collect()} == degrees


def test_soft_keywords_of_keys_with_equal_words(spark, tmp_path):
    papers = {"P1": ["loss modulus"], "P2": ["modulus loss", "gel"], "P3": ["loss modulus peak"], "P4": ["osmotic pressures", "salt"], "P5": ["pressures osmotic"], "P6": ["gel"], "P7": ["pressures osmotic", "osmotic pressures"]}
    d = inventory(spark, tmp_path, {p: (keys, []) for p, keys in papers.items()})

    def related(x, y):
        a, b = set(x.split()), set(y.split())
        v = len(a & b) / len(a | b)
        return 0.0 if x == y or v < 0.45 else round(min(0.94, 0.72 + 0.25 * v), 4) if v >= 0.82 else 0.55 * round(min(0.88, 0.58 + 0.25 * v), 4)

    want = {}
    for a, b in itertools.combinations(sorted(papers), 2):
        x, y = papers[a], papers[b]
        w = (sum(max(related(i, j) for j in y) for i in x) / len(x) + sum(max(related(i, j) for i in x) for j in y) / len(y)) / 2
        if w >= 0.1:
            want[a, b] = round(w, 3)
    assert {(r.src, r.dst): round(r.weight, 3) for r in registry.QUERIES["q34_soft_keyword"](spark, d).collect()} == want


def test_near_keys_are_all_pairs_above_the_ratio(spark):
    base = ["the role of narfuthane in cross linked networks", "why hoduratol oligomers lose their angle", "a common scale for the swelling of gels", "gel"]
    xs = base + [b.replace("u", "uu", 1) for b in base] + [b.replace("the ", "", 1) for b in base] + [b[::-1] for b in base] + [""]
    ys = base + [b.replace("rf", "nf").replace("to", "ot") for b in base] + ["the role of zulotetol in cross linked networks", "\u00fc gel \u0451"]
    left, right = (spark.createDataFrame([(x,) for x in v], "k string") for v in (xs, ys))
    for least in (0.6, 0.91):
        want = {(x, y) for x in xs for y in ys if x and y and difflib.SequenceMatcher(None, x, y).ratio() >= least}
        got = [tuple(r) for r in linkage.near_keys(left, right, "k", least, block_rows=3).collect()]
        assert set(got) == want and len(got) == len(want)


def test_scored_match_takes_altered_titles_and_tests_score_and_margin(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    titles = {"P1": ("The role of narfuthane in cross linked networks", 2010), "P2": ("A common scale for the swelling of gels", 2011), "P3": ("Why hoduratol oligomers lose their angle", 2012), "P4": ("Why hoduratol oligomers lose their angle", 2012)}
    saved(spark, tmp_path, "papers", [(p, t, 1, at, y, "J") for p, (t, y) in titles.items()], "paper_id string, title string, active int, last_seen_at timestamp, year int, journal string")
    refs = [
        (1, "The role of narfuthane in cross linked networks", 2010), (2, "The role of narufuthane in cross linked networks", 2010), (3, "Role of narfuthane in cross linked networks", 2010),
        (4, "A common scale for the swelling of gels", 1990), (5, "Why hoduratol oligomers lose their angle", 2012), (6, "Another title of no paper at all", 2010),
    ]
    d = saved(spark, tmp_path, "reference", [(n, t, ["X"], "J", y, None) for n, t, y in refs], "reference_no long, title string, authors array<string>, journal string, year int, doi string")
    got = {r.reference_no: (r.paper_id, r.title_score < 1) for r in registry.QUERIES["q23_scored_match"](spark, d).collect()}
    assert got == {1: ("P1", False), 2: ("P1", True), 3: ("P1", True)}
