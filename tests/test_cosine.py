"""Cosines in blocks: every pair from the threshold on, ties as stated, and no candidates that leave their task."""

import math
import random

import pytest

from evigraph.operators import cosine, keywords, similarity

WORDS = "gel of melt chain flow rate glass transition heat water film loss".split()


def _texts(n=120):
    rng = random.Random(7)
    return [(f"n{i:03}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 7)))) for i in range(n)] + [("same1", "gel of melt"), ("same2", "gel of melt"), ("same3", "melt of gel")]


def _vectors(spark):
    return similarity.tfidf(similarity.terms_of(spark.createDataFrame(_texts(), "id string, text string"), "id", "text"), sublinear=False)


def _every(rows):
    v = {}
    for r in rows:
        v.setdefault(r.node, {})[r.term] = r.w
    return {(a, b): d for a in v for b in v if a < b and (d := math.fsum(w * v[b].get(t, 0.0) for t, w in v[a].items())) > 0}


@pytest.mark.parametrize("rows", [10, 1000])
@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.9])
def test_all_pairs_from_the_threshold_on(spark, rows, threshold):
    v = _vectors(spark)
    want = {p: round(w, 9) for p, w in _every(v.collect()).items() if w >= threshold}
    got = [(r.src, r.dst, round(r.weight, 9)) for r in cosine.pairs_above(v, threshold, rows).collect()]
    assert len(got) == len(want) and {(a, b): w for a, b, w in got} == want


@pytest.mark.parametrize("rows", [10, 1000])
def test_the_best_of_either_end_with_ties(spark, rows):
    v = _vectors(spark)
    near = {}
    for (a, b), w in _every(v.collect()).items():
        if w >= 0.12:
            near.setdefault(a, []).append((round(w, 9), b))
            near.setdefault(b, []).append((round(w, 9), a))
    want = {(min(a, b), max(a, b)) for a, some in near.items() for _, b in sorted(some, reverse=True)[:3]}
    got = cosine.best_pairs(v, 0.12, 3, rows).collect()
    assert len(got) == len(want) and {(r.src, r.dst) for r in got} == want


def test_letter_pairs_join_no_runs_of_letters(spark):
    """Terms share most runs of letters with some other: a join on them has as many rows as pairs of terms."""
    terms = spark.createDataFrame([("glass transition",), ("glass transitions",), ("melt flow",)], "t string")
    df = keywords.lexical_pairs(terms, "t", 0.12, 7)
    assert [(r.src, r.dst) for r in df.collect()] == [("glass transition", "glass transitions")]
    assert "MapInArrow" in df._jdf.queryExecution().toString()
    assert keywords.lexical_pairs(terms.limit(0), "t", 0.12, 7).count() == 0


def test_statement_pairs_write_no_candidates(spark):
    assert "MapInArrow" in similarity.sparse_cosine_pairs(_vectors(spark), 0.5)._jdf.queryExecution().toString()


def test_the_terms_to_judge_join_no_runs_of_letters(spark, sf):
    from evigraph.plans import registry

    assert "MapInArrow" in registry.QUERIES["q72_candidate_terms"](spark, sf)._jdf.queryExecution().toString()
