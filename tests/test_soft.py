"""Soft set pairs worked in blocks."""

import itertools
import random

from evigraph.operators import similarity


def test_soft_pairs_of_blocks_are_those_of_all(spark):
    """Sets in many blocks; no pairs of papers are joined, so none are written."""
    rnd = random.Random(12)
    sets = {f"P{i:02}": rnd.sample("abcdefgh", rnd.randint(1, 4)) for i in range(40)}
    score = {(x, y): round(rnd.uniform(0.2, 0.9), 2) for x, y in itertools.combinations("abcdefgh", 2) if rnd.random() < 0.4}
    rel = lambda x, y: score.get((min(x, y), max(x, y)), 0.0) if x != y else 0.0
    mean = lambda x, y: sum(max(rel(i, j) for j in y) for i in x) / len(x)
    want = {(p, q): round(w, 6) for p, q in itertools.combinations(sets, 2) if (w := (mean(sets[p], sets[q]) + mean(sets[q], sets[p])) / 2) >= 0.1}
    members = spark.createDataFrame([(p, i) for p, x in sets.items() for i in x], "node string, item string")
    relations = spark.createDataFrame([(*k, v) for k, v in score.items()], "left string, right string, score double")
    out = similarity.soft_set_pairs(members, "node", "item", relations, 0.1, rows=7)
    assert {(r.src, r.dst): round(r.weight, 6) for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().toString()
