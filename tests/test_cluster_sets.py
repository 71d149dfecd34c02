"""Clusters of sets, whose edges are made in the task of their group."""

import itertools
import random

import numpy as np

from evigraph.operators import graph
from evigraph.plans import layers

LAYERS = {"property": (0.18, 0.45), "method": (0.18, 0.35)}


def _share(x, y):
    s = len(set(x) & set(y))
    v = s / (len(x) + len(y) - s) if s else 0.0
    return v if v >= 0.18 else 0.0


def test_clusters_of_sets_are_those_of_their_edges(spark):
    rnd, sets = random.Random(5), []
    for g, n in (("p", 60), ("q", 9), ("r", 1)):
        sets += [(g, f"{g}{i:02}", rnd.sample(range(8), rnd.randint(0, 3)), rnd.sample(range(6), rnd.randint(0, 2))) for i in range(n)]
    edges = [(g, a, b, 0.45 * _share(x, y) + 0.35 * _share(u, v)) for (g, a, x, u), (h, b, y, v) in itertools.combinations(sets, 2) if g == h]
    df = spark.createDataFrame([e for e in edges if e[3]], "g string, src string, dst string, weight double")
    got = graph.cluster_sets(spark.createDataFrame(sets, "g string, node string, property array<bigint>, method array<bigint>"), "g", LAYERS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.cluster_groups(df, "g").collect()))
    rows = list(graph.jaccard_rows([([x for g, _, x, _ in sets if g == "p"], 0.18, 0.45), ([u for g, _, _, u in sets if g == "p"], 0.18, 0.35)], 60, cells=180))
    found = {(i, int(j)): w for i, (r, k) in enumerate((r, k) for r in rows for k in range(len(r.ends) - 1)) for j, w in zip(r.col[r.ends[k] : r.ends[k + 1]], r.table[r.code[r.ends[k] : r.ends[k + 1]]], strict=True)}
    want = {(int(a[1:]), int(b[1:])): w for g, a, b, w in edges if g == "p" and w}
    assert found.keys() == want.keys() | {(b, a) for a, b in want} and all(np.isclose(found[k], w) for k, w in want.items())


def test_the_query_joins_no_pairs_of_papers(spark, sf):
    out = layers.q31_clusters(spark, sf)
    assert out._jdf.queryExecution().toString().count("Scan parquet") <= 8
    want = graph.cluster_groups(layers._projected(spark, sf), "project_slug")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_each_pair_pushes_once_and_all_do():
    pos = np.random.default_rng(1).standard_normal((70, 2))
    gap = pos[:, None, :] - pos[None, :, :]
    want = (gap / (np.square(gap).sum(2, keepdims=True) + 1e-3)).sum(1)
    assert np.allclose(graph._repulsion(pos, tile=16), want)


def test_layout_of_sets_is_that_of_their_edges(spark, sf):
    out = layers.q48_layout(spark, sf)
    edges = layers._projected(spark, sf)
    ends = {(r.project_slug, n) for r in edges.collect() for n in (r.src, r.dst)}
    got = out.collect()
    assert {(r.project_slug, r.node) for r in got} == ends and len(got) == len(ends)
    assert all(abs(r.x) <= 850.001 and abs(r.y) <= 850.001 for r in got)
