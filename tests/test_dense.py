"""Dense pairs of strings."""

from evigraph.operators import similarity


def test_rows_without_a_near_one_give_no_pairs(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.0, 0.0, 1.0])], "term string, v array<double>")
    assert similarity.dense_pairs(v, "term", "v", 0.72).count() == 0
    more = v.unionByName(spark.createDataFrame([("d", [0.0, 0.6, 0.8])], v.schema))
    assert [(r.src, r.dst, round(r.weight, 6)) for r in similarity.dense_pairs(more, "term", "v", 0.72, block_rows=1).collect()] == [("c", "d", 0.8)]
