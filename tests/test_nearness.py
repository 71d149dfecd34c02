"""Pairs of strings within some edits: all of them, and few others, however many strings share their phrases."""

import random

import pytest
from pyspark.sql import functions as F

from evigraph.operators import nearness, resolution

WORDS = ("molecular ", "weight ", "control of ", "gel ", "a", "bc", "üß ", " x", "polymer ")


def _edits(a, b, swaps=False):
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        before, last = last, row
    return last[-1]


def _strings():
    rng = random.Random(4)
    ys = sorted({"".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9)))[:50] for _ in range(80)})
    xs = set()
    for _ in range(90):
        x = list(rng.choice(ys))
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(x))
            if (what := rng.random()) < 0.4:
                x.insert(i, "z")
            elif what < 0.7 and i:
                x[i - 1], x[i] = x[i], x[i - 1]
            else:
                x[i] = "q"
        xs.add("".join(x))
    return sorted(xs), ys


def _found(xs, ys, **how):
    return {(i, j) for a, b in nearness.close(xs, ys, **how) for i, j in zip(a.tolist(), b.tolist(), strict=True)}


@pytest.mark.parametrize("share", [0.08, 0.1, 0.4, 0.6])
def test_none_within_the_share_is_left_out(share):
    xs, ys = _strings()
    assert {(i, j) for i, x in enumerate(xs) for j, y in enumerate(ys) if _edits(x, y) <= share * max(len(x), len(y)) + 1e-9} <= _found(xs, ys, share=share)


def test_none_within_the_edits_is_left_out_with_swaps_and_beginnings():
    xs, ys = _strings()
    assert {(i, j) for i, x in enumerate(xs) for j, y in enumerate(ys) if _edits(x, y, True) <= 3} <= _found(xs, ys, most=3, swaps=True)
    assert {(i, j) for i, x in enumerate(xs) for j, y in enumerate(ys) if _edits(x, y[: len(x)], True) <= 2} <= _found(xs, ys, most=2, swaps=True, begun=True)


def test_phrases_that_all_share_make_no_pairs():
    """Titles of one pattern about different things: all letter runs but those of their names are in all of them."""
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(8))
    titles = [f"molecular weight control of {name()} and {name()} networks" for _ in range(1500)]
    assert len(_found(titles, titles, share=0.08)) < 2 * len(titles)


def test_the_cascade_and_the_local_match_do_not_join_runs_of_letters(spark, sf):
    """Their plans on titles have no join on single runs, whose rows grow with the titles that share a phrase."""
    titles = spark.createDataFrame([("molecular weight control of gels",)], "k string")
    plan = resolution.near_titles(titles, titles, "k", 0.92)._jdf.queryExecution().toString()
    assert "Generate explode(runs" not in plan and "MapInPandas" in plan


def test_titles_too_short_for_runs_meet_by_their_letters():
    assert (0, 0) in _found(["ab", "abcdefghi"], ["ab", "abcdefghx", "zz"], share=0.1)
    assert (0, 0) in _found(["abcdefghij"], ["abcdefghix"], share=0.1)


def test_edits_are_counted_up_to_the_bound_only(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abcdefghix",), ("abcdefgxyz",)], "k string")
    near = resolution.near_titles(df, df, "k", 0.90)
    assert sorted((r.k, r.c_k, round(r.ratio, 9)) for r in near.where("k < c_k").collect()) == [("abcdefghij", "abcdefghix", 0.9)]
    assert "ceil" in near._jdf.queryExecution().toString().lower()


def test_letters_beyond_a_byte_are_counted_up_to_the_same_bound():
    assert nearness._letters(*nearness._flat(["a" * 300])[::2]).max() == 127
    assert (0, 0) in _found(["a" * 300 + "b"], ["a" * 299 + "b"], share=0.08)


@pytest.mark.parametrize("share", [0.02, 0.08, 0.1, 0.4, 0.6])
def test_only_titles_of_lengths_that_may_be_near_meet(spark, share):
    of = {r.n: r.b for r in spark.range(1, 400).select(F.col("id").alias("n"), nearness.band(F.col("id"), share).alias("b")).collect()}
    assert all(abs(of[n] - of[m]) <= 1 for n in of for m in of if abs(n - m) <= int(max(n, m) * share + 1e-9))
    assert of[399] - of[1] > 3


def test_lists_of_far_lengths_do_not_meet(spark, monkeypatch):
    """Twelve lengths, each half as long again as the last: a list meets that of its own length only."""
    monkeypatch.setattr(nearness, "close", lambda xs, ys, *_: iter([([0], [0])]))
    df = spark.createDataFrame([("a" * int(3 * 1.5**n),) for n in range(12)], "k string")
    assert len(nearness.close_pairs(df, df, share=0.08).collect()) == 12
    assert len(nearness.close_pairs(df, df, most=2).collect()) == 1


def test_lists_of_many_titles_are_divided_and_all_meet(spark):
    xs, ys = _strings()
    left, right = (spark.createDataFrame([(v,) for v in vs], "k string") for vs in (xs, ys))
    got = {(r.k, r.c) for r in nearness.close_pairs(left, right, share=0.4, left_rows=4, right_rows=5).collect()}
    assert {(x, y) for x in xs for y in ys if x and y and _edits(x, y) <= 0.4 * max(len(x), len(y)) + 1e-9} <= got
    assert not nearness.close_pairs(left.where("false"), right, share=0.4).collect() + nearness.close_pairs(left, right.where("false"), share=0.4).collect()


@pytest.mark.parametrize("how", [{"share": 0.4}, {"most": 2}])
def test_lists_are_sent_once_in_as_many_parts_as_asked_for(spark, how):
    """Another exchange by the key of the join alone would be made less for its few bytes, and tasks with it."""
    df = spark.createDataFrame([(v,) for v in _strings()[1]], "k string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = nearness.close_pairs(df, df, left_rows=8, right_rows=8, **how)
        pairs.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_NUM") == 2 and "AQEShuffleRead" not in plan.split("REPARTITION_BY_NUM")[0]


def test_places_beyond_the_index_are_found():
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(70_000))
    assert (0, 0) in _found([long], ["x" + long[:-1]], share=0.0001)


def test_the_nearest_title_is_sought_for_titles_that_the_library_lacks_only(spark, monkeypatch):
    sought, near = [], resolution.near_titles
    monkeypatch.setattr(resolution, "near_titles", lambda left, right, key, least: (sought.append(left.select(key)), near(left, right, key, least))[1])
    held = [("abcdefghij", "P1"), ("abcdefghij", "P2"), ("abcdefghix", "P9"), ("klmnopqrst", "P3"), ("klmnopqrsu", "P4")]
    right = spark.createDataFrame(held, "k string, paper_id string")
    left = spark.createDataFrame([("abcdefghij",), ("abcdefghij",), ("klmnopqrsv",), ("abcdefghiy",), ("zzzzzzzzzz",)], "k string")
    got = sorted(map(tuple, resolution.best_titles(left, right, "k", 0.9, "paper_id").collect()))
    assert got == [("abcdefghij", 1.0, "P2"), ("abcdefghiy", 0.9, "P9"), ("klmnopqrsv", 0.9, "P4")]
    assert sorted(r.k for r in sought[0].collect()) == ["abcdefghiy", "klmnopqrsv", "zzzzzzzzzz"]


def test_many_references_and_papers_of_one_title(spark, tmp_path):
    """The last paper is taken, whatever number of them and of references share the title."""
    from evigraph.plans import state

    title = "a common scale for the swelling of networks"
    spark.range(300).selectExpr("id as reference_no", f"'{title}' as title", "cast(null as string) as doi").write.parquet(f"{tmp_path}/reference.parquet")
    spark.range(200).selectExpr("printf('P%04d', id) as paper_id", "current_timestamp() as last_seen_at", "1 as active", f"'{title}' as title", "cast(null as string) as doi").write.parquet(f"{tmp_path}/papers.parquet")
    out = state.q105_cascade(spark, str(tmp_path))
    assert {(r.paper_id, r.method) for r in out.collect()} == {("P0199", "title")} and out.count() == 300
