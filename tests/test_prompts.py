import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evigraph.functions import prompts as p
from evigraph.functions import text
from evigraph.operators import chunks, documents, keywords, resolution, similarity

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=900), lambda x: st.lists(x, max_size=6) | st.dictionaries(st.text(max_size=8), x, max_size=5), max_leaves=14)


@settings(deadline=None, max_examples=60)
@given(VALUES, st.integers(256, 2000))
def test_bounded_values_fit(value, most):
    assert p._size(p.bounded(value, most)) <= most + most // 8 + 64 or p._size(value) <= most  # escapes of an excerpt may add to it
    assert p.bounded(value, 10**6) == value


def test_texts_for_models(spark):
    memory = {"central_question": "Why?", "major_findings": [{"statement": "It gels", "evidence_sids": ["s1", "s2"]}, "flat"], "definitions": [{"term": "gel"}]}
    assert p.memory_text(memory, 9000) == "CENTRAL QUESTION: Why?\nDEFINITIONS:\n- gel\nMAJOR FINDINGS:\n- It gels [MEMORY_EVIDENCE:s1,s2]\n- flat"
    assert p.memory_text({"major_findings": ["x" * 500] * 9}, 1200).endswith("x") and len(p.memory_text({"major_findings": ["x" * 500] * 9}, 1200)) == 1200
    assert p.without_runtime({"a": [{"model": 1, "b": 2}], "source": 3}) == {"a": [{"b": 2}]}
    assert p.flat_texts({"x": " a ", "summary": ["b"]}) == ["b"] and p.flat_texts([{"x": "a"}, "b", 1]) == ["a", "b"]
    assert len(json.dumps(p.for_merge({"a": ["y" * 4000] * 20}, 3000))) <= 3000
    df = spark.createDataFrame([(json.dumps(memory), "no json")], "m string, bad string")
    r = df.select(p.priority_text("m").alias("t"), p.memory_lines("bad").alias("none"), p.scientific_json(F.lit('{"model":1,"b":[2]}')).alias("s")).first()
    assert (r.t, r.none, r.s) == ("Why? It gels flat", None, '{"b":[2]}')
    q = df.select(
        p.visual_context(F.array(F.lit("a" * 6), F.lit("b" * 6), F.lit("c")), 12).alias("v"), p.visual_line(F.lit("vis:1"), F.lit(2), F.lit(None).cast("string"), F.lit(" Cap "), F.lit("")).alias("l"),
        p.inventory_text(F.lit(None).cast("string"), F.array(F.struct(F.lit("SYS001").alias("system_id"), F.lit("PEG").alias("name"), F.lit("peg").alias("normalized"), F.create_map(F.lit("dp"), F.lit("9"), F.lit("mn"), F.lit("")).alias("attributes")))).alias("i"),
        p.route(F.lit(10), 9).alias("r"), p.system_prompt(F.lit("Do. "), '{"b": 1, "a": 2}').alias("s"),
    ).first()
    assert q.v == "aaaaaa\nbbbbb" and q.l == "[vis:1 page=2 kind=] Cap" and q.i == "ARTICLE_TYPE: unclear\nKNOWN SYSTEMS:\n- SYS001: PEG | normalized=peg | dp=9"
    assert q.r == "hierarchical" and q.s.endswith('{"a":2,"b":1}')


def test_pictures_are_packed_like_text(spark):
    rows = [("P", i, n) for i, n in enumerate([100, 100, 400, 50, 50])]
    df = spark.createDataFrame(rows, "paper_id string, pos int, n int")
    got = {r["pos"]: r["chunk_no"] for r in chunks.pack_units(df, ["paper_id"], "pos", F.col("n") + 128, F.lit("figure_table"), 500).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3, 4: 3}


def test_small_functions(spark):
    one = spark.range(1)
    r = one.select(
        text.year_error(F.lit("19x")).alias("a"), text.year_error(F.lit("3000")).alias("b"), text.year_error(F.lit("")).alias("c"), text.seconds_between(F.lit("2024-01-01 00:00:05"), F.lit("2024-01-01 00:00:01")).alias("d"), text.palette(F.lit(5), ("x", "y", "z")).alias("e"),
        text.claim_text({k: F.lit(v) for k, v in (("statement", "S "), ("subject", ""), ("relation", "r"), ("object", None), ("conditions_text", "c"))}, F.array(F.lit("t"), F.lit(""))).alias("f"), text.resolution_band(F.lit(2.0)).alias("g"), text.now_text().alias("h"),
        text.union_box(text.boxes(F.lit("1,1,2,3,4;1,0,5,1,1")), 1.0).alias("i"), documents.text_or_memory(F.lit(" "), [F.lit("m"), F.lit("")]).alias("j"), documents.search_text([F.lit("A"), F.lit(None), F.lit(3)]).alias("k"), text.distinct_in_order(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("l"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("not a number", "out of range", None, 0.0, "z", "S r c t", "fine")
    assert r.h.endswith("+00:00") and (r.i.x0, r.i.y0, r.i.x1, r.i.y1) == (-1.0, 1.0, 5.0, 7.0) and (r.j, r.k, r.l) == ("m", "a 3", ["b", "a"])


def test_runs_of_words_and_letters(spark):
    df = spark.createDataFrame([("a", "aa bb cc")], "id string, t string")
    assert {r["term"] for r in similarity.terms_of(df, "id", "t", 3).collect()} == {"aa", "bb", "cc", "aa bb", "bb cc", "aa bb cc"}
    got = {r["term"]: r["tf"] for r in keywords.letter_grams(spark.createDataFrame([("ab x",)], "t string"), "t").collect()}
    assert got == {" ab": 1, "ab ": 1, " ab ": 1, " x ": 1}


def test_near_titles_are_all_pairs_above_the_ratio(spark):
    import random

    rng = random.Random(2)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(3, 40))).strip() or "a" for _ in range(40)]
    other = ["".join(c if rng.random() > 0.06 else rng.choice("abcdx") for c in b) for b in base] + ["zz", "a"]
    left, right = (spark.createDataFrame([(x,) for x in v], "k string") for v in (base, other))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for least in (0.9, 0.75):
        want = {(a, b) for a in base for b in other if a and b and 1 - edits(a, b) / max(len(a), len(b)) >= least - 1e-12}
        got = {(r["k"], r["c_k"]) for r in resolution.near_titles(left, right, "k", least).collect()}
        assert got == want
