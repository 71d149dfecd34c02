import pytest

from evigraph.llm import authors as a


@pytest.mark.parametrize(
    ("name", "kind", "given", "middle", "family"),
    [
        ("Katherine D. van Pustakond", "p", "katherine", "d", ["pustakond"]),
        ("K.D. VAN PUSTAKOND", "p", "k", "d", ["pustakond"]),
        ("Badrosom CT", "p", "c", "t", ["badrosom"]),
        ("Mokro-Kuls, X. J.", "p", "x", "j", ["mokro", "kuls"]),
        ("Dr. Ada Stone", "p", "ada", "", ["stone"]),
        ("Gel Network Collaboration (Nitoviborg)", "g", "gel network collaboration", "", ["nitoviborg"]),
        ("TSL (Tupanofeld)", "g", "tsl", "#", ["tupanofeld"]),
    ],
)
def test_parse(name, kind, given, middle, family):
    got = a.parse(name)
    assert (got[0], got[1], got[2], got[4]) == (kind, given, middle, family)


GROUPS = [
    ["Katherine D. Pustakond", "K. D. Pustakond", "Pustakond, Katherine", "Kate Pustakond", "KATHERINE PUSTAKOND", "Pustakond KD", "Dr. Katherine Pustakond", "Katherine Pustakomd"],
    ["Margareta Pustakond", "Greta Pustakond", "Pustakond, Margareta"],
    ["Robert T. Trarutung-Krogadrels", "Trarutung, R T", "Robert Trarutung Krogadrels"],
    ["Tupanofeld Scattering Laboratory", "TSL (Tupanofeld)", "Scattering Laboratory of Tupanofeld", "Tupanofeld Scatt. Lab.", "The Tupanofeld Scattering Laboratory"],
    ["Somebody Else"],
]


def test_variants_are_linked_and_others_are_not(spark):
    rows = [(n,) for g in GROUPS for i, n in enumerate(g) for _ in range(9 if i == 0 else 2)]
    rows += [(f"{g} {s}",) for g in ("Katherine", "Margareta", "Robert") for s in ("Alder", "Birch", "Cedar", "Dogwood") for _ in range(3)]
    rows += [(None,), ("",), ("  ",)]
    got = {}
    for r in a.link_names(spark.createDataFrame(rows, "name string")).collect():
        got.setdefault(r["entity"], set()).add(r["name"])
    for g in GROUPS:
        assert got[g[0]] == set(g)
    assert sum(map(len, got.values())) == len({r[0] for r in rows if r[0] and r[0].strip()})
    pairs = {tuple(r) for r in a.variant_pairs(a.link_names(spark.createDataFrame(rows, "name string"))).collect()}
    assert ("Greta Pustakond", "Margareta Pustakond") in pairs and all(x < y for x, y in pairs)
    assert len(pairs) == sum(len(g) * (len(g) - 1) // 2 for g in GROUPS)


def test_empty_tables(spark):
    assert a.link_names(spark.createDataFrame([], "name string")).count() == 0
    refs = spark.createDataFrame([(1, None), (2, ["A B", None])], "reference_no long, authors array<string>")
    meta = spark.createDataFrame([("P", None), ("Q", "{bad"), ("R", '{"canonical": {"authors": null}, "original": {"authors": ["C D"]}}')], "paper_id string, metadata_json string")
    assert sorted(r[0] or "" for r in a.author_strings(refs, meta).collect()) == ["", "A B", "C D"]


def test_short_forms_are_found_in_the_corpus(spark):
    families = [f"fam{i:02}" for i in range(30)]
    rows = [("charlotte", f) for f in families[:10]] + [("lotte", f) for f in families[:6]] + [("johanna", families[20]), ("johanna", families[21])] + [("anna", f) for f in families[10:20]] + [("pavel", f"other{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "given string, key string")
    assert {r["given"]: r["found"] for r in a.short_forms(df).collect()} == {"lotte": ["charlotte"]}
    assert a.stems("benny") == ["benny", "benn", "ben"] and "kol" in a.stems("kolya")
    assert a.short_forms(df.where("false")).count() == 0


def test_doubts_do_not_depend_on_size(spark):
    for times in (1, 50):
        df = spark.createDataFrame([("brandorf", 24 * times), ("brandrf", 2 * times), ("bramdorf", 20 * times), ("other", 5)], "word string, types long")
        got = {(r["word"], r["to"]) for r in a._doubts(df).collect()}
        assert ("brandrf", "brandorf") in got and ("bramdorf", "brandorf") not in got and ("brandorf", "bramdorf") not in got


def test_classes_count_links(spark):
    e = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "c")], "name string, entity string")
    assert {r["name"]: r["n_links"] for r in a.classes(e).collect()} == {"a": 1, "b": 1, "c": 0}
