from evigraph.llm import canonical as c

TERMS = [("property", "loss factor", ["loss factor", "tan delta"]), ("property", "toughness", ["toughness", "work of fracture"]), ("property", "glass transition temperature", ["glass transition temperature", "glass transition", "Tg"]), ("property", "refractive index", ["refractive index", "nD"]), ("property", "refractive index increment", ["refractive index increment", "dn/dc"]), ("method", "size exclusion chromatography", ["size exclusion chromatography", "SEC"]), ("method", "elemental analysis", None)]


def _map(spark, values, lexicon=None):
    terms = spark.createDataFrame(TERMS, "term_type string, canonical string, aliases array<string>")
    df = spark.createDataFrame(values, "term_type string, raw string")
    return {(r["term_type"], r["raw"]): r["canonical"] for r in c.map_terms(df, terms, lexicon).collect()}


def test_mentions_typos_abbreviations_and_strangers(spark):
    want = {
        ("property", " Tg (25 °C)"): "glass transition temperature",
        ("property", "temp., glass transition"): "glass transition temperature",
        ("property", "glasstransitiontemperature"): "glass transition temperature",
        ("property", "tan δ"): "loss factor",
        ("property", "Verlustfaktor"): "",
        ("property", "T_g"): "glass transition temperature",
        ("method", "Elementaranalyse"): "elemental analysis",
        ("property", "lo5s factor"): "loss factor",
        ("property", "loss of colour"): "",
        ("property", "surface roughness"): "",
        ("property", "tougnhess"): "toughness",
        ("property", "refractive-index increments"): "refractive index increment",
        ("property", "refractive index, dry state"): "refractive index",
        ("property", ""): "",
        ("property", "-"): "",
        ("method", "SEC / size exclusion chrom."): "size exclusion chromatography",
        ("method", "elemental anal."): "elemental analysis",
        ("method", "Tg"): "",
        ("other", "Tg"): "",
    }
    assert _map(spark, list(want)) == want
    assert _map(spark, [("property", "Verlustfaktor")], lexicon={"loss factor": ("Verlustfaktor",)}) == {("property", "Verlustfaktor"): "loss factor"}
    assert _map(spark, [("property", "x " * 20000 + "toughness")])[("property", "x " * 20000 + "toughness")] == "toughness"


def test_items_keep_their_positions(spark):
    schema = "inventory_id long, methods array<struct<method_raw:string>>, studied_properties array<struct<property_raw:string>>, raw string"
    df = spark.createDataFrame([(1, [("SEC",), (None,), ("x",)], None, "q"), (1, [("SEC",), (None,), ("x",)], None, "q"), (2, [], [None, ("Tg",)], "q")], schema)
    assert sorted(map(tuple, c.entered_values(df).collect())) == [(1, "method", 1, "SEC"), (1, "method", 3, "x"), (2, "property", 2, "Tg")]
    assert c.entered_values(df.where("false")).count() == 0


def test_distance():
    assert c.distance("modulus", "modulsu", 2) == 1 and c.distance("abc", "abd", 2) == 1 and c.distance("abc", "xyz", 1) > 1
