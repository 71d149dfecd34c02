import random

from evigraph.llm import scans as s

PROSE = "The storage modulus of the gel reached a maximum after annealing and the cross-linked network was examined by static light scattering in dilute brine. " * 30 + "The zero-shear viscosity of brotadexene remained unchanged without stirring. " * 25
PAGE = "ACTA VISCOSA BOREALIS\nThe storage modu-\n- 290 -\nlus of the ge1 reached a maxi mum\nafter annealing, and the cross-\nlinked network was examincd by\n117.18\n\n   The zero-\r\nshear viscosity of brotad­\nexene rernained unchanged.\nScanned copy — reading room she1f 9\n291    Smith et al.\n2.3 Rheology\nIt was so."


def _run(spark, found=True, page=PAGE, prose=PROSE):
    blocks = spark.createDataFrame([(1, "page_text", page), (1, "page_text", page), (2, "page_text", None), (3, "page_text", ""), (4, "paragraph", prose)], "block_id long, kind string, text string")
    refs = spark.createDataFrame([(7, ["Ann Sc0tt"], "Ann Sc0tt. The stat ic light scat¬\nS. 416\ntering of ge1 networks. Acta 1, 2 (2000)."), (8, None, None)], "reference_no long, authors array<string>, raw_reference string")
    titles = spark.createDataFrame([("Acta Viscosa Borealis",), (None,)], "title string")
    return s.repair(s.scan_records(blocks, refs), blocks.where("kind = 'paragraph'"), titles, found)


def test_findings(spark):
    got = sorted(map(tuple, _run(spark).collect()))
    assert got == sorted(
        [
            ("paper_json", 1, 1, "furniture", ""), ("paper_json", 1, 2, "hyphen", "modulus"), ("paper_json", 1, 3, "furniture", ""), ("paper_json", 1, 4, "ocr", "gel"), ("paper_json", 1, 4, "ocr", "maximum"),
            ("paper_json", 1, 5, "hyphen", "cross-linked"), ("paper_json", 1, 6, "ocr", "examined"), ("paper_json", 1, 9, "hyphen", "zero-shear"), ("paper_json", 1, 10, "hyphen", "brotadexene"), ("paper_json", 1, 11, "ocr", "remained"),
            ("paper_json", 1, 12, "furniture", ""), ("paper_json", 1, 13, "furniture", ""), ("reference", 7, 1, "ocr", "static"), ("reference", 7, 1, "hyphen", "scattering"), ("reference", 7, 2, "furniture", ""), ("reference", 7, 3, "ocr", "gel"),
        ]
    )


def test_restored_text(spark):
    got = {(r["record_no"], r["paragraph_no"]): r["text"] for r in _run(spark, found=False).collect()}
    assert got[1, 1].startswith("The storage modulus of the gel reached a maximum after annealing, and the cross-linked network was examined by")
    assert "117.18" in got[1, 1] + got[1, 2]
    assert any("The zero-shear viscosity of brotadexene remained unchanged." in t for t in got.values())
    assert got[7, 1] == "Ann Sc0tt. The static light scattering of gel networks. Acta 1, 2 (2000)."


def test_empty_tables_and_a_long_text(spark):
    empty = spark.createDataFrame([], "block_id long, kind string, text string")
    refs = spark.createDataFrame([], "reference_no long, authors array<string>, raw_reference string")
    assert s.repair(s.scan_records(empty, refs), empty, spark.createDataFrame([], "title string")).count() == 0
    assert _run(spark, page="word " * 100000).where("origin = 'paper_json'").count() == 0


def test_confusions():
    assert s.misread("during", "durmg") == 1 and s.misread("without", "vvitbout") == 2 and s.misread("cooling", "coohng") == 1
    assert s.misread("abc", "abc") is None and s.misread("abc", "xyz") is None
    assert all(s.skeleton(a) == s.skeleton(b) for a, b in (("scaled", "scalecl"), ("modulus", "modiilus"), ("elemental", "elernental"), ("interface", "interfa(e")))
    assert [s.is_furniture(x, ()) for x in ("- 290 -", "[291]", "l59o", "Page 3 of 9", "p. 12", "117.18", "Experimental", "RESULTS", "It is 5")] == [True] * 5 + [False] * 4


def test_words_run_together_are_parted_in_the_text_only(spark):
    page = "It said that the modulusof the gel was high in brine.\nThe maximum of the modulus and another modulusofx stay so."
    got = [r["text"] for r in _run(spark, found=False, page=page).where("origin = 'paper_json'").collect()]
    assert "the modulus of the gel" in " ".join(got) and "modulusofx" in " ".join(got)
    assert _run(spark, page=page).where("origin = 'paper_json'").count() == 0


def test_words_torn_in_three_and_torn_and_misread(spark):
    page = "The gel reached a max imu m after annealing in brine.\nThe ne tw0rk remained un\nchanged without stirring."
    got = {(r["line_no"], r["kind"], r["word"]) for r in _run(spark, page=page).where("origin = 'paper_json'").collect()}
    assert got == {(1, "ocr", "maximum"), (2, "ocr", "network"), (2, "hyphen", "unchanged")}


def test_batches_do_not_matter(spark, monkeypatch):
    words = "storage modulus gel maximum annealing network static light scattering brine zero-shear viscosity brotadexene remained unchanged stirring examined".split()
    rng = random.Random(3)

    def page():
        out = []
        for _ in range(8):
            line = []
            for _ in range(9):
                w = rng.choice(words)
                if rng.random() < 0.15:
                    w = w.replace("m", "rn", 1)
                elif rng.random() < 0.15:
                    w = w[:3] + " " + w[3:]
                line.append(w)
            out.append(" ".join(line) + rng.choice(["", "", "-"]))
        return "\n".join(out)

    rows = [(i, "page_text", page()) for i in range(40)] + [(99, "paragraph", PROSE)]
    blocks = spark.createDataFrame(rows, "block_id long, kind string, text string")
    refs = spark.createDataFrame([], "reference_no long, authors array<string>, raw_reference string")
    titles = spark.createDataFrame([("Acta",)], "title string")
    found = []
    for points in (10_000_000, 500):
        monkeypatch.setattr(s, "BATCH_POINTS", points)
        found.append(sorted(map(tuple, s.repair(s.scan_records(blocks, refs), blocks.where("kind = 'paragraph'"), titles).collect())))
    assert found[0] == found[1] and len(found[0]) > 300
