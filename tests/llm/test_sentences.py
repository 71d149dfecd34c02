import time

import pytest

from evigraph.llm.sentences import split_sentences

CASES = [
    ["Dr. K. L. Smith et al. found 4.5 in Fig. 3. ", "It was .47 vs. 2.1.3 before."],
    ["He asked, “Why this?” and left it out. ", "“Do not dry it.” ", "‘It gels.’ ", "Next one."],
    ["The note says, “Stir well. Then wait 5 min,” and it did. ", "Done?! ", "It rose by 1.5... ", "The gel held … but leaked."],
    ["It melted at 5 °C.[51] ", "It was clear.³³ ", "(See Table 2.) ", "pH was set. ", "α-Form grew. ", "n-Hexane left."],
    ["We met at 5 p.m. on day 3. ", "It came from the U.S. and Acme Corp. as salts, dyes, etc. ", "Then rest."],
    ["No spaces here.", "The next follows."],
    ["Am 3. Mai 2009 lag der Wert, d. h. im Sinn, bei ca. 4. ", "„Bitte nicht trocknen.“ ", "Einige, z. B. jene usw. ", "Warum?"],
    ["« Ne séchez pas. » ", "Le gel s’effondre après 2 h ! ", "M. Dupont a fourni env. 4 lots, p. ex. ceux-ci."],
    ["«No seque.» ", "La Dra. Gil midió, p. ej. la fig. 2. ", "¿Por qué? ", "¡El gel colapsó!"],
    ["样品静置了9小时。", "作者说：“不要干燥。要先冷却。”", "（不包括这个。）", "为什么？"],
    ["著者は「乾燥させない。必ず冷やす。」と述べた。", "（除外した。）", "図9に示す。"],
    ["Некоторые, т. е. соли, мешают. ", "Работа Ивана и др. описывает это в 1984 г. весьма кратко. ", "На рис. 3 видно."],
    ["چرا؟ ", "قال د. علي إن هذا لا يذوب. ", "نعم!"],
    ["डॉ. राम ने मापा। ", "क्यों?"],
    ["Γιατί τόσο αργά; ", "Η κ. Άννα, π.χ. στο σχ. 4, μέτρησε."],
    ["เราวัดซ้ำ 78 ครั้งในวันเดียวกัน ", "ตัวอย่างถูกเก็บไว้"],
    ["See https://a.example/x.y?z.html for more. ", "doi:10.1000/a.b.c is it."],
    ["The last one lacks its stop"],
]


@pytest.mark.parametrize("parts", CASES)
def test_known_boundaries(spark, parts):
    text = "　" + "".join(parts) + " "
    got = [r["sentence"] for r in split_sentences(spark.createDataFrame([(text,)], "text string")).orderBy("sentence_no").collect()]
    assert got == [p.strip() for p in parts]


def test_positions_are_code_points_and_edge_rows_are_defined(spark):
    rows = [(1, "😀 One. Two."), (2, None), (3, ""), (4, " \n　"), (5, "One. Two."), (5, "One. Two.")]
    got = sorted((r["block_id"], r["end_char"]) for r in split_sentences(spark.createDataFrame(rows, "block_id long, text string")).collect())
    assert got == [(1, 6), (1, 11), (5, 4), (5, 4), (5, 9), (5, 9)]
    extra = spark.createDataFrame([(1, "A b.", "x")], "block_id long, text string, other string")
    assert split_sentences(extra).columns == ["block_id", "text", "other", "sentence_no", "end_char", "sentence"]
    assert split_sentences(extra.where("false")).count() == 0


def test_a_very_long_text_is_split_whole(spark):
    began = time.time()
    df = spark.createDataFrame([("It is so. " * 20000 + "“Open. quote " * 50,)], "text string")
    assert split_sentences(df).count() >= 20000
    assert time.time() - began < 60


def test_quotations_of_any_length(spark):
    inner = "It holds. " * 400
    text = f"They wrote, “{inner}so far,” and left. Then more."
    df = spark.createDataFrame([(1, text)], "block_id long, text string")
    assert [r["end_char"] for r in split_sentences(df).orderBy("end_char").collect()] == [text.index(" Then"), len(text)]
    url = "See https://example.org/" + "a.b" * 300 + " now. Next."
    df = spark.createDataFrame([(1, url)], "block_id long, text string")
    assert [r["end_char"] for r in split_sentences(df).orderBy("end_char").collect()] == [url.index(" Next"), len(url)]
