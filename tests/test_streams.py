import datetime as dt
import json
import xml.etree.ElementTree as ET

from evigraph.sources import files
from evigraph.streaming import programs


def _event(i, paper, t):
    return json.dumps({"event_id": f"e{i}", "created_at": f"2024-01-01T00:00:{t:02d}", "paper_id": paper, "event_type": "term_alias", "entity_type": "m", "entity_uid": "u", "new": {"alias": f"a{i}", "canonical": "c"}})


def test_event_log_skips_bad_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join([_event(1, "P", 1), "", "{bad", _event(2, "Q", 2)]))
    assert {r["event_id"] for r in files.event_log(spark, str(tmp_path / "log.jsonl")).collect()} == {"e1", "e2"}


def test_replay_equals_batch(spark, tmp_path):
    src, log, seen = tmp_path / "in", str(tmp_path / "log"), []
    src.mkdir()
    for k in range(2):
        (src / f"{k}.jsonl").write_text("\n".join(_event(10 * k + i, "P", 10 * k + i) for i in range(3)))
        q = programs.replay(programs.event_stream(spark, str(src)), log, lambda whole, touched: seen.append(whole.count()), str(tmp_path / "ck"))
        q.awaitTermination()
    assert seen == [3, 6]


def test_debounce_and_windows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("p", t0 + dt.timedelta(seconds=s)) for s in (0, 1, 2, 30, 31)] + [("z", t0 + dt.timedelta(days=1))]
    spark.createDataFrame(rows, "k string, ts timestamp").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "e"))
    for name, df in (("bursts", programs.debounced(stream, "k", "ts", "5 seconds", "1 second")), ("counts", programs.windowed_counts(stream, "k", "ts", "10 seconds", "1 second"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("bursts").where("k = 'p'").collect()) == [2, 3]
    assert sorted(r["n"] for r in spark.table("counts").where("k = 'p'").collect()) == [2, 3]


def test_files_and_exports(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    m = files.file_manifest(spark, str(tmp_path)).first()
    assert m["file_name"] == "a.pdf" and m["size"] == 1
    (tmp_path / "x.log").write_text("one\r\ntwo")
    assert [(r["line_no"], r["line"]) for r in files.log_lines(spark, str(tmp_path / "x.log")).orderBy("line_no").collect()] == [(1, "one"), (2, "two")]
    tei = """<TEI xmlns="http://x"><teiHeader><fileDesc><titleStmt><title>T0</title></titleStmt><sourceDesc><biblStruct><analytic><title level="a">On <hi>gels</hi></title>
    <author><persName><forename>Ann</forename><forename>B.</forename><surname>Lee</surname></persName></author></analytic><monogr><title level="j">J</title><imprint><date when="2011-02"/></imprint></monogr><idno type="DOI">https://doi.org/10.1/x</idno></biblStruct></sourceDesc></fileDesc></teiHeader>
    <text><body><p>Loose &amp; free.</p><div><head>First</head><p>One <ref target="#b1">[1]</ref> and <hi>two</hi>.</p><p/><p>Three.</p></div><div><head n="2">Second</head><p>Four.</p></div></body>
    <figure type="table"><table><row><cell>a</cell><cell>b</cell></row><row><cell/><cell> </cell></row></table></figure></text></TEI>"""
    (tmp_path / "t.xml").write_text(tei)
    got = [(r["section_no"], r["heading"], r["text"], r["refs"]) for r in files.tei_paragraphs(spark, str(tmp_path / "t.xml")).orderBy("section_no", "paragraph_no").collect()]
    assert got == [(0, "", "Loose & free.", []), (1, "First", "One [1] and two .", ["b1"]), (1, "First", "Three.", []), (2, "Second", "Four.", [])]
    m = files.tei_metadata(spark, str(tmp_path / "t.xml")).first()
    assert (m["title"], m["doi"], m["journal"], m["year"], m["authors"][0]["full_name"], m["authors"][0]["surname"]) == ("On gels", "10.1/x", "J", 2011, "Ann B. Lee", "Lee")
    assert [r["cells"] for r in files.tei_tables(spark, str(tmp_path / "t.xml")).collect()] == [["a", "b"]]
    nodes = spark.createDataFrame([("a<", "t", None), ("b", "t", 'x"y')], "node_id string, node_type string, label string")
    edges = spark.createDataFrame([("a<", "b", "R", 1.0)], "source string, target string, relation string, weight double")
    files.write_text(files.graphml(nodes, edges), str(tmp_path / "g"))
    document = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    root = ET.fromstring(document)
    space = "{http://graphml.graphdrawing.org/xmlns}"
    assert {n.get("id") for n in root.iter(f"{space}node")} == {"a<", "b"} and next(root.iter(f"{space}edge")).get("source") == "a<"
    assert "</script>" not in files.page("x", '{"a": "</script>"}').split('json">')[1].split("</script></body>")[0]
    papers = spark.createDataFrame([("P2", "T|2", "B", None, "J", ""), ("P1", "T1", "A", 2001, "J", "10.1/x")], "paper_id string, title string, authors string, year int, journal string, doi string")
    lines = [r["line"] for r in files.bibliography(papers).orderBy("ord").collect()]
    assert lines[0].startswith("- A (2001). T1. J https://doi.org/10.1/x") and "T\\|2" in lines[1]
    parts = files.embedding_parts(spark.createDataFrame([(i, [float(i)]) for i in (5, 3, 9, 1)], "node int, v array<double>"))
    assert [(r["row_no"], r["node"]) for r in parts.orderBy("row_no").collect()] == [(0, 1), (1, 3), (2, 5), (3, 9)]
