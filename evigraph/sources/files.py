"""Readers with stated schemas: file manifests, JSON documents, event logs, run logs, XML text; and writers."""

from __future__ import annotations

import csv
import html
import io
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cell, collapse
from ..runtime import written

EVENT_SCHEMA = "event_id string, created_at timestamp, actor string, paper_id string, event_type string, entity_type string, entity_uid string, old string, new struct<alias:string, canonical:string, value:string, statement:string, tags:array<string>>, reason string"


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, file_name, size, sha, modified) of the files below a folder; contents never leave the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha"), F.col("modificationTime").alias("modified"))


def json_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One row a file, with its path; unreadable files come as rows of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(folder).withColumn("path", F.input_file_name())


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of an append-only log of JSON lines; blank and malformed lines are left out. Replay order is (created_at, event_id)."""
    return spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("event_id is not null")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text logs, each file read whole so that its lines keep their order."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))
    return lines.select("file", (F.col("i") + 1).alias("line_no"), "line")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, x): XML files without namespaces."""
    raw = spark.read.text(folder, wholetext=True).withColumn("path", F.input_file_name())
    bare = F.regexp_replace("value", r"""\sxmlns(?::\w+)?=("[^"]*"|'[^']*')""", "")
    return raw.select("path", F.regexp_replace(bare, r"<(/?)\w+:(\w)", "<$1$2").alias("x"))


def _element_text(xml):
    """All text below an element, joined by single blanks: tags taken out, the five entities read."""
    s = F.regexp_replace(xml, "<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return collapse(s)


def tei_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, section_no, heading, paragraph_no, text, refs) of the body of TEI XML files.

    The body is cut at the beginnings of its sections, a section at its paragraphs; what is marked up within a paragraph stays
    part of it. Paragraphs that stand under no section make up section 0 without a heading. ``refs`` has the targets of its
    references, '#' taken off, each once."""
    body = F.regexp_extract("x", r"(?s)<body\b[^>]*>(.*)</body>", 1)
    pieces = _texts(spark, folder).select("path", F.posexplode(F.split(body, r"(?=<div\b)")).alias("section_no", "d"))
    heading = _element_text(F.regexp_extract("d", r"(?s)<head\b[^>]*>(.*?)</head>", 1))
    each = pieces.select("path", "section_no", heading.alias("heading"), F.posexplode(F.regexp_extract_all("d", F.lit(r"(?s)<p\b[^>]*(?<!/)>(.*?)</p>"), F.lit(1))).alias("i", "p"))
    refs = F.regexp_extract_all("p", F.lit(r"""<ref\b[^>]*\btarget\s*=\s*["']#?([^"']+)["']"""), F.lit(1))
    return each.select("path", "section_no", "heading", (F.col("i") + 1).alias("paragraph_no"), _element_text(F.col("p")).alias("text"), F.array_distinct(refs).alias("refs")).where("text != ''")


def tei_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(path, title, doi, journal, year, authors array<struct<full_name, forename, surname>>) of TEI headers: those of the source
    description, else of the title statement."""
    x = _texts(spark, folder)
    head = F.regexp_extract("x", r"(?s)<teiHeader\b.*?</teiHeader>", 0)
    source = F.regexp_extract(head, r"(?s)<sourceDesc\b.*?</sourceDesc>", 0)
    statement = F.regexp_extract(head, r"(?s)<titleStmt\b.*?</titleStmt>", 0)
    analytic = F.regexp_extract(source, r"(?s)<analytic\b.*?</analytic>", 0)
    blank = lambda c: F.nullif(c, F.lit(""))
    title = F.coalesce(blank(_element_text(F.regexp_extract(analytic, r"""(?s)<title\b[^>]*level=["']a["'][^>]*>(.*?)</title>""", 1))), blank(_element_text(F.regexp_extract(statement, r"(?s)<title\b[^>]*>(.*?)</title>", 1))))
    doi = blank(F.trim(F.regexp_replace(_element_text(F.regexp_extract(source, r"""(?is)<idno\b[^>]*type=["']doi["'][^>]*>(.*?)</idno>""", 1)), r"^https?://doi\.org/", "")))
    journal = blank(_element_text(F.regexp_extract(source, r"""(?s)<monogr\b.*?<title\b[^>]*level=["']j["'][^>]*>(.*?)</title>""", 1)))
    imprint = F.regexp_extract(source, r"(?s)<imprint\b.*?</imprint>", 0)
    when = F.coalesce(blank(F.regexp_extract(imprint, r"""<date\b[^>]*\bwhen=["']([^"']+)["']""", 1)), _element_text(F.regexp_extract(imprint, r"(?s)<date\b[^>]*>(.*?)</date>", 1)))

    def people(xml):
        found = F.regexp_extract_all(xml, F.lit(r"(?s)<author\b[^>]*>(.*?)</author>"), F.lit(1))

        def one(a):
            fore = F.array_join(F.filter(F.transform(F.regexp_extract_all(a, F.lit(r"(?s)<forename\b[^>]*>(.*?)</forename>"), F.lit(1)), _element_text), lambda t: t != ""), " ")
            sur = _element_text(F.regexp_extract(a, r"(?s)<surname\b[^>]*>(.*?)</surname>", 1))
            full = F.coalesce(blank(F.trim(F.concat_ws(" ", blank(fore), blank(sur)))), _element_text(a))
            return F.struct(full.alias("full_name"), blank(fore).alias("forename"), blank(sur).alias("surname"))

        return F.filter(F.transform(found, one), lambda p: p["full_name"] != "")

    own = people(analytic)
    return x.select("path", title.alias("title"), doi.alias("doi"), journal.alias("journal"), blank(F.regexp_extract(when, r"\b((?:18|19|20|21)\d{2})\b", 1)).cast("int").alias("year"), F.when(F.size(own) > 0, own).otherwise(people(statement)).alias("authors"))


def tei_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(path, table_no, row_no, cells): the rows of the tables of TEI files; rows of blank cells are left out."""
    tables = _texts(spark, folder).select("path", F.posexplode(F.regexp_extract_all("x", F.lit(r"(?s)<table\b[^>]*>(.*?)</table>"), F.lit(1))).alias("t", "body"))
    rows = tables.select("path", (F.col("t") + 1).alias("table_no"), F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<row\b[^>]*>(.*?)</row>"), F.lit(1))).alias("r", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?s)<cell\b[^>]*?(?:/>|>(.*?)</cell>)"), F.lit(1)), _element_text)
    return rows.select("path", "table_no", (F.col("r") + 1).alias("row_no"), cells.alias("cells")).where(F.exists("cells", lambda c: c != ""))


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)


def _xml(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


GRAPHML_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="type" for="node" attr.name="type" attr.type="string"/>\n<key id="label" for="node" attr.name="label" attr.type="string"/>\n'
    '<key id="relation" for="edge" attr.name="relation" attr.type="string"/>\n<key id="weight" for="edge" attr.name="weight" attr.type="double"/>\n<graph edgedefault="undirected">'
)
GRAPHML_TAIL = "</graph>\n</graphml>"


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, line): the nodes (node_id, node_type, label) and edges (source, target, relation, weight) as a GraphML document, to be
    written in order of ``ord``: head 0, nodes 1, edges 2, tail 3."""
    spark = nodes.sparkSession
    n = nodes.select(F.lit(1).alias("ord"), F.format_string('<node id="%s"><data key="type">%s</data><data key="label">%s</data></node>', _xml(F.col("node_id")), _xml(F.coalesce("node_type", F.lit(""))), _xml(F.coalesce("label", F.lit("")))).alias("line"))
    e = edges.select(F.lit(2).alias("ord"), F.format_string('<edge source="%s" target="%s"><data key="relation">%s</data><data key="weight">%s</data></edge>', _xml(F.col("source")), _xml(F.col("target")), _xml(F.coalesce("relation", F.lit(""))), F.coalesce(F.col("weight"), F.lit(1.0)).cast("string")).alias("line"))
    frame = spark.createDataFrame([(0, GRAPHML_HEAD), (3, GRAPHML_TAIL)], "ord int, line string")
    return frame.unionByName(n).unionByName(e)


def write_text(lines: DataFrame, folder: str) -> None:
    """Lines (ord, line) as text files in order of ``ord``; their parts, read by name, make up one document."""
    lines.repartitionByRange("ord", "line").sortWithinPartitions("ord", "line").select("line").write.mode("overwrite").text(folder)


def component_columns(edges: DataFrame, layers: list[str]) -> DataFrame:
    """Combined edges with a column for each layer's part, 0 where it has none."""
    return edges.select("src", "dst", "weight", *[F.coalesce(F.try_element_at("components", F.lit(n)), F.lit(0.0)).alias(n) for n in layers])


def page(title: str, payload: str) -> str:
    """A page that holds a JSON payload and draws nothing else: the payload may stand in a script element."""
    safe = payload
    for a, b in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        safe = safe.replace(a, b)
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><div id="view"></div><script id="payload" type="application/json">{safe}</script></body></html>'


def bibliography(papers: DataFrame) -> DataFrame:
    """(ord, line): a Markdown list of papers (paper_id, title, authors, year, journal, doi), by year, unknown ones last, authors,
    title and id."""
    year = F.coalesce(F.when(F.col("year").cast("string").rlike(r"^\d+$"), F.col("year").cast("int")), F.lit(9999))
    doi = F.when(F.coalesce("doi", F.lit("")) != "", F.concat(F.lit(" https://doi.org/"), "doi")).otherwise("")
    line = F.concat(F.lit("- "), F.coalesce("authors", F.lit("Unknown author")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit("). "), cell(F.coalesce("title", F.lit("Untitled"))), F.lit(". "), F.coalesce("journal", F.lit("")), doi)
    return papers.select(F.struct(year.alias("year"), F.lower(F.coalesce("authors", F.lit(""))).alias("authors"), F.lower(F.coalesce("title", F.lit(""))).alias("title"), "paper_id").alias("ord"), line.alias("line"))


def embedding_parts(vectors: DataFrame) -> DataFrame:
    """(row_no, node, v): vectors (node, v) under a dense row number in order of the node, by which a matrix is written part by
    part; the number comes from the sizes of the ranges, not from one task."""
    spark = vectors.sparkSession
    rows = vectors.repartitionByRange("node").sortWithinPartitions("node").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    held = written(rows, "vectors")
    sizes = held.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("part").collect()  # one row for each range
    starts, total = [], 0
    for r in sizes:
        starts.append((r["part"], r["first"], total))
        total += r["n"]
    start = spark.createDataFrame(starts, "part int, first bigint, start bigint")
    return held.join(F.broadcast(start), "part").select((F.col("at") - F.col("first") + F.col("start")).alias("row_no"), "node", "v")


def report(issues: DataFrame) -> DataFrame:
    """(paper_id, report): a Markdown table of the issues of each paper, in a stable order."""
    row = F.concat(F.lit("| "), cell(F.col("severity")), F.lit(" | "), cell(F.col("issue")), F.lit(" | "), cell(F.col("item_id")), F.lit(" | "), cell(F.col("detail")), F.lit(" |"))
    lines = issues.groupBy("paper_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    head = F.lit("| severity | issue | item | detail |\n|-|-|-|-|\n")
    return lines.select("paper_id", F.concat(head, F.array_join("rows", "\n")).alias("report"))


def cluster_archive(papers: DataFrame, citations: dict[str, str], path: str, read: Callable[[str], bytes], most: int = 1000) -> int:
    """Writes the files of a cluster's papers (paper_id, path, title, authors, year) into a ZIP on the driver, in order of year, authors,
    title and id, with citations.txt and citations.csv; how many files. More than ``most`` papers are an error."""
    rows = papers.select(F.coalesce(F.when(F.col("year").cast("string").rlike(r"^\d+$"), F.col("year").cast("int")), F.lit(9999)).alias("y"), F.lower(F.coalesce("authors", F.lit(""))).alias("a"), F.lower(F.coalesce("title", F.lit(""))).alias("t"), "paper_id", "path").orderBy("y", "a", "t", "paper_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a cluster of more than {most} papers")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for n, r in enumerate(rows, 1):
            z.writestr(f"{n:03}_{r['paper_id']}.pdf", read(r["path"]))
        z.writestr("citations.txt", "\n".join(citations.get(r["paper_id"], "") for r in rows))
        out = io.StringIO()
        csv.writer(out).writerows([("paper_id", "citation"), *((r["paper_id"], citations.get(r["paper_id"], "")) for r in rows)])
        z.writestr("citations.csv", "\ufeff" + out.getvalue())
    return len(rows)
