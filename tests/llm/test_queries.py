import ast
from pathlib import Path

import pytest

from evigraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_columns(spark, sf):
    want = {"p1_found": "inventory_id term_type item_no canonical", "p2_found": "name_a name_b", "p3_found": "origin record_no line_no kind word", "p5_found": "citing_paper_id ref_id paper_id", "p6_found": "block_id end_char", "p7_ids": "doc_id ids", "p9_found": "doc_id shared_chars"}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, sf).columns == columns.split()


def test_nothing_outside_imports_this_subpackage():
    root = Path(queries.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [x.name for x in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n.split(".") for n in names)
