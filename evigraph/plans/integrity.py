"""Queries on references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.orphans import orphan_ledger
from ..runtime import table


def _ledger(spark: SparkSession, d: str, snapshots: bool = False):
    return orphan_ledger(table(spark, d, "papers"), table(spark, d, "reference_matches_v4"), table(spark, d, "paper_projects"), snapshots)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d)[0].open()


def p4_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d)[0].snapshot()


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    """Orphans open after each year, as the ledger stood then."""
    return _ledger(spark, d, True)[1]


def _number(column: str) -> str:
    return f"nullif(regexp_extract(translate({column}, 'Ｐｐ＃０１２３４５６７８９－', 'Pp#0123456789-'), '^[\\s#]*[Pp][\\s\\-_#:.]*0*([0-9]+)\\s*$', 1), '')"


_OPEN = f"""
WITH parent AS (
  SELECT num, arg_max(active, (last_seen_at, active)) AS active, min(first_seen_at) AS seen
  FROM (SELECT *, {_number("paper_id")} AS num FROM papers) WHERE num IS NOT NULL GROUP BY num),
m AS (SELECT * FROM reference_matches_v4 QUALIFY row_number() OVER (PARTITION BY citing_paper_id, ref_id ORDER BY updated_at DESC, target_paper_id DESC NULLS LAST) = 1),
p AS (SELECT paper_id, project_slug, max(assigned_at) AS assigned_at FROM paper_projects GROUP BY ALL),
refs AS (
  SELECT 'reference_matches_v4' AS child_table, 'citing_paper_id' AS child_column, concat(citing_paper_id, '|', ref_id) AS record_key, citing_paper_id AS id, updated_at AS tm FROM m
  UNION ALL SELECT 'reference_matches_v4', 'target_paper_id', concat(citing_paper_id, '|', ref_id), target_paper_id, updated_at FROM m
  UNION ALL SELECT 'paper_projects', 'paper_id', concat(paper_id, '|', project_slug), paper_id, assigned_at FROM p),
judged AS (
  SELECT r.*, CASE WHEN q.num IS NULL THEN 'missing' WHEN q.active = 0 THEN 'inactive' WHEN q.seen > r.tm THEN 'late' END AS kind
  FROM (SELECT *, {_number("id")} AS num FROM refs WHERE id IS NOT NULL) r LEFT JOIN parent q ON r.num = q.num),
opened AS (SELECT child_table, child_column, record_key, kind, strftime(tm, '%Y-%m') AS year_month FROM judged WHERE kind IS NOT NULL)
"""

_HISTORY = f"""
WITH pr AS (SELECT *, {_number("paper_id")} AS num, coalesce(year(last_seen_at), 0) AS h FROM papers),
mr AS (SELECT *, coalesce(year(updated_at), 0) AS h FROM reference_matches_v4),
jr AS (SELECT *, coalesce(year(assigned_at), 0) AS h FROM paper_projects),
years AS (SELECT h AS now FROM pr WHERE num IS NOT NULL UNION SELECT h FROM mr UNION SELECT h FROM jr),
parent AS (SELECT now, num, arg_max(active, (last_seen_at, active)) AS active, min(first_seen_at) AS seen FROM years JOIN pr ON h <= now WHERE num IS NOT NULL GROUP BY ALL),
m AS (SELECT * FROM years JOIN mr ON h <= now QUALIFY row_number() OVER (PARTITION BY now, citing_paper_id, ref_id ORDER BY updated_at DESC, target_paper_id DESC NULLS LAST) = 1),
p AS (SELECT now, paper_id, project_slug, max(assigned_at) AS assigned_at FROM years JOIN jr ON h <= now GROUP BY ALL),
refs AS (
  SELECT now, 'reference_matches_v4' AS child_table, 'citing_paper_id' AS child_column, citing_paper_id AS id, updated_at AS tm FROM m
  UNION ALL SELECT now, 'reference_matches_v4', 'target_paper_id', target_paper_id, updated_at FROM m
  UNION ALL SELECT now, 'paper_projects', 'paper_id', paper_id, assigned_at FROM p),
judged AS (
  SELECT r.*, CASE WHEN q.num IS NULL THEN 'missing' WHEN q.active = 0 THEN 'inactive' WHEN q.seen > r.tm THEN 'late' END AS kind
  FROM (SELECT *, {_number("id")} AS num FROM refs WHERE id IS NOT NULL) r LEFT JOIN parent q ON r.num = q.num AND r.now = q.now)
SELECT now::INT AS year, child_table, child_column, kind, count(*) AS n_open FROM judged WHERE kind IS NOT NULL GROUP BY ALL
"""

QUERIES = {"p4_found": p4_found, "p4_snapshot": p4_snapshot, "p4_history": p4_history}
SQL = {
    "p4_found": _OPEN + "SELECT * FROM opened",
    "p4_snapshot": _OPEN + "SELECT child_table, child_column, kind, year_month, count(*) AS n_orphans FROM opened GROUP BY ALL",
    "p4_history": _HISTORY,
}
