"""Dangling references of the probe's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandmill.operators.orphans import dangling, dangling_counts
from strandmill.tables import load


def _fields(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, str]]:
    return {"pid": (load(spark, d, "real_bb"), "pid"), "ligand": (load(spark, d, "ligand_maccs"), "ligand"), "labels": (load(spark, d, "affinity_labels"), "label_key")}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return dangling(load(spark, d, "probe_affinity"), _fields(spark, d))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return dangling_counts(load(spark, d, "probe_affinity"), _fields(spark, d), {"pid": "real_bb", "ligand": "ligand_maccs", "labels": "affinity_labels"})


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts}


def _key(c: str) -> str:
    return f"nullif(upper(trim({c}, ' ' || chr(9))), '')"


_JUDGED = f"""
WITH refs AS (
  SELECT row_id, ran_at, 'pid' AS ref_field, {_key('pid')} AS k FROM probe_affinity
  UNION ALL SELECT row_id, ran_at, 'ligand', {_key('ligand')} FROM probe_affinity
  UNION ALL SELECT row_id, ran_at, 'labels', {_key('labels')} FROM probe_affinity),
keyed AS (
  SELECT 'pid' AS ref_field, {_key('pid')} AS k, loaded_at, deleted_at FROM real_bb
  UNION ALL SELECT 'ligand', {_key('ligand')}, loaded_at, deleted_at FROM ligand_maccs
  UNION ALL SELECT 'labels', {_key('label_key')}, loaded_at, deleted_at FROM affinity_labels),
j AS (
  SELECT r.row_id, r.ref_field, r.ran_at, count(t.k) AS n,
    bool_or(t.loaded_at <= r.ran_at AND (t.deleted_at IS NULL OR t.deleted_at > r.ran_at)) AS alive,
    bool_and(t.loaded_at > r.ran_at) AS later
  FROM (SELECT DISTINCT * FROM refs WHERE k IS NOT NULL) r LEFT JOIN keyed t ON r.ref_field = t.ref_field AND r.k = t.k
  GROUP BY r.row_id, r.ref_field, r.ran_at, r.k),
judged AS (SELECT row_id, ref_field, strftime(ran_at, '%Y-%m') AS period, CASE WHEN n = 0 THEN 'missing' WHEN alive THEN 'held' WHEN later THEN 'later' ELSE 'deleted' END AS reason FROM j)"""

ORACLE = {
    "p2_found": f"{_JUDGED} SELECT DISTINCT row_id, ref_field, reason, period FROM judged WHERE reason <> 'held'",
    "p2_counts": f"""{_JUDGED}, t AS (SELECT ref_field, period, count(*) AS n_total FROM judged GROUP BY ALL)
SELECT CASE ref_field WHEN 'pid' THEN 'real_bb' WHEN 'ligand' THEN 'ligand_maccs' ELSE 'affinity_labels' END AS ref_table, period, reason, count(*) AS n_rows, any_value(n_total) AS n_total
FROM judged JOIN t USING (ref_field, period) WHERE reason <> 'held' GROUP BY ref_field, period, reason""",
}
