"""The query of problem 4 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.operators.periods import prediction_periods
from spanloom.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return prediction_periods(table(spark, d, "predictions")).select("document_id", "entity_type", "kind", "start", "stop")


SQL = r"""
WITH p AS (
  SELECT DISTINCT trim(regexp_replace(regexp_replace(trim(document_id), '^.*[/\\]', ''), '\.[A-Za-z0-9]+$', '')) AS document_id,
         regexp_replace(upper(trim(entity_type)), '^[BI]-', '') AS entity_type, start, stop
  FROM predictions WHERE start IS NOT NULL AND stop IS NOT NULL AND stop > start),
m AS (SELECT *, max(stop) OVER (PARTITION BY document_id, entity_type ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, entity_type ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS isle FROM m),
q AS (SELECT document_id, entity_type, min(start) AS start, max(stop) AS stop FROM g GROUP BY document_id, entity_type, isle),
l AS (SELECT *, lead(start) OVER (PARTITION BY document_id, entity_type ORDER BY start) AS next FROM q)
SELECT document_id, entity_type, 'period' AS kind, start, stop FROM q
UNION ALL SELECT document_id, entity_type, 'gap', stop, next FROM l WHERE next - stop <= 300
"""
