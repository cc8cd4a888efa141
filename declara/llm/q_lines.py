"""Query op8 and its SQL, which compares the words of all forms that share a half."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table
from .lines import dedup_lines


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.col("text"))


OP8_SQL = rf"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line, regexp_extract_all(translate(ls[i], '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
), p AS (
  SELECT *, array_to_string(ws, ' ') AS form, len(ws) AS n, row_number() OVER (ORDER BY doc_id, i) AS place FROM l
), f AS (
  SELECT form, any_value(ws) AS ws, any_value(n) AS n, min(place) AS first FROM p WHERE n > 0 GROUP BY form
), k AS (
  SELECT form, first, ws, n, unnest([n // 2, (n - 1) // 2]) AS k FROM f WHERE n >= 5
), halves AS (
  SELECT DISTINCT form, first, ws, n, k, 1 AS side, array_to_string(ws[1 : k], ' ') AS half FROM k
  UNION SELECT form, first, ws, n, k, 2, array_to_string(ws[n - k + 1 : n], ' ') FROM k
), tried AS (
  SELECT DISTINCT b.form, CASE WHEN a.n <= b.n THEN a.ws ELSE b.ws END AS x, CASE WHEN a.n <= b.n THEN b.ws ELSE a.ws END AS y
  FROM halves a JOIN halves b ON a.half = b.half AND a.side = b.side AND a.k = b.k AND a.first < b.first AND abs(a.n - b.n) <= 1
), met AS (
  SELECT form, x, y, coalesce(list_position(list_transform(range(1, len(x) + 1), lambda i: x[i] <> y[i]), true), len(x) + 1) AS i FROM tried
), near AS (
  SELECT DISTINCT form FROM met WHERE array_to_string(x[i + CASE WHEN len(x) = len(y) THEN 1 ELSE 0 END :], ' ') = array_to_string(y[i + 1 :], ' ')
), gone AS (
  SELECT place FROM p JOIN f USING (form) WHERE p.n > 0 AND (place > first OR form IN (SELECT form FROM near))
), told AS (
  SELECT doc_id, count(*) AS n_lines, count(gone.place) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone.place IS NULL), '') AS rest
  FROM p LEFT JOIN gone USING (place) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(told.n_lines, 0)::BIGINT AS n_lines, coalesce(told.n_removed, 0)::BIGINT AS n_removed, told.rest AS text FROM documents d LEFT JOIN told USING (doc_id)
"""
