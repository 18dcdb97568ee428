"""Common lines dropped from all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawlframe.llm.common import LOWER, UPPER, table
from trawlframe.llm.line_dedup import drop_common_lines
from trawlframe.llm.registry import query

SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS line FROM documents),
lines AS (
  SELECT doc_id, unnest(range(len(line))) AS place, unnest(line) AS line FROM split),
keys AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{UPPER}', '{LOWER}') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS last FROM keys WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, place, line, coalesce(doc_id <> last, false) AS gone
  FROM keys LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op12_line_dedup", SQL)
def op12_line_dedup(spark, sf_dir):
    left = drop_common_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
