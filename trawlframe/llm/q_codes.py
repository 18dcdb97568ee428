"""Codes of all embeddings."""

from __future__ import annotations

from trawlframe.llm.common import table
from trawlframe.llm.registry import query
from trawlframe.llm.vector_codes import vector_codes


def _rounds(n: int) -> str:
    """Assignment and new codebook of each round, as SQL."""
    steps = []
    for r in range(n + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT n, p, min(d * 1000 + e) // 1000 AS d, min(d * 1000 + e) % 1000 AS e
  FROM (SELECT n, p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS d
        FROM parts JOIN book{r} USING (p)) GROUP BY n, p)""")
        if r < n:
            steps.append(f"""
mean{r} AS (
  SELECT p, e, list(CAST(floor(s / k) AS BIGINT) ORDER BY i) AS c
  FROM (SELECT p, e, i, sum(v)::DOUBLE AS s, count(*) AS k
        FROM (SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM parts JOIN near{r} USING (n, p))
        GROUP BY p, e, i) GROUP BY p, e),
book{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(mean{r}.c, book{r}.c) AS c FROM book{r} LEFT JOIN mean{r} USING (p, e))""")
    return ",".join(steps)


SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, label,
         list_transform(embedding, lambda v: CAST(floor(1024 * v::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (
  SELECT n, vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x
  FROM kept CROSS JOIN (SELECT unnest(range(4)) AS p)),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 256),{_rounds(4)},
told AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book4),
coded AS (
  SELECT n, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near4 GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (n) CROSS JOIN told"""


@query("op11_vector_codes", SQL)
def op11_vector_codes(spark, sf_dir):
    coded = vector_codes(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
