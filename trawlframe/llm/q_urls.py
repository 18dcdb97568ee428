"""The url filter over all pages."""

from __future__ import annotations

from trawlframe.llm.common import table
from trawlframe.llm.registry import query
from trawlframe.llm.url_filter import judge_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]

SQL = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {", ".join(map(str, RULES))}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0
                              THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT row_number() OVER () AS n, page_id,
                 translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT any_value(page_id) AS page_id, any_value(host) AS host, any_value(path) AS path,
       arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
       coalesce(arg_max(rverdict, length(rhost || rpath)), 'allow') AS verdict
FROM parts LEFT JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY n"""


@query("op2_url_filter", SQL)
def op2_url_filter(spark, sf_dir):
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS t(host, path, verdict)")
    judged = judge_urls(table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")
