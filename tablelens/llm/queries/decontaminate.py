from __future__ import annotations

from ..common import read
from ..decontaminate import report
from .registry import query

_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op9_decontaminate",
    rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SPLIT} AS w FROM benchmark),
i AS (
  SELECT item, least(len(w), 10) AS size, unnest(range(greatest(len(w) - 9, 1))) AS s, w FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, size, array_to_string(w[s + 1 : s + size], ' ') AS gram FROM i),
sizes AS (SELECT DISTINCT size FROM g),
p AS (SELECT r, size, unnest(range(len(w) - size + 1)) AS s, w FROM d, sizes WHERE len(w) >= size),
q AS (SELECT r, size, s, array_to_string(w[s + 1 : s + size], ' ') AS gram FROM p),
h AS (SELECT r, s, q.size, item FROM q JOIN g ON q.gram = g.gram AND q.size = g.size),
n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS x FROM h) GROUP BY r),
t AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
""",
)
def op9_decontaminate(spark, sf_dir):
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
