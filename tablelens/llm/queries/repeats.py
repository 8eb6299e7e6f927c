from __future__ import annotations

from ..common import read
from ..repeats import report
from .registry import query


@query(
    "op4_repeats",
    """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT r, doc_id, x, length(x) // 2 AS n_bytes FROM d),
w AS (SELECT r, s, md5(substr(x, 2 * s + 1, 400)) AS h FROM (SELECT r, x, unnest(range(n_bytes - 199)) AS s FROM n WHERE n_bytes >= 200)),
m AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
c AS (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS p FROM w JOIN m USING (h)),
g AS (SELECT r, s, sum(CASE WHEN p IS NULL OR s > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS k FROM c),
u AS (SELECT r, k, min(s) AS b, max(s) + 200 AS e FROM g GROUP BY r, k),
v AS (SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS a FROM u),
t AS (SELECT r, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS z,
             string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) AS kept FROM v JOIN n USING (r) GROUP BY r)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN t USING (r)
""",
)
def op4_repeats(spark, sf_dir):
    return report(read(spark, sf_dir, "documents"))
