from __future__ import annotations

from ..common import read
from ..phrases import report
from .registry import query


@query(
    "op11_phrases",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, s, md5(array_to_string(w[s + 1 : s + 35], ' ')) AS g FROM (SELECT r, w, unnest(range(len(w) - 34)) AS s FROM d WHERE len(w) >= 35)),
g AS (SELECT g FROM p GROUP BY g HAVING count(*) > 1),
h AS (SELECT r, list(DISTINCT x) AS gone FROM (SELECT r, unnest(range(s, s + 35)) AS x FROM p SEMI JOIN g USING (g)) GROUP BY r),
k AS (SELECT r, string_agg(v, ' ' ORDER BY i) AS kept
      FROM (SELECT d.r, unnest(w) AS v, unnest(range(len(w))) AS i FROM d) u
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, unnest(gone) AS x FROM h) e WHERE e.r = u.r AND e.x = u.i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)
""",
)
def op11_phrases(spark, sf_dir):
    return report(read(spark, sf_dir, "documents"))
