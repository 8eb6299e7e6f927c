from __future__ import annotations

from ..common import read
from ..lexical import report
from .registry import query

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op12_lexical",
    f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark),
a AS (SELECT count(*) AS docs, sum(len(w)) AS terms FROM d WHERE len(w) > 0),
c AS (SELECT q, item_id, t, count(*) AS reps FROM (SELECT q, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
f AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) SEMI JOIN c USING (t) GROUP BY ALL),
g AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, a GROUP BY t),
x AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + CAST((25 * n * docs) // terms AS BIGINT)))) AS x FROM f JOIN g USING (t), a),
s AS (SELECT q, item_id, doc_id, CAST(sum(reps * x) AS BIGINT) AS score FROM c JOIN x USING (t) GROUP BY q, item_id, r, doc_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
""",
)
def op12_lexical(spark, sf_dir):
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
