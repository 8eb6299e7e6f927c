from __future__ import annotations

from ..common import read
from ..mixing import BUDGET, CYCLES, KEYS, OTHER, TEMPERATURE, TOPICS, report
from .registry import query

_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{name}'" for name, p in TOPICS) + f" ELSE '{OTHER}' END"
_SHARE = "CASE WHEN tokens > 0 THEN pow(CAST(tokens AS DOUBLE), {}) ELSE 0 END".format(TEMPERATURE)


def _targets(k: str) -> str:
    """Target shares, and the tokens to aim at: all there are, or the share times the peak of the factor."""
    return f"""
s_{k} AS (SELECT {k}, tokens AS size, share / sum(share) OVER () AS share FROM (
  SELECT {k}, tokens, {_SHARE} AS share FROM (SELECT {k}, sum(tokens) AS tokens FROM cells GROUP BY {k}))),
f_{k} AS (SELECT max(({BUDGET} * (SELECT sum(tokens) FROM cells) - before) / after) AS factor FROM (
  SELECT coalesce(sum(size) OVER (ORDER BY size / share ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(share) OVER (ORDER BY size / share ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM s_{k} WHERE share > 0)),
t_{k} AS (SELECT {k}, share AS target, CASE WHEN share > 0 THEN least(size, share * factor) ELSE 0 END AS aim FROM s_{k}, f_{k})"""


def _scaled(of: str, k: str) -> str:
    return f"SELECT * REPLACE (CASE WHEN held > 0 THEN w * a_{k} / held ELSE 0 END AS w) FROM (SELECT * EXCLUDE (held), sum(w) OVER (PARTITION BY {k}) AS held FROM ({of}))"


def _cycle(n: int) -> str:
    inner = f"SELECT * FROM c{n}"
    for k in KEYS:
        inner = _scaled(inner, k)
    return f"c{n + 1} AS MATERIALIZED (SELECT * REPLACE (least(w, tokens) AS w) FROM ({inner}))"


@query(
    "op1_mixing",
    f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, source, lang, {_TOPIC} AS topic, CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
             CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM d),
cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM e GROUP BY ALL),
{",".join(_targets(k) for k in KEYS)},
c0 AS MATERIALIZED (
  SELECT cells.*, {", ".join(f"t_{k}.target AS t_{k}, t_{k}.aim AS a_{k}" for k in KEYS)}, CAST(0 AS DOUBLE) AS held, {BUDGET} * CAST(tokens AS DOUBLE) AS w
  FROM cells {" ".join(f"JOIN t_{k} USING ({k})" for k in KEYS)}),
{",".join(_cycle(n) for n in range(CYCLES))}
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability, CAST(u AS DOUBLE) < p AS sampled,
       {", ".join(f"round(g_{k}, 6) AS gap_{k}" for k in KEYS)}
FROM e JOIN (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(w / tokens, 1.0) ELSE 1.0 END AS p,
                    {", ".join(f"sum(w) OVER (PARTITION BY {k}) / sum(w) OVER () - t_{k} AS g_{k}" for k in KEYS)}
             FROM c{CYCLES}) USING (source, lang, topic)
""",
)
def op1_mixing(spark, sf_dir):
    return report(read(spark, sf_dir, "documents"))
