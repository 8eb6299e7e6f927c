from __future__ import annotations

from ..common import read
from ..pii import ACCEPTED, ADDED, AFTER, AGAINST_BY, BASE, BEFORE, report
from .registry import query

# The patterns of the contract, that of account numbers, and runs that may be secrets.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "secret": "[A-Za-z0-9]{32,}",
}


def _hits(k: str) -> str:
    p = _PATTERNS[k]
    return f"""
h_{k} AS (
  SELECT r, i, v, t, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda g: length(g))), 0) AS s
  FROM (SELECT r, t, gaps, hits, unnest(hits) AS v, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT r, t, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits FROM d)))"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_VALID = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(v, '.'), lambda p: TRY_CAST(p AS HUGEINT))) <= 255",
    "card": f"""length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length({_DIGITS})), lambda j:
        CASE WHEN j % 2 = 0 THEN CAST(substr(reverse({_DIGITS}), j + 1, 1) AS INT)
             ELSE (CAST(substr(reverse({_DIGITS}), j + 1, 1) AS INT) * 2) % 10 + CAST(substr(reverse({_DIGITS}), j + 1, 1) AS INT) // 5 END)) % 10 = 0""",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": """NOT regexp_matches(CASE WHEN s > 0 THEN substr(t, CAST(s AS BIGINT), 1) ELSE '' END || ' ' || substr(t, CAST(s AS BIGINT) + length(v) + 1, 1), '[A-Za-z0-9]')
        AND list_reduce(list_prepend(0, list_transform(string_split(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''),
            lambda c: ascii(c))), lambda a, c: CASE WHEN c <= 57 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1""",
    "secret": "regexp_full_match(v, '[0-9A-Fa-f]{32,64}') AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Fa-f]')",
}
_ORDER = list(_PATTERNS)


def _score(kind) -> str:
    has = lambda words: "regexp_matches(near, '(?:^|[^a-z])(?:" + "|".join(words) + ")')" if words else "false"
    return f"""CAST(round(100 * ({kind.score} + CASE WHEN {has(kind.words)} THEN {kind.up} ELSE 0 END - CASE WHEN {has(kind.against)} THEN {AGAINST_BY} ELSE 0 END)) AS INT)"""


_NEAR = f"""lower(substr(t, CAST(greatest(s - {BEFORE}, 0) AS BIGINT) + 1, CAST(s - greatest(s - {BEFORE}, 0) AS BIGINT)) || ' '
    || substr(t, CAST(s AS BIGINT) + length(v) + 1, {AFTER}))"""


@query(
    "op10_pii",
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),"
    + ",".join(_hits(k) for k in _ORDER)
    + ", f AS (SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT r, {n} AS o, '{k.name}' AS kind, s, e, {_score(k)} AS score FROM ("
        f"SELECT r, CAST(s AS BIGINT) AS s, CAST(s AS BIGINT) + length(v) AS e, {_NEAR} AS near FROM h_{k.name} WHERE {_VALID[k.name]})"
        for n, k in enumerate(BASE + ADDED)
    )
    + f""") WHERE o < 4 OR score >= {100 * ACCEPTED}),
a AS (
  SELECT r, count(*) FILTER (o = 0) AS n_email, count(*) FILTER (o = 1) AS n_ip, count(*) FILTER (o = 2) AS n_card,
         count(*) FILTER (o = 3) AS n_phone,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (o < 4) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY o, s) AS scores
  FROM f GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN a USING (r)
""",
)
def op10_pii(spark, sf_dir):
    return report(read(spark, sf_dir, "documents"))
