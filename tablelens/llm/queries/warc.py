from __future__ import annotations

from ..common import read
from ..warc import report
from .registry import query

# A SHA-1 in base 32: five hexadecimal digits are four letters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >> {5 * j}) & 31), 1)"
    for k in range(8)
    for j in (3, 2, 1, 0)
)


@query(
    "op5_warc",
    f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
""",
)
def op5_warc(spark, sf_dir):
    return report(read(spark, sf_dir, "pages"))
