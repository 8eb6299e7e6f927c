"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as op
from .registry import query
from .tables import GAP_LINES, GAP_ORDERS, NARROW_LINES, gap_lines, gap_orders, narrow_lines, read, rounded

_TOTALS = """
SELECT count(*)::BIGINT AS rows, 4::BIGINT AS columns,
       (count(*) FILTER (quantity IS NULL) + count(*) FILTER (discount IS NULL)
        + count(*) FILTER (flag IS NULL) + count(*) FILTER (status IS NULL))::BIGINT AS missing_cells,
       (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM narrow_lines)))::BIGINT AS duplicate_rows
FROM narrow_lines
"""


@query("prof_table", f"WITH {NARROW_LINES} {_TOTALS}")
def prof_table(spark, sf_dir):
    return op.table_profile(narrow_lines(spark, sf_dir))


@query(
    "prof_quality",
    f"""WITH {NARROW_LINES}, totals AS ({_TOTALS})
SELECT *, round(greatest(0.0, least(100.0, 100.0 - 50.0 * missing_cells / (rows * columns)
                                     - 50.0 * duplicate_rows / rows))::DOUBLE, 4) AS quality_score
FROM totals""",
)
def prof_quality(spark, sf_dir):
    return rounded(op.quality_score(narrow_lines(spark, sf_dir)))


@query(
    "prof_documents",
    """SELECT count(*)::BIGINT AS rows, 3::BIGINT AS columns, 0::BIGINT AS missing_cells,
       (count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)))::BIGINT AS duplicate_rows
FROM documents""",
)
def prof_documents(spark, sf_dir):
    """Table totals of whole long texts."""
    return op.table_profile(read(spark, sf_dir, "documents").select("text", "lang", "source"))


@query(
    "prof_size",
    """SELECT count(*)::BIGINT AS rows,
       sum(8 + octet_length(encode(text)) + octet_length(encode(lang)) + octet_length(encode(source)) + 8)::BIGINT AS data_bytes
FROM documents""",
)
def prof_size(spark, sf_dir):
    return op.size_estimate(read(spark, sf_dir, "documents"))


@query(
    "prof_missing",
    f"""WITH {GAP_LINES}, n AS (
  SELECT count(*) AS n, count(*) - count(quantity) AS quantity, count(*) - count(price) AS price,
         count(*) - count(discount) AS discount, count(*) - count(flag) AS flag,
         count(*) - count(status) AS status, count(*) - count(shipped) AS shipped
  FROM gap_lines), long AS (
  SELECT "column", missing_count, n FROM n UNPIVOT (missing_count FOR "column" IN (quantity, price, discount, flag, status, shipped)))
SELECT "column", missing_count::BIGINT AS missing_count, round(missing_count * 100.0::DOUBLE / n, 4) AS missing_pct FROM long""",
)
def prof_missing(spark, sf_dir):
    df = gap_lines(spark, sf_dir).select("quantity", "price", "discount", "flag", "status", "shipped")
    return rounded(op.missing_by_column(df).drop("position"))


@query(
    "prof_unique",
    f"""WITH {GAP_LINES}
SELECT 'l_orderkey' AS "column", count(DISTINCT l_orderkey)::BIGINT AS unique_count FROM gap_lines
UNION ALL SELECT 'quantity', count(DISTINCT quantity) FROM gap_lines
UNION ALL SELECT 'price', count(DISTINCT price) FROM gap_lines
UNION ALL SELECT 'status', count(DISTINCT status) FROM gap_lines
UNION ALL SELECT 'shipped', count(DISTINCT shipped) FROM gap_lines""",
)
def prof_unique(spark, sf_dir):
    df = gap_lines(spark, sf_dir).select("l_orderkey", "quantity", "price", "status", "shipped")
    return op.unique_by_column(df).drop("position")


@query(
    "prof_unique_documents",
    """SELECT 'text' AS "column", count(DISTINCT text)::BIGINT AS unique_count FROM documents
UNION ALL SELECT 'lang', count(DISTINCT lang) FROM documents
UNION ALL SELECT 'source', count(DISTINCT source) FROM documents""",
)
def prof_unique_documents(spark, sf_dir):
    """Distinct whole texts, moved as digests."""
    return op.unique_by_column(read(spark, sf_dir, "documents").select("text", "lang", "source")).drop("position")


@query(
    "prof_semantic_type",
    f"""WITH {GAP_ORDERS}, few AS (
  SELECT 'priority' AS "column", count(DISTINCT priority) AS u, count(*) AS n FROM gap_orders
  UNION ALL SELECT 'status', count(DISTINCT status), count(*) FROM gap_orders
  UNION ALL SELECT 'label', count(DISTINCT 'order ' || o_orderkey), count(*) FROM gap_orders)
SELECT "column", CASE WHEN u < 20 OR u / n < 0.05 THEN 'categorical' ELSE 'text' END AS dtype FROM few
UNION ALL SELECT 'total', 'numeric'
UNION ALL SELECT 'ordered', 'datetime'
UNION ALL SELECT 'is_final', 'boolean'""",
)
def prof_semantic_type(spark, sf_dir):
    df = gap_orders(spark, sf_dir).select(
        "priority",
        "status",
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("label"),
        "total",
        "ordered",
        (F.col("status") == "F").alias("is_final"),
    )
    return op.semantic_types(df).drop("position")


@query(
    "prof_samples",
    f"""WITH {GAP_ORDERS}, cells AS (
  SELECT o_orderkey, 'priority' AS "column", priority AS value FROM gap_orders
  UNION ALL SELECT o_orderkey, 'status', status FROM gap_orders
  UNION ALL SELECT o_orderkey, 'ordered', ordered FROM gap_orders),
firsts AS (SELECT "column", value, min(o_orderkey) AS place FROM cells WHERE value IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY place) AS rank FROM firsts)
SELECT "column", rank::BIGINT AS rank, value FROM ranked WHERE rank <= 5""",
)
def prof_samples(spark, sf_dir):
    return op.sample_values(
        gap_orders(spark, sf_dir), 5, order_by=["o_orderkey"], columns=["priority", "status", "ordered"]
    )


_NUMERIC = """SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(min({c}), 4) AS min,
       round(max({c}), 4) AS max, round(stddev_samp({c}), 4) AS std FROM gap_lines"""


@query(
    "prof_numeric",
    f"WITH {GAP_LINES} " + " UNION ALL ".join(_NUMERIC.format(c=c) for c in ("quantity", "price", "discount", "tax")),
)
def prof_numeric(spark, sf_dir):
    out = op.numeric_profile(gap_lines(spark, sf_dir), ["quantity", "price", "discount", "tax"])
    return rounded(out.drop("position"))


_TEXT = """SELECT '{c}' AS "column", round(avg(length({c})), 4) AS avg_length, max(length({c}))::BIGINT AS max_length FROM documents"""


@query("prof_text", " UNION ALL ".join(_TEXT.format(c=c) for c in ("text", "lang", "source")))
def prof_text(spark, sf_dir):
    return rounded(op.text_profile(read(spark, sf_dir, "documents")).drop("position"))


@query(
    "prof_datetime",
    f"""WITH {GAP_ORDERS}
SELECT 'ordered' AS "column", strftime(min(ordered::TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS min_date,
       strftime(max(ordered::TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS max_date FROM gap_orders""",
)
def prof_datetime(spark, sf_dir):
    return op.datetime_profile(gap_orders(spark, sf_dir)).drop("position")


def _full(c: str, kind: str) -> str:
    number = kind == "numeric"
    text = kind == "text"
    stat = {n: f"round({n_sql}, 4)" if number else "NULL::DOUBLE" for n, n_sql in (
        ("mean", f"avg({c})"), ("median", f"median({c})"), ("min", f"min({c})::DOUBLE"),
        ("max", f"max({c})::DOUBLE"), ("std", f"stddev_samp({c})"))}
    dtype = f"'{kind}'" if not text else f"CASE WHEN count(DISTINCT {c}) < 20 OR count(DISTINCT {c}) / count(*) < 0.05 THEN 'categorical' ELSE 'text' END"
    return (
        f"""SELECT '{c}' AS "column", {dtype} AS dtype, (count(*) - count({c}))::BIGINT AS missing_count,
       round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 4) AS missing_pct, count(DISTINCT {c})::BIGINT AS unique_count, """
        + ", ".join(f"{e} AS {n}" for n, e in stat.items())
        + (f", round(avg(length({c})), 4) AS avg_length, max(length({c}))::BIGINT AS max_length" if text
           else ", NULL::DOUBLE AS avg_length, NULL::BIGINT AS max_length")
        + (f", strftime(min({c}::TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS min_date, strftime(max({c}::TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS max_date"
           if kind == "datetime" else ", NULL::VARCHAR AS min_date, NULL::VARCHAR AS max_date")
        + " FROM gap_orders"
    )


@query(
    "prof_columns",
    f"WITH {GAP_ORDERS} "
    + " UNION ALL ".join(
        _full(c, k)
        for c, k in (("o_custkey", "numeric"), ("priority", "text"), ("total", "numeric"), ("status", "text"), ("ordered", "datetime"))
    ),
)
def prof_columns(spark, sf_dir):
    """The whole profile of a table, all measures per column."""
    return rounded(op.column_profile(gap_orders(spark, sf_dir).drop("o_orderkey")).drop("position"))
