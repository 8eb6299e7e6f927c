"""Exploration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explore as op
from ..operators.profile import missing_by_column
from .registry import query
from .tables import (
    GAP_LINES,
    GAP_ORDERS,
    NARROW_LINES,
    gap_lines,
    gap_orders,
    narrow_lines,
    read,
    rounded,
)

NUMBERS = ("quantity", "price", "discount", "tax")


@query(
    "eda_sample",
    """SELECT count(*)::BIGINT AS rows, count(DISTINCT l_orderkey || '/' || l_partkey || '/' || l_suppkey || '/' || l_linenumber || '/' || l_extendedprice)::BIGINT AS distinct_rows
FROM (SELECT * FROM lineitem LIMIT 5000)""",
)
def eda_sample(spark, sf_dir):
    """Size of a repeatable sample of 5,000 rows (a sampling operator)."""
    s = op.sample_exact(read(spark, sf_dir, "lineitem"), 5000, seed=42)
    key = F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return s.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("distinct_rows"))


@query(
    "eda_overview",
    f"""WITH {NARROW_LINES}, t AS (
SELECT count(*)::BIGINT AS rows, 4::BIGINT AS columns,
       (4 * count(*) - count(quantity) - count(discount) - count(flag) - count(status))::BIGINT AS missing_cells,
       (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM narrow_lines)))::BIGINT AS duplicate_rows FROM narrow_lines)
SELECT *, round((100.0 - 50.0 * missing_cells / (rows * columns) - 50.0 * duplicate_rows / rows)::DOUBLE, 4) AS quality_score,
       false AS is_sampled, rows AS sample_rows FROM t""",
)
def eda_overview(spark, sf_dir):
    return rounded(op.overview(narrow_lines(spark, sf_dir)))


@query(
    "eda_classify",
    f"""WITH {GAP_ORDERS}
SELECT 'o_orderkey' AS "column", 'numeric' AS kind, count(o_orderkey)::BIGINT AS present FROM gap_orders
UNION ALL SELECT 'o_custkey', 'numeric', count(o_custkey) FROM gap_orders
UNION ALL SELECT 'priority', 'categorical', count(priority) FROM gap_orders
UNION ALL SELECT 'total', 'numeric', count(total) FROM gap_orders
UNION ALL SELECT 'status', 'categorical', count(status) FROM gap_orders
UNION ALL SELECT 'ordered', 'datetime', count(ordered) FROM gap_orders""",
)
def eda_classify(spark, sf_dir):
    df = gap_orders(spark, sf_dir)
    counts = missing_by_column(df)
    rows = df.agg(F.count(F.lit(1))).scalar()
    present = counts.select("position", (rows - F.col("missing_count")).alias("present"))
    return op.classify_columns(df).join(present, "position").drop("position")


def _describe(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c})::BIGINT AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(var_samp({c}), 1) AS variance, round(min({c}), 4) AS min, round(max({c}), 4) AS max,
  round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis,
  round(quantile_cont({c}, 0.25), 4) AS q25, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75,
  round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr,
  (SELECT {c} FROM gap_lines WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)::DOUBLE AS mode FROM gap_lines"""


@query("eda_numeric", f"WITH {GAP_LINES} " + " UNION ALL ".join(_describe(c) for c in NUMBERS))
def eda_numeric(spark, sf_dir):
    out = op.describe_numeric(gap_lines(spark, sf_dir), NUMBERS).drop("position")
    return rounded(out.withColumn("variance", F.round("variance", 1)))


@query(
    "eda_skewness",
    f"WITH {GAP_LINES} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(skewness({c}), 4) AS skewness FROM gap_lines""" for c in NUMBERS
    ),
)
def eda_skewness(spark, sf_dir):
    return rounded(op.shape_statistics(gap_lines(spark, sf_dir), NUMBERS).select("column", "skewness"))


@query(
    "eda_kurtosis",
    f"WITH {GAP_LINES} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(kurtosis({c}), 4) AS kurtosis FROM gap_lines""" for c in NUMBERS
    ),
)
def eda_kurtosis(spark, sf_dir):
    return rounded(op.shape_statistics(gap_lines(spark, sf_dir), NUMBERS).select("column", "kurtosis"))


@query(
    "eda_skew_flag",
    """WITH s AS (SELECT 'total' AS "column", skewness(o_totalprice) AS skewness FROM orders
  UNION ALL SELECT 'total_squared', skewness(o_totalprice * o_totalprice * o_totalprice) FROM orders)
SELECT "column", round(skewness, 4) AS skewness, abs(skewness) > 1 AS is_skewed FROM s""",
)
def eda_skew_flag(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(
        F.col("o_totalprice").alias("total"),
        (F.col("o_totalprice") * F.col("o_totalprice") * F.col("o_totalprice")).alias("total_squared"),
    )
    return rounded(op.skew_flag(op.shape_statistics(df)).select("column", "skewness", "is_skewed"))


@query(
    "eda_histogram",
    f"""WITH {GAP_LINES}, e AS (SELECT min(price) AS lo, max(price) AS hi FROM gap_lines),
w AS (SELECT lo, hi, (hi - lo) / 20 AS width FROM e),
placed AS (SELECT least(floor((price - lo) / width), 19)::INTEGER AS bin FROM gap_lines, w WHERE price IS NOT NULL),
bins AS (SELECT range::INTEGER AS bin FROM range(20))
SELECT b.bin, round(lo + b.bin * width, 4) AS lower, round(CASE WHEN b.bin = 19 THEN hi ELSE lo + (b.bin + 1) * width END, 4) AS upper,
       count(p.bin)::BIGINT AS "count"
FROM bins b CROSS JOIN w LEFT JOIN placed p ON p.bin = b.bin GROUP BY ALL""",
)
def eda_histogram(spark, sf_dir):
    return rounded(op.histogram(gap_lines(spark, sf_dir), "price"))


def _binned(c: str, position: int) -> str:
    return f"""SELECT {position}::INTEGER AS position, '{c}' AS "column", b.bin, round(lo + b.bin * width, 4) AS lower,
  round(CASE WHEN b.bin = 4 THEN hi ELSE lo + (b.bin + 1) * width END, 4) AS upper, count(p.bin)::BIGINT AS "count"
FROM (SELECT range::INTEGER AS bin FROM range(5)) b
CROSS JOIN (SELECT min({c}) AS lo, max({c}) AS hi, (max({c}) - min({c})) / 5 AS width FROM gap_lines)
LEFT JOIN (SELECT least(floor(({c} - lo) / width), 4)::INTEGER AS bin FROM gap_lines, (SELECT min({c}) AS lo, (max({c}) - min({c})) / 5 AS width FROM gap_lines)
  WHERE {c} IS NOT NULL) p ON p.bin = b.bin GROUP BY ALL"""


@query("eda_histograms", f"WITH {GAP_LINES} " + " UNION ALL ".join(_binned(c, i) for i, c in enumerate(NUMBERS)))
def eda_histograms(spark, sf_dir):
    """Bins of several columns from two scans."""
    return rounded(op.histograms(gap_lines(spark, sf_dir).select(*NUMBERS), NUMBERS, 5))


_OUTLIERS = """SELECT '{c}' AS "column", count(*) FILTER ({c} < lo OR {c} > hi)::BIGINT AS outlier_count,
  round(count(*) FILTER ({c} < lo OR {c} > hi) * 100.0::DOUBLE / count({c}), 4) AS outlier_pct,
  round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound
FROM spread, (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
                     quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM spread)"""

SPREAD = """spread AS (
  SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * l_quantity * l_quantity END AS volume,
         l_extendedprice * (1 + l_tax) AS gross, l_discount AS discount FROM lineitem)"""


def spread(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * l_quantity * l_quantity END AS volume",
        "l_extendedprice * (1 + l_tax) AS gross",
        "l_discount AS discount",
    )


@query(
    "eda_outliers", f"WITH {SPREAD} " + " UNION ALL ".join(_OUTLIERS.format(c=c) for c in ("volume", "gross", "discount"))
)
def eda_outliers(spark, sf_dir):
    return rounded(op.outlier_summary(spread(spark, sf_dir)).drop("position"))


_CATEGORY = """SELECT '{c}' AS "column", count(DISTINCT {c})::BIGINT AS unique_count, round(count(DISTINCT {c}) / count(*), 4) AS cardinality_ratio,
  (SELECT {c} FROM gap_orders WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_value FROM gap_orders"""


@query("eda_categorical", f"WITH {GAP_ORDERS} " + " UNION ALL ".join(_CATEGORY.format(c=c) for c in ("priority", "status")))
def eda_categorical(spark, sf_dir):
    return rounded(op.describe_categorical(gap_orders(spark, sf_dir)).drop("position"))


_TOP = """SELECT '{c}' AS "column", row_number() OVER (ORDER BY count(*) DESC, {c})::BIGINT AS rank, {c} AS value, count(*)::BIGINT AS "count"
FROM part GROUP BY {c} QUALIFY rank <= 20"""


@query("eda_top_values", " UNION ALL ".join(f"({_TOP.format(c=c)})" for c in ("p_name", "p_brand", "p_type")))
def eda_top_values(spark, sf_dir):
    return op.top_values(read(spark, sf_dir, "part"))


@query(
    "eda_top_documents",
    """SELECT 'text' AS "column", row_number() OVER (ORDER BY count(*) DESC, text)::BIGINT AS rank, text AS value, count(*)::BIGINT AS "count"
FROM documents GROUP BY text QUALIFY rank <= 20""",
)
def eda_top_documents(spark, sf_dir):
    """The most copied whole texts."""
    return op.top_values(read(spark, sf_dir, "documents"), ["text"])


@query(
    "eda_datetime",
    """SELECT 'ts' AS "column", strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS earliest_date, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS latest_date,
  floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)::DOUBLE AS span_days FROM events""",
)
def eda_datetime(spark, sf_dir):
    return op.describe_datetime(read(spark, sf_dir, "events")).drop("position")


_PAIRS = [(a, b) for i, a in enumerate(("quantity", "price", "gross", "discount")) for b in ("quantity", "price", "gross", "discount")[i + 1 :]]

_RELATED = """related AS (
  SELECT CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity END AS quantity, l_extendedprice AS price,
         l_extendedprice * (1 - l_discount) + 500 * l_quantity AS gross, l_discount AS discount FROM lineitem)"""

_CORR_SQL = " UNION ALL ".join(
    f"SELECT {n}::INTEGER AS pair, '{a}' AS column1, '{b}' AS column2, corr({a}, {b}) AS r FROM related" for n, (a, b) in enumerate(_PAIRS)
)


def _related(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity END AS quantity",
        "l_extendedprice AS price",
        "l_extendedprice * (1 - l_discount) + 500 * l_quantity AS gross",
        "l_discount AS discount",
    )


@query(
    "eda_correlation",
    f"WITH {_RELATED}, c AS ({_CORR_SQL}) SELECT pair, column1, column2, round(r, 4) AS coefficient FROM c WHERE abs(r) >= 0.3",
)
def eda_correlation(spark, sf_dir):
    return rounded(op.correlations(_related(spark, sf_dir)))


@query(
    "eda_corr_matrix",
    f"""WITH {_RELATED}, c AS ({_CORR_SQL}), kept AS (SELECT column1, column2, r FROM c WHERE abs(r) >= 0.3),
cells AS (SELECT column1 AS "row", column2 AS col, r FROM kept UNION ALL SELECT column2, column1, r FROM kept
  UNION ALL SELECT n, n, 1.0 FROM (VALUES ('quantity'), ('price'), ('gross'), ('discount')) v(n))
SELECT "row", """
    + ", ".join(f"round(max(r) FILTER (col = '{c}'), 4)::DOUBLE AS {c}" for c in ("quantity", "price", "gross", "discount"))
    + """ FROM cells GROUP BY "row" """,
)
def eda_corr_matrix(spark, sf_dir):
    df = _related(spark, sf_dir)
    return rounded(op.correlation_matrix(op.correlations(df), df.columns))


_MISSING = """SELECT '{c}' AS "column", (count(*) - count({c}))::BIGINT AS missing_count,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 4) AS missing_pct FROM gap_orders"""


@query(
    "eda_missing_columns",
    f"WITH {GAP_ORDERS} " + " UNION ALL ".join(_MISSING.format(c=c) for c in ("o_orderkey", "o_custkey", "priority", "total", "status", "ordered")),
)
def eda_missing_columns(spark, sf_dir):
    return rounded(op.missing_by_column(gap_orders(spark, sf_dir)).drop("position"))


@query(
    "eda_missing_rows",
    f"""WITH {GAP_LINES}
SELECT ((quantity IS NULL)::INT + (discount IS NULL)::INT + (status IS NULL)::INT)::BIGINT AS missing_cells, count(*)::BIGINT AS rows
FROM gap_lines GROUP BY 1""",
)
def eda_missing_rows(spark, sf_dir):
    return op.missing_row_distribution(gap_lines(spark, sf_dir))
