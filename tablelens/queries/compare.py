"""Version comparison queries: orders against an edited copy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as op
from ..operators.profile import missing_by_column
from .registry import query
from .tables import GAP_ORDERS, gap_orders

_EDITS = """
  SELECT o_orderkey, o_custkey, CASE WHEN status = 'F' THEN coalesce(priority, 'none') ELSE priority END AS priority,
         CASE WHEN o_orderkey >= 1000 AND priority = '1-URGENT' THEN total + 1 ELSE total END AS total, status, ordered
  FROM gap_orders WHERE NOT (priority = '2-HIGH' AND status = 'P')
"""

VERSIONS = f"""{GAP_ORDERS}, v1 AS (SELECT priority, total, status, ordered FROM gap_orders),
edited AS ({_EDITS}),
v2 AS (SELECT priority, total, status, ordered FROM edited
       UNION ALL SELECT priority, total, status, ordered FROM edited WHERE priority = '3-MEDIUM')"""


def versions(spark, sf_dir):
    old = gap_orders(spark, sf_dir)
    edited = old.where("NOT coalesce(priority = '2-HIGH' AND status = 'P', false)").select(
        "o_orderkey",
        "o_custkey",
        F.expr("CASE WHEN status = 'F' THEN coalesce(priority, 'none') ELSE priority END").alias("priority"),
        F.expr("CASE WHEN o_orderkey >= 1000 AND priority = '1-URGENT' THEN total + 1 ELSE total END").alias("total"),
        "status",
        "ordered",
    )
    names = ["priority", "total", "status", "ordered"]
    return old.select(*names), edited.select(*names).unionByName(edited.where("priority = '3-MEDIUM'").select(*names))


VERSIONS = VERSIONS.replace(
    "WHERE NOT (priority = '2-HIGH' AND status = 'P')", "WHERE NOT coalesce(priority = '2-HIGH' AND status = 'P', false)"
)


def _side(i: int) -> str:
    return f"""m{i} AS (SELECT count(*)::BIGINT AS v{i}_rows, 4::BIGINT AS v{i}_columns,
  (4 * count(*) - count(priority) - count(total) - count(status) - count(ordered))::BIGINT AS v{i}_missing,
  (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v{i})))::BIGINT AS v{i}_duplicates FROM v{i}),
q{i} AS (SELECT *, (100.0 - 50.0 * v{i}_missing / (v{i}_rows * 4) - 50.0 * v{i}_duplicates / v{i}_rows)::DOUBLE AS v{i}_quality FROM m{i})"""


@query(
    "diff_metrics",
    f"""WITH {VERSIONS}, {_side(1)}, {_side(2)}
SELECT v1_rows, v1_columns, v1_missing, v1_duplicates, round(v1_quality, 4) AS v1_quality,
       v2_rows, v2_columns, v2_missing, v2_duplicates, round(v2_quality, 4) AS v2_quality,
       v2_rows - v1_rows AS rows_difference, v2_columns - v1_columns AS columns_difference,
       v2_missing - v1_missing AS missing_difference, v2_duplicates - v1_duplicates AS duplicates_difference,
       round(v2_quality - v1_quality, 4) AS quality_difference FROM q1, q2""",
)
def diff_metrics(spark, sf_dir):
    from .tables import rounded

    return rounded(op.diff_metrics(*versions(spark, sf_dir)))


@query("diff_rows_added", f"WITH {VERSIONS} SELECT * FROM v2 EXCEPT SELECT * FROM v1")
def diff_rows_added(spark, sf_dir):
    return op.rows_added(*versions(spark, sf_dir))


@query("diff_rows_removed", f"WITH {VERSIONS} SELECT * FROM v1 EXCEPT SELECT * FROM v2")
def diff_rows_removed(spark, sf_dir):
    return op.rows_removed(*versions(spark, sf_dir))


@query(
    "diff_rows_changed",
    f"""WITH {VERSIONS}, n AS (SELECT (SELECT count(*) FROM (SELECT * FROM v2 EXCEPT SELECT * FROM v1))::BIGINT AS added_rows,
  (SELECT count(*) FROM (SELECT * FROM v1 EXCEPT SELECT * FROM v2))::BIGINT AS removed_rows)
SELECT *, greatest(0, (SELECT count(*) FROM v2) - (SELECT count(*) FROM v1) - added_rows + removed_rows)::BIGINT AS changed_rows FROM n""",
)
def diff_rows_changed(spark, sf_dir):
    return op.row_changes(*versions(spark, sf_dir))


def _reshaped(spark, sf_dir):
    v1, v2 = versions(spark, sf_dir)
    v2 = v2.select(
        F.col("priority").alias("urgency"), F.col("total").cast("string").alias("total"), "status",
        F.to_timestamp("ordered").alias("ordered"), F.year(F.to_timestamp("ordered")).alias("year"),
    )
    return v1, v2


@query(
    "diff_columns",
    f"""WITH {VERSIONS}
SELECT 'urgency' AS "column", 'added' AS change, (count(*) - count(priority))::BIGINT AS missing_count FROM v2
UNION ALL SELECT 'year', 'added', count(*) - count(ordered) FROM v2
UNION ALL SELECT 'priority', 'removed', count(*) - count(priority) FROM v1""",
)
def diff_columns(spark, sf_dir):
    """Columns of one version only, with their missing cells there."""
    v1, v2 = _reshaped(spark, sf_dir)
    gaps = missing_by_column(v2).withColumn("change", F.lit("added")).unionByName(
        missing_by_column(v1).withColumn("change", F.lit("removed"))
    )
    return op.diff_columns(v1, v2).join(gaps, ["column", "change"]).select("column", "change", "missing_count")


@query(
    "diff_types",
    f"""WITH {VERSIONS}
SELECT 'total' AS "column", 'double' AS v1_type, 'string' AS v2_type, (count(*) - count(total))::BIGINT AS missing_count FROM v2
UNION ALL SELECT 'ordered', 'string', 'timestamp', count(*) - count(ordered) FROM v2""",
)
def diff_types(spark, sf_dir):
    """Type changes, with the missing cells that the new type has."""
    v1, v2 = _reshaped(spark, sf_dir)
    gaps = missing_by_column(v2).select("column", "missing_count")
    return op.diff_types(v1, v2).join(gaps, "column")
