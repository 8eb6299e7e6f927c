"""Report queries: documents and tables written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import report
from ..session import scratch_path
from .findings import FINDINGS, NAMES, messy, _ALL
from .catalogue import tables
from .registry import query

_INFO = {
    "dataset_id": "lines", "dataset_name": "lines", "original_filename": "lines.csv", "created_at": "2024-01-01T00:00:00",
    "active_version": 2, "file_size_bytes": 1000, "user_id": "someone",
}


def _source(spark, sf_dir):
    jobs = tables(spark, sf_dir)["jobs"].where("dataset_id = '7'")
    return report.ReportSource(messy(spark, sf_dir), _INFO, jobs, order_by=list(NAMES))


_JOBS = "(SELECT count(*) FROM events WHERE event_type = 'click' AND user_id = 7)"


@query(
    "sink_report_json",
    f"""WITH {FINDINGS}, f AS ({_ALL})
SELECT 'lines' AS dataset_name, 2::BIGINT AS active_version, round(q, 4) AS quality_score, missing::BIGINT AS missing_cells, dups::BIGINT AS duplicate_rows,
  6::BIGINT AS profiled, {_JOBS}::BIGINT AS jobs, (SELECT count(*) FROM f)::BIGINT AS findings,
  (SELECT rule_id FROM f ORDER BY CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END, rule_order LIMIT 1) AS first_rule,
  (SELECT round(avg(quantity), 4) FROM messy) AS quantity_mean FROM quality""",
)
def sink_report_json(spark, sf_dir):
    """The document as JSON, read back with parts of every section."""
    path = scratch_path(spark, "report")
    report.write_document(report.report_document(_source(spark, sf_dir)), path)
    return spark.read.json(path).select(
        "dataset.dataset_name", "dataset.active_version", F.round("quality.quality_score", 4).alias("quality_score"),
        "quality.missing_cells", "quality.duplicate_rows",
        F.size("profiling.column_summary").cast("bigint").alias("profiled"),
        F.size("cleaning.cleaning_history").cast("bigint").alias("jobs"),
        F.size("insights.insights").cast("bigint").alias("findings"),
        F.col("insights.insights")[0]["rule_id"].alias("first_rule"),
        F.round(F.filter("eda.statistics.numeric", lambda x: x["column"] == "quantity")[0]["mean"], 4).alias("quantity_mean"),
    )


@query(
    "sink_report_tables",
    f"""WITH {FINDINGS}, f AS ({_ALL})
SELECT 'summary' AS "table", 6::BIGINT AS rows UNION ALL SELECT 'quality', 5 UNION ALL SELECT 'profiling', 6
UNION ALL SELECT 'cleaning', {_JOBS} UNION ALL SELECT 'eda', 3 UNION ALL SELECT 'insights', (SELECT count(*) FROM f)
UNION ALL SELECT 'kpis', 6 UNION ALL SELECT 'first_rows', (SELECT least(100, count(*)) FROM messy)""",
)
def sink_report_tables(spark, sf_dir):
    """Rows of each table of a report."""
    paths = report.write_tables(report.report_tables(_source(spark, sf_dir)), scratch_path(spark, "report"))
    out = None
    for name, path in paths.items():
        part = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
