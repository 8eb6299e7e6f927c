"""Source and sink queries: tables written by Spark and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.frequency import literal_rows
from ..session import scratch_path
from ..sources import delimited, versions
from .registry import query
from .tables import GAP_ORDERS, gap_orders, read


def _csv(spark, sf_dir, sep=";"):
    """orders with gaps as delimited text, 'N/A' standing for missing cells."""
    path = scratch_path(spark, "csv")
    gap_orders(spark, sf_dir).write.csv(path, header=True, sep=sep, nullValue="N/A")
    return path


@query("src_csv_sniff", f"WITH {GAP_ORDERS} SELECT * FROM gap_orders")
def src_csv_sniff(spark, sf_dir):
    """Semicolon-separated text read without telling the delimiter."""
    return delimited.read_csv(spark, _csv(spark, sf_dir))


@query(
    "src_header_validate",
    f"""WITH {GAP_ORDERS}, n AS (SELECT count(*)::BIGINT AS rows FROM gap_orders)
SELECT 'good' AS file, NULL::VARCHAR AS problem, rows FROM n
UNION ALL SELECT 'repeated', 'headers occur more than once: status', 0
UNION ALL SELECT 'blank', 'a column has no header', 0""",
)
def src_header_validate(spark, sf_dir):
    """Header checks of three files of the same rows."""
    lines = gap_orders(spark, sf_dir).select(F.concat_ws(",", "o_orderkey", "status").alias("line"))
    first_of_file = F.monotonically_increasing_id() % (1 << 33) == 0
    rows = []
    for name, header in (("good", "o_orderkey,status"), ("repeated", "status, status"), ("blank", "o_orderkey,")):
        path = scratch_path(spark, "headers")
        headed = F.when(first_of_file, F.concat(F.lit(header + "\n"), "line")).otherwise(F.col("line"))
        lines.select(headed.alias("value")).write.text(path)
        try:
            count, problem = delimited.read_csv(spark, path, infer=False).count(), None
        except ValueError as e:
            count, problem = 0, str(e)
        rows.append({"file": name, "problem": problem, "rows": count})
    return literal_rows(spark, rows, "file string, problem string, rows bigint")


@query(
    "src_metadata",
    """SELECT count(*)::BIGINT AS rows_count, 4::BIGINT AS columns_count,
       sum(16 + coalesce(octet_length(encode(role)), 0) + coalesce(octet_length(encode(text)), 0))::BIGINT AS memory_bytes,
       'bigint,bigint,string,string' AS types FROM conversations""",
)
def src_metadata(spark, sf_dir):
    out = delimited.table_metadata(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return out.withColumn("types", F.array_join(F.map_values("column_types"), ",")).drop("column_types")


@query(
    "sink_version",
    f"""WITH {GAP_ORDERS}, first AS (SELECT count(*)::BIGINT AS n, sum(8 + 8 + coalesce(octet_length(encode(priority)), 0) + 8 + octet_length(encode(status)) + octet_length(encode(ordered)))::BIGINT AS b FROM gap_orders),
second AS (SELECT count(*)::BIGINT AS n, sum(8 + 8 + octet_length(encode(priority)) + 8 + octet_length(encode(status)) + octet_length(encode(ordered)))::BIGINT AS b FROM gap_orders WHERE priority IS NOT NULL)
SELECT 'orders' AS dataset_id, 1::INTEGER AS version_number, n AS rows_count, 6::BIGINT AS columns_count, b AS file_size, 'UPLOADED' AS status, false AS is_current FROM first
UNION ALL SELECT 'orders', 2, n, 6, b, 'CLEANED', true FROM second""",
)
def sink_version(spark, sf_dir):
    """Two versions of a dataset and the catalogue rows they leave."""
    root = scratch_path(spark, "versions")
    df = gap_orders(spark, sf_dir)
    versions.write_version(df, root, "orders", "UPLOADED")
    versions.write_version(df.where("priority IS NOT NULL"), root, "orders", "CLEANED")
    return versions.read_catalogue(spark, root).select(
        "dataset_id", "version_number", "rows_count", "columns_count", "file_size", "status", "is_current"
    )


@query("src_current_version", f"WITH {GAP_ORDERS} SELECT * FROM gap_orders WHERE priority IS NOT NULL")
def src_current_version(spark, sf_dir):
    """The current version of a dataset that has two."""
    root = scratch_path(spark, "versions")
    df = gap_orders(spark, sf_dir)
    versions.write_version(df, root, "orders", "UPLOADED")
    versions.write_version(df.where("priority IS NOT NULL"), root, "orders", "CLEANED")
    return versions.read_version(spark, root, "orders")


@query(
    "fingerprint",
    f"""WITH {GAP_ORDERS}, texts AS (
  SELECT md5(concat_ws('|', length(o_orderkey::VARCHAR) || ':' || o_orderkey, length(o_custkey::VARCHAR) || ':' || o_custkey,
    coalesce(length(priority) || ':' || priority, '-'), coalesce(length(total::VARCHAR) || ':' || total, '-'), length(status) || ':' || status, length(ordered) || ':' || ordered)) AS d FROM gap_orders)
SELECT count(*)::BIGINT AS rows, sum(('0x' || substr(d, 1, 15))::BIGINT)::VARCHAR AS digest_sum,
  md5('10:o_orderkey:bigint|9:o_custkey:bigint|8:priority:string|5:total:double|6:status:string|7:ordered:string') AS schema_digest
FROM texts""",
)
def fingerprint(spark, sf_dir):
    return versions.fingerprint(gap_orders(spark, sf_dir))


@query(
    "fingerprint_documents",
    """WITH texts AS (SELECT md5(length(doc_id::VARCHAR) || ':' || doc_id || '|' || length(text) || ':' ||
    CASE WHEN length(text) > 64 THEN '#' || sha256(text) ELSE text END) AS d FROM documents)
SELECT count(*)::BIGINT AS rows, sum(('0x' || substr(d, 1, 15))::BIGINT)::VARCHAR AS digest_sum,
  md5('6:doc_id:bigint|4:text:string') AS schema_digest FROM texts""",
)
def fingerprint_documents(spark, sf_dir):
    """Fingerprint over whole long texts."""
    return versions.fingerprint(read(spark, sf_dir, "documents").select("doc_id", "text"))
