"""Catalogue queries.

The test tables play a catalogue: a market segment is an owner, orders are
datasets, lines are versions, and the events are jobs, analyses, findings and
reports.
"""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import catalogue as op
from ..operators import diff
from ..plans import cleaning_run
from ..plans.workspace import Workspace
from ..session import scratch_path
from ..sources import files, versions
from .registry import query
from .tables import read, rounded

OWNER = "MACHINERY"

_STATUS = "CASE WHEN l_returnflag = 'R' THEN 'PROFILED' WHEN l_returnflag = 'A' THEN 'CLEANED' WHEN l_linestatus = 'O' THEN 'ANALYZED' ELSE 'UPLOADED' END"


def tables(spark, sf_dir):
    t = {n: read(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "events")}
    datasets = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("dataset_id"),
        F.col("c_mktsegment").alias("user_id"),
        F.concat(F.lit("set "), "o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")).alias("dataset_name"),
        F.col("o_orderdate").alias("created_at"),
        F.expr("timestampadd(DAY, o_orderkey % 30, o_orderdate)").alias("updated_at"),
    )
    versions = t["lineitem"].groupBy(
        F.col("l_orderkey").cast("string").alias("dataset_id"), F.col("l_linenumber").alias("version_number")
    ).agg(
        F.sum(F.floor("l_extendedprice")).alias("file_size"),
        F.max(F.expr(_STATUS)).alias("status"),
        F.max("l_shipdate").alias("created_at"),
    )
    newest = t["lineitem"].groupBy(F.col("l_orderkey").cast("string").alias("dataset_id")).agg(
        F.max("l_linenumber").alias("newest")
    )
    uploads = versions  # for queries that need not tell which is the newest
    versions = versions.join(newest, "dataset_id").select(
        *versions.columns, (F.col("version_number") == F.col("newest")).alias("is_current")
    )
    profiles = t["orders"].where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").cast("string").alias("dataset_id"),
        (F.floor("o_totalprice") % 101).cast("double").alias("quality_score"),
    )
    jobs = t["events"].where("event_type = 'click'").selectExpr(
        "event_id AS job_id", "cast(user_id AS string) AS dataset_id", "cast(user_id AS string) AS target_version_id",
        "floor(value) AS rows_removed", "floor(value) AS duplicates_removed", "event_id % 3 AS outliers_handled",
        "event_id % 7 AS missing_handled", "event_id % 1000 AS execution_time_ms", "ts AS created_at",
        "array(named_struct('type', 'drop_duplicates', 'column', string(null), 'affected', floor(value)),"
        " named_struct('type', 'fill_missing', 'column', 'value', 'affected', event_id % 7),"
        " named_struct('type', 'remove_outliers', 'column', 'value', 'affected', event_id % 3)) AS cleaning_summary",
    )
    eda = t["events"].where("event_type = 'view'").selectExpr("cast(user_id AS string) AS dataset_id", "ts AS created_at")
    insights = t["events"].where("event_type = 'error'").selectExpr(
        "cast(user_id AS string) AS dataset_id", "ts AS created_at",
        "array(named_struct('rule_id', 'QUAL_001', 'category', concat('group ', user_id % 40), 'severity',"
        " CASE WHEN value > 100 THEN 'CRITICAL' WHEN value > 50 THEN 'HIGH' ELSE 'MEDIUM' END,"
        " 'observation', concat('value ', floor(value)), 'recommendation', 'look'),"
        " named_struct('rule_id', 'CARD_005', 'category', 'Statistics', 'severity', 'LOW',"
        " 'observation', 'labels', 'recommendation', 'none')) AS insights",
    )
    reports = t["events"].where("event_type IN ('purchase', 'signup')").selectExpr(
        "event_id AS report_id", "cast(user_id AS string) AS dataset_id",
        "CASE event_id % 3 WHEN 0 THEN 'PDF' WHEN 1 THEN 'HTML' ELSE 'JSON' END AS report_type",
        "CASE WHEN value < 5 THEN 'FAILED' ELSE 'COMPLETED' END AS status",
        "floor(value * 100) AS file_size", "ts AS created_at",
    )
    return {"datasets": datasets, "versions": versions, "uploads": uploads, "profiles": profiles, "jobs": jobs, "eda": eda,
            "insights": insights, "reports": reports}


def mine(spark, sf_dir):
    t = tables(spark, sf_dir)
    return op.owned(t["datasets"], OWNER), t


CATALOGUE = f"""
datasets AS (SELECT o_orderkey::VARCHAR AS dataset_id, c_mktsegment AS user_id, 'set ' || o_orderpriority || ' ' || o_orderkey AS dataset_name,
    o_orderdate AS created_at, o_orderdate + to_days((o_orderkey % 30)::INTEGER) AS updated_at
  FROM orders JOIN customer ON o_custkey = c_custkey),
owned AS (SELECT * FROM datasets WHERE user_id = '{OWNER}'),
versions AS (SELECT *, version_number = max(version_number) OVER (PARTITION BY dataset_id) AS is_current FROM (
  SELECT l_orderkey::VARCHAR AS dataset_id, l_linenumber AS version_number, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS file_size,
    max({_STATUS}) AS status, max(l_shipdate) AS created_at FROM lineitem GROUP BY 1, 2)),
profiles AS (SELECT o_orderkey::VARCHAR AS dataset_id, (floor(o_totalprice)::BIGINT % 101)::DOUBLE AS quality_score FROM orders WHERE o_orderstatus <> 'P'),
jobs AS (SELECT event_id AS job_id, user_id::VARCHAR AS dataset_id, floor(value)::BIGINT AS rows_removed, floor(value)::BIGINT AS duplicates_removed,
    event_id % 3 AS outliers_handled, event_id % 7 AS missing_handled, event_id % 1000 AS execution_time_ms, ts AS created_at FROM events WHERE event_type = 'click'),
eda AS (SELECT user_id::VARCHAR AS dataset_id, ts AS created_at FROM events WHERE event_type = 'view'),
insights AS (SELECT user_id::VARCHAR AS dataset_id, ts AS created_at, user_id % 40 AS grp,
    CASE WHEN value > 100 THEN 'CRITICAL' WHEN value > 50 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'value ' || floor(value)::BIGINT AS observation
  FROM events WHERE event_type = 'error'),
reports AS (SELECT event_id AS report_id, user_id::VARCHAR AS dataset_id, CASE event_id % 3 WHEN 0 THEN 'PDF' WHEN 1 THEN 'HTML' ELSE 'JSON' END AS report_type,
    CASE WHEN value < 5 THEN 'FAILED' ELSE 'COMPLETED' END AS status, floor(value * 100)::BIGINT AS file_size, ts AS created_at
  FROM events WHERE event_type IN ('purchase', 'signup'))
"""

_STAMP = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}"


def _stamped(df, *names):
    return df.select(
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if c in names else F.col(c) for c in df.columns]
    )


@query("cat_owner_isolation", f"WITH {CATALOGUE} SELECT dataset_id, user_id, dataset_name FROM owned")
def cat_owner_isolation(spark, sf_dir):
    return mine(spark, sf_dir)[0].select("dataset_id", "user_id", "dataset_name")


@query(
    "cat_list_datasets",
    f"""WITH {CATALOGUE}
SELECT d.dataset_id, dataset_name, {_STAMP.format(c='created_at').replace('strftime(created_at', 'strftime(d.created_at')}
FROM owned d WHERE dataset_name ILIKE '%urgent%' AND d.created_at >= TIMESTAMP '1994-01-01' AND d.created_at <= TIMESTAMP '1999-12-31'
  AND EXISTS (SELECT 1 FROM versions v WHERE v.dataset_id = d.dataset_id AND is_current AND status = 'CLEANED')
ORDER BY dataset_name DESC, d.dataset_id LIMIT 20 OFFSET 20""",
)
def cat_list_datasets(spark, sf_dir):
    t = tables(spark, sf_dir)
    page = op.list_datasets(
        t["datasets"], t["versions"], OWNER, search="URGENT", status="CLEANED", after=datetime.datetime(1994, 1, 1),
        before=datetime.datetime(1999, 12, 31), sort="dataset_name:desc", page=2, size=20,
    )
    return _stamped(page.select("dataset_id", "dataset_name", "created_at"), "created_at")


@query(
    "cat_list_reports",
    f"""WITH {CATALOGUE}
SELECT report_id, r.dataset_id, report_type, status, file_size, dataset_name FROM reports r JOIN owned d USING (dataset_id)
WHERE dataset_name ILIKE '%low%' AND status = 'COMPLETED' AND report_type = 'PDF' AND r.created_at >= TIMESTAMP '2024-01-02'
ORDER BY file_size DESC, report_id LIMIT 20""",
)
def cat_list_reports(spark, sf_dir):
    t = tables(spark, sf_dir)
    page = op.list_reports(
        t["reports"], t["datasets"], OWNER, search="low", status="completed", format="pdf",
        after=datetime.datetime(2024, 1, 2), sort="file_size:desc",
    )
    return page.select("report_id", "dataset_id", "report_type", "status", "file_size", "dataset_name")


@query(
    "dash_kpis",
    f"""WITH {CATALOGUE}, v AS (SELECT dataset_id, count(*) AS n, sum(file_size) AS b FROM versions GROUP BY 1)
SELECT count(*)::BIGINT AS total_datasets, sum(n)::BIGINT AS total_versions, sum(b)::BIGINT AS total_storage_bytes,
  round(coalesce(avg(quality_score), 100.0), 4) AS average_quality_score
FROM owned LEFT JOIN v USING (dataset_id) LEFT JOIN profiles USING (dataset_id)""",
)
def dash_kpis(spark, sf_dir):
    d, t = mine(spark, sf_dir)
    return rounded(op.kpis(d, t["versions"], t["profiles"]))


@query(
    "dash_status",
    f"""WITH {CATALOGUE} SELECT coalesce(v.status, 'UPLOADED') AS status, count(*)::BIGINT AS datasets
FROM owned d LEFT JOIN versions v ON v.dataset_id = d.dataset_id AND v.is_current GROUP BY 1""",
)
def dash_status(spark, sf_dir):
    d, t = mine(spark, sf_dir)
    return op.status_distribution(d, t["versions"])


@query(
    "dash_quality",
    f"""WITH {CATALOGUE} SELECT dataset_id, dataset_name, coalesce(quality_score, 100.0)::DOUBLE AS quality_score
FROM owned LEFT JOIN profiles USING (dataset_id) ORDER BY 3 DESC, 2, 1 LIMIT 10""",
)
def dash_quality(spark, sf_dir):
    d, t = mine(spark, sf_dir)
    return op.quality_ranking(d, t["profiles"])


@query(
    "dash_storage",
    f"""WITH {CATALOGUE}, s AS (SELECT d.dataset_id, dataset_name, coalesce(sum(file_size), 0)::BIGINT AS bytes
  FROM owned d LEFT JOIN versions v USING (dataset_id) GROUP BY 1, 2)
SELECT *, round(bytes * 100.0::DOUBLE / (SELECT sum(bytes) FROM s), 4) AS percentage FROM s ORDER BY bytes DESC, dataset_name, dataset_id LIMIT 10""",
)
def dash_storage(spark, sf_dir):
    d, t = mine(spark, sf_dir)
    return rounded(op.storage_breakdown(d, t["versions"]))


@query(
    "dash_activity",
    f"""WITH {CATALOGUE}, a AS (
  SELECT 'UPLOAD' AS type, dataset_id, version_number::INTEGER AS version, file_size::BIGINT AS bytes, NULL::BIGINT AS rows_removed,
         NULL::BIGINT AS cells_filled, NULL::INTEGER AS findings, created_at AS "timestamp" FROM versions
  UNION ALL SELECT 'CLEAN', dataset_id, NULL, NULL, rows_removed, missing_handled, NULL, created_at FROM jobs
  UNION ALL SELECT 'EDA', dataset_id, NULL, NULL, NULL, NULL, NULL, created_at FROM eda
  UNION ALL SELECT 'INSIGHTS', dataset_id, NULL, NULL, NULL, NULL, 2, created_at FROM insights)
SELECT type, dataset_id, version, bytes, rows_removed, cells_filled, findings, {_STAMP.format(c='"timestamp"')}, dataset_name
FROM a JOIN (SELECT dataset_id, dataset_name FROM owned) USING (dataset_id)
ORDER BY a."timestamp" DESC, type, dataset_id, version DESC NULLS LAST, bytes, rows_removed, cells_filled, findings LIMIT 10""",
)
def dash_activity(spark, sf_dir):
    d, t = mine(spark, sf_dir)
    return _stamped(op.recent_activity(d, t["uploads"], t["jobs"], t["eda"], t["insights"]), "timestamp")


@query(
    "dash_recent_datasets",
    f"""WITH {CATALOGUE}, v AS (SELECT dataset_id, count(*) AS n, max(status) FILTER (is_current) AS s FROM versions GROUP BY 1)
SELECT dataset_id, dataset_name, coalesce(s, 'UPLOADED') AS status, coalesce(quality_score, 100.0)::DOUBLE AS quality_score,
  coalesce(n, 0)::BIGINT AS versions, {_STAMP.format(c='updated_at')}
FROM owned o LEFT JOIN v USING (dataset_id) LEFT JOIN profiles USING (dataset_id) ORDER BY o.updated_at DESC, dataset_id LIMIT 5""",
)
def dash_recent_datasets(spark, sf_dir):
    d, t = mine(spark, sf_dir)
    return _stamped(op.recent_datasets(d, t["versions"], t["profiles"]), "updated_at")


@query(
    "dash_cleaning_jobs",
    f"""WITH {CATALOGUE} SELECT job_id, dataset_name, duplicates_removed, outliers_handled, missing_handled, execution_time_ms,
  strftime(j.created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at
FROM jobs j JOIN owned USING (dataset_id) ORDER BY j.created_at DESC, job_id LIMIT 5""",
)
def dash_cleaning_jobs(spark, sf_dir):
    d, t = mine(spark, sf_dir)
    return _stamped(op.recent_cleaning_jobs(d, t["jobs"]), "created_at")


@query(
    "dash_severe_insights",
    f"""WITH {CATALOGUE} SELECT dataset_name, 'QUAL_001' AS rule_id, severity, observation, 'look' AS recommendation,
  strftime(i.created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at
FROM insights i JOIN owned USING (dataset_id) WHERE severity IN ('CRITICAL', 'HIGH') ORDER BY i.created_at DESC, dataset_id LIMIT 5""",
)
def dash_severe_insights(spark, sf_dir):
    d, t = mine(spark, sf_dir)
    return _stamped(op.severe_insights(d, t["insights"]), "created_at")


@query(
    "dash_recent_reports",
    f"""WITH {CATALOGUE} SELECT report_id, dataset_name, report_type, status, file_size,
  strftime(r.created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at
FROM reports r JOIN owned USING (dataset_id) ORDER BY r.created_at DESC, report_id LIMIT 5""",
)
def dash_recent_reports(spark, sf_dir):
    d, t = mine(spark, sf_dir)
    return _stamped(op.recent_reports(d, t["reports"]), "created_at")


_ASKED = "SELECT user_id::VARCHAR AS dataset_id FROM events WHERE event_type = 'signup'"


@query(
    "cat_bulk_delete",
    f"""WITH {CATALOGUE}, asked AS ({_ASKED}), granted AS (SELECT DISTINCT dataset_id FROM asked JOIN owned USING (dataset_id))
SELECT (SELECT count(*) FROM granted)::BIGINT AS deleted, ((SELECT count(*) FROM asked) - (SELECT count(*) FROM granted))::BIGINT AS failed,
  (SELECT count(*) FROM asked)::BIGINT AS total,
  (SELECT count(*) FROM datasets WHERE dataset_id NOT IN (SELECT dataset_id FROM granted))::BIGINT AS datasets_left,
  (SELECT count(*) FROM versions WHERE dataset_id NOT IN (SELECT dataset_id FROM granted))::BIGINT AS versions_left""",
)
def cat_bulk_delete(spark, sf_dir):
    """Counts of a bulk delete and the rows that remain."""
    t = tables(spark, sf_dir)
    asked = read(spark, sf_dir, "events").where("event_type = 'signup'").selectExpr("cast(user_id AS string) AS dataset_id")
    left, counts = op.delete_datasets({n: t[n] for n in ("datasets", "versions")}, asked, OWNER)
    for n, df in left.items():
        counts = counts.withColumn(f"{n}_left", df.agg(F.count(F.lit(1))).scalar())
    return counts


@query(
    "cat_job_rollup",
    f"""WITH {CATALOGUE} SELECT dataset_id, sum(rows_removed + outliers_handled)::BIGINT AS rows_removed, sum(rows_removed)::BIGINT AS duplicates_removed,
  sum(missing_handled)::BIGINT AS missing_handled, sum(outliers_handled)::BIGINT AS outliers_handled FROM jobs GROUP BY 1""",
)
def cat_job_rollup(spark, sf_dir):
    """Totals per dataset over the step lists of all its cleaning jobs."""
    steps = tables(spark, sf_dir)["jobs"].select("dataset_id", F.explode("cleaning_summary").alias("s"))
    return cleaning_run.job_rollup(steps.select("dataset_id", "s.*"), by=["dataset_id"])


@query(
    "diff_lineage",
    f"""WITH {CATALOGUE}, j AS (SELECT * FROM jobs WHERE dataset_id = '7')
SELECT job_id, 0::INTEGER AS step, 'drop_duplicates' AS type, NULL::VARCHAR AS "column", rows_removed AS affected FROM j
UNION ALL SELECT job_id, 1, 'fill_missing', 'value', missing_handled FROM j
UNION ALL SELECT job_id, 2, 'remove_outliers', 'value', outliers_handled FROM j""",
)
def diff_lineage(spark, sf_dir):
    return diff.lineage(tables(spark, sf_dir)["jobs"], "7")


@query(
    "diff_insights",
    f"""WITH {CATALOGUE}, a AS (SELECT DISTINCT 'group ' || grp AS category FROM insights WHERE created_at < TIMESTAMP '2024-01-02'
    UNION SELECT 'Statistics' FROM insights WHERE created_at < TIMESTAMP '2024-01-02'),
b AS (SELECT DISTINCT 'group ' || grp AS category FROM insights WHERE created_at >= TIMESTAMP '2024-01-30 12:00:00'
    UNION SELECT 'Statistics' FROM insights WHERE created_at >= TIMESTAMP '2024-01-30 12:00:00')
SELECT category, 'new' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT category, 'resolved' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def diff_insights(spark, sf_dir):
    found = tables(spark, sf_dir)["insights"]
    old = found.where("created_at < timestamp '2024-01-02'")
    new = found.where("created_at >= timestamp '2024-01-30 12:00:00'")
    return diff.diff_insights(old, new)


_PARTS = """p AS (SELECT p_size, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END AS price FROM part),
twice AS (SELECT * FROM p UNION ALL SELECT * FROM p), once AS (SELECT DISTINCT p_size, price FROM p)"""


@query(
    "dash_stored_work",
    f"""WITH {_PARTS}
SELECT 3::BIGINT AS total_versions, 2::BIGINT AS total_datasets, 1::BIGINT AS cleaned, 1::BIGINT AS profiled, 1::BIGINT AS jobs,
  (SELECT 2 * (SELECT count(*) FROM p) - (SELECT count(*) FROM once))::BIGINT AS duplicates_removed,
  (SELECT count(*) FROM once WHERE price IS NULL)::BIGINT AS missing_handled, true AS timed, 100.0::DOUBLE AS best_quality""",
)
def dash_stored_work(spark, sf_dir):
    """Two datasets stored; one is cleaned, profiled and explored, and the dashboard tells so from the stored tables."""
    space = Workspace(spark, scratch_path(spark, "workspace"), OWNER)
    parts = read(spark, sf_dir, "part").selectExpr("p_size", "CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END AS price")
    first, second = space.add(parts.unionAll(parts), "parts twice"), space.add(parts.distinct(), "parts once")
    space.clean(first, [{"type": "drop_duplicates"}, {"type": "fill_missing", "column": "price", "strategy": "mean"}])
    space.profile(first)
    space.profile(second)
    space.explore(second)
    board = space.dashboard()
    status = {r["status"]: r["datasets"] for r in board["status_distribution"].collect()}
    kpis, jobs = board["kpis"], board["recent_cleaning_jobs"]
    best = board["quality_scores"].agg(F.round(F.max("quality_score"), 4)).scalar()
    return kpis.select(
        "total_versions", "total_datasets",
        F.lit(status.get("ANALYZED", 0)).cast("bigint").alias("cleaned"), F.lit(status.get("PROFILED", 0)).cast("bigint").alias("profiled"),
        jobs.agg(F.count(F.lit(1))).scalar().alias("jobs"), jobs.agg(F.sum("duplicates_removed")).scalar().alias("duplicates_removed"),
        jobs.agg(F.sum("missing_handled")).scalar().alias("missing_handled"),
        jobs.agg(F.bool_and(F.col("execution_time_ms") > 0)).scalar().alias("timed"), best.alias("best_quality"),
    )


@query(
    "cat_delete_stored",
    """SELECT 1::BIGINT AS deleted, 2::BIGINT AS failed, 3::BIGINT AS total, 1::BIGINT AS datasets_left, (SELECT count(*) FROM part)::BIGINT AS rows_left,
  0::BIGINT AS folders_left""",
)
def cat_delete_stored(spark, sf_dir):
    """A dataset is deleted from storage, a foreign and an unknown one are not; its folders are gone."""
    root = scratch_path(spark, "workspace")
    mine, other = Workspace(spark, root, OWNER), Workspace(spark, root, "somebody else")
    parts = read(spark, sf_dir, "part")
    gone, kept, foreign = mine.add(parts, "a"), mine.add(parts, "b"), other.add(parts, "c")
    mine.profile(gone)
    counts = mine.delete([gone, foreign, "no such dataset"])
    kinds = [*[f"catalogue/{t}" for t in files.children(spark, f"{root}/catalogue")], "claims", "data"]
    left = sum(files.exists(spark, f"{root}/{kind}/dataset_id={gone}") for kind in kinds)
    rows = versions.read_version(spark, root, kept).agg(F.count(F.lit(1)).alias("rows_left"))
    remaining = mine.dashboard()["kpis"].select("total_datasets").scalar()
    return rows.select(
        *[F.lit(v).cast("bigint").alias(k) for k, v in counts.items()], remaining.alias("datasets_left"), "rows_left", F.lit(left).cast("bigint").alias("folders_left")
    )
