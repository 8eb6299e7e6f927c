"""Queries over the catalogue of datasets and its dashboard roll-ups.

The catalogue tables are plain DataFrames:

* ``datasets`` (dataset_id, user_id, dataset_name, created_at, updated_at, ...)
* ``versions`` (dataset_id, version_number, file_size, status, is_current, created_at, ...)
* ``profiles`` (dataset_id, quality_score, ...), at most one per dataset
* ``jobs`` (dataset_id, rows_removed, missing_handled, ..., created_at)
* ``eda`` (dataset_id, created_at), ``insights`` (dataset_id, insights, created_at)
* ``reports`` (report_id, dataset_id, report_type, status, file_size, created_at, ...)

Tables with several rows per dataset are reduced per dataset before they are
joined, so that a dataset with very many versions does not skew the join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..session import materialize
from .pages import Order, page_of

# Lengths of the dashboard lists, defaults for missing parts.
CHART_ROWS = 10
ACTIVITY_ROWS = 10
# Rows looked at per row of the activity list.
LOOK = 1_000
RECENT_ROWS = 5
DEFAULT_QUALITY = 100.0
DEFAULT_STATUS = "UPLOADED"


def owned(df: DataFrame, user_id: str) -> DataFrame:
    """The rows of one owner; every catalogue query starts here."""
    return df.where(F.col("user_id") == user_id)


def _ordering(sort: str | None, allowed: Sequence[str], key: str) -> list[Order]:
    """Columns of ``name:asc|desc``; newest first without one, any order for unknown names."""
    down = lambda name: Order(F.col(name), descending=True, nulls_first=False)
    if not sort:
        return [down("created_at"), Order(F.col(key))]
    name, _, direction = sort.partition(":")
    chosen = [down(name) if direction == "desc" else Order(F.col(name))] if name in allowed else []
    return [*chosen, Order(F.col(key))]


def list_datasets(
    datasets: DataFrame,
    versions: DataFrame,
    user_id: str,
    search: str | None = None,
    status: str | None = None,
    before=None,
    after=None,
    sort: str | None = None,
    page: int = 1,
    size: int = 100,
) -> DataFrame:
    """One page of an owner's datasets, filtered by name, dates and current status."""
    df = owned(datasets, user_id)
    if search:
        df = df.where(F.col("dataset_name").ilike(f"%{search}%"))
    if before is not None:
        df = df.where(F.col("created_at") <= F.lit(before))
    if after is not None:
        df = df.where(F.col("created_at") >= F.lit(after))
    if status:
        now = versions.where(F.col("is_current") & (F.col("status") == status)).select("dataset_id")
        df = df.join(now, "dataset_id", "left_semi")
    order = _ordering(sort, ("dataset_name", "created_at"), "dataset_id")
    return page_of(df, order, page, size)


def list_reports(
    reports: DataFrame,
    datasets: DataFrame,
    user_id: str,
    search: str | None = None,
    status: str | None = None,
    format: str | None = None,
    dataset_id: str | None = None,
    before=None,
    after=None,
    sort: str | None = None,
    page: int = 1,
    size: int = 20,
) -> DataFrame:
    """One page of the reports on an owner's datasets."""
    mine = owned(datasets, user_id)
    if search:
        mine = mine.where(F.col("dataset_name").ilike(f"%{search}%"))
    df = reports
    if status:
        df = df.where(F.col("status") == status.upper())
    if format:
        df = df.where(F.col("report_type") == format.upper())
    if dataset_id is not None:
        df = df.where(F.col("dataset_id") == dataset_id)
    if after is not None:
        df = df.where(F.col("created_at") >= F.lit(after))
    if before is not None:
        df = df.where(F.col("created_at") <= F.lit(before))
    df = df.join(mine.select("dataset_id", "dataset_name"), "dataset_id")
    order = _ordering(sort, ("created_at", "file_size", "report_type", "status"), "report_id")
    return page_of(df, order, page, size)


def _per_dataset(versions: DataFrame) -> DataFrame:
    return versions.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("versions"),
        F.sum("file_size").alias("bytes"),
        F.max(F.when(F.col("is_current"), F.col("status"))).alias("current_status"),
    )


def kpis(datasets: DataFrame, versions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Datasets, versions, bytes, and the mean quality score (100 without profiles)."""
    df = datasets.select("dataset_id").join(_per_dataset(versions), "dataset_id", "left")
    df = df.join(profiles.select("dataset_id", "quality_score"), "dataset_id", "left")
    return df.agg(
        F.count(F.lit(1)).alias("total_datasets"),
        F.coalesce(F.sum("versions"), F.lit(0)).alias("total_versions"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_storage_bytes"),
        F.coalesce(F.avg("quality_score"), F.lit(DEFAULT_QUALITY)).alias("average_quality_score"),
    )


def status_distribution(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """Datasets per status of their current version."""
    now = _per_dataset(versions).select("dataset_id", "current_status")
    df = datasets.select("dataset_id").join(now, "dataset_id", "left")
    status = F.coalesce("current_status", F.lit(DEFAULT_STATUS)).alias("status")
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("datasets"))


def quality_ranking(datasets: DataFrame, profiles: DataFrame, k: int = CHART_ROWS) -> DataFrame:
    """The ``k`` datasets of best quality."""
    df = datasets.join(profiles.select("dataset_id", "quality_score"), "dataset_id", "left")
    score = F.coalesce("quality_score", F.lit(DEFAULT_QUALITY)).alias("quality_score")
    return df.select("dataset_id", "dataset_name", score).orderBy(F.desc("quality_score"), "dataset_name", "dataset_id").limit(k)


def storage_breakdown(datasets: DataFrame, versions: DataFrame, k: int = CHART_ROWS) -> DataFrame:
    """The ``k`` largest datasets and their share of all bytes."""
    sizes = datasets.select("dataset_id", "dataset_name").join(
        _per_dataset(versions).select("dataset_id", "bytes"), "dataset_id", "left"
    ).select("dataset_id", "dataset_name", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).scalar()
    top = sizes.orderBy(F.desc("bytes"), "dataset_name", "dataset_id").limit(k)
    return top.withColumn("percentage", stats.percent(F.col("bytes"), total))


def recent_activity(
    datasets: DataFrame,
    versions: DataFrame,
    jobs: DataFrame,
    eda: DataFrame,
    insights: DataFrame,
    k: int = ACTIVITY_ROWS,
) -> DataFrame:
    """The newest uploads, cleanings, analyses and findings in one list.

    The newest rows of each kind, whoever owns them, are looked up among the
    given datasets first.  Only a kind of which these hold fewer than ``k`` of
    the given datasets is joined as a whole.
    """
    facts = {"version": "int", "bytes": "bigint", "rows_removed": "bigint", "cells_filled": "bigint", "findings": "int"}
    kinds = (
        ("UPLOAD", versions, {"version": F.col("version_number"), "bytes": F.col("file_size")}),
        ("CLEAN", jobs, {"rows_removed": F.col("rows_removed"), "cells_filled": F.col("missing_handled")}),
        ("EDA", eda, {}),
        ("INSIGHTS", insights, {"findings": F.size("insights")}),
    )
    names = datasets.select("dataset_id", "dataset_name")
    newest = [F.desc("timestamp"), F.asc("type"), F.asc("dataset_id"), F.desc("version"), *[F.asc(n) for n in list(facts)[1:]]]
    columns = ["dataset_id", "type", "timestamp", *facts, "dataset_name"]
    rows = {
        kind: df.select(
            F.lit(kind).alias("type"), "dataset_id", F.col("created_at").alias("timestamp"),
            *[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in facts.items()],
        ).where(F.col("dataset_id").isNotNull())
        for kind, df, known in kinds
    }
    look = LOOK * k
    first = materialize(reduce(DataFrame.unionByName, [r.orderBy(*newest).limit(look) for r in rows.values()]), "newest-rows")
    # At most ``look`` rows of each kind.
    found = materialize(names.join(F.broadcast(first), "dataset_id").select(columns), "newest-owned")
    seen, held = ({r["type"]: r["count"] for r in x.groupBy("type").count().collect()} for x in (first, found))
    short = [kind for kind in rows if seen.get(kind, 0) == look and held.get(kind, 0) < k]
    whole = [rows[kind].join(names, "dataset_id").select(columns).orderBy(*newest).limit(k) for kind in short]
    return reduce(DataFrame.unionByName, whole, found.where(~F.col("type").isin(short))).orderBy(*newest).limit(k)


def recent_datasets(datasets: DataFrame, versions: DataFrame, profiles: DataFrame, k: int = RECENT_ROWS) -> DataFrame:
    """The ``k`` datasets updated last, with versions, status and quality."""
    top = datasets.orderBy(F.desc("updated_at"), "dataset_id").limit(k)
    # The list is short: find its versions first, then reduce those.
    kept = _per_dataset(versions.join(top.select("dataset_id"), "dataset_id", "left_semi"))
    df = top.join(kept, "dataset_id", "left").join(profiles.select("dataset_id", "quality_score"), "dataset_id", "left")
    return df.select(
        "dataset_id",
        "dataset_name",
        F.coalesce("current_status", F.lit(DEFAULT_STATUS)).alias("status"),
        F.coalesce("quality_score", F.lit(DEFAULT_QUALITY)).alias("quality_score"),
        F.coalesce("versions", F.lit(0)).alias("versions"),
        "updated_at",
    )


def recent_cleaning_jobs(datasets: DataFrame, jobs: DataFrame, k: int = RECENT_ROWS) -> DataFrame:
    """The ``k`` newest cleaning jobs."""
    df = jobs.join(datasets.select("dataset_id", "dataset_name"), "dataset_id")
    return df.orderBy(F.desc("created_at"), "job_id").limit(k).select(
        "job_id", "dataset_name", "duplicates_removed", "outliers_handled", "missing_handled", "execution_time_ms", "created_at"
    )


def severe_insights(datasets: DataFrame, insights: DataFrame, k: int = RECENT_ROWS) -> DataFrame:
    """The newest critical and high findings."""
    found = insights.select("dataset_id", "created_at", F.posexplode("insights").alias("place", "i"))
    found = found.where(F.col("i.severity").isin("CRITICAL", "HIGH"))
    df = found.join(datasets.select("dataset_id", "dataset_name"), "dataset_id")
    return df.orderBy(F.desc("created_at"), "dataset_id", "place").limit(k).select(
        "dataset_name", "i.rule_id", "i.severity", "i.observation", "i.recommendation", "created_at"
    )


def recent_reports(datasets: DataFrame, reports: DataFrame, k: int = RECENT_ROWS) -> DataFrame:
    """The newest reports with the names of their datasets."""
    df = reports.join(datasets.select("dataset_id", "dataset_name"), "dataset_id")
    return df.orderBy(F.desc("created_at"), "report_id").limit(k).select(
        "report_id", "dataset_name", "report_type", "status", "file_size", "created_at"
    )


def delete_datasets(catalogue: dict[str, DataFrame], ids: DataFrame, user_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove an owner's datasets from every catalogue table.

    ``ids`` has one ``dataset_id`` per request; unknown and foreign ones, and
    repetitions, count as failed.  Returns the remaining tables and the counts.
    """
    mine = owned(catalogue["datasets"], user_id).select("dataset_id")
    granted = ids.select("dataset_id").distinct().join(mine, "dataset_id", "left_semi")
    remaining = {name: df.join(granted, "dataset_id", "left_anti") for name, df in catalogue.items()}
    marked = ids.select(F.lit(1).alias("asked"), F.lit(0).alias("done")).unionByName(
        granted.select(F.lit(0).alias("asked"), F.lit(1).alias("done"))
    )
    counts = marked.agg(F.coalesce(F.sum("asked"), F.lit(0)).alias("total"), F.coalesce(F.sum("done"), F.lit(0)).alias("deleted"))
    return remaining, counts.select("deleted", (F.col("total") - F.col("deleted")).alias("failed"), "total")


def dashboard(tables: dict[str, DataFrame], user_id: str) -> dict[str, DataFrame]:
    """All dashboard tables of one owner."""
    mine = owned(tables["datasets"], user_id)
    versions, profiles = tables["versions"], tables["profiles"]
    return {
        "kpis": kpis(mine, versions, profiles),
        "status_distribution": status_distribution(mine, versions),
        "quality_scores": quality_ranking(mine, profiles),
        "storage_breakdown": storage_breakdown(mine, versions),
        "recent_activity": recent_activity(mine, versions, tables["jobs"], tables["eda"], tables["insights"]),
        "recent_datasets": recent_datasets(mine, versions, profiles),
        "recent_cleaning_jobs": recent_cleaning_jobs(mine, tables["jobs"]),
        "recent_insights": severe_insights(mine, tables["insights"]),
        "recent_reports": recent_reports(mine, tables["reports"]),
    }
