"""Datasets of an owner with everything computed about them, stored and read back.

Each step of the work appends what it found to a table below ``root`` and moves
the version's status on; the dashboard reads these tables.  Results of a
version replace earlier ones of its dataset by being newer.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import TableError
from ..operators import catalogue, profile
from ..sources import versions
from . import cleaning_run, report
from .findings import Statistics, rank

_SCHEMAS = {
    "datasets": "dataset_id string, user_id string, dataset_name string, created_at timestamp",
    "profiles": "dataset_id string, version_number int, quality_score double, rows bigint, missing_cells bigint, duplicate_rows bigint, created_at timestamp",
    "column_profiles": "dataset_id string, version_number int, column string, dtype string, missing_count bigint, unique_count bigint, created_at timestamp",
    "jobs": "dataset_id string, job_id string, source_version int, version_number int, rows_removed bigint, duplicates_removed bigint, missing_handled bigint, "
    "outliers_handled bigint, execution_time_ms bigint, created_at timestamp",
    "eda": "dataset_id string, version_number int, numeric_columns bigint, strong_pairs bigint, created_at timestamp",
    "insights": "dataset_id string, version_number int, insights array<struct<rule_id:string,severity:string,observation:string,recommendation:string>>, created_at timestamp",
    "reports": "dataset_id string, report_id string, report_type string, status string, file_size bigint, storage_path string, created_at timestamp",
}


class Workspace:
    """An owner's datasets below ``root``."""

    def __init__(self, spark: SparkSession, root: str, user_id: str) -> None:
        self.spark, self.root, self.user_id = spark, root.rstrip("/"), user_id

    def _keep(self, table: str, dataset_id: str, rows: DataFrame) -> None:
        names = [f.split()[0] for f in _SCHEMAS[table].replace("array<struct<", "array ").split(", ")]
        known = {"dataset_id": F.lit(dataset_id), "created_at": F.current_timestamp()}
        versions.append(rows.select(*[known[n].alias(n) if n in known else F.col(n) for n in names]), self.root, table, dataset_id)

    def table(self, name: str) -> DataFrame:
        """All rows of a result table of the owner."""
        found = versions.stored(self.spark, self.root, name, _SCHEMAS[name])
        return found if name == "datasets" else found.join(self._mine(), "dataset_id", "left_semi")

    def _mine(self) -> DataFrame:
        datasets = versions.stored(self.spark, self.root, "datasets", _SCHEMAS["datasets"])
        return catalogue.owned(datasets, self.user_id).select("dataset_id")

    def _owned(self, dataset_id: str) -> str:
        if self._mine().where(F.col("dataset_id") == dataset_id).isEmpty():
            raise TableError(f"no dataset {dataset_id}")
        return dataset_id

    def _current(self, dataset_id: str) -> tuple[int, DataFrame]:
        number = versions.current_version(self.spark, self.root, self._owned(dataset_id))
        return number, versions.read_version(self.spark, self.root, dataset_id, number)

    def _moved(self, dataset_id: str, number: int, status: str) -> None:
        versions.set_status(self.spark, self.root, dataset_id, number, status)

    def _named(self, name: str) -> str:
        dataset_id = uuid.uuid4().hex
        self._keep("datasets", dataset_id, self.spark.range(1).select(F.lit(self.user_id).alias("user_id"), F.lit(name).alias("dataset_name")))
        return dataset_id

    def add(self, df: DataFrame, name: str) -> str:
        """A new dataset from a table; returns its id."""
        dataset_id = self._named(name)
        versions.write_version(df, self.root, dataset_id, "UPLOADED")
        return dataset_id

    def add_csv(self, path: str, name: str) -> str:
        """A new dataset from a CSV file; a file that fails a check leaves nothing behind."""
        dataset_id = self._named(name)
        try:
            versions.import_csv(self.spark, path, self.root, dataset_id)
        except BaseException:
            versions.delete_dataset(self.spark, self.root, dataset_id)
            raise
        return dataset_id

    def profile(self, dataset_id: str) -> DataFrame:
        """Profile the current version."""
        number, df = self._current(dataset_id)
        columns = profile.column_profile(df)
        self._keep("column_profiles", dataset_id, columns.withColumn("version_number", F.lit(number)))
        self._keep("profiles", dataset_id, profile.quality_score(df).withColumn("version_number", F.lit(number)))
        self._moved(dataset_id, number, "PROFILED")
        return columns

    def clean(self, dataset_id: str, steps: Sequence[dict]) -> int:
        """Clean the current version into the next one, with a job that tells what was done and how long it took."""
        number, df = self._current(dataset_id)
        start = time.monotonic()
        cleaned, summary = cleaning_run.clean(df, steps)
        after = versions.write_version(cleaned, self.root, dataset_id, "CLEANED")
        took = int((time.monotonic() - start) * 1000)
        job = cleaning_run.job_rollup(summary).select(
            "*", F.lit(uuid.uuid4().hex).alias("job_id"), F.lit(number).alias("source_version"), F.lit(after).alias("version_number"),
            F.lit(took).cast("bigint").alias("execution_time_ms"),
        )
        self._keep("jobs", dataset_id, job)
        return after

    def explore(self, dataset_id: str) -> Statistics:
        """Statistics and findings of the current version."""
        number, df = self._current(dataset_id)
        stats = Statistics(df)
        counts = stats.numeric.agg(F.count(F.lit(1)).alias("numeric_columns"), F.lit(number).alias("version_number"))
        self._keep("eda", dataset_id, counts.withColumn("strong_pairs", stats.pairs.agg(F.count(F.lit(1))).scalar()))
        # A row per rule at most.
        found = rank(stats.findings()).select("rule_id", "severity", "observation", "recommendation", "rule_order")
        fields = F.struct("rule_order", F.struct("rule_id", "severity", "observation", "recommendation").alias("item"))
        listed = found.agg(F.transform(F.sort_array(F.collect_list(fields)), lambda x: x["item"]).alias("insights"))
        self._keep("insights", dataset_id, listed.withColumn("version_number", F.lit(number)))
        self._moved(dataset_id, number, "ANALYZED")
        return stats

    def report(self, dataset_id: str, stats: Statistics | None = None, order_by: Sequence[str] = ()) -> str:
        """Write the document on the current version; returns its path."""
        number, df = self._current(dataset_id)
        name = self.table("datasets").where(F.col("dataset_id") == dataset_id).first()["dataset_name"]
        info = {"dataset_id": dataset_id, "dataset_name": name, "active_version": number, "user_id": self.user_id}
        jobs = self.table("jobs").where(F.col("dataset_id") == dataset_id)
        report_id = uuid.uuid4().hex
        path = f"{self.root}/reports/{report_id}"
        report.write_document(report.report_document(report.ReportSource(df, info, jobs, stats=stats, order_by=order_by)), path)
        size = self.spark.read.text(path).agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("file_size"))
        kept = {"report_id": report_id, "report_type": "JSON", "status": "COMPLETED", "storage_path": path}
        self._keep("reports", dataset_id, size.withColumns({k: F.lit(v) for k, v in kept.items()}))
        return path

    def _newest(self, name: str) -> DataFrame:
        rows = self.table(name)
        newest = rows.groupBy("dataset_id").agg(F.max_by(F.struct(*rows.columns), "created_at").alias("row"))
        return newest.select("row.*")

    def dashboard(self) -> dict[str, DataFrame]:
        """All dashboard tables from what is stored."""
        stored = versions.read_catalogue(self.spark, self.root).join(self._mine(), "dataset_id", "left_semi")
        latest = stored.groupBy("dataset_id").agg(F.max("created_at").alias("updated_at"))
        datasets = catalogue.owned(self.table("datasets"), self.user_id).join(latest, "dataset_id", "left")
        datasets = datasets.withColumn("updated_at", F.coalesce("updated_at", "created_at"))
        tables = {"datasets": datasets, "versions": stored, "profiles": self._newest("profiles"), "insights": self._newest("insights")}
        return catalogue.dashboard(tables | {n: self.table(n) for n in ("jobs", "eda", "reports")}, self.user_id)

    def delete(self, ids: Iterable[str]) -> dict[str, int]:
        """Remove datasets with all that is stored of them; unknown, foreign and repeated ids fail."""
        asked = list(ids)
        mine = {r["dataset_id"] for r in self._mine().where(F.col("dataset_id").isin(*set(asked))).collect()} if asked else set()
        for r in self.table("reports").where(F.col("dataset_id").isin(*mine)).select("storage_path").collect() if mine else []:
            versions.files.remove(self.spark, r["storage_path"])
        for dataset_id in mine:
            versions.delete_dataset(self.spark, self.root, dataset_id)
        return {"deleted": len(mine), "failed": len(asked) - len(mine), "total": len(asked)}
