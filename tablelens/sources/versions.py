"""Versions of a dataset as Parquet tables, with an append-only catalogue of them.

Layout below ``root``, each with a folder per dataset: ``data`` holds the rows
of each version in a folder of its own, ``catalogue/dataset_versions`` one row
per version, ``catalogue/version_status`` one per change of a status, and
``claims`` an empty file per version number.  Nothing is updated in place.  A
writer claims its number by creating that file, which fails if it is there, so
no two writers share a number and none changes later.  The current version is
the one with the largest number.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import TableError
from ..functions.columns import is_float, is_missing, ref
from ..functions.text import equality_key
from ..operators.profile import data_bytes
from . import delimited, files

VERSION_SCHEMA = (
    "version_id string, dataset_id string, version_number int, storage_path string, file_size bigint, "
    "checksum string, rows_count bigint, columns_count bigint, status string, created_at timestamp"
)
STATUS_SCHEMA = "dataset_id string, version_number int, status string, place int, changed_at timestamp"
# States of a version.
STATUSES = ("UPLOADED", "PROFILED", "CLEANED", "ANALYZED", "TRAINED", "COMPLETED", "FAILED")


def _cell_text(df: DataFrame, name: str) -> Column:
    """Unambiguous text of a cell: its length, a colon, and its characters."""
    c = ref(name)
    if is_float(df.schema[name].dataType):
        c = F.when(~is_missing(df, name), c)
    text = c.cast("string")
    text = F.concat(F.length(text).cast("string"), F.lit(":"), equality_key(text))
    return F.coalesce(text, F.lit("-"))


def digest_sum(df: DataFrame) -> Column:
    """Aggregate: the sum of the row digests."""
    digest = F.md5(F.concat_ws("|", *[_cell_text(df, n) for n in df.columns]))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(28,0)")
    return F.coalesce(F.sum(number).cast("string"), F.lit("0"))


def schema_digest(df: DataFrame) -> Column:
    """Digest of the column names and types in order."""
    return F.md5(F.lit("|".join(f"{len(n)}:{n}:{t}" for n, t in df.dtypes)))


def fingerprint(df: DataFrame) -> DataFrame:
    """Identity of a table, whatever the order of its rows: their content, and the names and types of its columns.

    The row digests are added up, so the result needs one partial aggregation
    and no sort, and copies of a row count.
    """
    return df.agg(
        F.count(F.lit(1)).alias("rows"), digest_sum(df).alias("digest_sum"), schema_digest(df).alias("schema_digest")
    )


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the catalogue; empty before its first row."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append(df: DataFrame, root: str, table: str, dataset_id: str) -> None:
    """Add rows of a dataset to a table of the catalogue, in a folder of their own, as two writers must not share one."""
    path = f"{_folder(df.sparkSession, root, f'catalogue/{table}', dataset_id)}/batch={uuid.uuid4().hex}"
    df.drop("dataset_id").write.parquet(path)


def stored(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    found = _read(spark, f"{root.rstrip('/')}/catalogue/{table}", schema)
    return found.drop("batch")


def _folder(spark: SparkSession, root: str, kind: str, dataset_id: str) -> str:
    return f"{root.rstrip('/')}/{kind}/{files.folder_of(spark, 'dataset_id', dataset_id)}"


def _records(spark: SparkSession, root: str) -> DataFrame:
    """The catalogue with the newest status of each version."""
    written = stored(spark, root, "dataset_versions", VERSION_SCHEMA)
    changes = stored(spark, root, "version_status", STATUS_SCHEMA)
    newest = changes.groupBy("dataset_id", "version_number").agg(F.max_by("status", F.struct("changed_at", "place")).alias("now"))
    return written.join(newest, ["dataset_id", "version_number"], "left").withColumn("status", F.coalesce("now", "status")).select(*written.columns)


def set_status(spark: SparkSession, root: str, dataset_id: str, number: int, status: str) -> None:
    if status not in STATUSES:
        raise TableError(f"unknown status: {status}")
    place = STATUSES.index(status)  # of changes in the same instant the later state counts
    row = spark.range(1).select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(number).alias("version_number"), F.lit(status).alias("status"),
        F.lit(place).alias("place"), F.current_timestamp().alias("changed_at"),
    )
    append(row, root, "version_status", dataset_id)


def read_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """All versions, with ``is_current`` set for the newest of each dataset."""
    versions = _records(spark, root)
    newest = versions.groupBy("dataset_id").agg(F.max("version_number").alias("__newest"))
    return versions.join(newest, "dataset_id").select(
        *versions.columns, (F.col("version_number") == F.col("__newest")).alias("is_current")
    )


def current_version(spark: SparkSession, root: str, dataset_id: str) -> int | None:
    mine = _records(spark, root).where(F.col("dataset_id") == dataset_id)
    return mine.agg(F.max("version_number")).first()[0]


def write_version(df: DataFrame, root: str, dataset_id: str, status: str = "CLEANED") -> int:
    """Store the table as the dataset's next version and return its number.

    The data are written first; the version exists once its catalogue row does,
    so a failed write leaves the current version as it was.
    """
    if status not in STATUSES:
        raise TableError(f"unknown status: {status}")
    spark = df.sparkSession
    number = (current_version(spark, root, dataset_id) or 0) + 1
    claims = _folder(spark, root, "claims", dataset_id)
    while not files.claim(spark, f"{claims}/{number}"):
        number += 1
    try:
        _write(df, root, dataset_id, number, status)
    except BaseException:
        files.remove(spark, f"{claims}/{number}")
        raise
    return number


def _write(df: DataFrame, root: str, dataset_id: str, number: int, status: str) -> None:
    spark = df.sparkSession
    version_id = uuid.uuid4().hex
    path = f"{_folder(spark, root, 'data', dataset_id)}/{version_id}"
    df.write.mode("errorifexists").parquet(path)
    kept = spark.read.parquet(path)
    totals = kept.agg(
        F.count(F.lit(1)).alias("rows"), data_bytes(kept).alias("data_bytes"), F.concat_ws("-", schema_digest(kept), digest_sum(kept)).alias("checksum"),
    )
    record = totals.select(
        F.lit(version_id).alias("version_id"),
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(number).alias("version_number"),
        F.lit(path).alias("storage_path"),
        F.col("data_bytes").alias("file_size"),
        "checksum",
        F.col("rows").alias("rows_count"),
        F.lit(len(df.columns)).cast("bigint").alias("columns_count"),
        F.lit(status).alias("status"),
        F.current_timestamp().alias("created_at"),
    )
    append(record, root, "dataset_versions", dataset_id)


def read_version(spark: SparkSession, root: str, dataset_id: str, n: int | None = None) -> DataFrame:
    """Load one version, the current one by default."""
    current = current_version(spark, root, dataset_id)
    if current is None:
        raise TableError(f"dataset {dataset_id} has no version")
    number = current if n is None else n
    if not 1 <= number <= current:
        raise TableError(f"dataset {dataset_id} has no version {number}")
    mine = (F.col("dataset_id") == dataset_id) & (F.col("version_number") == number)
    row = stored(spark, root, "dataset_versions", VERSION_SCHEMA).where(mine).first()
    if row is None:  # claimed by a writer that is not done, or failed
        raise TableError(f"dataset {dataset_id} has no version {number}")
    return spark.read.parquet(row["storage_path"])


def delete_dataset(spark: SparkSession, root: str, dataset_id: str) -> bool:
    """Remove all rows, versions and results of a dataset from storage; False if there is nothing of it."""
    tables = files.children(spark, f"{root.rstrip('/')}/catalogue")
    kinds = [*[f"catalogue/{t}" for t in tables], "claims", "data"]
    return any([files.remove(spark, _folder(spark, root, kind, dataset_id)) for kind in kinds])


def import_csv(
    spark: SparkSession, path: str, root: str, dataset_id: str, sep: str | None = None, encoding: str | None = None
) -> DataFrame:
    """Read a CSV file, check it, and store it as the dataset's next version.

    A file that fails a check leaves no version behind.

    Later work scans the stored columns; text is never parsed again.
    """
    df = delimited.read_csv(spark, path, sep, encoding)
    if df.isEmpty():
        raise TableError("the table has no rows")
    return read_version(spark, root, dataset_id, write_version(df, root, dataset_id, "UPLOADED"))
