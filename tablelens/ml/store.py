"""Stored models, their records, and the log of predictions."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import TableError
from ..functions.columns import ref
from ..operators.catalogue import owned
from ..operators.frequency import literal_rows
from .prepare import Features
from .search import Champion

MODEL_SCHEMA = (
    "model_id string, dataset_id string, model_version int, target_column string, problem_type string, "
    "model_type string, status string, best_score double, training_rows bigint, testing_rows bigint, "
    "features array<string>, roles string, evaluation_metrics map<string,double>, "
    "feature_importances map<string,double>, model_path string, created_at timestamp"
)
LOG_SCHEMA = (
    "prediction_id string, model_id string, input_payload map<string,string>, prediction string, "
    "confidence double, created_at timestamp"
)
HISTORY_ROWS = 50


def _table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def models(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, "ml_models", MODEL_SCHEMA)


def save_model(champion: Champion, root: str, dataset_id: str) -> str:
    """Store the model, then its record; versions count up per dataset.  Returns the model id."""
    spark = champion.metrics.sparkSession
    newest = models(spark, root).where(F.col("dataset_id") == dataset_id).agg(F.max("model_version")).first()[0]
    model_id = uuid.uuid4().hex
    path = f"{root.rstrip('/')}/models/{model_id}"
    champion.model.write().overwrite().save(path)

    def as_map(df: DataFrame, key: str, value: str):
        return df.agg(F.map_from_entries(F.collect_list(F.struct(key, value)))).scalar()

    record = literal_rows(
        spark,
        [
            {
                "model_id": model_id,
                "dataset_id": dataset_id,
                "model_version": (newest or 0) + 1,
                "target_column": champion.target,
                "problem_type": champion.problem,
                "model_type": champion.algorithm,
                "status": "COMPLETED",
                "best_score": champion.score,
                "training_rows": champion.training_rows,
                "testing_rows": champion.testing_rows,
            }
        ],
        "model_id string, dataset_id string, model_version int, target_column string, problem_type string, "
        "model_type string, status string, best_score double, training_rows bigint, testing_rows bigint",
    )
    record.select(
        "*",
        F.array(*[F.lit(c) for c in champion.roles.raw]).alias("features"),
        F.lit(json.dumps(asdict(champion.roles))).alias("roles"),
        as_map(champion.metrics, "metric", "value").alias("evaluation_metrics"),
        as_map(champion.importances, "feature", "importance").alias("feature_importances"),
        F.lit(path).alias("model_path"),
        F.current_timestamp().alias("created_at"),
    ).write.mode("append").parquet(f"{root.rstrip('/')}/ml_models")
    return model_id


def load_model(spark: SparkSession, root: str, model_id: str) -> tuple[PipelineModel, Features, str]:
    """A stored model with its feature roles and problem type."""
    row = models(spark, root).where(F.col("model_id") == model_id).first()
    if row is None:
        raise TableError(f"no model {model_id}")
    raw = json.loads(row["roles"])
    roles = Features(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) for k, v in raw.items()})
    return PipelineModel.load(row["model_path"]), roles, row["problem_type"]


def log_predictions(scored: DataFrame, root: str, model_id: str) -> None:
    """Append the predictions of a table with their inputs."""
    inputs = [c for c in scored.columns if c not in ("prediction", "confidence")]
    pairs = [x for c in inputs for x in (F.lit(c), ref(c).cast("string"))]
    scored.select(
        F.uuid().alias("prediction_id"),
        F.lit(model_id).alias("model_id"),
        F.create_map(*pairs).alias("input_payload"),
        F.col("prediction").cast("string").alias("prediction"),
        F.col("confidence").cast("double").alias("confidence"),
        F.current_timestamp().alias("created_at"),
    ).write.mode("append").partitionBy("model_id").parquet(f"{root.rstrip('/')}/prediction_logs")


def newest_predictions(logs: DataFrame, model_id: str, limit: int = HISTORY_ROWS) -> DataFrame:
    """A model's predictions, newest first."""
    return logs.where(F.col("model_id") == model_id).orderBy(F.desc("created_at"), "prediction_id").limit(limit)


def history(spark: SparkSession, root: str, model_id: str, limit: int = HISTORY_ROWS) -> DataFrame:
    return newest_predictions(_table(spark, root, "prediction_logs", LOG_SCHEMA), model_id, limit)


def list_models(all_models: DataFrame, datasets: DataFrame, user_id: str) -> DataFrame:
    """The models on an owner's datasets, newest first."""
    mine = owned(datasets, user_id).select("dataset_id", "dataset_name")
    return all_models.join(mine, "dataset_id").orderBy(F.desc("created_at"), "model_id")
