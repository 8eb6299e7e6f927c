"""Candidate models, model search and batch scoring."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial
from typing import TypeVar

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import TableError
from ..functions.columns import is_missing, ref
from ..operators.frequency import literal_rows
from ..session import materialize
from . import evaluate, prepare
from .cells import BINS, OnCells
from .forest import ForestOnCells
from .split import split, with_folds

T = TypeVar("T")

# Candidates per problem, in the order in which they compete.
CANDIDATES = {
    "classification": ("random_forest", "logistic_regression", "gradient_boosting"),
    "regression": ("random_forest", "linear_regression", "gradient_boosting"),
}
# Sizes of the ensembles and of the steps.
TREES, ROUNDS, BOOST_DEPTH, STEP = 100, 100, 3, 0.1
# Spark's bound.
FOREST_DEPTH = 30
TOP_FEATURES = 20


def candidate(
    name: str, problem: str, seed: int = 42, classes: int = 2, rows: int = 1, trees: int = TREES, rounds: int = ROUNDS,
    depth: int = FOREST_DEPTH,
):
    """An unfitted estimator of one candidate."""
    if name not in CANDIDATES[problem]:
        raise TableError(f"no candidate '{name}' for {problem}")
    cols = {"featuresCol": "features", "labelCol": "label"}
    if name == "random_forest":
        forest = RandomForestClassifier if problem == "classification" else RandomForestRegressor
        grown = forest(numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True, **cols)
        return ForestOnCells(grown, classes if problem == "classification" else 0, seed)
    if name == "gradient_boosting":
        cell = {"featuresCol": "binned", "labelCol": "label", "weightCol": "weight"}
        settings = {"maxIter": rounds, "maxDepth": BOOST_DEPTH, "stepSize": STEP, "seed": seed, "maxBins": 2 * BINS}
        if problem == "regression":
            return OnCells(GBTRegressor(**settings, **cell), False, seed)
        boosted = GBTClassifier(**settings, **cell)
        return OnCells(boosted if classes == 2 else OneVsRest(classifier=boosted, parallelism=AT_ONCE, **cell), True, seed)
    if name == "logistic_regression":
        # The penalty is per data set, Spark's is per row; inputs are scaled already.
        return LogisticRegression(maxIter=100, regParam=1.0 / max(rows, 1), standardization=False, **cols)
    return LinearRegression(regParam=0.0, **cols)


def class_scores(df: DataFrame) -> DataFrame:
    """Add ``scores``, the class probabilities as an array.

    One-vs-rest boosting has a margin per class only; its logistic values are
    normalised to sum to one.
    """
    if "probability" in df.columns:
        return df.withColumn("scores", vector_to_array("probability"))
    margins = vector_to_array("rawPrediction")
    logistic = F.transform(margins, lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
    total = F.aggregate(logistic, F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("scores", F.transform(logistic, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0))))


def validation_score(pred: DataFrame, problem: str) -> float:
    """Weighted F1 or R2 of predictions."""
    if problem == "classification":
        return evaluate.classification_metrics(pred).first()["f1"]
    return evaluate.regression_metrics(pred).first()["r2"]


def labelled(df: DataFrame, target: str, problem: str) -> tuple[DataFrame, list[str]]:
    """Rows with a target, with a numeric ``label``; class names in label order."""
    kept = df.where(~is_missing(df, target))
    if problem == "regression":
        return kept.withColumn("label", ref(target).cast("double")), []
    named = kept.withColumn("__class", ref(target).cast("string"))
    indexer = StringIndexer(inputCol="__class", outputCol="label", stringOrderType="alphabetAsc").fit(named)
    return indexer.transform(named).drop("__class"), list(indexer.labels)


# Models that are fitted at the same time.
AT_ONCE = 4
# Rows of one task while a model is fitted: tables of fewer stay as they are, and no task gets more.
FEW_ROWS, TASK_ROWS = 5_000, 50_000


def tasks_of(spark: SparkSession, n: int) -> int:
    """Tasks that ``n`` rows are dealt to."""
    return max(min(spark.sparkContext.defaultParallelism, n // FEW_ROWS), math.ceil(n / TASK_ROWS), 1)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores.

    A narrow table of many rows is one small file, hence one task, whereas the
    trees hold far more bytes of a row than its file does.
    """
    tasks = tasks_of(df.sparkSession, df.count())
    return df.repartition(tasks) if tasks > 1 else df


def fit(estimator, data: DataFrame):
    """The estimator fitted to the prepared rows, which are dealt over the cores first."""
    return estimator.fit(spread(data.select("features", "label")))


def in_parallel(spark: SparkSession, jobs: Sequence[Callable[[], T]]) -> list[T]:
    """The jobs' results, in order; Spark shares its tasks out between them."""
    with ThreadPoolExecutor(max_workers=max(1, min(AT_ONCE, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def cross_validate(
    df: DataFrame, roles: prepare.Features, name: str, problem: str, folds: int = 3, seed: int = 42,
    key: Sequence[str] | None = None, fold_col: str | None = None, **settings,
) -> list[float]:
    """Score per fold; preparation and model are fitted on the other folds only, all folds at the same time.

    ``fold_col`` has the fold (from 0) of each row where it is given beforehand.
    """
    marked = with_folds(df, folds, seed, key) if fold_col is None else df.withColumn("fold", ref(fold_col))
    marked = materialize(marked, "folds")

    def scored(k: int) -> float:
        train, held = marked.where(F.col("fold") != k), marked.where(F.col("fold") == k)
        preparation = prepare.fit_preparation(train, roles)
        model = fit(candidate(name, problem, seed, **settings), preparation.transform(train))
        return validation_score(model.transform(preparation.transform(held)), problem)

    return in_parallel(df.sparkSession, [partial(scored, k) for k in range(folds)])


def _weights(model) -> np.ndarray | None:
    """Importance per entry of the feature vector, or None if the model has none."""
    if isinstance(model, OneVsRestModel):
        parts = [_weights(m) for m in model.models]
        return None if any(p is None for p in parts) else np.mean(parts, axis=0)
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficientMatrix"):
        return np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    if hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray())
    return None


def importances(model: PipelineModel, roles: prepare.Features, spark, k: int = TOP_FEATURES) -> DataFrame:
    """The ``k`` most important features, shares summing to one over all features."""
    names = prepare.encoded_names(model, roles)
    fitted = [w for w in (_weights(s) for s in model.stages) if w is not None]
    weights = fitted[-1] if fitted and len(fitted[-1]) == len(names) else np.ones(len(names))
    total = float(weights.sum())
    shares = weights / total if total > 0 else weights
    rows = sorted(({"feature": n, "importance": float(w)} for n, w in zip(names, shares)), key=lambda r: (-r["importance"], r["feature"]))
    return literal_rows(spark, rows[:k], "feature string, importance double")


@dataclass
class Champion:
    """Outcome of a model search."""

    model: PipelineModel
    algorithm: str
    problem: str
    target: str
    score: float
    roles: prepare.Features
    metrics: DataFrame
    leaderboard: DataFrame
    importances: DataFrame
    training_rows: int
    testing_rows: int
    # Of classes, by name: precision and so on, the confusion matrix, and how often each is predicted.
    report: DataFrame | None = None
    confusion: DataFrame | None = None
    distribution: DataFrame | None = None


def train_champion(
    df: DataFrame,
    target: str,
    problem: str = "auto",
    features: Sequence[str] | None = None,
    algorithms: Sequence[str] | None = None,
    cv: bool = False,
    seed: int = 42,
    key: Sequence[str] | None = None,
    trees: int = TREES,
    rounds: int = ROUNDS,
    depth: int = FOREST_DEPTH,
) -> Champion:
    """Fit every candidate on 80 % of the rows, keep the best on the rest, refit it on all.

    The first candidate wins ties.  With ``cv`` the mean of three folds of the
    training rows decides instead of the test score.  Prepared rows are stored
    once; the candidates are fitted on them at the same time.
    """
    spark = df.sparkSession
    if target not in df.columns:
        raise TableError(f"target column '{target}' is missing")
    if problem == "auto":
        problem = prepare.detect_problem_type(df, target)
    prepare.validate_training(df, target, problem)
    roles = prepare.feature_roles(df, prepare.select_features(df, target, features))
    rows, labels = labelled(df, target, problem)
    prepare.width_guard(rows, roles.encoded_numeric, roles.categorical)
    names = [a for a in (algorithms or CANDIDATES[problem]) if a in CANDIDATES[problem]]
    if not names:
        raise TableError(f"no valid algorithm for {problem}")

    columns = list(dict.fromkeys([*roles.raw, "label", *(key or [])]))
    rows = materialize(spread(rows.select(*[ref(c) for c in columns])), "labelled-rows")
    train, test = split(rows, 0.2, seed, "label" if problem == "classification" else None, key or df_key(roles))
    train, test = materialize(train, "training-rows"), materialize(test, "test-rows")
    n_train, n_test = train.count(), test.count()
    settings = {"classes": max(len(labels), 2), "rows": n_train, "trees": trees, "rounds": rounds, "depth": depth}
    preparation = prepare.fit_preparation(train, roles)
    seen, unseen = (materialize(preparation.transform(x).select("features", "label"), "prepared-rows") for x in (train, test))

    def tried(name: str) -> tuple[DataFrame, dict, float]:
        pred = fit(candidate(name, problem, seed, **settings), seen).transform(unseen)
        measured = _measure(pred, problem, len(labels))
        if cv:
            return pred, measured, float(np.mean(cross_validate(train, roles, name, problem, 3, seed, key, **settings)))
        return pred, measured, measured["f1" if problem == "classification" else "r2"]

    results = dict(zip(names, in_parallel(spark, [partial(tried, name) for name in names]), strict=True))
    board = [{"algorithm": name, "score": results[name][2]} for name in names]
    name = max(names, key=lambda n: results[n][2])  # the first of the best
    pred, measured, score = results[name]

    preparation = prepare.fit_preparation(rows, roles)
    final = fit(candidate(name, problem, seed, **{**settings, "rows": n_train + n_test}), preparation.transform(rows))
    stages = [*preparation.stages, *(final.stages if isinstance(final, PipelineModel) else [final])]
    if labels:
        stages.append(IndexToString(inputCol="prediction", outputCol="predicted_class", labels=labels))
    model = PipelineModel(stages)
    return Champion(
        model=model,
        algorithm=name,
        problem=problem,
        target=target,
        score=score,
        roles=roles,
        metrics=literal_rows(
            spark, [{"metric": m, "value": v} for m, v in measured.items()], "metric string, value double"
        ),
        leaderboard=literal_rows(spark, board, "algorithm string, score double"),
        importances=importances(model, roles, spark),
        training_rows=n_train,
        testing_rows=n_test,
        **_class_tables(pred, labels),
    )


def _class_tables(pred: DataFrame, labels: Sequence[str]) -> dict[str, DataFrame]:
    """Report, confusion matrix and distribution of predicted classes with the classes' names."""
    if not labels:
        return {}
    named = F.array(*[F.lit(x) for x in labels])
    told = materialize(pred.select(*[named[F.col(c).cast("int")].alias(c) for c in ("label", "prediction")]), "predictions")
    tables = {"report": evaluate.class_report(told), "confusion": evaluate.confusion(told), "distribution": evaluate.class_distribution(told)}
    return {k: materialize(v, k) for k, v in tables.items()}


def df_key(roles: prepare.Features) -> list[str]:
    """Without a key, rows are told apart by features and label."""
    return [*roles.raw, "label"]


def _measure(pred: DataFrame, problem: str, classes: int) -> dict[str, float | None]:
    if problem == "regression":
        return evaluate.regression_metrics(pred).first().asDict()
    out = evaluate.classification_metrics(pred).first().asDict()
    scored = class_scores(pred)
    if classes == 2:
        area = evaluate.roc_auc(scored.select("label", F.col("scores")[1].alias("score")))
    else:
        area = evaluate.roc_auc_weighted(scored)
    out["roc_auc"] = area.first()["roc_auc"]
    return out


def score(model: PipelineModel, roles: prepare.Features, df: DataFrame, problem: str) -> DataFrame:
    """Predict all rows of a table; lacking features count as missing.

    Adds ``prediction`` as text and, for classes, ``confidence``, the largest
    class probability.
    """
    out = model.transform(prepare.with_missing_features(df, roles))
    if problem == "regression":
        prediction, confidence = F.col("prediction").cast("string"), F.lit(None).cast("double")
    else:
        out = class_scores(out)
        prediction, confidence = F.col("predicted_class"), F.array_max("scores")
    out = out.withColumn("__prediction", prediction).withColumn("__confidence", confidence)
    return out.select(
        *[ref(c) for c in df.columns if c not in ("prediction", "confidence")],
        F.col("__prediction").alias("prediction"),
        F.col("__confidence").alias("confidence"),
    )
