"""Evaluation of predictions as aggregations over (label, prediction) columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_totals
from ..session import materialize

# Fixed value: smallest divisor of the percentage error.
EPSILON = 2.220446049250313e-16
# Classes up to which the confusion matrix has a row for every pair.
DENSE_CLASSES = 500


def _confusion(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """Counts per (label, prediction): everything else derives from these few rows."""
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).count()


def class_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    cells = _confusion(pred, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("count").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("count").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    totals = cells.select(F.inline(sides)).groupBy("class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]
    )
    zero = F.lit(0.0)
    return totals.select(
        "class",
        F.coalesce(F.try_divide("hits", "predicted"), zero).alias("precision"),
        F.coalesce(F.try_divide("hits", "support"), zero).alias("recall"),
        F.coalesce(F.try_divide(F.col("hits") * 2.0, F.col("predicted") + F.col("support")), zero).alias("f1"),
        "support",
    )


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    report = class_report(pred, label, prediction)
    n = F.sum("support")
    return report.agg(
        F.try_divide(F.sum(F.col("recall") * F.col("support")), n).alias("accuracy"),
        *[F.try_divide(F.sum(F.col(m) * F.col("support")), n).alias(m) for m in ("precision", "recall", "f1")],
    )


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The confusion matrix as rows, zero cells included; beyond ``DENSE_CLASSES`` classes only the cells that occur."""
    cells = materialize(_confusion(pred, label, prediction), "confusion")
    labels, guesses = cells.agg(F.count_distinct("label"), F.count_distinct("prediction")).first()
    if max(labels, guesses) > DENSE_CLASSES:
        return cells.select("label", "prediction", "count")
    classes = cells.select(F.explode(F.array("label", "prediction")).alias("class"))
    # All classes as one array, unfolded twice: classes squared, not rows.
    grid = classes.agg(F.sort_array(F.collect_set("class")).alias("classes"))
    grid = grid.select(F.explode("classes").alias("label"), "classes").select("label", F.explode("classes").alias("prediction"))
    return grid.join(cells, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("count", F.lit(0)).alias("count")
    )


def class_distribution(pred: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Predicted rows per class."""
    return pred.groupBy(F.col(prediction).alias("prediction")).count()


def roc_auc_by(scores: DataFrame, by: str, positive: str, score: str) -> DataFrame:
    """Area under the ROC curve per group, ties counted half; null without both outcomes.

    Rows are reduced to one per score, then ordered in blocks; no group is
    ranked in one task.
    """
    is_pos = F.col(positive).cast("boolean")
    points = scores.groupBy(F.col(by).alias("group"), F.col(score).alias("score")).agg(
        F.count_if(is_pos).alias("pos"), F.count_if(~is_pos).alias("neg")
    )
    run = running_totals(points, ["group", "score"], {"neg_before": F.col("neg")})
    sums = run.groupBy("group").agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.min("neg_before").alias("start"),
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("won"),
    )
    area = F.try_divide(
        F.col("won") - F.col("positives") * F.col("start"), F.col("positives").cast("double") * F.col("negatives")
    )
    return sums.select("group", "positives", "negatives", area.alias("roc_auc"))


def roc_auc(scores: DataFrame, positive: str = "label", score: str = "score") -> DataFrame:
    """Binary AUC as one row."""
    return roc_auc_by(scores.select(F.lit(1).alias("g"), F.col(positive).alias("p"), F.col(score).alias("s")), "g", "p", "s").select(
        "roc_auc"
    )


def roc_auc_weighted(pred: DataFrame, label: str = "label", scores: str = "scores") -> DataFrame:
    """One-vs-rest AUC weighted by class size; ``scores`` is an array indexed by the label."""
    long = pred.select(F.col(label).cast("int").alias("y"), F.posexplode(scores).alias("class", "s"))
    each = roc_auc_by(long.select("class", (F.col("y") == F.col("class")).alias("p"), "s"), "class", "p", "s")
    return each.agg(F.try_divide(F.sum(F.col("roc_auc") * F.col("positives")), F.sum(F.when(F.col("roc_auc").isNotNull(), F.col("positives")))).alias("roc_auc"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Squared, absolute and percentage errors and R2, in one aggregation."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    mse = F.avg((y - p) * (y - p))
    spread = F.var_pop(y)
    r2 = F.coalesce(F.lit(1.0) - F.try_divide(mse, spread), F.when(mse == 0, 1.0).otherwise(0.0))
    return pred.agg(
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
        r2.alias("r2"),
        F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"),
    )
