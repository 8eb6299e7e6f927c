"""From a table to model input: problem type, checks, features, fills, encoding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import TableError
from ..functions.columns import is_missing, is_numeric, is_text, ref, require_columns, value_of
from ..functions.dates import DATE_LAYOUTS, shape
from ..operators.cleaning import most_common
from ..operators.frequency import distinct_counts, value_summary
from ..operators.profile import date_columns
from ..operators.quantiles import exact_quantiles

# A numeric target with more distinct values is a regression.
CLASS_LIMIT = 10
MIN_ROWS = 10
MIN_CLASSES = 2
# Names of identifier columns.
ID_NAMES = ("id", "uuid", "index")
UNSUITABLE_NAMES = ("id", "uuid", "index", "email", "customerid", "invoiceno", "customername")
# Widths that one-hot encoding may reach.
MAX_CATEGORIES = 50
MAX_WIDTH = 500
FALLBACK_DATE = "2026-01-01"
PARTS = ("year", "month", "day_of_week", "is_weekend")


def detect_problem_type(df: DataFrame, target: str) -> str:
    """``regression`` for numbers with more than ten distinct values, else ``classification``."""
    require_columns(df, [target])
    if not is_numeric(df.schema[target].dataType):
        return "classification"
    values = df.where(~is_missing(df, target)).select(ref(target)).distinct()
    return "regression" if len(values.take(CLASS_LIMIT + 1)) > CLASS_LIMIT else "classification"


def validate_training(df: DataFrame, target: str, problem: str) -> int:
    """Rows with a target; an error if they are too few or all of one class."""
    if target not in df.columns:
        raise TableError(f"target column '{target}' is missing")
    x = value_of(df, target)
    row = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if row["n"] < MIN_ROWS:
        raise TableError(f"fewer than {MIN_ROWS} rows have a target")
    if problem == "classification" and row["lo"] == row["hi"]:
        raise TableError(f"the target needs at least {MIN_CLASSES} classes")
    return row["n"]


def select_features(df: DataFrame, target: str, features: Sequence[str] | None = None) -> list[str]:
    """The given columns, or all but the target and identifiers."""
    if features:
        chosen = [c for c in features if c in df.columns and c != target]
    else:
        chosen = [
            c for c in df.columns if c != target and c.lower() not in ID_NAMES and not c.lower().endswith("_id")
        ]
    if not chosen:
        raise TableError("no usable feature column")
    return chosen


def suitable_features(profile: DataFrame, target: str) -> DataFrame:
    """Columns proposed as features, judged by name and number of distinct values."""
    name = F.lower("column")
    named = name.isin(*UNSUITABLE_NAMES) | name.endswith("id")
    wide = (F.col("dtype") != "numeric") & (F.col("unique_count") > MAX_CATEGORIES)
    return profile.select(
        "column", "dtype", "unique_count", ((F.col("column") != target) & ~named & ~wide).alias("suitable")
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _timestamp_sql(df: DataFrame, column: str) -> str:
    if not is_text(df.schema[column].dataType):
        return f"CAST({_quoted(column)} AS TIMESTAMP)"
    c = _quoted(column)
    tries = ", ".join(f"CASE WHEN {c} RLIKE {_text(shape(d))} THEN try_to_timestamp({c}, {_text(d)}) END" for d in DATE_LAYOUTS)
    return f"coalesce({tries})"


def _parts_sql(df: DataFrame, column: str) -> dict[str, str]:
    """SQL of the calendar parts of a date column; gaps take the most frequent date."""
    stamp = _timestamp_sql(df, column)
    modal = most_common(df.select(F.date_format(F.expr(stamp), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("d")), "d")
    filled = f"coalesce({stamp}, TIMESTAMP {_text(modal or FALLBACK_DATE)})"
    return {
        f"{column}_year": f"year({filled})",
        f"{column}_month": f"month({filled})",
        f"{column}_day_of_week": f"weekday({filled})",
        f"{column}_is_weekend": f"CAST(weekday({filled}) >= 5 AS INT)",
    }


def datetime_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace date columns by year, month, day of the week (Monday 0) and a weekend mark."""
    parts: dict[str, str] = {}
    for c in columns:
        parts |= _parts_sql(df, c)
    kept = [ref(c) for c in df.columns if c not in columns]
    return df.select(*kept, *[F.expr(sql).alias(name) for name, sql in parts.items()])


def width_guard(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    max_unique: int = MAX_CATEGORIES,
    max_width: int = MAX_WIDTH,
) -> int:
    """Width after one-hot encoding; an error if a column or the whole is too wide."""
    if not categorical:
        return len(numeric)
    counts = {r["column"]: r["unique_count"] for r in distinct_counts(df, categorical).collect()}
    wide = [f"{c} ({counts[c]})" for c in categorical if counts[c] > max_unique]
    if wide:
        raise TableError(f"columns with more than {max_unique} distinct values cannot be encoded: {', '.join(wide)}")
    width = len(numeric) + sum(counts.values())
    if width > max_width:
        raise TableError(f"{width} encoded columns exceed the limit of {max_width}")
    return width


@dataclass(frozen=True)
class Features:
    """Feature columns by role; ``types`` are the Spark types of the raw columns."""

    raw: tuple[str, ...]
    dates: tuple[str, ...]
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    types: tuple[tuple[str, str], ...]

    @property
    def encoded_numeric(self) -> list[str]:
        return [*self.numeric, *[f"{d}_{p}" for d in self.dates for p in PARTS]]


def feature_roles(df: DataFrame, features: Sequence[str]) -> Features:
    numeric = [c for c in features if is_numeric(df.schema[c].dataType)]
    dates = [c for c in date_columns(df, candidates=[c for c in features if c not in numeric])]
    categorical = [c for c in features if c not in numeric and c not in dates]
    types = dict(df.dtypes)
    return Features(tuple(features), tuple(dates), tuple(numeric), tuple(categorical), tuple((c, types[c]) for c in features))


def fill_stage(df: DataFrame, roles: Features) -> SQLTransformer:
    """Date parts and filled features as SQL: medians for numbers, modes for categories.

    The constants come from ``df`` (exact medians, which ``Imputer`` does not
    give) and are stored with the pipeline.
    """
    medians = exact_quantiles(df, roles.numeric, [0.5]) if roles.numeric else {}
    parts: list[str] = []
    for c in roles.numeric:
        median = medians[c][0.5]
        number = f"CAST({_quoted(c)} AS DOUBLE)"
        value = 0.0 if median is None else median
        parts.append(f"coalesce(CASE WHEN isnan({number}) THEN NULL ELSE {number} END, {value!r}D) AS {_quoted(c + '__num')}")
    for d in roles.dates:
        for name, sql in _parts_sql(df, d).items():
            parts.append(f"CAST({sql} AS DOUBLE) AS {_quoted(name + '__num')}")
    modes = {}
    if roles.categorical:
        modes = {r["column"]: r["top_value"] for r in value_summary(df, roles.categorical).collect()}
    for c in roles.categorical:
        mode = modes[c]
        parts.append(f"coalesce(CAST({_quoted(c)} AS STRING), {_text('' if mode is None else mode)}) AS {_quoted(c + '__cat')}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def numeric_stages(columns: Sequence[str]) -> list:
    """Centre and scale filled numbers (sample deviation)."""
    return [
        VectorAssembler(inputCols=[f"{c}__num" for c in columns], outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
    ]


def categorical_stages(columns: Sequence[str]) -> list:
    """One-hot encode filled categories; a category unseen in training gives zeros."""
    cats = [f"{c}__cat" for c in columns]
    return [
        StringIndexer(inputCols=cats, outputCols=[f"{c}_idx" for c in cats], handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[f"{c}_idx" for c in cats], outputCols=[f"{c}_hot" for c in cats], dropLast=True),
    ]


def fit_preparation(df: DataFrame, roles: Features) -> PipelineModel:
    """All preparation stages fitted on ``df``; the output column is ``features``."""
    stages: list = [fill_stage(df, roles)]
    inputs = []
    if roles.encoded_numeric:
        stages += numeric_stages(roles.encoded_numeric)
        inputs.append("scaled")
    if roles.categorical:
        stages += categorical_stages(roles.categorical)
        inputs += [f"{c}__cat_hot" for c in roles.categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return Pipeline(stages=stages).fit(df)


def encoded_names(preparation: PipelineModel, roles: Features) -> list[str]:
    """Names of the entries of ``features``, categories as ``column_value``."""
    names = list(roles.encoded_numeric)
    if roles.categorical:
        labels = next(s for s in preparation.stages if hasattr(s, "labelsArray")).labelsArray
        names += [f"{c}_{v}" for c, values in zip(roles.categorical, labels) for v in values]
    return names


def with_missing_features(df: DataFrame, roles: Features) -> DataFrame:
    """Add feature columns the table lacks as missing."""
    absent = [(c, t) for c, t in roles.types if c not in df.columns]
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in absent])
