"""Ordered cleaning steps with an account of what each one changed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import TableError
from ..functions.columns import is_missing, is_numeric, is_text, per_column, ref
from ..operators import cleaning as ops
from ..operators.frequency import literal_rows
from ..operators.preview import head
from ..operators.profile import table_profile
from ..session import materialize

COLUMN_STEPS = ("fill_missing", "cast_type", "clean_text", "remove_outliers", "drop_missing")
SUMMARY_SCHEMA = (
    "step int, type string, column string, affected bigint, strategy string, target_type string, fill_value string"
)


@dataclass(frozen=True)
class Step:
    """One cleaning step; which fields count depends on its type."""

    type: str
    column: str | None = None
    strategy: str | None = None
    target_type: str | None = None
    fill_value: object = None
    order_by: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    formats: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, spec: Step | dict) -> Step:
        if isinstance(spec, Step):
            return spec
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in spec.items() if k in cls.__dataclass_fields__}
        return cls(**known)


def check_step(schema: T.StructType, step: Step) -> str | None:
    """Why a step cannot run on a table of this schema, or None."""
    if step.type == "drop_duplicates":
        return None
    if step.type not in COLUMN_STEPS:
        return f"unsupported operation type '{step.type}'"
    if not step.column:
        return f"operation '{step.type}' requires a column"
    if step.column not in schema.fieldNames():
        return f"column '{step.column}' does not exist"
    dtype = schema[step.column].dataType
    if step.type == "fill_missing":
        if step.strategy not in ops.FILL_STRATEGIES:
            return f"unknown fill strategy '{step.strategy}'"
        if step.strategy in ("mean", "median") and not is_numeric(dtype):
            return f"strategy '{step.strategy}' needs a numeric column"
        if step.strategy in ("ffill", "bfill") and not step.order_by:
            return f"strategy '{step.strategy}' needs order_by"
    elif step.type == "clean_text":
        if step.strategy not in ops.TEXT_STRATEGIES:
            return f"unknown text strategy '{step.strategy}'"
        if not is_text(dtype):
            return "text operations need a text column"
    elif step.type == "cast_type":
        if step.target_type not in ops.CAST_TARGETS:
            return f"unknown cast target '{step.target_type}'"
    elif step.type == "remove_outliers":
        if step.strategy not in ops.OUTLIER_STRATEGIES:
            return f"unknown outlier strategy '{step.strategy}'"
        if not is_numeric(dtype):
            return "outlier removal needs a numeric column"
    return None


def schema_after(schema: T.StructType, step: Step) -> T.StructType:
    """The schema a valid step leaves behind (a constant fill may also turn a column into text)."""
    new = None
    if step.type == "cast_type":
        new = {"string": T.StringType(), "datetime": T.TimestampType(), "boolean": T.BooleanType()}.get(
            step.target_type
        )
        if step.target_type == "numeric":
            old = schema[step.column].dataType
            new = old if is_numeric(old) else T.DoubleType()
    elif step.type == "fill_missing" and step.strategy in ("mean", "median"):
        new = T.DoubleType()
    if new is None:
        return schema
    return T.StructType(
        [T.StructField(f.name, new if f.name == step.column else f.dataType, True) for f in schema.fields]
    )


def validate(schema: T.StructType, steps: Iterable[Step | dict]) -> list[str | None]:
    """Check each step against the schema as the earlier steps leave it; no job runs."""
    outcome = []
    for spec in steps:
        step = Step.of(spec)
        problem = check_step(schema, step)
        outcome.append(problem)
        if problem is None:
            schema = schema_after(schema, step)
    return outcome


class _Account:
    """Collects the change counts of steps until the table is next reduced.

    Row-wise steps add a hidden flag column each; the flags of a run of steps
    are summed together with the row count in one aggregation.
    """

    def __init__(self) -> None:
        self.affected: dict[int, int] = {}
        self.flags: dict[int, str] = {}

    def flag(self, df: DataFrame, step_no: int, test: Column) -> DataFrame:
        self.flags[step_no] = f"__step_{step_no}"
        return df.withColumn(self.flags[step_no], test)

    def settle(self, df: DataFrame, extra: dict[int, Column] | None = None) -> tuple[DataFrame, int]:
        """Count everything pending; returns the table without flags and its rows."""
        tests = {n: ref(name) for n, name in self.flags.items()} | (extra or {})
        row = df.agg(
            F.count(F.lit(1)).alias("rows"), *[F.count_if(t).alias(f"a{n}") for n, t in tests.items()]
        ).first()
        for n in tests:
            self.affected[n] = row[f"a{n}"]
        df = df.drop(*self.flags.values())
        self.flags = {}
        return df, row["rows"]


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*[ref(c) for c in df.columns if not c.startswith("__step_")])


def _row_wise(df: DataFrame, plain: DataFrame, step: Step) -> tuple[Column, Column]:
    """Change test and new value of a step that looks at one row at a time."""
    before = ref(step.column)
    if step.type == "clean_text":
        after = ops.text_expr(before, step.strategy)
        return ops.changed(before, after), after
    after = ops.cast_expr(plain, step.column, step.target_type, step.formats or None)
    return ops.changed(before, after), after


def clean(df: DataFrame, steps: Sequence[Step | dict]) -> tuple[DataFrame, DataFrame]:
    """Apply the steps in order; returns the cleaned table and one summary row per step.

    Steps whose result is read more than once (duplicate removal, fills along
    an order) are written to shared storage once, so that their shuffle is not
    repeated.
    """
    plan = [Step.of(s) for s in steps]
    schema = df.schema
    for step in plan:
        problem = check_step(schema, step)
        if problem:
            raise TableError(problem)
        schema = schema_after(schema, step)

    account = _Account()
    for n, step in enumerate(plan):
        if step.type in ("clean_text", "cast_type"):
            test, after = _row_wise(df, _plain(df), step)
            df = account.flag(df, n, test)
            df = ops.replace_column(df, step.column, after)
        elif step.type == "fill_missing":
            df = account.flag(df, n, is_missing(df, step.column))
            df = ops.fill_missing(
                df, step.column, step.strategy, step.fill_value, step.order_by, step.partition_by
            )
            if step.strategy in ("ffill", "bfill") and n + 1 < len(plan):
                df = materialize(df, "filled")
        elif step.type == "drop_duplicates":
            df, rows = account.settle(df)
            df = materialize(ops.drop_duplicates(df), "distinct")
            account.affected[n] = rows - df.count()
        else:
            if step.type == "remove_outliers":
                drop = ops.outlier_test(df, step.column, step.strategy)
            else:
                drop = is_missing(df, step.column)
            df, _ = account.settle(df, {n: drop})
            df = df.where(~drop)
    if account.flags:
        df, _ = account.settle(df)

    rows = [
        {
            "step": n,
            "type": s.type,
            "column": s.column,
            "affected": account.affected[n],
            "strategy": s.strategy,
            "target_type": s.target_type,
            "fill_value": None if s.fill_value is None else str(s.fill_value),
        }
        for n, s in enumerate(plan)
    ]
    return df, literal_rows(df.sparkSession, rows, SUMMARY_SCHEMA)


def empty_column_warnings(df: DataFrame) -> DataFrame:
    """Columns without any value."""
    counts = per_column(
        df, df.columns, lambda c: {"present": F.count_if(~is_missing(df, c))}
    )
    return counts.where(F.col("present") == 0).select(
        "column", F.concat(F.lit("column '"), F.col("column"), F.lit("' has no values left")).alias("warning")
    )


def preview(
    df: DataFrame, steps: Sequence[Step | dict], order_by: Sequence[str] = (), sample: int = 10
) -> dict[str, DataFrame]:
    """What a cleaning run would do: totals before and after, changes, warnings, samples."""
    cleaned, summary = clean(df, steps)
    stages = [
        table_profile(t).select(F.lit(stage).alias("stage"), "*") for stage, t in (("before", df), ("after", cleaned))
    ]
    return {
        "stages": stages[0].unionByName(stages[1]),
        "changes": summary,
        "warnings": empty_column_warnings(cleaned),
        "original_sample": head(df, sample, order_by),
        "cleaned_sample": head(cleaned, sample, order_by),
    }


def job_rollup(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of a cleaning run from its step counts (per key, if ``by`` is given)."""
    kind, n = F.col("type"), F.col("affected")

    def total(*types: str) -> Column:
        return F.coalesce(F.sum(F.when(kind.isin(*types), n)), F.lit(0)).cast("bigint")

    return summary.groupBy(*[ref(c) for c in by]).agg(
        total("drop_duplicates", "remove_outliers").alias("rows_removed"),
        total("drop_duplicates").alias("duplicates_removed"),
        total("fill_missing").alias("missing_handled"),
        total("remove_outliers").alias("outliers_handled"),
    )


def clean_totals(summary: DataFrame) -> DataFrame:
    """Affected cells or rows per kind of step."""
    return summary.groupBy("type").agg(F.sum("affected").cast("bigint").alias("affected"))
