"""Rule-based findings about a table, their ranking, health label and repairs.

The rules read the small result tables of profile and exploration (one row per
column or pair), so their own work does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.columns import numeric_columns
from ..operators import explore, profile
from ..operators.frequency import literal_rows, value_summary
from ..operators.quantiles import quantiles
from ..session import materialize

# Rule, order of evaluation, category, confidence, actionability.
RULES = (
    ("QUAL_001", 1, "Quality", 0.98, 0.90),
    ("QUAL_002", 2, "Quality", 0.99, 0.95),
    ("OUT_003", 3, "Risk", 0.92, 0.85),
    ("CORR_004", 4, "Correlation", 0.95, 0.70),
    ("CARD_005", 5, "Statistics", 0.90, 0.60),
    ("TEMP_006", 6, "Timeline", 0.95, 0.50),
)
# Weight of each severity in the ranking.
SEVERITIES = (("CRITICAL", 5), ("HIGH", 4), ("MEDIUM", 3), ("LOW", 2), ("INFO", 1))
# Thresholds of the rules.
MISSING_CRITICAL, MISSING_HIGH = 20.0, 10.0
DUPLICATES_HIGH = 10.0
OUTLIERS_HIGH = 5.0
CORRELATION_STRONG, CORRELATION_HIGH = 0.5, 0.8
CARDINALITY_RATIO, CARDINALITY_COUNT = 0.5, 10
WORST_COLUMNS, STRONG_PAIRS, WIDE_COLUMNS = 3, 5, 3

REPAIR = "array<struct<type string, column string, strategy string, target_type string>>"


def _first_k(df: DataFrame, test: Column, order: Sequence[Column], fields: Sequence[Column], k: int | None) -> Column:
    """The first ``k`` rows in order as an array; the input has one row per column or pair."""
    rows = F.sort_array(F.collect_list(F.when(test, F.struct(*order, *fields))))
    return F.slice(rows, 1, k) if k else rows


def _repairs(columns: Column, kind: str, strategy: str | None = None, target: str | None = None) -> Column:
    return F.transform(
        columns,
        lambda c: F.struct(
            F.lit(kind).alias("type"),
            c["column"].alias("column"),
            F.lit(strategy).cast("string").alias("strategy"),
            F.lit(target).cast("string").alias("target_type"),
        ),
    ).cast(REPAIR)


def _listing(items: Column, text) -> Column:
    return F.array_join(F.transform(items, text), ", ")


def _evidence(items: Column, name, value) -> Column:
    return F.map_from_entries(
        F.transform(items, lambda c: F.struct(name(c).alias("key"), value(c).cast("double").alias("value")))
    )


def _finding(df: DataFrame, rule: str, severity: Column, observation: Column, detail: Column,
             recommendation: str, evidence: Column, repairs: Column) -> DataFrame:
    category = next(r[2] for r in RULES if r[0] == rule)
    return df.select(
        F.lit(rule).alias("rule_id"),
        F.lit(category).alias("category"),
        severity.alias("severity"),
        observation.alias("observation"),
        detail.alias("detail"),
        F.lit(recommendation).alias("recommendation"),
        evidence.alias("evidence"),
        repairs.alias("repairs"),
    )


def rule_missing(table: DataFrame, columns: DataFrame) -> DataFrame:
    """Missing cells, naming the three columns that have most of them."""
    worst = columns.agg(
        _first_k(
            columns,
            F.col("missing_count") > 0,
            [(-F.col("missing_count")).alias("rank"), F.col("position")],
            [F.col("column"), F.col("missing_count").alias("n")],
            WORST_COLUMNS,
        )
    ).scalar()
    df = table.where(F.col("missing_cells") > 0).select(
        "missing_cells",
        stats.percent(F.col("missing_cells"), F.col("rows") * F.col("columns")).alias("pct"),
        worst.alias("worst"),
    )
    severity = (
        F.when(F.col("pct") > MISSING_CRITICAL, "CRITICAL").when(F.col("pct") > MISSING_HIGH, "HIGH").otherwise("MEDIUM")
    )
    return _finding(
        df,
        "QUAL_001",
        severity,
        F.format_string("%.2f%% of the cells are missing.", "pct"),
        F.concat(
            F.col("missing_cells").cast("string"),
            F.lit(" cells are empty, most of them in "),
            _listing(F.col("worst"), lambda c: F.concat(c["column"], F.lit(" ("), c["n"].cast("string"), F.lit(")"))),
        ),
        "Fill the gaps; for numbers the median is a safe choice.",
        F.map_concat(
            F.create_map(
                F.lit("missing_count"), F.col("missing_cells").cast("double"), F.lit("missing_percentage"), F.col("pct")
            ),
            _evidence(F.col("worst"), lambda c: F.concat(F.lit("column:"), c["column"]), lambda c: c["n"]),
        ),
        _repairs(F.col("worst"), "fill_missing", "median"),
    )


def rule_duplicates(table: DataFrame) -> DataFrame:
    """Exact duplicate rows."""
    df = table.where(F.col("duplicate_rows") > 0).select(
        "duplicate_rows", stats.percent(F.col("duplicate_rows"), F.col("rows")).alias("pct")
    )
    repair = F.array(
        F.struct(*[F.lit(v).cast("string").alias(n) for n, v in (
            ("type", "drop_duplicates"), ("column", None), ("strategy", None), ("target_type", None))])
    ).cast(REPAIR)
    return _finding(
        df,
        "QUAL_002",
        F.when(F.col("pct") > DUPLICATES_HIGH, "HIGH").otherwise("MEDIUM"),
        F.format_string("%.2f%% of the rows repeat another row.", "pct"),
        F.concat(F.col("duplicate_rows").cast("string"), F.lit(" rows are copies, perhaps from loading data twice")),
        "Drop duplicate rows before computing statistics.",
        F.create_map(
            F.lit("duplicate_rows"), F.col("duplicate_rows").cast("double"), F.lit("duplicate_percentage"), F.col("pct")
        ),
        repair,
    )


def rule_outliers(outliers: DataFrame) -> DataFrame:
    """Numeric columns with values outside the fences, the three worst by count."""
    df = outliers.agg(
        _first_k(
            outliers,
            F.col("outlier_count") > 0,
            [(-F.col("outlier_count")).alias("rank"), F.col("position")],
            [F.col("column"), F.col("outlier_count").alias("n"), F.col("outlier_pct").alias("pct")],
            WORST_COLUMNS,
        ).alias("worst")
    ).where(F.size("worst") > 0)
    return _finding(
        df,
        "OUT_003",
        F.when(F.col("worst")[0]["pct"] > OUTLIERS_HIGH, "HIGH").otherwise("MEDIUM"),
        F.lit("Numeric columns contain outliers."),
        F.concat(
            F.lit("Values lie beyond 1.5 interquartile ranges in "),
            _listing(
                F.col("worst"),
                lambda c: F.concat(c["column"], F.lit(" ("), c["n"].cast("string"), F.format_string(", %.1f%%)", c["pct"])),
            ),
        ),
        "Check whether these are faults or rare events; trim them by the fences if they are faults.",
        _evidence(F.col("worst"), lambda c: c["column"], lambda c: c["pct"]),
        _repairs(F.col("worst"), "remove_outliers", "iqr"),
    )


def rule_correlation(pairs: DataFrame) -> DataFrame:
    """Strongly related column pairs, the first five in column order."""
    df = pairs.agg(
        _first_k(
            pairs,
            F.abs("coefficient") >= CORRELATION_STRONG,
            [F.col("pair")],
            [F.col("column1"), F.col("column2"), F.col("coefficient").alias("r")],
            STRONG_PAIRS,
        ).alias("strong")
    ).where(F.size("strong") > 0)
    high = F.exists("strong", lambda c: F.abs(c["r"]) >= CORRELATION_HIGH)
    return _finding(
        df,
        "CORR_004",
        F.when(high, "HIGH").otherwise("MEDIUM"),
        F.lit("Numeric columns depend linearly on each other."),
        F.concat(
            F.lit("Strong Pearson correlation: "),
            _listing(
                F.col("strong"),
                lambda c: F.concat(c["column1"], F.lit(" & "), c["column2"], F.format_string(" (r=%.2f)", c["r"])),
            ),
        ),
        "Drop one column of each pair or reduce dimensions before modelling.",
        _evidence(
            F.col("strong"), lambda c: F.concat(c["column1"], F.lit(" & "), c["column2"]), lambda c: c["r"]
        ),
        F.array().cast(REPAIR),
    )


def rule_cardinality(categorical: DataFrame) -> DataFrame:
    """Categorical columns in which most values differ, the first three."""
    df = categorical.agg(
        _first_k(
            categorical,
            (F.col("cardinality_ratio") > CARDINALITY_RATIO) & (F.col("unique_count") > CARDINALITY_COUNT),
            [F.col("position")],
            [F.col("column"), F.col("unique_count").alias("n"), F.col("cardinality_ratio").alias("ratio")],
            WIDE_COLUMNS,
        ).alias("wide")
    ).where(F.size("wide") > 0)
    return _finding(
        df,
        "CARD_005",
        F.lit("LOW"),
        F.lit("Categorical columns hold mostly distinct values."),
        F.concat(
            F.lit("These look like labels or identifiers: "),
            _listing(
                F.col("wide"),
                lambda c: F.concat(
                    c["column"], F.lit(" ("), c["n"].cast("string"), F.format_string(" values, %.1f%%)", c["ratio"] * 100)
                ),
            ),
        ),
        "Keep them as text, or group their values before using them as categories.",
        _evidence(F.col("wide"), lambda c: c["column"], lambda c: c["ratio"]),
        _repairs(F.col("wide"), "cast_type", target="string"),
    )


def rule_timeline(datetimes: DataFrame) -> DataFrame:
    """Date columns and the time they cover."""
    df = datetimes.agg(
        _first_k(
            datetimes,
            F.lit(True),
            [F.col("position")],
            [F.col("column"), F.col("span_days").alias("days"), F.col("earliest_date"), F.col("latest_date")],
            None,
        ).alias("dates")
    ).where(F.size("dates") > 0)
    return _finding(
        df,
        "TEMP_006",
        F.lit("INFO"),
        F.lit("Date columns cover a period of time."),
        _listing(
            F.col("dates"),
            lambda c: F.concat(
                c["column"],
                F.format_string(": %.1f days", c["days"]),
                F.lit(" from "), c["earliest_date"], F.lit(" to "), c["latest_date"],
            ),
        ),
        "For seasonal forecasts make sure that a whole cycle is covered.",
        _evidence(F.col("dates"), lambda c: c["column"], lambda c: c["days"]),
        F.array().cast(REPAIR),
    )


def rule_scores(spark: SparkSession) -> DataFrame:
    rows = [dict(zip(("rule_id", "rule_order", "category", "confidence", "actionability"), r)) for r in RULES]
    return literal_rows(
        spark, rows, "rule_id string, rule_order int, category string, confidence double, actionability double"
    )


def with_scores(findings: DataFrame) -> DataFrame:
    """Add each rule's confidence and actionability."""
    scores = rule_scores(findings.sparkSession).drop("category")
    return findings.join(scores, "rule_id")


def severity_weight(severity: Column) -> Column:
    weight = F.lit(0)
    for name, value in SEVERITIES:
        weight = F.when(severity == name, value).otherwise(weight)
    return weight


def rank(findings: DataFrame) -> DataFrame:
    """Most severe first; equal severities keep the order of the rules."""
    scored = findings if "rule_order" in findings.columns else with_scores(findings)
    return scored.orderBy(severity_weight(F.col("severity")).desc(), "rule_order")


def health(findings: DataFrame, table: DataFrame) -> DataFrame:
    """Health label, quality score and the number of findings per severity."""
    names = [name.lower() for name, _ in SEVERITIES]
    counts = findings.agg(
        F.struct(
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col("severity") == n.upper()).alias(n) for n in names],
        )
    ).scalar()
    df = table.select("quality_score", counts.alias("n"))
    q, n = F.col("quality_score"), F.col("n")
    label = (
        F.when((n["critical"] > 0) | (q < 50), "CRITICAL")
        .when((n["high"] > 2) | (q < 70), "POOR")
        .when((n["high"] > 0) | (q < 85), "FAIR")
        .when((q >= 95) & (n["medium"] == 0), "EXCELLENT")
        .otherwise("GOOD")
    )
    return df.select(
        label.alias("overall_health"), "quality_score", n["total"].alias("total_findings"), *[n[x].alias(x) for x in names]
    )


def context_text(table: DataFrame, columns: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """A text summary of shape, quality, columns and strong correlations."""
    column_lines = columns.agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("position"),
                    F.concat(
                        F.lit("- "), F.col("column"), F.lit(": type "), F.col("dtype"),
                        F.lit(", distinct "), F.col("unique_count").cast("string"),
                        F.lit(", missing "), F.col("missing_count").cast("string"),
                    ).alias("line"),
                )
            )
        )
    ).scalar()
    pair_lines = pairs.agg(
        F.sort_array(
            F.collect_list(
                F.when(
                    F.abs("coefficient") >= CORRELATION_STRONG,
                    F.struct(
                        F.col("pair"),
                        F.concat(
                            F.lit("- "), F.col("column1"), F.lit(" & "), F.col("column2"),
                            F.format_string(": r=%.2f", "coefficient"),
                        ).alias("line"),
                    ),
                )
            )
        )
    ).scalar()
    head = F.array(
        F.lit(f"Table {name}"),
        F.concat(F.lit("rows "), F.col("rows").cast("string"), F.lit(", columns "), F.col("columns").cast("string")),
        F.format_string("quality %.1f/100", "quality_score"),
        F.concat(F.lit("missing cells "), F.col("missing_cells").cast("string")),
        F.concat(F.lit("duplicate rows "), F.col("duplicate_rows").cast("string")),
        F.lit("Columns:"),
    )
    df = table.select(
        "rows", "columns", "quality_score", head.alias("head"), column_lines.alias("cols"), pair_lines.alias("pairs")
    )
    lines = F.concat(
        F.col("head"),
        F.transform("cols", lambda c: c["line"]),
        F.when(F.size("pairs") > 0, F.array(F.lit("Strong correlations:"))).otherwise(F.array().cast("array<string>")),
        F.transform("pairs", lambda c: c["line"]),
    )
    return df.select(
        F.lit(name).alias("dataset_name"), "rows", "columns", "quality_score", F.array_join(lines, "\n").alias("context")
    )


class Statistics:
    """The result tables that the rules, the report and the health label share.

    Quartiles, value frequencies and date detection run once for all of them.  Each result has a
    row per column, value or pair; it is written once and read from then on.
    """

    def __init__(self, df: DataFrame, exact: bool = True) -> None:
        numbers = numeric_columns(df)
        quarts = quantiles(df, numbers, explore.QUARTILES, exact)
        dates = profile.date_columns(df)
        labels = [c for c in df.columns if c not in numbers and c not in dates]
        values = materialize(value_summary(df, df.columns), "values")
        keep = {
            "table": explore.overview(df),
            "columns": profile.column_profile(df, exact, quarts, dates, values),
            "numeric": explore.describe_numeric(df, numbers, exact, quarts, values),
            "outliers": explore.outlier_summary(df, numbers, exact=exact, quarts=quarts),
            "pairs": explore.correlations(df, numbers),
            "categorical": explore.describe_categorical(df, labels, values),
            "datetimes": explore.describe_datetime(df, dates),
        }
        for name, result in keep.items():
            setattr(self, name, materialize(result, name))

    def findings(self) -> DataFrame:
        parts = [
            rule_missing(self.table, self.columns),
            rule_duplicates(self.table),
            rule_outliers(self.outliers),
            rule_correlation(self.pairs),
            rule_cardinality(self.categorical),
            rule_timeline(self.datetimes),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return with_scores(out)


def findings(df: DataFrame, exact: bool = True) -> DataFrame:
    """All rules over a table."""
    return Statistics(df, exact).findings()


def recommend(ranked: DataFrame) -> DataFrame:
    """The proposed cleaning steps in order of urgency."""
    weight = severity_weight(F.col("severity"))
    return ranked.select(
        weight.alias("weight"), "rule_order", "rule_id", F.posexplode("repairs").alias("place", "repair")
    ).select("rule_id", "weight", "rule_order", "place", "repair.*")


def steps_of(recommended: DataFrame) -> list[dict]:
    """The steps as input for a cleaning run; a few rows at most."""
    rows = recommended.orderBy(F.desc("weight"), "rule_order", "place").collect()
    return [
        {k: r[k] for k in ("type", "column", "strategy", "target_type") if r[k] is not None} for r in rows
    ]
