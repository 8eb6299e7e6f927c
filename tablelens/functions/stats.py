"""Statistical aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the quality score.
MISSING_WEIGHT = 50.0
DUPLICATE_WEIGHT = 50.0


def skewness_adj(c: Column) -> Column:
    """Bias-corrected sample skewness: null below 3 values, 0 for a constant."""
    n = F.count(c).cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, F.coalesce(factor * F.skewness(c), F.lit(0.0)))


def kurtosis_adj(c: Column) -> Column:
    """Bias-corrected excess kurtosis: null below 4 values, 0 for a constant."""
    n = F.count(c).cast("double")
    factor = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n >= 4, F.coalesce(factor * ((n + 1) * F.kurtosis(c) + 6), F.lit(0.0)))


def pearson(a: Column, b: Column) -> Column:
    """Pairwise-complete correlation; null where either side is constant.

    ``corr`` raises on a constant column under ANSI rules, hence the guarded
    quotient of its parts.  Deviations of a constant need not be exactly 0
    after tasks' parts are merged, so least and greatest value tell.
    """
    a_pair = F.when(b.isNotNull(), a)
    b_pair = F.when(a.isNotNull(), b)
    varied = (F.min(a_pair) < F.max(a_pair)) & (F.min(b_pair) < F.max(b_pair))
    return F.when(varied, F.try_divide(F.covar_pop(a_pair, b_pair), F.stddev_pop(a_pair) * F.stddev_pop(b_pair)))


def quality(
    rows: Column,
    cells: Column,
    missing: Column,
    duplicates: Column,
    w_missing: float = MISSING_WEIGHT,
    w_dup: float = DUPLICATE_WEIGHT,
) -> Column:
    """Score 0..100: full marks less the weighted missing and duplicate shares."""
    lost = F.coalesce(F.try_divide(missing, cells), F.lit(0.0)) * w_missing + F.coalesce(
        F.try_divide(duplicates, rows), F.lit(0.0)
    ) * w_dup
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - lost))


def percent(part: Column, whole: Column) -> Column:
    """Percentage, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))
