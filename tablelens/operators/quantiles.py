"""Exact quantiles by narrowing, without sorting or shuffling the values.

``percentile`` keeps every distinct value of a column in one aggregation
buffer, which does not fit once a column has billions of them, and sorting the
column would move all of it.  Here each pass is a column-pruned scan with an
ordinary partial aggregation: a bounded KLL sketch proposes two pivots close to
the wanted rank, the next pass counts exactly how many values lie below and on
them, and the open interval that still holds the rank shrinks to about twice
``MARGIN`` of its size.  The pivots are values of the column, so a value held by
a third of the rows becomes a pivot and is then either the answer or outside
the interval.  Once an interval holds at most ``FINAL_VALUES`` values they are
sorted in one small buffer.  The sketch only affects how many passes are
needed, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import TableError
from ..functions.columns import value_of

FINAL_VALUES = 200_000
# Values that one aggregation may buffer, and intervals it may count, over all columns.
BUFFERED_VALUES = 1_000_000
INTERVALS_PER_SCAN = 24
SKETCH_SIZE = 2_000
MARGIN = 1.0 / 300
# Sketches of all tasks are merged in this many groups before the last merge.
MERGE_GROUPS = 256


@dataclass
class _Search:
    """The open interval that still holds the value of one rank (0-based)."""

    column: str
    rank: int
    inside: int
    below: int = 0
    low: Any = None
    high: Any = None
    answer: Any = None
    done: bool = False

    @property
    def interval(self):
        return (self.column, self.low, self.high)

    @property
    def bounded(self) -> bool:
        return self.low is not None or self.high is not None

    def settle(self, value) -> None:
        self.answer, self.done = value, True


def _integral(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.IntegralType)


def _number(df: DataFrame, column: str) -> Column:
    return value_of(df, column).cast("bigint" if _integral(df, column) else "double")


def _test(df: DataFrame, s: _Search) -> Column:
    c = _number(df, s.column)
    keep = c.isNotNull()
    if s.low is not None:
        keep = keep & (c > F.lit(s.low))
    if s.high is not None:
        keep = keep & (c < F.lit(s.high))
    return keep


def _inside(df: DataFrame, s: _Search) -> Column:
    if s.low is None and s.high is None:
        return _number(df, s.column)
    return F.when(_test(df, s), _number(df, s.column))


def _by_interval(searches: list[_Search]) -> list[list[_Search]]:
    shared: dict[tuple, list[_Search]] = {}
    for s in searches:
        shared.setdefault(s.interval, []).append(s)
    return list(shared.values())


def _read_small(df: DataFrame, groups: list[list[_Search]]) -> None:
    """Sort the few values left in each interval and pick the ranks."""
    wanted = reduce(lambda a, b: a | b, [_test(df, g[0]) for g in groups])
    ordered = df.where(wanted).agg(
        *[F.sort_array(F.collect_list(_inside(df, g[0]))).alias(f"v{i}") for i, g in enumerate(groups)]
    )
    picks = [
        F.element_at(F.col(f"v{i}"), s.rank - s.below + 1).alias(f"p{i}_{j}")
        for i, g in enumerate(groups)
        for j, s in enumerate(g)
    ]
    row = ordered.select(*picks).first()
    for s, value in zip([s for g in groups for s in g], row):
        s.settle(value)


def sketch_quantiles(
    df: DataFrame, asked: Sequence[tuple[str, Column, Sequence[float]]]
) -> list[tuple[int, list]]:
    """Exact count and approximate quantiles of several expressions from one scan.

    The sketches of the tasks meet in ``MERGE_GROUPS`` places first, so that no
    single task merges one sketch per input split.
    """
    kinds = ["bigint" if _integral(df, column) else "double" for column, _, _ in asked]
    grouped = df.groupBy((F.spark_partition_id() % MERGE_GROUPS).alias("__group")).agg(
        *[
            getattr(F, f"kll_sketch_agg_{kind}")(expr, F.lit(SKETCH_SIZE)).alias(f"s{i}")
            for i, (kind, (_, expr, _)) in enumerate(zip(kinds, asked))
        ]
    )
    merged = grouped.agg(
        *[getattr(F, f"kll_merge_agg_{kind}")(f"s{i}", SKETCH_SIZE).alias(f"s{i}") for i, kind in enumerate(kinds)]
    )
    fields = []
    for i, (kind, (_, _, probs)) in enumerate(zip(kinds, asked)):
        n = F.coalesce(getattr(F, f"kll_sketch_get_n_{kind}")(f"s{i}"), F.lit(0))
        ranks = F.array(*[F.lit(float(p)) for p in probs])
        found = getattr(F, f"kll_sketch_get_quantile_{kind}")(F.col(f"s{i}"), ranks)
        fields += [n.alias(f"n{i}"), F.when(n > 0, found).alias(f"q{i}")]
    row = merged.select(*fields).first()
    return [(row[f"n{i}"], list(row[f"q{i}"] or [])) for i in range(len(asked))]


def _around(places: Sequence[float]) -> list[float]:
    return sorted({p for x in places for p in (max(0.0, x - MARGIN), min(1.0, x + MARGIN))})


def _narrow(df: DataFrame, groups: list[list[_Search]], proposed: dict[str, list]) -> None:
    """Propose pivots per interval, then count exactly around them.

    Pivots ``proposed`` for whole columns save the first proposal.
    """
    pivots: list[list] = [[] if g[0].bounded else proposed.get(g[0].column, []) for g in groups]
    open_ = [i for i, ps in enumerate(pivots) if not ps]
    asked = [
        (g[0].column, _inside(df, g[0]), _around([(s.rank - s.below + 0.5) / s.inside for s in g]))
        for g in (groups[i] for i in open_)
    ]
    for i, (_, values) in zip(open_, sketch_quantiles(df, asked) if asked else []):
        pivots[i] = values
    pivots = [sorted(set(values)) for values in pivots]

    counts = []
    for i, (g, ps) in enumerate(zip(groups, pivots)):
        x = _inside(df, g[0])
        for j, p in enumerate(ps):
            counts += [F.count_if(x < F.lit(p)).alias(f"lt{i}_{j}"), F.count_if(x <= F.lit(p)).alias(f"le{i}_{j}")]
    found = df.agg(*counts).first()

    for i, (g, ps) in enumerate(zip(groups, pivots)):
        for s in g:
            _place(s, ps, [(found[f"lt{i}_{j}"], found[f"le{i}_{j}"]) for j in range(len(ps))])


def _place(s: _Search, pivots: list, counts: list[tuple[int, int]]) -> None:
    """Settle on a pivot or shrink to the gap between two of them."""
    at, start = s.rank - s.below, 0
    for pivot, (less, up_to) in zip(pivots, counts):
        if at < less:
            s.high, s.inside = pivot, less - start
            break
        if at < up_to:
            s.settle(pivot)
            return
        s.low, start = pivot, up_to
    else:
        s.inside -= start
    s.below += start
    if s.inside <= 0:
        raise TableError("the table returned different rows in two scans; write it down first")


def _batches(groups: list, cost, limit: int) -> list[list]:
    """Cut a list into runs whose cost stays within the limit (at least one item each).

    Very wide tables take several scans this way, each of its own columns only.
    """
    out: list[list] = []
    used = 0
    for g in groups:
        if not out or used + cost(g) > limit:
            out.append([])
            used = 0
        out[-1].append(g)
        used += cost(g)
    return out


def order_statistics(
    df: DataFrame,
    wanted: dict[str, Sequence[int]],
    counts: dict[str, int],
    final: int = FINAL_VALUES,
    proposed: dict[str, list] | None = None,
) -> dict[tuple[str, int], Any]:
    """Value at each 0-based rank of each column (missing values excluded).

    Only pivots and counts, a handful per rank, reach the driver.
    """
    searches = [
        _Search(column, rank, counts[column]) for column, ranks in wanted.items() for rank in sorted(set(ranks))
    ]
    while open_ := [s for s in searches if not s.done]:
        groups = _by_interval(open_)
        for batch in _batches([g for g in groups if g[0].inside <= final], lambda g: g[0].inside, BUFFERED_VALUES):
            _read_small(df, batch)
        for batch in _batches([g for g in groups if g[0].inside > final], lambda g: 1, INTERVALS_PER_SCAN):
            _narrow(df, batch, proposed or {})
    return {(s.column, s.rank): s.answer for s in searches}


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], final: int = FINAL_VALUES
) -> dict[str, dict[float, float | None]]:
    """Linear-interpolated quantiles per column, null for a column without values."""
    if not columns:
        return {}
    narrow = df.select(*dict.fromkeys(columns))
    counts, proposed = {}, {}
    for i in range(0, len(columns), INTERVALS_PER_SCAN):
        batch = columns[i : i + INTERVALS_PER_SCAN]
        found = sketch_quantiles(narrow, [(c, _number(narrow, c), _around(probs)) for c in batch])
        for c, (n, pivots) in zip(batch, found):
            counts[c], proposed[c] = n, pivots
    wanted: dict[str, list[int]] = {}
    for c in columns:
        if counts[c]:
            positions = [p * (counts[c] - 1) for p in probs]
            wanted[c] = [r for x in positions for r in (math.floor(x), math.ceil(x))]
    values = order_statistics(narrow, wanted, counts, final, proposed)
    out: dict[str, dict[float, float | None]] = {}
    for c in columns:
        out[c] = {}
        for p in probs:
            if not counts[c]:
                out[c][p] = None
                continue
            x = p * (counts[c] - 1)
            low, high = float(values[c, math.floor(x)]), float(values[c, math.ceil(x)])
            out[c][p] = low if low == high else low + (high - low) * (x - math.floor(x))
    return out


def approximate_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float]
) -> dict[str, dict[float, float | None]]:
    """Sketch quantiles of all columns from one scan."""
    if not columns:
        return {}
    found = sketch_quantiles(df, [(c, _number(df, c), probs) for c in columns])
    return {
        c: {p: float(v) for p, v in zip(probs, values)} if n else dict.fromkeys(probs)
        for c, (n, values) in zip(columns, found)
    }


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], exact: bool = True):
    return exact_quantiles(df, columns, probs) if exact else approximate_quantiles(df, columns, probs)
