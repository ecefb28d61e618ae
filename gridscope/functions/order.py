"""Exact order statistics without sorting a column in one task."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_LIMIT = 20_000
SKETCH_ACCURACY = 10_000


@dataclass
class _Search:
    """The value at `rank` among the rows strictly between `low` and `high`."""

    column: str
    rank: int
    size: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def interior(self) -> Column:
        column = F.col(self.column)
        inside = column.isNotNull()
        if self.low is not None:
            inside = inside & (column > F.lit(self.low))
        if self.high is not None:
            inside = inside & (column < F.lit(self.high))
        return F.when(inside, column)


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    list_limit: int = LIST_LIMIT,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of double columns, exact at any size.

    `percentile` holds every distinct value of a column in one task. Here each
    round takes pivots from the mergeable quantile sketch, counts the rows below
    and at each pivot, and goes on inside one open interval between pivots, which
    is about 1/2500 of the rows before. Counts are exact, so the sketch decides
    only the speed. When at most `list_limit` rows are left they are sorted and
    indexed on an executor; only the chosen numbers reach the driver. A value held
    by many rows becomes a pivot and leaves the interval at once.
    """
    counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    sizes = {c: counts[f"n{i}"] for i, c in enumerate(columns)}

    searches: dict[tuple[str, int], _Search] = {}
    for column in columns:
        for probability in probabilities:
            if sizes[column]:
                place = (sizes[column] - 1) * probability
                for rank in (math.floor(place), math.ceil(place)):
                    searches[column, rank] = _Search(column, rank, sizes[column])

    open_searches = list(searches.values())
    while open_searches:
        wide = [s for s in open_searches if s.size > list_limit]
        _read_off(df, [s for s in open_searches if s.size <= list_limit])
        if wide:
            _narrow(df, wide)
        open_searches = [s for s in wide if s.value is None]

    result: dict[str, list[float | None]] = {}
    for column in columns:
        values: list[float | None] = []
        for probability in probabilities:
            if not sizes[column]:
                values.append(None)
                continue
            place = (sizes[column] - 1) * probability
            low = searches[column, math.floor(place)].value
            high = searches[column, math.ceil(place)].value
            share = place - math.floor(place)
            values.append(low if low == high else low + (high - low) * share)
        result[column] = values
    return result


def _by_interval(searches: list[_Search]) -> list[list[_Search]]:
    groups: dict[tuple, list[_Search]] = {}
    for s in searches:
        groups.setdefault((s.column, s.low, s.high), []).append(s)
    return list(groups.values())


def _read_off(df: DataFrame, searches: list[_Search]) -> None:
    groups = _by_interval(searches)
    if not groups:
        return
    ordered = df.agg(
        *[
            F.sort_array(F.collect_list(group[0].interior())).alias(f"v{i}")
            for i, group in enumerate(groups)
        ]
    )
    row = ordered.select(
        *[
            F.get(F.col(f"v{i}"), s.rank).alias(f"v{i}_{j}")
            for i, group in enumerate(groups)
            for j, s in enumerate(group)
        ]
    ).first()
    for i, group in enumerate(groups):
        for j, s in enumerate(group):
            s.value = row[f"v{i}_{j}"]


def _narrow(df: DataFrame, searches: list[_Search]) -> None:
    margin = 2.0 / SKETCH_ACCURACY
    groups = _by_interval(searches)
    sketches = []
    for i, group in enumerate(groups):
        around = set()
        for s in group:
            place = s.rank / (s.size - 1)
            around |= {max(0.0, place - margin), place, min(1.0, place + margin)}
        sketches.append(
            F.percentile_approx(group[0].interior(), sorted(around), SKETCH_ACCURACY).alias(f"p{i}")
        )
    row = df.agg(*sketches).first()
    pivots = [sorted(set(row[f"p{i}"])) for i in range(len(groups))]

    tallies = []
    for i, group in enumerate(groups):
        inside = group[0].interior()
        for j, pivot in enumerate(pivots[i]):
            tallies.append(F.count_if(inside < F.lit(pivot)).alias(f"below_{i}_{j}"))
            tallies.append(F.count_if(inside == F.lit(pivot)).alias(f"equal_{i}_{j}"))
    row = df.agg(*tallies).first()

    for i, group in enumerate(groups):
        bounds = [
            (pivot, row[f"below_{i}_{j}"], row[f"equal_{i}_{j}"])
            for j, pivot in enumerate(pivots[i])
        ]
        for s in group:
            _place(s, bounds)


def _place(s: _Search, bounds: list[tuple[float, int, int]]) -> None:
    """Move a search to the pivot, or to the gap between pivots, that holds its rank."""
    passed = 0
    for pivot, below, equal in bounds:
        if s.rank < below:
            s.high, s.rank, s.size = pivot, s.rank - passed, below - passed
            return
        if s.rank < below + equal:
            s.value = pivot
            return
        s.low, passed = pivot, below + equal
    s.rank, s.size = s.rank - passed, s.size - passed
