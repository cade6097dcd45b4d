"""Exact quantiles without collecting or sorting a column in one task.

The engine's exact percentile keeps every distinct value of a column in a single buffer. Here a
mergeable sketch proposes a bracket around each wanted rank, a counting scan proves where the
rank lies, and the bracket shrinks by a factor of some hundreds per scan until few enough rows are
left to rank exactly. Wrong proposals only cost another scan; they never change the result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRID = 256
SKETCH_ACCURACY = 10_000
RANK_DIRECTLY = 500_000


@dataclass
class _Target:
    column: str
    rank: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0
    answer: float | None = None

    @property
    def bracket(self):
        return (self.column, self.low, self.high)


def _ranked_as(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.IntegralType):
        return T.LongType()
    return kind if isinstance(kind, T.DecimalType) else T.DoubleType()


def _inside(value: Column, low: float | None, high: float | None) -> Column:
    test = value.isNotNull()
    if low is not None:
        test = test & (value > low)
    if high is not None:
        test = test & (value < high)
    return test


Number = int | float | Decimal


def _between(lower: Number, upper: Number, part: float) -> Number:
    """Linear interpolation; whole numbers and decimals lose no digit."""
    if part == 0 or lower == upper:
        return lower
    if isinstance(lower, float):
        return lower + (upper - lower) * part
    with localcontext(prec=80):
        return Decimal(lower) + (Decimal(upper) - Decimal(lower)) * Decimal(part)


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[Number | None]]:
    """Linearly interpolated quantiles of numeric columns; NULL-only columns give None.

    Whole numbers and decimals are ranked in their own type.
    """
    columns = list(wanted)
    if not columns:
        return {}
    values = df.select(*[F.col(c).cast(_ranked_as(df.schema[c].dataType)).alias(c) for c in columns])
    counts = values.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    size = {c: counts[f"c{i}"] for i, c in enumerate(columns)}

    targets: dict[tuple[str, int], _Target] = {}
    for column, probs in wanted.items():
        for prob in probs if size[column] else ():
            position = (size[column] - 1) * prob
            for rank in {math.floor(position), math.ceil(position)}:
                targets[column, rank] = _Target(column, rank, inside=size[column])

    open_targets = [t for t in targets.values() if t.inside > RANK_DIRECTLY]
    while open_targets:
        _narrow(values, open_targets)
        open_targets = [t for t in open_targets if t.answer is None and t.inside > RANK_DIRECTLY]
    _rank_directly(values, [t for t in targets.values() if t.answer is None])

    out: dict[str, list[Number | None]] = {}
    for column, probs in wanted.items():
        out[column] = []
        for prob in probs:
            if not size[column]:
                out[column].append(None)
                continue
            position = (size[column] - 1) * prob
            lower = targets[column, math.floor(position)].answer
            upper = targets[column, math.ceil(position)].answer
            part = position - math.floor(position)
            out[column].append(_between(lower, upper, part))
    return out


def _narrow(values: DataFrame, targets: list[_Target]) -> None:
    """One sketch scan proposing tighter brackets, one counting scan proving them."""
    brackets = list({t.bracket for t in targets})
    steps = [i / GRID for i in range(GRID + 1)]
    sketches = values.agg(*[
        F.percentile_approx(
            F.when(_inside(F.col(c), lo, hi), F.col(c)), steps, SKETCH_ACCURACY
        ).alias(f"g{i}")
        for i, (c, lo, hi) in enumerate(brackets)
    ]).first()
    grid = {b: sketches[f"g{i}"] for i, b in enumerate(brackets)}

    proposals: list[tuple[float, float]] = []
    for t in targets:
        points = grid[t.bracket]
        share = (t.rank - t.below) / t.inside
        left = max(0, math.floor(share * GRID) - 1)
        right = min(GRID, math.ceil(share * GRID) + 1)
        proposals.append((points[left], points[right]))

    checks = values.agg(*[
        F.struct(
            F.count_if(F.col(t.column) < lo).alias("lt_lo"),
            F.count_if(F.col(t.column) <= lo).alias("le_lo"),
            F.count_if(F.col(t.column) < hi).alias("lt_hi"),
            F.count_if(F.col(t.column) <= hi).alias("le_hi"),
        ).alias(f"p{i}")
        for i, (t, (lo, hi)) in enumerate(zip(targets, proposals))
    ]).first()
    for i, (t, (lo, hi)) in enumerate(zip(targets, proposals)):
        seen = checks[f"p{i}"]
        if seen.lt_lo <= t.rank < seen.le_lo:
            t.answer = lo
        elif seen.lt_hi <= t.rank < seen.le_hi:
            t.answer = hi
        elif t.rank < seen.lt_lo:
            t.high, t.inside = lo, seen.lt_lo - t.below
        elif t.rank >= seen.le_hi:
            t.inside -= seen.le_hi - t.below
            t.low, t.below = hi, seen.le_hi
        else:
            t.low, t.high, t.below, t.inside = lo, hi, seen.le_lo, seen.lt_hi - seen.le_lo


def _rank_directly(values: DataFrame, targets: list[_Target]) -> None:
    """Rank the few rows left in each bracket; distinct values are folded before the window."""
    if not targets:
        return
    kinds = {t.column: values.schema[t.column].dataType for t in targets}
    for kind in set(kinds.values()):
        _rank_one_kind(values, [t for t in targets if kinds[t.column] == kind])


def _rank_one_kind(values: DataFrame, targets: list[_Target]) -> None:
    brackets = list({t.bracket for t in targets})
    numbers = {b: i for i, b in enumerate(brackets)}
    tagged = values.select(F.inline(F.array_compact(F.array(*[
        F.when(
            _inside(F.col(c), lo, hi),
            F.struct(F.lit(i).alias("bracket"), F.col(c).alias("value")),
        )
        for i, (c, lo, hi) in enumerate(brackets)
    ]))))
    folded = tagged.groupBy("bracket", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("bracket").orderBy("value")
    ranked = folded.withColumn("upto", F.sum("n").over(order))
    hit = F.lit(False)
    for t in targets:
        offset = t.rank - t.below
        hit = hit | (
            (F.col("bracket") == numbers[t.bracket])
            & (F.col("upto") > offset) & (F.col("upto") - F.col("n") <= offset)
        )
    found = ranked.where(hit).select("bracket", "value", "n", "upto").collect()
    for t in targets:
        offset = t.rank - t.below
        for row in found:
            if row.bracket == numbers[t.bracket] and row.upto - row.n <= offset < row.upto:
                t.answer = row.value
