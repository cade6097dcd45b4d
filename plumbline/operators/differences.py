"""Where two tables differ: a tree of checksums over ranges of the key, followed only where they disagree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ranges compared at once, and how many ranges of the key a scan may be asked for.
BUCKETS = 4096
RANGES = 64


@dataclass
class Range:
    low: int
    high: int

    @property
    def width(self) -> int:
        return self.high - self.low + 1


def _place(df: DataFrame, key: str) -> Column:
    """The whole number by which keys are laid out; keys of other types lie by their hash."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(key).cast("long")
    return F.unix_date(F.col(key)).cast("long") if isinstance(kind, T.DateType) else F.xxhash64(key)


def _within(ranges: list[Range], place: Column) -> Column:
    """Rows of the ranges, and rows without a key, which lie nowhere."""
    inside = place.isNull()
    for r in ranges:
        inside = inside | ((place >= r.low) & (place <= r.high))
    return inside


def _offset(ranges: list[Range], place: Column) -> Column:
    """The place counted over the ranges alone, end to end; null outside."""
    before, out = 0, F.lit(None).cast("decimal(20,0)")
    for r in ranges:
        inside = (place >= r.low) & (place <= r.high)
        out = F.when(inside, place.cast("decimal(20,0)") - r.low + before).otherwise(out)
        before += r.width
    return out


def _sums(df: DataFrame, columns: list[str], *by: Column) -> DataFrame:
    """Number of rows and two order-free checksums of them for each group."""
    row = F.xxhash64(*columns)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s"))


def _merged(ranges: list[Range], most: int) -> list[Range]:
    """At most ``most`` ranges that cover the given ones; those with the smallest gaps become one."""
    ranges = sorted(ranges, key=lambda r: r.low)
    gaps = sorted(range(1, len(ranges)), key=lambda i: ranges[i].low - ranges[i - 1].high, reverse=True)
    cuts = sorted(i for i in gaps[:most - 1] if ranges[i].low - ranges[i - 1].high > 1)
    parts = [ranges[a:b] for a, b in zip([0, *cuts], [*cuts, len(ranges)])]
    return [Range(p[0].low, max(r.high for r in p)) for p in parts if p]


def differing_ranges(source: DataFrame, target: DataFrame, key: str, columns: list[str], buckets: int = BUCKETS) -> list[Range]:
    """Ranges of the key outside of which both tables agree.

    Each level reads both tables in the ranges that are left and compares the checksums of equal parts of them: ``buckets`` rows,
    however large the tables. It ends when parts are single keys or most of what is read differs.
    """
    ends = None
    for df in (source, target):
        place = _place(df, key)
        row = df.agg(F.min(place).alias("low"), F.max(place).alias("high"))
        ends = row if ends is None else ends.unionByName(row)
    first = ends.agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    if first.low is None:
        return []
    ranges = [Range(first.low, first.high)]
    while ranges:
        total = sum(r.width for r in ranges)
        width = -(-total // buckets)
        sides = []
        for df, name in ((source, "a"), (target, "b")):
            place = _place(df, key)
            part = F.floor(_offset(ranges, place) / F.lit(width).cast("decimal(20,0)")).cast("long").alias("part")
            rows = df.where(_within(ranges, place) & place.isNotNull())
            sides.append(_sums(rows, columns, part).select("part", F.struct("n", "x", "s").alias(name)))
        apart = sides[0].join(sides[1], "part", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("part")
        found = []
        for part in sorted(r.part for r in apart.collect()):
            before = 0
            low, high = part * width, (part + 1) * width - 1
            for r in ranges:
                lo, hi = max(low - before, 0), min(high - before, r.width - 1)
                if lo <= hi:
                    found.append(Range(r.low + lo, r.low + hi))
                before += r.width
        ranges = _merged(found, RANGES)
        if width == 1 or 2 * sum(r.width for r in ranges) > total:
            break
    return ranges


def differing_keys(source: DataFrame, target: DataFrame, key: str, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(key, finding, source_rows, target_rows): keys whose rows differ, MISSING in the target, EXTRA or CHANGED.

    Only ranges with different checksums are read in full. Rows of equal keys are compared as a whole, whatever
    their order; a null key is a key.
    """
    ranges = differing_ranges(source, target, key, columns, buckets)
    sides = []
    for df, name in ((source, "a"), (target, "b")):
        rows = df.where(_within(ranges, _place(df, key))).select(*dict.fromkeys([key, *columns]))
        sides.append(_sums(rows, columns, F.col(key)).select(
            F.col(key).alias(f"{name}_key"), F.struct("n", "x", "s").alias(name)))
    both = sides[0].join(sides[1], F.col("a_key").eqNullSafe(F.col("b_key")), "full_outer")
    finding = F.when(F.col("b").isNull(), "MISSING").when(F.col("a").isNull(), "EXTRA").otherwise("CHANGED")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(
        F.coalesce("a_key", "b_key").alias(key), finding.alias("finding"),
        F.coalesce("a.n", F.lit(0)).alias("source_rows"), F.coalesce("b.n", F.lit(0)).alias("target_rows"))
