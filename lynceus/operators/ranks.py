"""Exact order statistics without sorting the data.

A KLL sketch brackets every wanted rank, one more scan counts what lies below and inside the brackets, and only the
few values inside are ranked. While a bracket still holds too many values it is narrowed by another sketch, so no
task ever receives more than ``limit`` distinct values, whatever the size of the table or the skew of its values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH_K = 2000
MARGIN = 0.005


def sketch_of(num: Column) -> Column:
    return F.kll_sketch_agg_double(num, F.lit(SKETCH_K))


@dataclass
class Target:
    """One wanted rank of one column, known to lie strictly between ``low`` and ``high``."""

    column: str
    rank: int
    inside: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    margin: float = MARGIN
    bracket: tuple[float, float] | None = None
    value: float | None = None

    def share(self) -> tuple[float, float]:
        middle = (self.rank - self.below + 0.5) / self.inside
        return max(0.0, middle - self.margin), min(1.0, middle + self.margin)

    def expected(self) -> float:
        return self.inside * 2 * self.margin


def _within(num: Column, low: float | None, high: float | None) -> Column:
    test = num.isNotNull()
    if low is not None:
        test = test & (num > F.lit(low))
    if high is not None:
        test = test & (num < F.lit(high))
    return test


def _sketch_brackets(df: DataFrame, views: dict[str, Column], targets: list[Target]) -> None:
    """Fill in ``bracket`` for the targets with one scan and one sketch per column and interval."""
    intervals = sorted({(t.column, t.low, t.high) for t in targets}, key=str)
    slots = {c: f"x{i}" for i, c in enumerate(sorted({t.column for t in targets}))}
    seen = df.select(*[views[c].alias(slot) for c, slot in slots.items()])
    shares = {k: sorted({x for t in targets if (t.column, t.low, t.high) == k for x in t.share()}) for k in intervals}
    aggregates = []
    for i, (c, low, high) in enumerate(intervals):
        v = F.col(slots[c])
        aggregates.append(sketch_of(F.when(_within(v, low, high), v)).alias(f"s{i}"))
    row = seen.agg(*aggregates).select(*[
        F.kll_sketch_get_quantile_double(F.col(f"s{i}"), F.array(*[F.lit(float(x)) for x in shares[k]])).alias(f"q{i}")
        for i, k in enumerate(intervals)]).first()
    for t in targets:
        k = (t.column, t.low, t.high)
        quantiles = row[f"q{intervals.index(k)}"]
        t.bracket = tuple(quantiles[shares[k].index(x)] for x in t.share())


def _narrow(df: DataFrame, views: dict[str, Column], targets: list[Target]) -> None:
    """One counting scan: move each target into the part of its interval that holds its rank."""
    aggregates = []
    for i, t in enumerate(targets):
        v, (a, b) = views[t.column], t.bracket
        aggregates += [
            F.count_if(_within(v, t.low, a)).alias(f"l{i}"),
            F.count_if(v == F.lit(a)).alias(f"a{i}"),
            F.count_if(_within(v, a, b)).alias(f"m{i}"),
            F.count_if((v == F.lit(b)) & F.lit(b > a)).alias(f"b{i}"),
        ]
    row = df.agg(*aggregates).first()
    for i, t in enumerate(targets):
        (a, b), rank = t.bracket, t.rank - t.below
        left, at_a, mid, at_b = (row[f"{x}{i}"] for x in "lamb")
        if rank < left:
            t.high, t.inside, t.margin = a, left, t.margin * 2
        elif rank < left + at_a:
            t.value = a
        elif rank < left + at_a + mid:
            t.low, t.high, t.below, t.inside = a, b, t.below + left + at_a, mid
        elif rank < left + at_a + mid + at_b:
            t.value = b
        else:
            t.below += left + at_a + mid + at_b
            t.low, t.inside, t.margin = b, t.inside - (left + at_a + mid + at_b), t.margin * 2


def _finish(df: DataFrame, views: dict[str, Column], targets: list[Target]) -> None:
    """Rank the values inside the brackets; the rest of each column is only counted."""
    by_column: dict[str, list[Target]] = {}
    for t in targets:
        by_column.setdefault(t.column, []).append(t)
    parts, regions = [], {}
    for name, wanted in by_column.items():
        cuts = sorted({x for t in wanted for x in (t.low, t.high, *t.bracket) if x is not None})
        inner = sorted({2 * i for t in wanted for i, c in enumerate(cuts) if t.bracket[0] < c <= t.bracket[1]})
        regions[name] = (cuts, set(inner))
        v = F.col("v")
        region = F.lit(2 * len(cuts))
        for i in reversed(range(len(cuts))):
            region = F.when(v < cuts[i], F.lit(2 * i)).when(v == cuts[i], F.lit(2 * i + 1)).otherwise(region)
        keep = F.when(F.col("region").isin(*inner), v) if inner else F.lit(None).cast("double")
        parts.append(
            df.select(views[name].alias("v")).where(v.isNotNull())
            .withColumn("region", region)
            .select(F.lit(len(parts)).alias("k"), "region", keep.alias("v"))
        )
    names = list(by_column)
    running = Window.partitionBy("k").orderBy("region", "v").rowsBetween(Window.unboundedPreceding, 0)
    ranks = F.array(*[F.array(*[F.lit(t.rank).cast("bigint") for t in wanted]) for wanted in by_column.values()])
    hits = (
        reduce(DataFrame.union, parts).groupBy("k", "region", "v").agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("upto", F.sum("cnt").over(running))
        .select(F.array(*[F.lit(c) for c in names])[F.col("k")].alias("column"), "region", "v", F.explode(F.filter(
            ranks[F.col("k")], lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("cnt")))).alias("rank"))
    )
    found = {(r["column"], r["rank"]): (r["region"], r["v"]) for r in hits.collect()}
    for t in targets:
        region, v = found[(t.column, t.rank)]
        cuts, inner = regions[t.column]
        if region % 2:
            t.value = cuts[region // 2]
        elif region in inner:
            t.value = v
        else:  # the sketch missed: look again with a wider margin
            t.margin, t.bracket = t.margin * 4, None


def exact_ranks(
    df: DataFrame,
    views: dict[str, Column],
    wanted: dict[str, tuple[int, list[int]]],
    limit: int = 1_000_000,
) -> dict[tuple[str, int], float]:
    """Value at each 0-based rank. ``wanted`` maps a column to (non-null count, ranks)."""
    targets = [Target(c, r, n) for c, (n, ranks) in wanted.items() for r in sorted(set(ranks)) if n > 0]
    while True:
        pending = [t for t in targets if t.value is None]
        if not pending:
            return {(t.column, t.rank): t.value for t in targets}
        missing = [t for t in pending if t.bracket is None]
        if missing:
            _sketch_brackets(df, views, missing)
        wide = [t for t in pending if t.expected() > limit]
        if wide:
            _narrow(df, views, wide)
            for t in wide:
                t.bracket = None
        else:
            _finish(df, views, pending)
