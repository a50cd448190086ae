"""Analyses that read a numeric column in row order.

``order_by`` must order the rows completely (end it with a unique column). A series is a column, optionally within
``series`` keys; one series may hold most of the table. The rows are range-partitioned by (series, order) and sorted
once, as wide as they are: all measures of a row travel together. Where they are sorted, segmented scans give each
measure its place, its neighbours or its running sums within the series and partition, and the result is written column
by column, so an analysis reads what it needs. A task holds one chunk of its rows at a time; what crosses chunks and
partitions is one small record per series and chunk.
Measures become rows of their own only behind that, on the way into a filter or an aggregation; no window spans a series.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.functions.scoring import clamp, correlation_t, p_value, p_value_ref
from lynceus.operators.values import quoted
from lynceus.session import checkpointed, stored
from lynceus.table import Table

PERIOD_LABELS = {7: "weekly", 12: "monthly", 4: "quarterly", 24: "hourly"}  # fixed values
CHUNK = 1 << 16      # rows of a partition that a task scans at a time
BLOCK = 1 << 20      # positions per block when thinning change points
LAG_BLOCK = 1 << 16  # positions per block when the lags are bounded; series up to this length are correlated whole

#: Columns that each scan adds per measure.
SCANS = {"neighbours": {"p": "double", "q": "double"}, "sums": {"m": "double", "s": "double", "t": "double"}}


def _segments(columns: list[pa.ChunkedArray], rows: int) -> np.ndarray:
    """Number of the run of equal keys (nulls are equal) that each row is in."""
    new = np.zeros(rows, dtype=bool)
    for column in columns:
        codes = column.combine_chunks().dictionary_encode()
        codes = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def _scan_measure(values: np.ndarray, segment: np.ndarray, scans: tuple[str, ...]) -> dict[str, pa.Array]:
    """Place of each number among those of its segment, and what the scans ask for; null where there is no number."""
    rows = len(values)
    at = np.flatnonzero(~np.isnan(values))
    x, of = values[at], segment[at]
    held = np.bincount(of, minlength=int(segment[-1]) + 1)
    first = (np.cumsum(held) - held)[of]

    def column(numbers: np.ndarray) -> pa.Array:
        out = np.full(rows, np.nan)
        out[at] = numbers
        return pa.array(out, from_pandas=True)

    place = np.zeros(rows, dtype=np.int64)
    place[at] = np.arange(len(at)) - first
    out = {"r": pa.array(place, mask=np.isnan(values))}
    if "neighbours" in scans:
        same = of[1:] == of[:-1]
        before, after = np.full(len(at), np.nan), np.full(len(at), np.nan)
        before[1:][same], after[:-1][same] = x[:-1][same], x[1:][same]
        out |= {"p": column(before), "q": column(after)}
    if "sums" in scans:
        some = np.maximum(held, 1)
        mean = (np.bincount(of, x, len(held)) / some)[of]
        spread = np.sqrt(np.bincount(of, (x - mean) ** 2, len(held)) / some)[of]
        spread[spread == 0] = 1.0
        z = (x - mean) / spread  # segments of any scale add up side by side
        s, t = np.cumsum(z) - z, np.cumsum(z * z) - z * z
        out |= {"m": column(mean), "s": column((s - s[first]) * spread), "t": column((t - t[first]) * spread ** 2)}
    return out


def _scan(keys: int, measures: int, scans: tuple[str, ...], most: int):
    def chunk(found: list[pa.RecordBatch], before: int) -> tuple[pa.Table, int]:
        """Rows of one chunk, whose segments are numbered on from ``before``, with the number behind them."""
        table = pa.Table.from_batches(found)
        segment = _segments(table.columns[:keys], len(table))
        columns = dict(zip(table.column_names[:keys], table.columns[:keys]))
        columns["__part"] = pa.array(np.full(len(table), TaskContext.get().partitionId(), dtype=np.int32))
        columns["__segment"] = pa.array((segment + before).astype(np.int32))
        for i in range(measures):
            values = table.column(keys + i)
            columns[f"__v{i}"] = values
            for name, column in _scan_measure(values.to_numpy().astype(float), segment, scans).items():
                columns[f"__{name}{i}"] = column
        return pa.table(columns), before + int(segment[-1]) + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, before = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                found.append(batch.slice(at, most))
                if sum(b.num_rows for b in found) >= most:
                    table, before = chunk(found, before)
                    found = []
                    yield from table.to_batches(max_chunksize=1 << 14)
        if found:
            yield from chunk(found, before)[0].to_batches(max_chunksize=1 << 14)

    return scan


class Series:
    """Positions and per-series facts of one or several numeric columns in row order.

    ``rows``: series keys, __part, __segment and per measure i its number __v{i}, its place __r{i} within the segment and
    the columns of the scans. ``keys``: the series keys and "column". A segment is what a series has in one partition and
    chunk of ``chunk`` rows, which is all that a task holds in memory.
    """

    def __init__(self, source, cols: list[str] | None, order_by: list[str] | None, series: list[str] | None = None,
                 scans: tuple[str, ...] = (), chunk: int = CHUNK):
        t = Table.of(source)
        order = list(order_by or t.order_by)
        if not order:
            raise ValueError("order_by is needed: rows of a DataFrame have no order of their own")
        self.table, self.series, self.scans = t, list(series or []), scans
        self.keys = [*self.series, "column"]
        self.names = list(cols if cols is not None else t.numeric)
        ordered = [f"__order{i}" for i in range(len(order))]
        by = [*map(quoted, self.series), *ordered]
        wide = t.df.select(
            *map(quoted, self.series), *[t.number(c).alias(f"__v{i}") for i, c in enumerate(self.names)],
            *[quoted(o).alias(a) for o, a in zip(order, ordered)])
        dealt = wide.repartitionByRange(*by).sortWithinPartitions(*by).drop(*ordered)
        schema = "".join(f"{quoted_name(k)} {t.df.schema[k].dataType.simpleString()}, " for k in self.series)
        added = {"v": "double", "r": "bigint"} | {k: v for scan in scans for k, v in SCANS[scan].items()}
        schema += "__part int, __segment int" + "".join(
            f", __{k}{i} {v}" for i in range(len(self.names)) for k, v in added.items())
        self.rows = stored(dealt.mapInArrow(_scan(len(self.series), len(self.names), scans, chunk), schema), "series")

    @cached_property
    def facts(self) -> DataFrame:
        """One row per measure, series, partition and chunk with everything known before and after it."""
        measures = range(len(self.names))
        aggregates = [a for i in measures for a in (
            F.count(f"__v{i}").alias(f"n{i}"), F.avg(f"__v{i}").alias(f"avg{i}"), F.var_pop(f"__v{i}").alias(f"var{i}"),
            F.max(F.when(F.col(f"__r{i}") == 0, F.col(f"__v{i}"))).alias(f"first{i}"),
            F.max_by(f"__v{i}", f"__r{i}").alias(f"last{i}"))] or [F.count(F.lit(1)).alias("rows")]
        per_part = self.rows.groupBy(*map(quoted, self.series), "__part", "__segment").agg(*aggregates)
        each = [F.struct(F.lit(i).alias("__measure"), F.lit(c).alias("column"), F.col(f"n{i}").alias("m"),
                         F.col(f"avg{i}").alias("avg"), F.col(f"var{i}").alias("var"), F.col(f"first{i}").alias("first_value"),
                         F.col(f"last{i}").alias("last_value")) for i, c in enumerate(self.names)]
        empty = F.array().cast("array<struct<__measure:int,column:string,m:bigint,avg:double,var:double,first_value:double,last_value:double>>")
        long = per_part.select(*map(quoted, self.series), "__part", "__segment",
                               F.inline(F.array(*each) if each else empty)).where(F.col("m") > 0)
        whole = Window.partitionBy(*map(quoted, self.keys))
        before = whole.orderBy("__part", "__segment").rowsBetween(Window.unboundedPreceding, -1)
        neighbours = whole.orderBy("__part", "__segment")
        with_mean = (
            long.withColumn("n", F.sum("m").over(whole))
            .withColumn("mean", F.sum(F.col("m") * F.col("avg")).over(whole) / F.col("n"))
            .withColumn("s1", F.col("m") * (F.col("avg") - F.col("mean")))
            .withColumn("s2", F.col("m") * (F.col("var") + F.pow(F.col("avg") - F.col("mean"), 2)))
        )
        return stored(with_mean.select(
            *map(quoted, self.keys), "__part", "__segment", "__measure", "n", "mean",
            (F.sum("s2").over(whole) / F.col("n")).alias("var"), F.sum("s2").over(whole).alias("s2_all"),
            F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m_before"),
            F.coalesce(F.sum("s1").over(before), F.lit(0.0)).alias("s1_before"),
            F.coalesce(F.sum("s2").over(before), F.lit(0.0)).alias("s2_before"),
            F.lag("last_value").over(neighbours).alias("value_before"),
            F.lead("first_value").over(neighbours).alias("value_after"),
        ), "series-facts")

    def whole(self) -> DataFrame:
        """One row per series: keys, n, mean and population variance."""
        return self.facts.groupBy(*map(quoted, self.keys)).agg(
            F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("var").alias("var"))

    def placed(self) -> DataFrame:
        """A row per number with its position ``idx`` in the series, the facts and what the scans found.

        The records of a series and partition meet its rows once, for all measures.
        """
        given = ["n", "mean", "var", "s2_all", "m_before", "s1_before", "s2_before", "value_before", "value_after"]
        if not self.names:
            return self.facts.select(*map(quoted, self.keys), *given, F.lit(0).cast("bigint").alias("idx"),
                                     F.lit(None).cast("double").alias("value"))
        records = self.facts.groupBy("__part", "__segment").agg(*[
            F.max(F.when(F.col("__measure") == i, F.struct(*given))).alias(f"__f{i}") for i in range(len(self.names))])
        cells = []
        for i, c in enumerate(self.names):
            value, place, facts = F.col(f"__v{i}"), F.col(f"__r{i}"), F.col(f"__f{i}")
            fields = [F.lit(c).alias("column"), value.alias("value"), (facts["m_before"] + place).alias("idx"),
                      *[facts[g].alias(g) for g in given]]
            if "neighbours" in self.scans:
                fields += [F.coalesce(f"__p{i}", facts["value_before"]).alias("previous"),
                           F.coalesce(f"__q{i}", facts["value_after"]).alias("next")]
            if "sums" in self.scans:
                off = F.col(f"__m{i}") - facts["mean"]
                fields += [(facts["s1_before"] + F.col(f"__s{i}") + place * off).alias("s1"),
                           (facts["s2_before"] + F.col(f"__t{i}") + 2 * off * F.col(f"__s{i}") + place * off * off).alias("s2")]
            cells.append(F.struct(*fields))
        return (self.rows.join(records, ["__part", "__segment"])
                .select(*map(quoted, self.series), F.inline(F.array(*cells))).where(F.col("value").isNotNull()))


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which null equals null."""
    renamed = right.select(*[quoted(k).alias(f"__right{i}") for i, k in enumerate(keys)],
                           *[quoted(c) for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [left[quoted_name(k)].eqNullSafe(renamed[f"__right{i}"]) for i, k in enumerate(keys)])
    return left.join(renamed, same, how).drop(*[f"__right{i}" for i in range(len(keys))])


def _shown(df: DataFrame, keys: list[str], *columns) -> DataFrame:
    return df.select(*[quoted(k) for k in keys], *columns)


def global_index(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Add ``idx``, the 0-based position of each row in the given order."""
    spread = (
        df.repartitionByRange(*[quoted(o) for o in order_by]).sortWithinPartitions(*[quoted(o) for o in order_by])
        .withColumn("at", F.monotonically_increasing_id())
    )
    pinned = checkpointed(spread.withColumn("part", F.shiftright("at", 33)))
    sizes = pinned.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    # one row per partition: as small as the partition count of the job
    starts = sizes.withColumn(
        "start", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (
        pinned.join(F.broadcast(starts.select("part", "start")), "part")
        .withColumn("idx", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("part", "start", "at")
    )


def series_head(source, col: str, order_by: list[str] | None = None, n: int = 50) -> DataFrame:
    """The first n numbers of a column in row order (line chart data)."""
    t = Table.of(source)
    order = list(order_by or t.order_by)
    first = (
        t.df.select(*[quoted(o).alias(f"__order{i}") for i, o in enumerate(order)], t.number(col).alias("value"))
        .where(F.col("value").isNotNull()).orderBy(*[f"__order{i}" for i in range(len(order))]).limit(n)
    )
    numbered = Window.orderBy(*[f"__order{i}" for i in range(len(order))])  # at most n rows
    return first.select((F.row_number().over(numbered) - 1).cast("bigint").alias("idx"), "value")


def trend_all(s: Series) -> DataFrame:
    """Slope, change and direction of every series, before any filter."""
    quarter = F.ceil(F.col("n") / 4)
    aggregated = s.placed().groupBy(*s.keys).agg(
        F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("var").alias("var"),
        F.covar_pop("value", "idx").alias("cov"), F.var_pop("idx").alias("var_idx"),
        F.avg(F.when(F.col("idx") < quarter, F.col("value"))).alias("first_mean"),
        F.avg(F.when(F.col("idx") >= F.col("n") - quarter, F.col("value"))).alias("last_mean"),
    )
    first, last, mean = F.col("first_mean"), F.col("last_mean"), F.col("mean")
    slope = F.coalesce(F.try_divide("cov", "var_idx"), F.lit(0.0))
    base = F.when(first != 0, F.abs(first)).when(F.abs(mean) > 0, F.abs(mean)).otherwise(F.lit(1.0))
    steep = F.abs(mean) * 0.05 / F.col("n")
    return (
        aggregated.withColumn("slope", slope)
        .withColumn("change_percent", 100 * (last - first) / base)
        .withColumn("direction", F.when(slope > steep, "up").when(slope < -steep, "down").otherwise("stable"))
    )


def trend(source, cols: list[str] | None = None, order_by: list[str] | None = None,
          series: list[str] | None = None) -> DataFrame:
    """Trends of series with five values or more that are not stable or changed by more than 5 %."""
    s = Series(source, cols, order_by, series)
    kept = trend_all(s).where(
        (F.col("n") >= 5) & ((F.col("direction") != "stable") | (F.abs("change_percent") > 5)))
    return _shown(kept, s.keys, "n", "direction", "slope", "change_percent", "first_mean", "last_mean")


def trend_test(source, cols: list[str] | None = None, order_by: list[str] | None = None,
               series: list[str] | None = None) -> DataFrame:
    """Correlation of value and position with its p-value; supported if |r| >= .2 and p < .05 (10 values or more)."""
    s = Series(source, cols, order_by, series)
    r = F.coalesce(F.try_divide(F.col("cov"), F.sqrt("var_idx") * F.sqrt("var")), F.lit(0.0))
    tested = trend_all(s).where(F.col("n") >= 10).withColumn("r", clamp(r, -1.0, 1.0))
    statistic = correlation_t(F.col("r"), F.col("n"))
    tested = (
        tested.withColumn("t_statistic", statistic)
        .withColumn("p_value", F.coalesce(p_value(statistic), F.lit(0.0)))
        .withColumn("p_value_ref", F.coalesce(p_value_ref(statistic), F.lit(0.0)))
    )
    strong = F.abs("r") >= 0.2
    return _shown(
        tested, s.keys, "n", "r", "t_statistic", "p_value", "p_value_ref",
        (strong & (F.col("p_value") < 0.05)).alias("supported"),
        (strong & (F.col("p_value_ref") < 0.05)).alias("supported_ref"),
        F.round(F.abs("r") * 100).cast("int").alias("confidence"))


def _peaks(s: Series) -> DataFrame:
    """Numbers above the one before and the one after, across partition borders."""
    return s.placed().where((F.col("value") > F.col("previous")) & (F.col("value") > F.col("next")))


def local_peaks(source, cols: list[str] | None = None, order_by: list[str] | None = None,
                series: list[str] | None = None) -> DataFrame:
    """Positions whose value exceeds both neighbours."""
    s = Series(source, cols, order_by, series, ("neighbours",))
    return _shown(_peaks(s), s.keys, "idx", "value")


# --- change points ---------------------------------------------------------------------------------------------

def change_point_candidates(s: Series, min_segment: int = 5, threshold: float = 2.0, min_n: int = 0) -> DataFrame:
    """Every split whose mean shift exceeds ``threshold`` standard errors, from running sums of centred values."""
    inside = s.placed().where(
        (F.col("n") >= max(2 * min_segment, min_n)) & (F.col("var") > 0)
        & (F.col("idx") >= min_segment) & (F.col("idx") < F.col("n") - min_segment))
    nb, na = F.col("idx").cast("double"), (F.col("n") - F.col("idx")).cast("double")
    mean_b, mean_a = F.col("s1") / nb, -F.col("s1") / na
    var_b = F.greatest(F.lit(0.0), F.col("s2") / nb - mean_b * mean_b)
    var_a = F.greatest(F.lit(0.0), (F.col("s2_all") - F.col("s2")) / na - mean_a * mean_a)
    pooled = F.sqrt(((nb - 1) * var_b + (na - 1) * var_a) / (nb + na - 2))
    significance = F.try_divide(F.abs(mean_a - mean_b), pooled * F.sqrt(1 / nb + 1 / na))
    return _shown(
        inside, s.keys, "idx", (mean_b + F.col("mean")).alias("before_mean"), (mean_a + F.col("mean")).alias("after_mean"),
        significance.alias("significance"),
        F.when(mean_a > mean_b, "increase").otherwise("decrease").alias("direction"),
    ).where(F.col("significance") > threshold)


def _thin_block(reach: int):
    """Settle the candidates of one block. A candidate is kept once no kept or open one within reach outranks it,
    dropped once a kept one is within reach, and stays open while its fate depends on another block."""

    def settle(block: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        idx, state, own = (block[c].to_numpy() for c in ("idx", "state", "own"))
        state = state.copy()
        ranked = np.lexsort((idx, -block["significance"].to_numpy()))
        rank = np.empty(len(block), dtype=np.int64)
        rank[ranked] = np.arange(len(block))
        left = np.searchsorted(idx, idx - reach, side="left")
        right = np.searchsorted(idx, idx + reach, side="right")
        for i in ranked[(state == 0)[ranked] & own[ranked]]:
            if state[i] != 0:
                continue
            near = slice(left[i], right[i])
            if (state[near] == 1).any():
                state[i] = 2
            elif not ((state[near] == 0) & (rank[near] < rank[i])).any():
                state[i] = 1
        kept = block.set_column(block.column_names.index("state"), "state", pa.array(state))
        # a dropped one settles no other any more, so the next round need not carry it
        return kept.drop_columns(["own", "block"]).filter(pa.array(own & (state != 2)))

    return settle


def thin_candidates(candidates: DataFrame, keys: list[str], min_segment: int, block: int = BLOCK) -> DataFrame:
    """Keep the most significant candidates at least ``min_segment`` apart, best first (ties: earlier position).

    Exactly the one-by-one greedy selection, found per block of positions. Blocks see the candidates just beyond
    their borders; the few whose fate crosses a border wait for the next round.
    """
    reach = min_segment - 1
    names = [*keys, "idx", "before_mean", "after_mean", "significance", "direction", "state"]
    current = checkpointed(candidates.withColumn("state", F.lit(0)).select(*names))
    schema = current.schema
    while True:
        home = F.floor(F.col("idx") / block)
        copies = F.array_compact(F.array(
            F.struct(home.alias("block"), F.lit(True).alias("own")),
            F.when(F.col("idx") % block < reach, F.struct((home - 1).alias("block"), F.lit(False).alias("own"))),
            F.when(F.col("idx") % block >= block - reach, F.struct((home + 1).alias("block"), F.lit(False).alias("own"))),
        ))
        spread = current.select(*names, F.inline(copies))
        current = checkpointed(
            spread.groupBy(*[quoted(k) for k in keys], "block").applyInArrow(_thin_block(reach), schema).select(*names))
        if current.where(F.col("state") == 0).isEmpty():
            return current.where(F.col("state") == 1).drop("state")


def change_points(source, cols: list[str] | None = None, order_by: list[str] | None = None,
                  series: list[str] | None = None, min_segment: int = 5, threshold: float = 2.0,
                  block: int = BLOCK) -> DataFrame:
    """Positions where the mean level shifts, thinned so that none is within ``min_segment`` of a stronger one."""
    s = Series(source, cols, order_by, series, ("sums",))
    return thin_candidates(change_point_candidates(s, min_segment, threshold), s.keys, min_segment, block)


# --- autocorrelation -------------------------------------------------------------------------------------------

def _block_sums(keys: list[str]):
    """Products of the values of one block with those up to the largest lag behind them."""

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x, own = pdf["x"].to_numpy(), pdf["own"].to_numpy()
        lags = min(int(pdf["max_lag"].iloc[0]), len(x) - 1)
        size = 1 << int(len(x) + own.sum()).bit_length()
        products = np.fft.irfft(np.conj(np.fft.rfft(x[own], size)) * np.fft.rfft(x, size), size)[: lags + 1]
        out = {k: [pdf[k].iloc[0]] * (lags + 1) for k in keys}
        return pd.DataFrame({**out, "lag": np.arange(lags + 1), "total": products})

    return sums


def bounded_autocovariance_sums(placed: DataFrame, keys: list[str], max_lag: int, block: int = LAG_BLOCK) -> DataFrame:
    """Per series and lag up to ``max_lag`` (at most ``block``) the sum of x(i) x(i + lag).

    Blocks of positions see the values just behind them, so one shuffle is enough and no group exceeds two blocks.
    """
    names = [quoted(k) for k in keys]
    home = F.floor(F.col("idx") / block)
    copies = F.array_compact(F.array(
        F.struct(home.alias("block"), F.lit(True).alias("own")),
        F.when((F.col("idx") % block < max_lag) & (home > 0), F.struct((home - 1).alias("block"), F.lit(False).alias("own")))))
    spread = placed.select(
        *names, "idx", (F.col("value") - F.col("mean")).alias("x"),
        F.least(F.lit(max_lag), F.col("n") - 1).alias("max_lag"), F.inline(copies))
    key_schema = "".join(f"`{k}` {placed.schema[k].dataType.simpleString()}, " for k in keys)
    sums = spread.groupBy(*names, "block").applyInPandas(_block_sums(keys), key_schema + "lag bigint, total double")
    return sums.groupBy(*names, "lag").agg(F.sum("total").alias("total"))


def _column_step(keys: list[str], forward_power: bool):
    """One pass of the transform over a group of positions sharing a remainder.

    A transform of N = N1 * N2 points is done as short transforms: points with equal ``i mod N1`` are transformed,
    turned by a twiddle factor, regrouped and transformed again. ``forward_power`` marks the middle pass, which
    finishes the first transform, takes the squared magnitude and starts the second one on the same group.
    """

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        group, n1, n2 = (int(pdf[c].iloc[0]) for c in ("g", "n1", "n2"))
        if forward_power:
            # group is k2; entries are indexed by i1 in [0, n1)
            z = np.zeros(n1, dtype=complex)
            z[pdf["j"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
            power = np.abs(np.fft.fft(z)) ** 2
            # now N1' = n2 with i1' = k2 and N2' = n1
            y = np.fft.fft(power) * np.exp(-2j * np.pi * group * np.arange(n1) / (n1 * n2))
            new_groups = np.arange(n1)
        else:
            z = np.zeros(n2)
            z[pdf["j"].to_numpy()] = pdf["re"].to_numpy()
            y = np.fft.fft(z) * np.exp(-2j * np.pi * group * np.arange(n2) / (n1 * n2))
            new_groups = np.arange(n2)
        out = {k: [pdf[k].iloc[0]] * len(y) for k in keys}
        return pd.DataFrame({
            **out, "g": new_groups, "j": group, "re": y.real, "im": y.imag,
            "n1": n1, "n2": n2, "max_lag": int(pdf["max_lag"].iloc[0])})

    return step


def _last_step(keys: list[str]):
    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        group, n1, n2, lags = (int(pdf[c].iloc[0]) for c in ("g", "n1", "n2", "max_lag"))
        z = np.zeros(n2, dtype=complex)
        z[pdf["j"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        products = np.fft.fft(z).real / (n1 * n2)
        lag = n1 * np.arange(n2) + group
        keep = lag <= lags
        out = {k: [pdf[k].iloc[0]] * int(keep.sum()) for k in keys}
        return pd.DataFrame({**out, "lag": lag[keep], "total": products[keep]})

    return step


def autocovariance_sums(placed: DataFrame, keys: list[str], max_lag: Column) -> DataFrame:
    """Per series and lag the sum of x(i) x(i + lag), for all lags up to ``max_lag``.

    Every series goes through a distributed transform in groups of about the square root of its padded length, so all
    n/2 lags cost O(n log n) and no group holds a series.
    """
    names = [quoted(k) for k in keys]
    x = placed.select(*names, "idx", "n", (F.col("value") - F.col("mean")).alias("x"), max_lag.cast("bigint").alias("max_lag"))
    key_schema = "".join(f"`{k}` {placed.schema[k].dataType.simpleString()}, " for k in keys)
    sums_schema = key_schema + "lag bigint, total double"
    bits = F.ceil(F.log2((2 * F.col("n")).cast("double"))).cast("int")
    step_schema = key_schema + "g bigint, j bigint, re double, im double, n1 bigint, n2 bigint, max_lag bigint"
    n1 = F.pow(F.lit(2.0), F.floor(bits / 2)).cast("bigint")
    n2 = F.pow(F.lit(2.0), bits - F.floor(bits / 2)).cast("bigint")
    start = (
        x.withColumn("n1", n1).withColumn("n2", n2)
        .select(*names, (F.col("idx") % F.col("n1")).alias("g"), F.floor(F.col("idx") / F.col("n1")).alias("j"),
                F.col("x").alias("re"), F.lit(0.0).alias("im"), "n1", "n2", "max_lag")
    )
    turned = start.groupBy(*names, "g").applyInPandas(_column_step(keys, False), step_schema)
    power = turned.groupBy(*names, "g").applyInPandas(_column_step(keys, True), step_schema)
    return power.groupBy(*names, "g").applyInPandas(_last_step(keys), sums_schema)


def _short_sums(keys: list[str], bound: int | None):
    """All products of a whole series with itself, by one transform in memory."""

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("idx")["x"].to_numpy()
        n = len(x)
        lags = n // 2 if bound is None else min(bound, n - 1)
        size = 1 << (2 * n).bit_length()
        products = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[: lags + 1]
        out = {k: [pdf[k].iloc[0]] * (lags + 1) for k in keys}
        return pd.DataFrame({**out, "lag": np.arange(lags + 1), "total": products})

    return sums


def _correlogram(s: Series, max_lag: int | None, min_n: int) -> DataFrame:
    names = [quoted(k) for k in s.keys]
    whole = s.whole().where((F.col("n") >= min_n) & (F.col("var") > 0))
    longest = whole.agg(F.max("n")).first()[0] or 0
    placed = s.placed().where((F.col("n") >= min_n) & (F.col("var") > 0))
    if max_lag is not None and max_lag <= LAG_BLOCK:
        sums = bounded_autocovariance_sums(placed, s.keys, max_lag)
    else:
        x = placed.where(F.col("n") <= LAG_BLOCK).select(*names, "idx", (F.col("value") - F.col("mean")).alias("x"))
        key_schema = "".join(f"`{k}` {placed.schema[k].dataType.simpleString()}, " for k in s.keys)
        sums = x.groupBy(*names).applyInPandas(_short_sums(s.keys, max_lag), key_schema + "lag bigint, total double")
        if longest > LAG_BLOCK:
            lags = F.floor(F.col("n") / 2) if max_lag is None else F.least(F.lit(max_lag), F.col("n") - 1)
            sums = sums.unionByName(autocovariance_sums(placed.where(F.col("n") > LAG_BLOCK), s.keys, lags))
    return same_keys(sums, whole.select(*names, "n", "var"), s.keys).select(
        *names, "lag", (F.col("total") / ((F.col("n") - F.col("lag")) * F.col("var"))).alias("acf"))


def acf(source, cols: list[str] | None = None, order_by: list[str] | None = None, series: list[str] | None = None,
        max_lag: int | None = None) -> DataFrame:
    """Autocorrelation for lags 2 to ``max_lag`` (default half the series), each lag over its own pair count."""
    s = Series(source, cols, order_by, series)
    return _correlogram(s, max_lag, 2).where(F.col("lag") >= 2)


def seasonality_of(s: Series, max_period: int | None = None, min_n: int = 8) -> DataFrame:
    """Best seasonal period per series: the highest strict local maximum above .3 of the correlogram."""
    correlogram = _correlogram(s, max_period, min_n).where(F.col("lag") >= 2)
    # a lag is compared with its two neighbours by an equality join, so no window spans a whole correlogram
    sides = correlogram.select(*s.keys, F.explode(F.array(F.col("lag") - 1, F.col("lag") + 1)).alias("lag"),
                               F.col("acf").alias("beside"))
    higher = (
        sides.groupBy(*s.keys, "lag").agg(F.count(F.lit(1)).alias("sides"), F.max("beside").alias("beside"))
    )
    higher = (
        same_keys(higher, correlogram, [*s.keys, "lag"])
        .where((F.col("sides") == 2) & (F.col("acf") > F.col("beside")) & (F.col("acf") > 0.3))
    )
    best = higher.groupBy(*s.keys).agg(
        # multiples of a period may tie; rounding keeps the transform's last bits from choosing among them
        F.max(F.struct(F.round("acf", 9).alias("rounded"), (-F.col("lag")).alias("early"), "acf")).alias("best"))
    return best.select(*s.keys, (-F.col("best.early")).alias("period"), F.col("best.acf").alias("strength"))


def seasonality(source, cols: list[str] | None = None, order_by: list[str] | None = None,
                series: list[str] | None = None, max_period: int | None = None) -> DataFrame:
    """Detected seasonality per series: period, strength, label and the first ten peaks of the data."""
    s = Series(source, cols, order_by, series, ("neighbours",))
    found = seasonality_of(s, max_period)
    order = Window.partitionBy(*s.keys).orderBy("idx")
    peaks = (
        _peaks(s).withColumn("place", F.row_number().over(order)).where(F.col("place") <= 10)
        .groupBy(*s.keys).agg(F.array_sort(F.collect_list("idx")).alias("peaks"))
    )
    label = F.lit(None).cast("string")
    for period, text in PERIOD_LABELS.items():
        label = F.when(F.col("period") == period, text).otherwise(label)
    return same_keys(found, peaks, s.keys, "left").select(
        *[quoted(k) for k in s.keys], "period", "strength", label.alias("label"),
        F.coalesce("peaks", F.array().cast("array<bigint>")).alias("peaks"))


def time_series_report(source, cols: list[str] | None = None, order_by: list[str] | None = None,
                       series: list[str] | None = None, min_values: int = 20) -> DataFrame:
    """Change points and seasonality of every numeric column with 20 values or more, one row per finding."""
    s = Series(source, cols, order_by, series, ("sums",))
    names = [quoted(k) for k in s.keys]
    points = thin_candidates(change_point_candidates(s, min_n=min_values), s.keys, 5).select(
        *names, F.lit("change_point").alias("finding"), F.col("idx").alias("position"),
        F.col("significance").alias("strength"), "before_mean", "after_mean", "direction")
    periods = seasonality_of(s, min_n=min_values).select(
        *names, F.lit("seasonality").alias("finding"), F.col("period").alias("position"), "strength",
        F.lit(None).cast("double").alias("before_mean"), F.lit(None).cast("double").alias("after_mean"),
        F.lit(None).cast("string").alias("direction"))
    return points.unionByName(periods)
