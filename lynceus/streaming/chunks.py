"""User functions over chunks of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.operators.values import quoted


class _Progress(AccumulatorParam):
    """A count of rows whose sum on the driver is reported."""

    def __init__(self, total: int, report: Callable[[int, int], None] | None):
        self.total, self.report = total, report

    def __getstate__(self):
        return {"total": self.total, "report": None}  # tasks only count

    def zero(self, value: int) -> int:
        return 0

    def addInPlace(self, value1: int, value2: int) -> int:
        if self.report and value2:
            self.report(value1 + value2, self.total)
        return value1 + value2


def apply_in_chunks(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, chunk_rows: int = 10_000,
                    by: list[str] | None = None, task_rows: int = 1_000_000,
                    on_progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """Run ``fn`` on chunks of at most ``chunk_rows`` rows, in parallel.

    With ``by`` a chunk holds rows of one key only. A key of more than ``task_rows`` rows is spread over as many tasks
    as that takes, by the position of its rows, so a key with a third of all rows is neither one task nor one frame, be
    the rows equal or not. ``on_progress`` is called on the driver with the rows processed so far and all rows, as tasks end
    (a task that runs twice counts twice).
    """
    names = list(by or [])
    done = None
    if on_progress:
        done = df.sparkSession.sparkContext.accumulator(0, _Progress(df.count(), on_progress))

    def run(waiting: list[pd.DataFrame]) -> pd.DataFrame:
        chunk = pd.concat(waiting, ignore_index=True)
        if done is not None:
            done.add(len(chunk))
        return fn(chunk)

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        count = 0
        key = None
        for frame in frames:
            groups = [((), frame)] if not names else frame.groupby(names, sort=False, dropna=False)
            for group_key, part in groups:
                if names and waiting and group_key != key:
                    yield run(waiting)
                    waiting, count = [], 0
                key = group_key
                while len(part):
                    taken = part.iloc[: chunk_rows - count]
                    part = part.iloc[len(taken):]
                    waiting.append(taken)
                    count += len(taken)
                    if count == chunk_rows:
                        yield run(waiting)
                        waiting, count = [], 0
        if waiting:
            yield run(waiting)

    source = df
    if names:
        keys = [quoted(c) for c in names]
        # at most one row per ``task_rows`` rows of the table, so the list of large keys is small beside the table
        large = df.groupBy(*[k.alias(f"__key{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__rows")).where(
            F.col("__rows") > task_rows).withColumn("__spread", F.ceil(F.col("__rows") / task_rows)).drop("__rows")
        same = reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)])
        salt = F.pmod("__position", F.coalesce("__spread", F.lit(1)))
        source = (
            df.withColumn("__position", F.monotonically_increasing_id()).join(large, same, "left").withColumn("__salt", salt).repartition(*keys, "__salt")
            .sortWithinPartitions(*keys).select(*[quoted(c) for c in df.columns]))
    return source.mapInPandas(chunks, schema)
