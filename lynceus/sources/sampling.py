"""Systematic samples. Nothing in this package samples on its own; these are for callers who want a sample."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.operators.series import global_index
from lynceus.operators.values import quoted

# Size tiers with their sample and chunk sizes (None: everything).
TIERS = (
    ("small", 10_000, None, None),
    ("medium", 100_000, 10_000, 50_000),
    ("large", 500_000, 5_000, 25_000),
    ("massive", None, 5_000, 10_000),
)

PLACE = ["__file", "__row"]


def _located(df: DataFrame) -> DataFrame | None:
    """The rows with their file and their place in it; null where the rows are not those of files that know it."""
    try:
        located = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        return located if located.schema["__row"].dataType.typeName() == "long" else None
    except AnalysisException:
        return None


def systematic_sample(df: DataFrame, max_rows: int, order_by: list[str], rows: int | None = None) -> DataFrame:
    """Every k-th row in the given order, at most ``max_rows``; the whole table if it is no larger."""
    total = df.count() if rows is None else rows
    if total <= max_rows:
        return df
    step = math.ceil(total / max_rows)
    wanted = (F.col("idx") % step == 0) & (F.col("idx") < step * max_rows)
    located = _located(df)
    if located is None:
        return global_index(df, order_by).where(wanted).drop("idx")
    # the order keys alone are sorted; the rows are picked by their place in the files, max_rows of them at most
    keys = located.select(*PLACE, *[quoted(o).alias(f"__order{i}") for i, o in enumerate(order_by)])
    picked = global_index(keys, [f"__order{i}" for i in range(len(order_by))]).where(wanted).select(*PLACE)
    return located.join(F.broadcast(picked), PLACE, "left_semi").select(*[quoted(c) for c in df.columns])


def size_tier(rows: int) -> tuple[str, int | None, int | None]:
    """Tier, sample size and chunk size for a number of rows."""
    for tier, most, sample, chunk in TIERS:
        if most is None or rows <= most:
            return tier, sample, chunk
    raise AssertionError


def sampling_plan(df: DataFrame) -> DataFrame:
    """One row: rows, tier, sample_size, chunk_size, should_sample."""
    rows = df.count()
    tier, sample, chunk = size_tier(rows)
    return df.sparkSession.createDataFrame(
        [(rows, tier, sample, chunk, sample is not None)],
        "rows bigint, tier string, sample_size bigint, chunk_size bigint, should_sample boolean")


def tiered_sample(df: DataFrame, order_by: list[str]) -> DataFrame:
    """The systematic sample of the table's size tier."""
    rows = df.count()
    _, sample, _ = size_tier(rows)
    return df if sample is None else systematic_sample(df, sample, order_by, rows)
