"""Ranked hypotheses about a table.

Every function returns rows (kind, column1, column2, confidence, interpretation, statistic, p_value, evidence,
confounders); ``evidence`` is an array of (name, value).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions.names import causal_direction
from lynceus.operators.association import confounder_table
from lynceus.operators.groups import extremes, small_groups
from lynceus.operators.outliers import outlier_counts
from lynceus.operators.series import trend
from lynceus.operators.testing import MIN_GROUP, with_welch
from lynceus.table import Table

SCHEMA = (
    "kind string, column1 string, column2 string, confidence double, interpretation string, statistic double, "
    "p_value double, evidence array<struct<name:string,value:double>>, confounders array<string>"
)


def _evidence(**values: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in values.items()])


def _no_names() -> Column:
    return F.array().cast("array<string>")


def hypotheses_correlation(source, matrix: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Pairs with |r| >= .4; ``limit`` keeps the strongest ones."""
    t = Table.of(source)
    m = matrix if matrix is not None else t.matrix
    top = m.where(F.abs("value") >= 0.4)
    if limit:
        top = top.orderBy(F.abs("value").desc(), "column1", "column2").limit(limit)
    listed = confounder_table(t, top, m).groupBy("column1", "column2").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "confounder"))), lambda x: x["confounder"])
        .alias("confounders"))
    found = top.join(listed, ["column1", "column2"], "left").withColumn("confounders", F.coalesce("confounders", _no_names()))
    size = 10 if t.rows > 1000 else (-10 if t.rows < 100 else 0)
    confidence = (
        F.floor(F.abs("value") * 80 + 0.5) + size - F.when(F.size("confounders") > 2, 10).otherwise(0)).cast("double")
    return found.select(
        F.lit("correlation").alias("kind"), "column1", "column2",
        F.greatest(F.lit(30.0), F.least(F.lit(95.0), confidence)).alias("confidence"),
        causal_direction(F.col("column1"), F.col("column2")).alias("interpretation"),
        F.col("value").alias("statistic"), F.lit(None).cast("double").alias("p_value"),
        _evidence(pearson_r=F.col("value"), r_squared=F.col("value") * F.col("value"), rows=F.col("n")).alias("evidence"),
        "confounders")


def hypotheses_group_difference(source, max_columns: int | None = None) -> DataFrame:
    """Categorical columns of at most ten values against measures, where the means of the highest and lowest group
    (five values or more) differ by 10 % of their middle. ``max_columns`` takes the first columns of either kind only."""
    t = Table.of(source)
    groups = small_groups(t)
    if max_columns:
        first = F.array(*map(F.lit, t.numeric[:max_columns]))
        places = groups.select("place").distinct().orderBy("place").limit(max_columns)  # a row per small category
        groups = groups.where(F.array_contains(first, F.col("measure"))).join(F.broadcast(places), "place", "left_semi")
    pairs = extremes(groups, MIN_GROUP)
    middle = F.abs(F.col("top.mean") + F.col("bottom.mean")) / 2
    difference = F.coalesce(F.try_divide(F.abs(F.col("top.mean") - F.col("bottom.mean")), middle) * 100, F.lit(0.0))
    found = with_welch(pairs).withColumn("difference", difference).where(F.col("difference") >= 10)
    raw = F.when(F.col("significant"), 70 + (1 - F.col("p_value")) * 20).otherwise(40.0)
    return found.select(
        F.lit("group_difference").alias("kind"), F.col("category").alias("column1"), F.col("measure").alias("column2"),
        F.least(F.lit(90.0), F.greatest(F.lit(40.0), raw)).alias("confidence"),
        F.lit("correlational").alias("interpretation"), F.col("t_statistic").alias("statistic"), "p_value",
        _evidence(top_mean=F.col("top.mean"), top_n=F.col("top.n"), bottom_mean=F.col("bottom.mean"),
                  bottom_n=F.col("bottom.n"), difference_percent=F.col("difference")).alias("evidence"),
        _no_names().alias("confounders"))


def hypotheses_trend(source, order_by: list[str] | None = None, trends: DataFrame | None = None,
                     limit: int | None = None) -> DataFrame:
    """Columns with a trend that changed by 5 % or more; ``limit`` keeps the first ones in column order."""
    t = Table.of(source)
    found = trends if trends is not None else trend(t, None, order_by)
    change = F.abs("change_percent")
    steady = found.where((F.col("direction") != "stable") & (change >= 5))
    if limit:
        places = t.spark.createDataFrame(list(zip(t.columns, range(len(t.columns)))), "column string, place int")
        steady = steady.join(places, "column").orderBy("place").limit(limit)
    raw = (
        F.lit(50.0) + F.when(change > 50, 25).when(change > 20, 15).otherwise(0) + (10 if t.rows > 100 else 0))
    return steady.select(
        F.lit("trend").alias("kind"), F.col("column").alias("column1"), F.lit(None).cast("string").alias("column2"),
        F.least(F.lit(85.0), raw).alias("confidence"), F.lit("correlational").alias("interpretation"),
        F.col("change_percent").alias("statistic"), F.lit(None).cast("double").alias("p_value"),
        _evidence(change_percent=F.col("change_percent"), slope=F.col("slope")).alias("evidence"),
        _no_names().alias("confounders"))


def hypotheses_anomaly(source) -> DataFrame:
    """Columns with values outside the quartile fences."""
    t = Table.of(source)
    rows = []
    for column, found in outlier_counts(t).items():
        if not found["outliers"]:
            continue
        share, z = 100.0 * found["outliers"] / t.rows, found["max_zscore"]
        confidence = (70 if share > 5 else 60 if share > 2 else 50) + (10 if z > 5 else 0)
        severity = "extreme" if z > 4 else "severe" if z > 3 else "moderate"
        evidence = [("outliers", float(found["outliers"])), ("outlier_percent", share), ("max_zscore", z),
                    ("expected_min", found["expected_min"]), ("expected_max", found["expected_max"])]
        rows.append(("anomaly", column, None, float(min(85, confidence)), severity, float(found["outliers"]), None,
                     evidence, []))
    return t.spark.createDataFrame(rows, SCHEMA)


def hypotheses(source, order_by: list[str] | None = None, limit: int | None = None, matrix: DataFrame | None = None,
               trends: DataFrame | None = None) -> DataFrame:
    """All hypotheses, most confident first; ``limit`` keeps the first ones. Trends need a row order and are left out
    without one."""
    t = Table.of(source)
    parts = [hypotheses_correlation(t, matrix), hypotheses_group_difference(t)]
    if trends is not None or order_by or t.order_by:
        parts.append(hypotheses_trend(t, order_by, trends))
    parts.append(hypotheses_anomaly(t))
    ranked = reduce(DataFrame.unionByName, parts).orderBy(
        F.col("confidence").desc(),
        F.array_position(F.array(*map(F.lit, ("correlation", "group_difference", "trend", "anomaly"))), F.col("kind")),
        "column1", "column2")
    return ranked.limit(limit) if limit else ranked
