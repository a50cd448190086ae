"""Statistical tests. ``p_value`` is the two-tailed normal value, ``p_value_ref`` the historical variant of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.functions.scoring import correlation_t, p_value, p_value_ref
from lynceus.operators.association import _pair_moments
from lynceus.operators.groups import extremes, group_facts
from lynceus.operators.outliers import outlier_test
from lynceus.operators.series import trend_test
from lynceus.table import Table

ALPHA = 0.05
MIN_GROUP = 5


def with_welch(extremes: DataFrame) -> DataFrame:
    """Add t (population variances) and its p-values; a zero standard error means no evidence (t = 0, p = 1)."""
    se = F.sqrt(F.col("top.var") / F.col("top.n") + F.col("bottom.var") / F.col("bottom.n"))
    statistic = F.coalesce(F.try_divide(F.col("top.mean") - F.col("bottom.mean"), se), F.lit(0.0))
    none = se == 0
    return (
        extremes.withColumn("t_statistic", statistic)
        .withColumn("p_value", F.when(none, 1.0).otherwise(p_value(F.col("t_statistic"))))
        .withColumn("p_value_ref", F.when(none, 1.0).otherwise(p_value_ref(F.col("t_statistic"))))
        .withColumn("significant", F.col("p_value") < ALPHA)
        .withColumn("significant_ref", F.col("p_value_ref") < ALPHA)
    )


def welch_t_test(source, num: str, cat: str) -> DataFrame:
    """Do the groups with the highest and the lowest mean differ? No row with fewer than two groups of five."""
    t = Table.of(source)
    tested = with_welch(extremes(group_facts(t, [cat], [num]), MIN_GROUP))
    return tested.select(
        "category", "measure", "groups",
        F.col("top.group").alias("top_group"), F.col("top.n").alias("top_n"), F.col("top.mean").alias("top_mean"),
        F.col("bottom.group").alias("bottom_group"), F.col("bottom.n").alias("bottom_n"),
        F.col("bottom.mean").alias("bottom_mean"), "t_statistic", "p_value", "p_value_ref",
        F.try_divide(F.col("top.mean") - F.col("bottom.mean"), F.col("bottom.mean")).alias("effect_size"),
        F.col("significant").alias("supported"), F.col("significant_ref").alias("supported_ref"),
        F.when(F.col("significant"), 75.0).otherwise(40.0).alias("confidence"))


def correlation_test(source, a: str, b: str) -> DataFrame:
    """Pearson r with t and p; supported if |r| >= .4 and p < .05. No row with fewer than ten pairs."""
    t = Table.of(source)
    facts = t.moments([a, b])
    schema = ("column1 string, column2 string, n bigint, r double, t_statistic double, p_value double, "
              "p_value_ref double, supported boolean, supported_ref boolean, confidence double")
    if not (facts[a]["count"] and facts[b]["count"]):
        return t.spark.createDataFrame([], schema)
    full = {c for c, s in facts.items() if s["count"] == s["rows"]}
    r = F.coalesce("value", F.lit(0.0))
    tested = _pair_moments(t, [(a, b)], facts, full).where(F.col("n") >= 10).withColumn("r", r)
    tested = tested.withColumn("t_statistic", correlation_t(F.col("r"), F.col("n")))
    tested = tested.withColumn("p_value", F.coalesce(p_value(F.col("t_statistic")), F.lit(0.0))).withColumn(
        "p_value_ref", F.coalesce(p_value_ref(F.col("t_statistic")), F.lit(0.0)))
    strong = F.abs("r") >= 0.4
    return tested.select(
        "column1", "column2", "n", "r", "t_statistic", "p_value", "p_value_ref",
        (strong & (F.col("p_value") < ALPHA)).alias("supported"),
        (strong & (F.col("p_value_ref") < ALPHA)).alias("supported_ref"),
        F.floor(F.abs("r") * 100 + 0.5).cast("double").alias("confidence"))


def test_hypothesis(source, kind: str, variables: list[str], order_by: list[str] | None = None) -> DataFrame:
    """Test one hypothesis row: correlation, group_difference, trend or anomaly. Rows (kind, statistic, p_value,
    supported, confidence)."""
    if kind == "correlation":
        tested = correlation_test(source, *variables).withColumn("statistic", F.col("r"))
    elif kind == "group_difference":
        category, measure = variables
        tested = welch_t_test(source, measure, category).withColumn("statistic", F.col("t_statistic"))
    elif kind == "trend":
        tested = trend_test(source, list(variables), order_by).withColumn("statistic", F.col("r"))
    elif kind == "anomaly":
        tested = outlier_test(source, *variables).withColumn("statistic", F.col("outliers")).withColumn(
            "p_value", F.lit(None).cast("double"))
    else:
        raise ValueError(f"unknown kind of hypothesis: {kind}")
    return tested.select(
        F.lit(kind).alias("kind"), F.col("statistic").cast("double").alias("statistic"), "p_value", "supported",
        F.col("confidence").cast("double").alias("confidence"))


test_hypothesis.__test__ = False
