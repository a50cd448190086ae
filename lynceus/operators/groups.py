"""Statistics of measures within the values of small categories, for all categories in one aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.functions import cells
from lynceus.session import stored
from lynceus.table import Table

GROUPS = "place int, column string, value string, size bigint, measure string, n bigint, mean double, var double"


def group_facts(t: Table, cats: list[str], nums: list[str]) -> DataFrame:
    """Rows (place, column, value, size, measure, n, mean, var): every value of each category with every measure.

    Each row is offered to its group of every category and measure before anything is merged, and merged before anything is
    shuffled: one scan, one shuffle of group records. Missing categories form no group.
    """
    if not cats or not nums:
        return t.spark.createDataFrame([], GROUPS)
    views = [cells.key_view(t.df, c).cast("string").alias(f"g{i}") for i, c in enumerate(cats)]
    rows = t.df.select(*views, *[t.number(c).alias(f"x{i}") for i, c in enumerate(nums)])
    groups = F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"g{i}").alias("key")) for i in range(len(cats))])
    measures = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"x{i}").alias("x")) for i in range(len(nums))])
    each = rows.select(F.inline(groups), *[f"x{i}" for i in range(len(nums))]).where(F.col("key").isNotNull())
    found = each.select("place", "key", F.inline(measures)).groupBy("place", "key", "slot").agg(
        F.count(F.lit(1)).alias("size"), F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    # the canonical text is made per group
    value = reduce(lambda a, i: F.when(F.col("place") == i, cells.key_text(t.df, cats[i], "key")).otherwise(a),
                   range(len(cats)), F.lit(None).cast("string"))
    named = [F.array(*map(F.lit, names))[F.col(c)].alias(k) for names, c, k in ((cats, "place", "column"), (nums, "slot", "measure"))]
    return found.select("place", named[0], value.alias("value"), "size", named[1], "n", "mean", "var")


def small_groups(t: Table) -> DataFrame:
    """``group_facts`` of all categories of 2 to 10 values and all measures, kept with the table (a small record each)."""
    if t.small_groups is None:
        cats, nums = t.few_valued(2, 10), t.numeric
        if cats and nums:
            t.small_groups = stored(group_facts(t, cats, nums), "groups")
        else:
            t.small_groups = t.spark.createDataFrame([], GROUPS)
    return t.small_groups


def extremes(groups: DataFrame, min_group: int) -> DataFrame:
    """Per category and measure the groups (``min_group`` values or more) with the highest and the lowest mean: rows
    (category, measure, groups, top, bottom), the last two structs (group, n, mean, var)."""
    side = F.struct(F.col("value").alias("group"), "n", "mean", "var")
    return (
        groups.where((F.col("n") >= min_group) & (F.col("value") != "")).groupBy(F.col("column").alias("category"), "measure").agg(
            F.count(F.lit(1)).alias("groups"),
            F.min_by(side, F.struct(-F.col("mean"), F.col("value"))).alias("top"),
            F.min_by(side, F.struct(F.col("mean"), F.col("value"))).alias("bottom"))
        .where(F.col("groups") >= 2)
    )
