"""How columns move together."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions.names import CONFOUNDER_WORDS, names_related
from lynceus.functions.scoring import clamp, correlation_strength
from lynceus.operators.values import grouping_key
from lynceus.table import Table

SUMS_PER_SCAN = 40  # more would not fit the generated code of one aggregation
CORRELATION_SCHEMA = "column1 string, column2 string, value double, strength string, n bigint"


def pearson(covariance: Column, variance_a: Column, variance_b: Column) -> Column:
    """r from population moments, null where a side is constant."""
    scale = F.sqrt(F.greatest(variance_a, F.lit(0.0))) * F.sqrt(F.greatest(variance_b, F.lit(0.0)))
    return F.try_divide(covariance, scale)


def correlation_matrix(source, cols: list[str] | None = None) -> DataFrame:
    """Pearson r of every pair of numeric columns over the rows where both are numbers (3 rows or more).

    Sums of products of centred values in one scan; no rows are shuffled. A few sums are plain aggregates, many are
    matrix products per Arrow batch.
    """
    t = Table.of(source)
    names = list(cols or t.numeric)
    facts = t.moments(names) if len(names) > 1 else {}
    names = [c for c in names if c in facts and facts[c]["count"]]
    pairs = list(combinations(names, 2))
    if not pairs:
        return t.spark.createDataFrame([], CORRELATION_SCHEMA)
    full = {c for c in names if facts[c]["count"] == facts[c]["rows"]}
    sums = sum(1 if full.issuperset(p) else 6 for p in pairs)
    found = _pair_moments(t, pairs, facts, full) if sums <= SUMS_PER_SCAN else _pair_products(t, names, facts)
    return (
        found.where((F.col("n") >= 3) & F.col("value").isNotNull())
        .select("column1", "column2", "value", correlation_strength(F.col("value")).alias("strength"), "n")
        .orderBy(F.abs("value").desc(), "column1", "column2")
    )


def _pair_products(t: Table, names: list[str], facts: dict[str, dict]) -> DataFrame:
    """All pairs by matrix products of the values and of what is present; a task gives one row per pair."""
    centred = t.df.select(*[(t.number(c) - F.lit(facts[c]["mean"])).alias(f"x{i}") for i, c in enumerate(names)])
    width = len(names)

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, x1, x2, xy = np.zeros((4, width, width))
        for frame in frames:
            x = frame.to_numpy(dtype=float)
            seen = ~np.isnan(x)
            x, seen = np.where(seen, x, 0.0), seen.astype(float)
            n += seen.T @ seen
            x1 += x.T @ seen
            x2 += (x * x).T @ seen
            xy += x.T @ x
        a, b = np.triu_indices(width, 1)
        yield pd.DataFrame({"a": a, "b": b, "n": n[a, b], "sx": x1[a, b], "sy": x1[b, a], "sxx": x2[a, b],
                            "syy": x2[b, a], "sxy": xy[a, b]})

    sums = centred.mapInPandas(
        products, "a int, b int, n double, sx double, sy double, sxx double, syy double, sxy double")
    merged = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    mean_x, mean_y = F.try_divide("sx", "n"), F.try_divide("sy", "n")
    r = pearson(F.try_divide("sxy", "n") - mean_x * mean_y, F.try_divide("sxx", "n") - mean_x * mean_x,
                F.try_divide("syy", "n") - mean_y * mean_y)
    shown = F.array(*[F.lit(c) for c in names])
    return merged.select(
        shown[F.col("a")].alias("column1"), shown[F.col("b")].alias("column2"), clamp(r, -1.0, 1.0).alias("value"),
        F.col("n").cast("bigint").alias("n"))


def _pair_moments(t: Table, pairs: list[tuple[str, str]], facts: dict[str, dict], full: set[str]) -> DataFrame:
    names = sorted({c for p in pairs for c in p})
    slot = {c: f"x{i}" for i, c in enumerate(names)}
    centred = t.df.select(*[(t.number(c) - F.lit(facts[c]["mean"])).alias(slot[c]) for c in names])
    aggregates, records = [], []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(slot[a]), F.col(slot[b])
        aggregates.append(F.sum(x * y).alias(f"xy{i}"))
        if a in full and b in full:
            n = F.lit(facts[a]["rows"])
            r = F.try_divide(F.col(f"xy{i}") / n, F.lit(facts[a]["std"] * facts[b]["std"]))
        else:
            aggregates += [
                F.count(x * y).alias(f"n{i}"),
                F.sum(F.when(y.isNotNull(), x)).alias(f"x{i}s"), F.sum(F.when(x.isNotNull(), y)).alias(f"y{i}s"),
                F.sum(F.when(y.isNotNull(), x * x)).alias(f"xx{i}"), F.sum(F.when(x.isNotNull(), y * y)).alias(f"yy{i}")]
            n = F.col(f"n{i}")
            mean_x, mean_y = F.try_divide(f"x{i}s", n), F.try_divide(f"y{i}s", n)
            r = pearson(F.try_divide(f"xy{i}", n) - mean_x * mean_y,
                        F.try_divide(f"xx{i}", n) - mean_x * mean_x, F.try_divide(f"yy{i}", n) - mean_y * mean_y)
        records.append(F.struct(F.lit(a).alias("column1"), F.lit(b).alias("column2"),
                                clamp(r, -1.0, 1.0).alias("value"),
                                n.cast("bigint").alias("n")))
    return centred.agg(*aggregates).select(F.inline(F.array(*records)))


def cramers_v(source, a: str, b: str) -> DataFrame:
    """Association of two categorical columns in [0, 1].

    chi-square = n (sum o^2 / (row total * column total) - 1), so empty cells need not be produced.
    """
    t = Table.of(source)
    cells = (
        t.df.select(grouping_key(t.text(a)).alias("a"), grouping_key(t.text(b)).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("o"))
    )
    rows = cells.groupBy("a").agg(F.sum("o").alias("row_total"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("col_total"))
    terms = cells.join(rows, "a").join(cols, "b").agg(
        F.coalesce(F.sum("o"), F.lit(0)).alias("n"),
        F.sum(F.col("o") * F.col("o") / (F.col("row_total").cast("double") * F.col("col_total"))).alias("s"),
        F.lit(None).cast("bigint").alias("row_levels"), F.lit(None).cast("bigint").alias("col_levels"),
    )
    levels = rows.agg(F.count(F.lit(1)).alias("row_levels")).unionByName(
        cols.agg(F.count(F.lit(1)).alias("col_levels")), allowMissingColumns=True)
    both = terms.unionByName(levels, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in ("n", "s", "row_levels", "col_levels")])
    smaller = F.least(F.col("row_levels"), F.col("col_levels")) - 1
    chi = F.greatest(F.col("n") * (F.col("s") - 1), F.lit(0.0))
    v = F.when(smaller < 1, 0.0).otherwise(clamp(F.sqrt(F.try_divide(chi, F.col("n") * smaller)), 0.0, 1.0))
    return one.select(
        F.lit(a).alias("column1"), F.lit(b).alias("column2"), "n", "row_levels", "col_levels",
        F.when(smaller < 1, 0.0).otherwise(F.coalesce(chi, F.lit(0.0))).alias("chi_squared"),
        F.coalesce(v, F.lit(0.0)).alias("cramers_v"),
    )


def point_biserial(source, num: str, cat: str) -> DataFrame:
    """Correlation of a number with "is the most frequent category"."""
    t = Table.of(source)
    pairs = t.df.select(grouping_key(t.text(cat)).alias("c"), t.number(num).alias("v")).where(F.col("c").isNotNull())
    groups = pairs.groupBy("c").agg(
        F.count(F.lit(1)).alias("rows"), F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    top = groups.orderBy(F.col("rows").desc(), "c").limit(1).select(F.col("c").alias("top"))
    joined = groups.join(F.broadcast(top), F.col("c") == F.col("top"), "left")
    is_top = F.col("top").isNotNull()
    weight = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    total = lambda test: F.sum(F.when(test & (F.col("n") > 0), F.col("n") * F.col("mean")))
    sums = joined.agg(
        F.max("top").alias("category"), F.count(F.lit(1)).alias("levels"),
        weight(is_top).alias("n1"), weight(~is_top).alias("n0"),
        total(is_top).alias("s1"), total(~is_top).alias("s0"),
        F.sum(F.when(F.col("n") > 0, F.col("n") * F.col("var"))).alias("within"),
        F.sum(F.when(F.col("n") > 0, F.col("n") * F.col("mean") * F.col("mean"))).alias("between"),
    )
    n = F.col("n0") + F.col("n1")
    grand = F.try_divide(F.col("s0") + F.col("s1"), n)
    std = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("within") + F.col("between"), n) - grand * grand))
    mean1, mean0 = F.try_divide("s1", "n1"), F.try_divide("s0", "n0")
    r = F.try_divide(mean1 - mean0, std) * F.sqrt(F.try_divide((F.col("n0") * F.col("n1")).cast("double"), n * n))
    return sums.select(
        F.lit(num).alias("measure"), F.lit(cat).alias("category_column"), "category", "n1", "n0",
        mean1.alias("mean1"), mean0.alias("mean0"),
        F.coalesce(clamp(r, -1.0, 1.0), F.lit(0.0)).alias("point_biserial"),
    )


def correlation_insights(source, matrix: DataFrame | None = None) -> DataFrame:
    """Strong pairs (|r| > .7, with explained variance) and pairs related by name that do not correlate (|r| < .1)."""
    m = matrix if matrix is not None else correlation_matrix(source)
    size = F.abs("value")
    kind = F.when(size > 0.7, "strong").when(
        (size < 0.1) & names_related(F.col("column1"), F.col("column2")), "surprisingly_weak")
    return m.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "column1", "column2", "value", (F.col("value") * F.col("value")).alias("r_squared"), "kind")


def both_ways(matrix: DataFrame) -> DataFrame:
    """Each pair in both orders."""
    swapped = matrix.select(F.col("column2").alias("column1"), F.col("column1").alias("column2"), "value")
    return matrix.select("column1", "column2", "value").unionByName(swapped)


def confounder_table(t: Table, pairs: DataFrame, matrix: DataFrame, limit: int | None = None) -> DataFrame:
    """Per pair (column1, column2) its confounders (the first ``limit``, if given): columns with |r| > .3 to both, then columns whose
    names suggest one. Rows (column1, column2, confounder, source, place)."""
    links = both_ways(matrix).where(F.abs("value") > 0.3)
    to_first = links.select(F.col("column1").alias("column1"), F.col("column2").alias("confounder"))
    to_second = links.select(F.col("column1").alias("column2"), F.col("column2").alias("confounder"))
    keyed = pairs.select("column1", "column2")
    correlated = keyed.join(to_first, "column1").join(to_second, ["column2", "confounder"]).select(
        "column1", "column2", "confounder", F.lit(0).alias("by_name"))
    named = [c for c in t.columns if any(w in c.lower() for w in CONFOUNDER_WORDS)]
    suggested = keyed.select(
        "column1", "column2", F.explode(F.array(*[F.lit(c) for c in named]).cast("array<string>")).alias("confounder"),
        F.lit(1).alias("by_name"),
    ).where((F.col("confounder") != F.col("column1")) & (F.col("confounder") != F.col("column2")))
    places = t.spark.createDataFrame(list(zip(t.columns, range(len(t.columns)))), "confounder string, place int")
    merged = (
        correlated.unionByName(suggested)
        .groupBy("column1", "column2", "confounder").agg(F.min("by_name").alias("by_name"))
        .join(places, "confounder")
    )
    ordered = F.array_sort(F.collect_list(F.struct("by_name", "place", "confounder")))  # at most one per column
    ranked = merged.groupBy("column1", "column2").agg((F.slice(ordered, 1, limit) if limit else ordered).alias("found"))
    return ranked.select("column1", "column2", F.posexplode("found").alias("position", "entry")).select(
        "column1", "column2", "position", F.col("entry.confounder").alias("confounder"),
        F.when(F.col("entry.by_name") == 1, "name").otherwise("correlation").alias("basis"))


def confounders(source, a: str, b: str, matrix: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Columns that may explain the correlation of two columns; ``limit`` keeps the first ones."""
    t = Table.of(source)
    pair = t.spark.createDataFrame([(a, b)], "column1 string, column2 string")
    found = confounder_table(t, pair, matrix if matrix is not None else correlation_matrix(t), limit)
    return found.select("position", "confounder", "basis")
