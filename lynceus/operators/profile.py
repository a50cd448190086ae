"""Column and table profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lynceus.functions import cells
from lynceus.operators.values import distinct_counts, grouping_key, quoted, spell_out, top_values
from lynceus.operators.groups import small_groups
from lynceus.table import Table

STATS_SCHEMA = (
    "column string, count bigint, null_count bigint, mean double, median double, min double, max double, "
    "std double, sum double, p25 double, p50 double, p75 double, skewness double"
)

# Names of a table's key measure.
KEY_MEASURE_WORDS = ("revenue", "sales", "amount", "total", "value", "price")


def numeric_stats(source, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """One row of statistics per numeric column. ``approx`` trades exact quartiles for a single scan."""
    t = Table.of(source)
    names = list(cols or t.numeric)
    if approx:
        return _approximate_stats(t, names)
    facts = t.summary(names)
    rows = [
        (c, s["count"], s["null_count"], s["mean"], s["median"], s["min"], s["max"], s["std"], s["sum"],
         s["p25"], s["median"], s["p75"], s["skewness"]) for c, s in facts.items()
    ]
    return t.spark.createDataFrame(rows, STATS_SCHEMA)


def _approximate_stats(t: Table, names: list[str]) -> DataFrame:
    aggregates, records = [], []
    for i, c in enumerate(names):
        v = t.number(c)
        aggregates += [
            F.count(v).alias(f"n{i}"), F.count_if(~cells.present(t.df, c)).alias(f"z{i}"), F.avg(v).alias(f"a{i}"),
            F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.stddev_pop(v).alias(f"sd{i}"),
            F.sum(v).alias(f"s{i}"), F.percentile_approx(v, [0.25, 0.5, 0.75], 10000).alias(f"q{i}"),
            F.skewness(v).alias(f"sk{i}"),
        ]
        records.append(F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"z{i}").alias("null_count"),
            F.col(f"a{i}").alias("mean"), F.col(f"q{i}")[1].alias("median"), F.col(f"lo{i}").alias("min"),
            F.col(f"hi{i}").alias("max"), F.col(f"sd{i}").alias("std"), F.col(f"s{i}").alias("sum"),
            F.col(f"q{i}")[0].alias("p25"), F.col(f"q{i}")[1].alias("p50"), F.col(f"q{i}")[2].alias("p75"),
            F.col(f"sk{i}").alias("skewness")))
    return t.df.agg(*aggregates).select(F.inline(F.array(*records)))


def categorical_stats(source, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """Rows per categorical column and top value: count (missing included), null_count, unique_count, rank, value."""
    t = Table.of(source)
    names = list(cols or t.categorical)
    vc = t.counts(names)
    top = top_values(vc, k).select("column", "rank", "value", F.col("cnt").alias("value_count"))
    top = spell_out(t.df, top, [c for c in names if c in t.long_texts])
    per_column = distinct_counts(vc).select("column", F.col("rows").alias("count"), "null_count", "unique_count")
    return per_column.join(top, "column", "left")


def column_nulls_uniques(source, approx: bool = False) -> DataFrame:
    """Missing cells and distinct values per column; ``approx`` counts distinct values with HyperLogLog in one scan."""
    t = Table.of(source)
    if not approx:
        return distinct_counts(t.counts(t.columns)).select("column", "null_count", "unique_count")
    aggregates, records = [], []
    for i, c in enumerate(t.columns):
        aggregates += [F.count_if(~cells.present(t.df, c)).alias(f"z{i}"), F.approx_count_distinct(t.text(c)).alias(f"u{i}")]
        records.append(F.struct(F.lit(c).alias("column"), F.col(f"z{i}").alias("null_count"),
                                F.col(f"u{i}").alias("unique_count")))
    return t.df.agg(*aggregates).select(F.inline(F.array(*records)))


def duplicate_rows(source) -> DataFrame:
    """Rows that repeat an earlier row. Equal rows merge before the shuffle; long texts travel as digests."""
    t = Table.of(source)
    keys = []
    for field in t.df.schema.fields:
        if field.dataType.typeName() == "string" or cells.is_nested_type(field.dataType):
            keys.append(grouping_key(t.text(field.name)).alias(field.name))
        else:
            keys.append(quoted(field.name))
    groups = t.df.select(*keys).groupBy(*[quoted(c) for c in t.columns]).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("distinct_rows")
    ).withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_rows"))


def dataset_summary(source) -> DataFrame:
    """One row: size, column kinds, share of missing cells, duplicate rows, and maps of nulls and distinct values."""
    t = Table.of(source)
    width = len(t.columns)
    per_column = distinct_counts(t.counts(t.columns)).agg(
        F.sum("null_count").alias("nulls"),
        F.map_from_entries(F.collect_list(F.struct("column", "null_count"))).alias("null_counts"),
        F.map_from_entries(F.collect_list(F.struct("column", "unique_count"))).alias("unique_counts"),
    )
    both = duplicate_rows(t).unionByName(per_column, allowMissingColumns=True)
    one = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])
    return one.select(
        "total_rows", F.lit(width).alias("total_columns"), F.lit(len(t.numeric)).alias("numeric_columns"),
        F.lit(len(t.categorical)).alias("categorical_columns"),
        F.coalesce(F.try_divide(F.col("nulls").cast("double"), F.col("total_rows") * width), F.lit(0.0)).alias("missing_percent"),
        "duplicate_rows", "null_counts", "unique_counts",
    )


def category_distribution(source, col: str, k: int = 8) -> DataFrame:
    """The k most frequent values of a column with their counts (bar and pie chart data)."""
    t = Table.of(source)
    top = spell_out(t.df, top_values(t.counts([col]), k), [c for c in [col] if c in t.long_texts])
    return top.select("rank", "value", F.col("cnt").alias("count"))


def mean_by_category(source, num: str, cat: str, k: int = 8) -> DataFrame:
    """Mean of a number per category, the k highest. Missing and empty categories are "Unknown"."""
    t = Table.of(source)
    return (
        t.df.select(F.coalesce(t.text(cat), F.lit("Unknown")).alias("category"), t.number(num).alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy("category").agg(F.avg("v").alias("mean"))
        .orderBy(F.col("mean").desc(), "category").limit(k)
    )


def dominant_values(source, cols: list[str] | None = None) -> DataFrame:
    """Top value per categorical column, its share of all rows and of the top ten, and the bands it falls in."""
    t = Table.of(source)
    stats = categorical_stats(t, cols, k=10)
    per_column = Window.partitionBy("column")
    return (
        stats.where(F.col("rank").isNotNull())
        .withColumn("top_total", F.sum("value_count").over(per_column))
        .where(F.col("rank") == 1)
        .select(
            "column", "value", "value_count",
            (F.col("value_count") / F.col("count")).alias("share"),
            (F.col("value_count") / F.col("top_total")).alias("share_of_top"),
        )
        .withColumn("over_half", F.col("share") > 0.5)
        .withColumn("imbalanced", F.col("share_of_top") > 0.6)
        .withColumn("dominated", F.col("share") > 0.7)
        .withColumn("nearly_constant", F.col("share") > 0.9)
    )


def round_number_ratio(source, cols: list[str] | None = None) -> DataFrame:
    """Share of numeric cells divisible by five."""
    t = Table.of(source)
    names = list(cols or t.numeric)
    rows = t.df.agg(*[F.avg(F.when(t.number(c) % 5 == 0, 1.0).when(t.number(c).isNotNull(), 0.0)).alias(str(i))
                      for i, c in enumerate(names)])
    return rows.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(str(i)), F.lit(0.0)).alias("round_ratio"))
        for i, c in enumerate(names)])))


def near_duplicate_labels(source, col: str, top_k: int | None = None) -> DataFrame:
    """Labels that differ only in case or surrounding blanks. ``top_k`` looks at the most frequent labels only."""
    t = Table.of(source)
    raw = quoted(col) if t.df.schema[col].dataType.typeName() == "string" else t.text(col)
    labels = (
        t.df.select(cells.null_if_token(raw).alias("label")).where(F.col("label").isNotNull())
        .groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))
    )
    if top_k:
        labels = labels.orderBy(F.col("cnt").desc(), "label").limit(top_k)
    return (
        labels.groupBy(cells.fold(F.col("label")).alias("normalized"))
        .agg(F.count(F.lit(1)).alias("spellings"), F.sum("cnt").alias("rows"),
             F.min("label").alias("first_label"), F.max("label").alias("last_label"))
        .where(F.col("spellings") > 1)
    )


def distribution_shape(source, cols: list[str] | None = None) -> DataFrame:
    """Skewness and position of the mean within the range, with their flags."""
    t = Table.of(source)
    rows = [(c, s["mean"], s["min"], s["max"], s["skewness"]) for c, s in t.moments(cols).items()]
    stats = t.spark.createDataFrame(rows, "column string, mean double, min double, max double, skewness double")
    position = F.try_divide(F.col("mean") - F.col("min"), F.col("max") - F.col("min"))
    return stats.select(
        "column", "skewness", position.alias("mean_position"),
        F.coalesce(F.abs("skewness") > 2, F.lit(False)).alias("skewed"),
        F.coalesce((position < 0.2) | (position > 0.8), F.lit(False)).alias("concentrated"),
    )


def similar_distributions(source, cols: list[str] | None = None) -> DataFrame:
    """Column pairs whose means agree within 10 % and standard deviations within 20 %.

    Means within 10 % share a bucket of the logarithm of the mean or sit in neighbouring buckets, so pairs are found
    by an equality join.
    """
    t = Table.of(source)
    place = {c: i for i, c in enumerate(t.columns)}
    stats = t.spark.createDataFrame(
        [(c, place[c], s["mean"], s["std"]) for c, s in t.moments(cols).items() if s["mean"] and s["std"]],
        "column string, place int, mean double, std double",
    ).withColumn("bucket", F.floor(F.log(F.abs("mean")) / F.log(F.lit(1.2))))
    a = stats.select(*[F.col(c).alias(c + "1") for c in stats.columns if c != "bucket"],
                     F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    b = stats.select(*[F.col(c).alias(c + "2") for c in stats.columns if c != "bucket"], "bucket")
    ratio = {x: F.col(x + "1") / F.col(x + "2") for x in ("mean", "std")}
    return (
        a.join(b, "bucket").where(F.col("place1") < F.col("place2"))
        .select("column1", "column2", ratio["mean"].alias("mean_ratio"), ratio["std"].alias("std_ratio"))
        .where((F.abs(F.col("mean_ratio") - 1) < 0.1) & (F.abs(F.col("std_ratio") - 1) < 0.2))
    )


def uniformity_check(source, cols: list[str] | None = None) -> DataFrame:
    """For columns spanning exactly 0 to 100: largest deviation of five equal buckets from an even spread."""
    t = Table.of(source)
    spans = {c: s for c, s in t.moments(cols).items() if s["min"] == 0 and s["max"] == 100}
    schema = "column string, n bigint, max_deviation double, uniform boolean"
    if not spans:
        return t.spark.createDataFrame([], schema)
    aggregates, records = [], []
    for i, c in enumerate(spans):
        v = t.number(c)
        bucket = F.when(v.isNotNull(), F.least(F.lit(4), F.floor(v / 20)))  # least alone would skip a null
        aggregates += [F.count_if(bucket == b).alias(f"b{i}_{b}") for b in range(5)]
        even = spans[c]["count"] / 5
        worst = F.greatest(*[F.abs(F.col(f"b{i}_{b}") - F.lit(even)) for b in range(5)]) / F.lit(even)
        records.append(F.struct(F.lit(c).alias("column"), F.lit(spans[c]["count"]).cast("bigint").alias("n"),
                                worst.alias("max_deviation"), (worst < 0.05).alias("uniform")))
    return t.df.agg(*aggregates).select(F.inline(F.array(*records)))


def group_means_agree(t: Table, cats: list[str], nums: list[str]) -> DataFrame:
    """``group_mean_homogeneity`` of every category with every measure: one grouping per category."""
    stds = {c: s["std"] for c, s in t.moments(nums).items()}
    slots = {n: f"m{i}" for i, n in enumerate(nums)}
    parts = []
    for cat in cats:
        groups = t.df.select(
            F.coalesce(grouping_key(t.text(cat)), F.lit("null")).alias("g"),
            *[t.number(n).alias(m) for n, m in slots.items()],
        ).groupBy("g").agg(*[F.avg(m).alias(m) for m in slots.values()])
        facts = groups.agg(*[
            F.struct(F.lit(n).alias("measure"), F.lit(stds[n]).cast("double").alias("std"), F.count(m).alias("groups"),
                     F.avg(m).alias("middle"), F.min(m).alias("lowest"), F.max(m).alias("highest")).alias(m)
            for n, m in slots.items()])
        parts.append(facts.select(F.lit(cat).alias("category"), F.inline(F.array(*slots.values()))))
    spread = F.greatest(F.col("highest") - F.col("middle"), F.col("middle") - F.col("lowest"))
    return reduce(DataFrame.unionByName, parts).select(
        "category", "measure", "groups", spread.alias("max_difference"), "std",
        F.coalesce((F.col("groups") >= 3) & (spread < 1) & (F.col("std") > 10), F.lit(False)).alias("homogeneous"))


def group_mean_homogeneity(source, cat: str, num: str) -> DataFrame:
    """Do the group means agree (largest distance below 1) although the values spread (std above 10)?"""
    return group_means_agree(Table.of(source), [cat], [num])


def segment_profile(source, max_segments: int | None = None, max_measures: int | None = None,
                    max_values: int | None = None) -> DataFrame:
    """Segments that differ: values (10 rows or more) of columns with 2 to 10 values, and the measures whose segment
    mean is more than 10 % off the overall mean.

    One row per segment and such measure. For a short report, ``max_measures`` takes the first measures only,
    ``max_values`` the most frequent values of a column and ``max_segments`` the first segments in column and frequency
    order; by default nothing is left out.
    """
    t = Table.of(source)
    overall = {m: s["mean"] for m, s in t.moments(t.numeric[:max_measures]).items() if s["mean"]}
    schema = ("segment_order bigint, column string, value string, size bigint, share double, measure string, "
              "segment_mean double, difference_percent double")
    if not overall:
        return t.spark.createDataFrame([], schema)
    groups = small_groups(t)
    if max_values:
        by_size = Window.partitionBy("place").orderBy(F.col("size").desc(), "value")  # ten values of a column at most
        groups = groups.withColumn("rank", F.dense_rank().over(by_size)).where(F.col("rank") <= max_values)
    middle = F.element_at(F.create_map(*[x for m, v in overall.items() for x in (F.lit(m), F.lit(v))]), F.col("measure"))
    distinct = (
        groups.where(F.col("size") >= 10).withColumn("middle", middle).where(F.col("middle").isNotNull())
        .withColumn("segment_mean", F.col("mean"))
        .withColumn("difference_percent", 100 * (F.col("mean") - F.col("middle")) / F.col("middle"))
        .where(F.abs("difference_percent") > 10).withColumn("share", F.col("size") / F.lit(t.rows)))
    # at most 10 segments per column, so the ranking window is small by construction
    order = Window.orderBy("place", F.col("size").desc(), "value")
    ranked = distinct.withColumn("segment_order", F.dense_rank().over(order).cast("bigint"))
    if max_segments:
        ranked = ranked.where(F.col("segment_order") <= max_segments)
    return ranked.select("segment_order", "column", "value", "size", "share", "measure", "segment_mean", "difference_percent")


def key_measure(t: Table) -> str | None:
    named = [c for c in t.numeric if any(w in c.lower() for w in KEY_MEASURE_WORDS)]
    return (named or t.numeric or [None])[0]
