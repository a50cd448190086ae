"""Tables compared with tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.functions.names import CATALOG_KEY_WORDS, KEY_SPELLINGS, contains_any, squeeze_name
from lynceus.operators.profile import column_nulls_uniques
from lynceus.operators.quality import quality_score
from lynceus.operators.relations import _as_tables
from lynceus.table import Table


def catalog(tables) -> DataFrame:
    """One row per table and column with the size of the table: what the comparisons below work on."""
    named = _as_tables(tables)
    spark = next(iter(named.values())).spark
    rows = [(i, n, len(t.columns), c) for i, (n, t) in enumerate(named.items()) for c in t.columns]
    columns = spark.createDataFrame(rows, "place int, table string, width int, column string")
    counts = reduce(DataFrame.unionByName, [
        t.df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in named.items()])
    return columns.join(counts, "table").select("place", "table", "width", "column", "rows")


def catalog_similarity(tables, limit: int | None = None) -> DataFrame:
    """Per pair of tables: common columns, possible joins by key name, and schema overlap above 70 %, most confident
    first; ``limit`` keeps the first ones."""
    c = catalog(tables)
    first = c.select(*[F.col(x).alias(x + "1") for x in c.columns])
    second = c.select(*[F.col(x).alias(x + "2") for x in c.columns])
    in_order = F.col("place1") < F.col("place2")
    common = (
        first.join(second, F.col("column1") == F.col("column2")).where(in_order)
        .groupBy("table1", "table2", "width1", "width2", "rows1", "rows2")
        .agg(F.count(F.lit(1)).alias("shared"), F.array_sort(F.collect_list("column1")).alias("columns"))
    )
    overlap = F.col("shared") / F.greatest("width1", "width2")
    shared_rows = common.select(
        F.lit("common_columns").alias("kind"), "table1", "table2",
        F.least(F.lit(90.0), 50.0 + 10.0 * F.col("shared")).alias("confidence"), "columns",
        F.col("shared").cast("double").alias("measure"), "rows1", "rows2")
    schema_rows = common.where(overlap > 0.7).select(
        F.lit("schema_similarity").alias("kind"), "table1", "table2", F.lit(85.0).alias("confidence"), "columns",
        overlap.alias("measure"), "rows1", "rows2")
    ranked = shared_rows.unionByName(_possible_joins(c)).unionByName(schema_rows).orderBy(
        F.col("confidence").desc(), "kind", "table1", "table2", "columns")
    return ranked.limit(limit) if limit else ranked


def _possible_joins(c: DataFrame) -> DataFrame:
    """Key-like columns with similar names: equal without separators, one inside the other, or two spellings of one
    entity key. Containment is found by joining a name with the substrings of the others."""
    keys = c.where(contains_any(F.lower("column"), CATALOG_KEY_WORDS)).withColumn("squeezed", squeeze_name(F.col("column")))
    starts = F.sequence(F.lit(1), F.length("squeezed"))
    pieces = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.transform(
        F.sequence(F.lit(1), F.length("squeezed") - s + 1), lambda n: F.substring("squeezed", s, n)))))
    groups = F.array_compact(F.array(*[
        F.when(F.col("squeezed").isin(*forms), F.lit("#" + forms[0])) for forms in KEY_SPELLINGS]))
    whole = keys.select("place", "table", "column", "rows", F.explode(F.concat(F.array("squeezed"), groups)).alias("token"))
    parts = keys.select(F.col("place").alias("place2"), F.col("table").alias("table2"), F.col("column").alias("column2"),
                        F.col("rows").alias("rows2"), F.explode(F.concat(pieces, groups)).alias("token"))
    joined = whole.join(parts, "token").where((F.col("place") != F.col("place2")) & (F.col("column") != F.col("column2")))
    earlier = F.col("place") < F.col("place2")
    return joined.select(
        F.when(earlier, F.col("table")).otherwise(F.col("table2")).alias("table1"),
        F.when(earlier, F.col("table2")).otherwise(F.col("table")).alias("table2"),
        F.when(earlier, F.array("column", "column2")).otherwise(F.array("column2", "column")).alias("columns"),
        F.when(earlier, F.col("rows")).otherwise(F.col("rows2")).alias("rows1"),
        F.when(earlier, F.col("rows2")).otherwise(F.col("rows")).alias("rows2"),
    ).distinct().select(
        F.lit("possible_join").alias("kind"), "table1", "table2", F.lit(70.0).alias("confidence"), "columns",
        F.lit(1.0).alias("measure"), "rows1", "rows2")


def compare_datasets(a, b, order_by: list[str] | None = None) -> DataFrame:
    """Two tables side by side, one row per column of either: where it occurs and its numbers on each side.

    Table-level facts (rows, columns, quality score) are the row with a null column.
    """
    a, b = Table.of(a), Table.of(b)

    def facts(t: Table, side: str) -> DataFrame:
        counts = column_nulls_uniques(t)
        means = t.spark.createDataFrame(
            [(c, s["mean"], s["std"]) for c, s in t.moments().items()], "column string, mean double, std double")
        return counts.join(means, "column", "left").select(
            "column", *[F.col(x).alias(f"{x}_{side}") for x in ("null_count", "unique_count", "mean", "std")],
            F.lit(True).alias(f"in_{side}"))

    def whole(t: Table, side: str) -> DataFrame:
        return quality_score(t).select(
            F.lit(t.rows).cast("bigint").alias(f"rows_{side}"), F.lit(len(t.columns)).alias(f"columns_{side}"),
            F.col("score").alias(f"score_{side}"))

    columns = facts(a, "left").join(facts(b, "right"), "column", "full").select(
        "column",
        F.when(F.col("in_left") & F.col("in_right"), "common").when(F.col("in_left"), "only_left")
        .otherwise("only_right").alias("presence"),
        *[f"{x}_{side}" for x in ("null_count", "unique_count", "mean", "std") for side in ("left", "right")],
        (F.col("mean_right") - F.col("mean_left")).alias("mean_change"))
    both = whole(a, "left").unionByName(whole(b, "right"), allowMissingColumns=True)
    table = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns]).withColumn("presence", F.lit("table"))
    return table.unionByName(columns, allowMissingColumns=True)


def dataset_fingerprint(source, name: str | None = None) -> DataFrame:
    """Name, size, hash of the column names and an order-free hash of all rows.

    The content hash adds up 60 bits of each row's MD5 in decimal arithmetic, so it does not depend on row order,
    partitioning or the number of executors.
    """
    t = Table.of(source)
    label = name or t.name
    # Each cell begins with its length, so cells cannot run into each other; a missing one is "-".
    cells = [F.coalesce(F.concat(F.length(t.text(c)).cast("string"), F.lit(":"), t.text(c)), F.lit("-")) for c in t.columns]
    row = F.md5(F.concat(*cells))
    bits = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(28,0)")
    return t.df.select(bits.alias("h")).agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("h"), F.lit(0)).cast("decimal(38,0)").cast("string").alias("content_hash")
    ).select(
        F.lit(label).alias("name"), "row_count", F.lit(len(t.columns)).alias("column_count"),
        F.lit("|".join(t.columns)).alias("columns"),
        F.substring(F.md5(F.lit("|".join(t.columns))), 1, 8).alias("column_hash"), "content_hash")


def column_sets(a, b) -> DataFrame:
    """Rows (column, presence): common, only_left, only_right."""
    left, right = Table.of(a).columns, Table.of(b).columns
    spark = Table.of(a).spark
    rows = [(c, "common" if c in right else "only_left") for c in left] + [(c, "only_right") for c in right if c not in left]
    return spark.createDataFrame(rows, "column string, presence string")

