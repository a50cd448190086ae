"""Profiles that merge: partial states per part of a table, combined exactly, also over a stream."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lynceus.functions import cells
from lynceus.operators.ranks import sketch_of
from lynceus.operators.values import quoted
from lynceus.streaming import manifest

DISTINCT_BITS = 12
PAIRS_PER_SCAN = 8  # more would not fit the generated code of one aggregation


def _numeric_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if cells.is_number_type(f.dataType)]


def profile_state(df: DataFrame, by: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    """Partial state per part and column: counts, sum, squared deviations, extremes, distinct and quantile sketches.

    ``by`` names the parts; all aggregation is partial on the map side, so a part holding most rows costs no more
    than any other.
    """
    names = [c for c in (cols or df.columns) if c not in (by or [])]
    keys = [quoted(b) for b in by or []]
    views = [v for i, c in enumerate(names) for v in (
        cells.numeric_view(df, c).alias(f"x{i}"), cells.present(df, c).alias(f"p{i}"), _identity(df, c).alias(f"u{i}"))]
    seen = df.select(*keys, *views)
    moments, moment_rows, sketches, sketch_rows = [], [], [], []
    for i, c in enumerate(names):
        v = F.col(f"x{i}")
        moments += [
            F.count_if(~F.col(f"p{i}")).alias(f"z{i}"), F.count(v).alias(f"n{i}"), F.sum(v).alias(f"s{i}"),
            F.var_pop(v).alias(f"v{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        moment_rows.append(F.struct(
            F.lit(c).alias("column"), F.col("rows"), F.col(f"z{i}").alias("nulls"), F.col(f"n{i}").alias("n"),
            F.col(f"s{i}").alias("total"), (F.col(f"n{i}") * F.col(f"v{i}")).alias("deviations"),
            F.col(f"lo{i}").alias("lowest"), F.col(f"hi{i}").alias("highest")))
        sketches += [F.hll_sketch_agg(f"u{i}", DISTINCT_BITS).alias(f"d{i}"), sketch_of(v).alias(f"q{i}")]
        sketch_rows.append(F.struct(
            F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct_sketch"), F.col(f"q{i}").alias("quantile_sketch")))
    # moments and sketches are separate rows of the state, because sketches keep Spark from compiling the moments
    exact = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *moments).select(*keys, F.inline(F.array(*moment_rows)))
    rough = seen.groupBy(*keys).agg(*sketches).select(*keys, F.inline(F.array(*sketch_rows)))
    return exact.unionByName(rough, allowMissingColumns=True)


def _identity(df: DataFrame, name: str) -> Column:
    """What makes two cells of a column distinct, in a type the distinct sketch reads fast."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("byte", "short", "integer", "long", "boolean"):
        return quoted(name).cast("bigint") if kind != "boolean" else quoted(name).cast("int").cast("bigint")
    if kind in ("float", "double"):
        return F.expr(f"CASE WHEN NOT isnan({cells.sql_name(name)}) THEN CAST({cells.sql_name(name)} AS STRING) END")
    return cells.text_view(df, name)


def combine_states(states: DataFrame) -> DataFrame:
    """One state row per column that stands for any set of partial states: states of states combine the same way."""
    # distances from the mean of all, which squares of sums would lose; a state is a row per part and column
    same = Window.partitionBy("column")
    off = F.try_divide("total", "n") - F.sum("total").over(same) / F.sum("n").over(same)
    return states.withColumn("__off", off).groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.sum(F.col("deviations") + F.col("n") * F.col("__off") * F.col("__off")).alias("deviations"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))


def merge_states(states: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Final profile per column from any set of partial states. Counts, sums, mean, std and extremes are exact;
    distinct counts and quantiles carry the error of their sketches."""
    points = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(
        "quantile_sketch", F.array(*[F.lit(float(p)) for p in quantiles])))
    return combine_states(states).select(
        "column", "rows", F.col("n").alias("count"), F.col("nulls").alias("null_count"), F.col("total").alias("sum"),
        F.try_divide("total", "n").alias("mean"), F.sqrt(F.try_divide("deviations", "n")).alias("std"),
        F.col("lowest").alias("min"), F.col("highest").alias("max"),
        F.hll_sketch_estimate("distinct_sketch").alias("approx_unique"), points.alias("approx_quantiles"))


def pair_state(df: DataFrame, by: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    """Partial cross moments per part and pair of numeric columns."""
    pairs = list(combinations(cols or [c for c in _numeric_fields(df) if c not in (by or [])], 2))
    batches = [_pair_batch(df, by, pairs[i:i + PAIRS_PER_SCAN]) for i in range(0, len(pairs), PAIRS_PER_SCAN)]
    return reduce(DataFrame.unionByName, batches or [_pair_batch(df, by, [])])


def _pair_batch(df: DataFrame, by: list[str] | None, pairs: list[tuple[str, str]]) -> DataFrame:
    """Cross moments of some pairs; a scan of their columns whose aggregation stays compact."""
    keys = [quoted(b) for b in by or []]
    if not pairs:
        empty = "n bigint, total1 double, total2 double, products double, deviations1 double, deviations2 double"
        none = F.from_json(F.lit("[]"), f"array<struct<column1:string,column2:string,{empty.replace(' ', ':').replace(',:', ',')}>>")
        return df.limit(0).select(*keys, F.inline(none))
    aggregates, records = [], []
    for i, (a, b) in enumerate(pairs):
        x, y = cells.numeric_view(df, a), cells.numeric_view(df, b)
        both = x.isNotNull() & y.isNotNull()
        xs, ys = F.when(both, x), F.when(both, y)
        aggregates += [F.count(xs).alias(f"n{i}"), F.sum(xs).alias(f"x{i}"), F.sum(ys).alias(f"y{i}"),
                       F.covar_pop(xs, ys).alias(f"c{i}"), F.var_pop(xs).alias(f"u{i}"), F.var_pop(ys).alias(f"w{i}")]
        n = F.col(f"n{i}")
        records.append(F.struct(
            F.lit(a).alias("column1"), F.lit(b).alias("column2"), n.alias("n"), F.col(f"x{i}").alias("total1"),
            F.col(f"y{i}").alias("total2"), (n * F.col(f"c{i}")).alias("products"),
            (n * F.col(f"u{i}")).alias("deviations1"), (n * F.col(f"w{i}")).alias("deviations2")))
    return df.groupBy(*keys).agg(*aggregates).select(*keys, F.inline(F.array(*records)))


def merge_pairs(states: DataFrame) -> DataFrame:
    """Pearson r per pair from any set of partial cross moments."""

    same = Window.partitionBy("column1", "column2")
    off = [F.try_divide(c, "n") - F.sum(c).over(same) / F.sum("n").over(same) for c in ("total1", "total2")]

    def combined(inside: str, first: str, second: str) -> Column:
        return F.sum(F.col(inside) + F.col("n") * F.col(first) * F.col(second))

    filled = states.where(F.col("n") > 0).withColumn("__off1", off[0]).withColumn("__off2", off[1])
    merged = filled.groupBy("column1", "column2").agg(
        F.sum("n").alias("n"), combined("products", "__off1", "__off2").alias("xy"),
        combined("deviations1", "__off1", "__off1").alias("xx"), combined("deviations2", "__off2", "__off2").alias("yy"))
    return merged.where(F.col("n") >= 3).select(
        "column1", "column2", "n", F.try_divide(F.col("xy"), F.sqrt(F.greatest(F.col("xx"), F.lit(0.0))) *
                                               F.sqrt(F.greatest(F.col("yy"), F.lit(0.0)))).alias("value")
    ).where(F.col("value").isNotNull())


def mergeable_profile(df: DataFrame, by: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    """Profile each part, then merge the parts: equal to the profile of the whole table."""
    return merge_states(profile_state(df, by, cols))


def save_batch(batch: DataFrame, batch_id: int, state_path: str, cols: list[str] | None = None, fan: int = 8) -> None:
    """Adds a batch to the states in ``state_path``, once: a batch that is run again is recognised by its number.

    ``fan`` states of one level are combined into one of the next, so there are at most ``fan`` - 1 per level and the
    levels are the logarithm of the batches. The new set of states replaces the old one as a whole.
    """
    spark = batch.sparkSession
    folder = manifest.Folder(spark, state_path)
    known = manifest.current(folder)
    if batch_id <= known["last_batch"]:
        return
    kept = batch.select(*[quoted(c) for c in cols or batch.columns]).persist(StorageLevel.DISK_ONLY)  # read twice
    try:
        segments = [*known["segments"], _segment(profile_state(kept, cols=cols), state_path, 0)]
    finally:
        kept.unpersist()
    level = 0
    while sum(s["level"] == level for s in segments) >= fan:
        full = [s for s in segments if s["level"] == level]
        states = spark.read.parquet(*[f"{state_path}/{s['name']}" for s in full])
        segments = [s for s in segments if s["level"] != level] + [_segment(states, state_path, level + 1)]
        level += 1
    manifest.replace(folder, batch_id, segments)


def _segment(states: DataFrame, state_path: str, level: int) -> dict:
    name = manifest.new_segment()
    combine_states(states).coalesce(1).write.parquet(f"{state_path}/{name}")  # a row per column
    return {"name": name, "level": level}


def streaming_profile(stream: DataFrame, state_path: str, checkpoint_path: str, cols: list[str] | None = None,
                      fan: int = 8, **trigger) -> StreamingQuery:
    """Keep a profile up to date over a stream. Read the result with ``read_streaming_profile``, also while it runs."""
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: save_batch(batch, batch_id, state_path, cols, fan))
        .option("checkpointLocation", checkpoint_path).trigger(**(trigger or {"availableNow": True})).start()
    )


def read_streaming_profile(spark: SparkSession, state_path: str) -> DataFrame:
    """The merged profile of all batches written so far."""
    found = manifest.paths(manifest.Folder(spark, state_path))
    if not found:
        raise ValueError(f"no batch has been written to {state_path}")
    return merge_states(spark.read.parquet(*found))
