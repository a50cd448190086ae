"""Every operator of the package on the given tables. Each query reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import lynceus as ly
from lynceus.functions import names, patterns, scoring
from lynceus.session import ensure_checkpoint_dir

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
#: Columns that order the rows of lineitem completely.
LINEITEM_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Floating-point columns rounded, so that results do not depend on the order of additions."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), special.get(f.name, digits)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# --- derived inputs --------------------------------------------------------------------------------------------

def events_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose value is missing for errors and whose user is missing for views."""
    e = load(spark, sf, "events")
    return e.select(
        "event_id", "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("user_id"))


def monthly_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return ly.Table(li.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.sum("l_quantity").alias("quantity"), F.sum(F.col("l_tax") * 100).alias("tax"))).stored()


def seasonal_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly sums, one of them rising within every year."""
    li = load(spark, sf, "lineitem")
    return ly.Table(li.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.sum("l_quantity").alias("quantity"), F.sum(F.col("l_tax") * 100).alias("tax"),
        F.sum(F.col("l_quantity") * F.month("l_shipdate")).alias("weighted"))).stored()


def hourly_events(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.sum("value").alias("total"))


def lineitem_measures(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return li.select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("l_quantity") + F.col("l_tax")).alias("quantity_tax"),
        (F.col("l_quantity") * F.col("l_extendedprice") / 1000).alias("order_size"))


def spelled_priorities(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    label = (
        F.when(F.col("o_orderstatus") == "F", F.lower("o_orderpriority"))
        .when(F.col("o_orderstatus") == "O", F.concat(F.col("o_orderpriority"), F.lit(" ")))
        .otherwise(F.col("o_orderpriority")))
    return o.select("o_orderkey", "o_totalprice", label.alias("label"))


def sized_documents(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").withColumn("size", F.when(F.col("n_chars") > 200, "long").otherwise("short"))


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


# --- scans, sources, sinks -------------------------------------------------------------------------------------

def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints (shared storage on a cluster)."""
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@query
def read_delimited(spark, sf):
    path = scratch(spark)
    ly.write_csv(load(spark, sf, "conversations"), path)
    back = ly.read_delimited(spark, path)
    return back.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       "role", F.md5("text").alias("text_md5"))


@query
def read_json_records(spark, sf):
    path = scratch(spark)
    load(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string")).write.json(path)
    back = ly.read_json_records(spark, path, lines=True)
    return rounded(back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.min("o_orderdate").alias("first_date")), 2)


def _json_files(spark, sf, wrap) -> str:
    """Orders as one JSON file a month; ``wrap`` makes the text of a file of its array of records."""
    path = scratch(spark)
    o = load(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    files = o.groupBy(F.substring("o_orderdate", 1, 7).alias("month")).agg(F.sort_array(F.collect_list(F.struct(*o.columns))).alias("records"))
    files.select("month", wrap(F.col("records")).alias("text")).repartition("month").write.partitionBy("month").text(path)
    return path


def _order_totals(back: DataFrame) -> DataFrame:
    return rounded(back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.min("o_orderdate").alias("first_date"),
        F.max("o_custkey").alias("last_customer"), F.count_distinct("o_orderpriority").alias("priorities")), 2)


@query
def read_json_root_array(spark, sf):
    return _order_totals(ly.read_json_records(spark, _json_files(spark, sf, F.to_json)))


@query
def read_json_at_path(spark, sf):
    path = _json_files(spark, sf, lambda r: F.to_json(F.struct(F.array(F.lit(0)).alias("decoy"), F.struct(r.alias("items")).alias("payload"))))
    return _order_totals(ly.read_json_records(spark, path, array_path="payload.items"))


@query
def read_json_first_array(spark, sf):
    path = _json_files(spark, sf, lambda r: F.to_json(F.struct(F.size(r).alias("count"), r.alias("entries"))))
    return _order_totals(ly.read_json_records(spark, path))


@query
def export_data(spark, sf):
    """A table as CSV and as JSON, read back."""
    path, c = scratch(spark), load(spark, sf, "customer")
    ly.export_data(c, path + "/csv", "csv")
    ly.export_data(c, path + "/json", "json")
    kinds = ["c_custkey bigint", "c_name string", "c_nationkey int", "c_acctbal double", "c_mktsegment string"]
    text = ly.read_delimited(spark, path + "/csv")
    csv = text.select(*[F.col(k.split()[0]).cast(k.split()[1]).alias(k.split()[0]) for k in kinds])
    json = spark.read.schema(", ".join(kinds)).json(path + "/json/data")
    return csv.withColumn("kind", F.lit("csv")).unionByName(json.withColumn("kind", F.lit("json")))


@query
def read_auto(spark, sf):
    path = scratch(spark) + ".csv"
    ly.write_csv(load(spark, sf, "customer"), path)
    return ly.read_auto(spark, path).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.min("c_name").alias("first_name"))


@query
def write_report(spark, sf):
    path = scratch(spark)
    o = load(spark, sf, "orders")
    ly.write_report({"issues": ly.quality_issues(o)}, path, o, max_rows=1000)
    return spark.read.json(f"{path}/metadata").select("row_count", "column_count", "truncated")


@query
def write_report_results(spark, sf):
    """The results of a report as they stand in its files, and the number of its data rows."""
    path, o = scratch(spark), load(spark, sf, "orders")
    ly.write_report({"issues": ly.quality_issues(o)}, path, o)
    issues = spark.read.schema("issue string, `column` string, severity string, affected_count bigint, percent double").json(f"{path}/issues")
    data = spark.read.json(f"{path}/data").agg(F.count_distinct("o_orderkey").alias("affected_count"))
    return rounded(issues.unionByName(data.withColumn("issue", F.lit("data")), allowMissingColumns=True), 4)


@query
def normalize_cells(spark, sf):
    o = as_text(load(spark, sf, "orders"))
    marked = o.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", " NA ").otherwise(F.col("o_orderstatus")))
    cells = ly.normalize_cells(marked, numeric_suffix="_num")
    return rounded(cells.select("o_orderkey", "o_orderstatus", "o_totalprice_num", "o_orderpriority_num"), 2)


@query
def infer_column_types(spark, sf):
    o = as_text(load(spark, sf, "orders"))
    return ly.infer_column_types(o)


@query
def flatten_json_column(spark, sf):
    e = load(spark, sf, "events").select("event_id", "props")
    return ly.flatten_json_column(e, "props", {"k": "int"}).select("event_id", "k")


@query
def merge_pages(spark, sf):
    labels = load(spark, sf, "labels")
    page = F.floor(F.col("doc_id") / 50)
    paged = labels.groupBy(page.alias("page")).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("doc_id", "quality")))).alias("payload"))
    return ly.merge_pages(paged, "page", "payload", limit=15, max_pages=None, fields={"doc_id": "bigint", "quality": "int"}).select(
        "page", "position", "doc_id", "quality")


@query
def merge_pages_wrapped(spark, sf):
    """Pages that wrap their records; reading stops at the first short page."""
    page = F.floor(F.col("doc_id") / 50)
    paged = load(spark, sf, "labels").groupBy(page.alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "quality", "toxic"))).alias("records"))
    wrapped = paged.select("page", F.when(F.col("page") % 2 == 0, F.to_json(F.struct(F.col("records").alias("results"))))
                           .otherwise(F.to_json(F.struct(F.lit(1).alias("count"), F.col("records").alias("items")))).alias("payload"))
    return ly.merge_pages(wrapped, "page", "payload", limit=19, fields={"doc_id": "bigint", "quality": "int", "toxic": "int"}).select(
        "page", "position", "doc_id", "quality", "toxic")


@query
def systematic_sample(spark, sf):
    return rounded(ly.systematic_sample(load(spark, sf, "orders"), 1000, ["o_orderdate", "o_orderkey"]), 4)


@query
def tiered_sample(spark, sf):
    return rounded(ly.tiered_sample(load(spark, sf, "lineitem"), LINEITEM_ORDER), 4)


@query
def sampling_plan(spark, sf):
    return ly.sampling_plan(load(spark, sf, "lineitem"))


# --- predicates and scalar functions ---------------------------------------------------------------------------

def text_cells(spark, sf):
    parts = [("url", load(spark, sf, "pages"), "url"), ("props", load(spark, sf, "events"), "props"),
             ("orderdate", load(spark, sf, "orders"), "o_orderdate"), ("custkey", load(spark, sf, "orders"), "o_custkey"),
             ("text", load(spark, sf, "documents"), "text"), ("name", load(spark, sf, "customer"), "c_name"),
             ("status", load(spark, sf, "orders"), "o_orderstatus")]
    out = None
    for label, df, c in parts:
        cells = df.select(F.lit(label).alias("source"), F.col(c).cast("string").alias("cell"))
        out = cells if out is None else out.unionByName(cells)
    o = load(spark, sf, "orders")
    date = F.col("o_orderdate")
    made = {
        "us_date": F.date_format(date, "MM/dd/yyyy"), "eu_date": F.date_format(date, "dd-MM-yyyy"),
        "money": F.concat(F.lit("$"), F.col("o_custkey").cast("string")),
        "share": F.concat(F.col("o_custkey").cast("string"), F.lit("%")),
        "mail": F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com")),
        "phone": F.concat(F.lit("+1 555-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")),
        "flag": F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("no"),
    }
    built = o.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("source"), v.alias("cell")) for k, v in made.items()])))
    return out.unionByName(built)


@query
def pattern_flags(spark, sf):
    flags = text_cells(spark, sf).select("source", patterns.pattern_flags(F.col("cell")).alias("f"))
    return flags.groupBy("source").agg(*[F.count_if(F.col(f"f.{p}")).alias(p) for p in patterns.PATTERN_NAMES])


@query
def is_date_string(spark, sf):
    cells = text_cells(spark, sf)
    return cells.groupBy("source").agg(F.count_if(patterns.is_date_string(F.col("cell"))).alias("dates"))


@query
def is_date_value(spark, sf):
    cells = text_cells(spark, sf)
    return cells.groupBy("source").agg(F.count_if(patterns.is_date_value(F.col("cell"))).alias("dates"))


@query
def correlation_strength(spark, sf):
    li = load(spark, sf, "lineitem").select(((F.col("l_quantity") - 25) / 25).alias("r"))
    return li.groupBy(scoring.correlation_strength(F.col("r")).alias("strength")).agg(F.count(F.lit(1)).alias("n"))


@query
def confidence_level(spark, sf):
    li = load(spark, sf, "lineitem").select((F.col("l_quantity") * 2).alias("c"))
    return li.groupBy(scoring.confidence_level(F.col("c")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query
def zscore(spark, sf):
    e = load(spark, sf, "events")
    facts = ly.Table(e).moments(["value"])["value"]
    return rounded(e.select("event_id", scoring.zscore(F.col("value"), F.lit(facts["mean"]), F.lit(facts["std"])).alias("z")))


@query
def p_value(spark, sf):
    e = load(spark, sf, "events").select("event_id", (F.col("value") / 100).alias("z"))
    return rounded(e.select("event_id", scoring.p_value(F.col("z")).alias("p_value"),
                            scoring.p_value_ref(F.col("z")).alias("p_value_ref")))


def part_names(spark, sf):
    """Column-like names made from the words of the part table."""
    p = load(spark, sf, "part")
    word = F.split("p_name", " ")
    return p.select(
        "p_partkey",
        F.concat(F.initcap(word[0]), F.lit(" "), F.lower("p_type"), F.lit("ID")).alias("a"),
        F.concat(F.lit("fk_"), word[1], F.lit("-"), F.when(F.col("p_size") > 25, "cost").otherwise("code")).alias("b"),
        F.concat(F.when(F.col("p_size") > 30, "client").otherwise("item"), F.lit("_"), word[0], F.lit("_id")).alias("c"),
        F.concat(F.when(F.col("p_retailprice") > 950, "cust").otherwise("sku"), F.lit("_num")).alias("d"),
        F.concat(F.when(F.col("p_size") > 20, "sales").otherwise("price"), F.lit("_"), word[1]).alias("e"))


@query
def normalize_column_name(spark, sf):
    n = part_names(spark, sf)
    return n.select("p_partkey", *[names.normalize_column_name(F.col(x)).alias(x) for x in "abcde"])


@query
def name_match_type(spark, sf):
    n = part_names(spark, sf)
    return n.select("p_partkey", names.name_match_type(F.col("a"), F.col("c")).alias("ac"),
                    names.name_match_type(F.col("b"), F.col("c")).alias("bc"),
                    names.name_match_type(F.col("c"), F.col("d")).alias("cd"),
                    names.name_match_type(F.col("b"), F.col("d")).alias("bd"))


@query
def names_related(spark, sf):
    n = part_names(spark, sf)
    return n.select("p_partkey", names.names_related(F.col("b"), F.col("e")).alias("be"),
                    names.names_related(F.col("c"), F.col("e")).alias("ce"),
                    names.names_related(F.col("a"), F.col("e")).alias("ae"))


@query
def similar_key_names(spark, sf):
    p = load(spark, sf, "part")
    long_form = F.when(F.col("p_size") > 25, "customer_id").otherwise("product-id")
    short_form = F.when(F.col("p_retailprice") > 950, "cust id").otherwise("itemId")
    return p.select("p_partkey", names.similar_key_names(long_form, short_form).alias("similar"),
                    names.similar_key_names(F.lower("p_type"), F.lower(F.col("p_name"))).alias("contained"))


@query
def causal_direction(spark, sf):
    n = part_names(spark, sf)
    return n.select("p_partkey", names.causal_direction(F.col("b"), F.col("e")).alias("be"),
                    names.causal_direction(F.col("e"), F.col("b")).alias("eb"),
                    names.causal_direction(F.col("c"), F.col("d")).alias("cd"))


# --- profile ---------------------------------------------------------------------------------------------------

@query
def numeric_stats(spark, sf):
    return rounded(ly.numeric_stats(load(spark, sf, "lineitem")), 4, sum=2, skewness=5)


@query
def numeric_stats_orders(spark, sf):
    return rounded(ly.numeric_stats(load(spark, sf, "orders")), 4, sum=2, skewness=5)


@query
def numeric_stats_missing(spark, sf):
    return rounded(ly.numeric_stats(events_with_gaps(spark, sf)), 4, sum=1, skewness=5)


@query
def numeric_stats_approx(spark, sf):
    return rounded(ly.numeric_stats(load(spark, sf, "lineitem"), approx=True).select(
        "column", "count", "null_count", "mean", "min", "max", "std", "sum"), 4, sum=1)


@query
def value_counts(spark, sf):
    return ly.value_counts(load(spark, sf, "part")).select("column", "value", "chars", "cnt")


@query
def categorical_stats(spark, sf):
    return ly.categorical_stats(load(spark, sf, "orders"))


@query
def categorical_stats_documents(spark, sf):
    top = ly.categorical_stats(load(spark, sf, "documents"))
    return top.select("column", "count", "null_count", "unique_count", "rank", F.md5("value").alias("value_md5"), "value_count")


@query
def column_nulls_uniques(spark, sf):
    return ly.column_nulls_uniques(events_with_gaps(spark, sf))


@query
def dataset_summary_columns(spark, sf):
    """The maps of the summary, a row per column."""
    one = ly.dataset_summary(events_with_gaps(spark, sf))
    return one.select(F.explode("null_counts").alias("column", "null_count"), "unique_counts").select(
        "column", "null_count", F.element_at("unique_counts", F.col("column")).alias("unique_count"))


@query
def dataset_summary(spark, sf):
    return rounded(ly.dataset_summary(events_with_gaps(spark, sf)).drop("null_counts", "unique_counts"))


@query
def duplicate_rows(spark, sf):
    return ly.duplicate_rows(load(spark, sf, "documents").select("text", "lang"))


@query
def duplicate_rows_lineitem(spark, sf):
    return ly.duplicate_rows(load(spark, sf, "lineitem"))


@query
def duplicate_rows_documents(spark, sf):
    return ly.duplicate_rows(load(spark, sf, "documents"))


@query
def correlation_matrix(spark, sf):
    return rounded(ly.correlation_matrix(lineitem_measures(spark, sf)))


@query
def correlation_matrix_missing(spark, sf):
    return rounded(ly.correlation_matrix(events_with_gaps(spark, sf)))


@query
def cramers_v(spark, sf):
    return rounded(ly.cramers_v(load(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"), 5)


@query
def cramers_v_events(spark, sf):
    return rounded(ly.cramers_v(load(spark, sf, "events"), "event_type", "user_id"), 5)


@query
def point_biserial(spark, sf):
    return rounded(ly.point_biserial(events_with_gaps(spark, sf), "value", "event_type"))


@query
def mean_by_category(spark, sf):
    return rounded(ly.mean_by_category(load(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), 4)


@query
def category_distribution(spark, sf):
    return ly.category_distribution(load(spark, sf, "part"), "p_brand", 8)


@query
def kpis(spark, sf):
    return rounded(ly.kpis(load(spark, sf, "orders"), ["o_orderdate", "o_orderkey"]), 4, value=1)


@query
def uniformity_check(spark, sf):
    li = load(spark, sf, "lineitem")
    return rounded(ly.uniformity_check(li.select("l_quantity", F.round(F.col("l_discount") * 1000).alias("discount_points"))))


@query
def group_mean_homogeneity(spark, sf):
    return rounded(ly.group_mean_homogeneity(load(spark, sf, "lineitem"), "l_returnflag", "l_quantity"))


@query
def round_number_ratio(spark, sf):
    return rounded(ly.round_number_ratio(load(spark, sf, "lineitem")))


@query
def near_duplicate_labels(spark, sf):
    return ly.near_duplicate_labels(spelled_priorities(spark, sf), "label")


@query
def similar_distributions(spark, sf):
    return rounded(ly.similar_distributions(lineitem_measures(spark, sf)))


@query
def dominant_values(spark, sf):
    d = load(spark, sf, "documents").select("lang", "source", F.when(F.col("n_chars") > 200, "long").otherwise("short").alias("size"))
    return rounded(ly.dominant_values(d))


@query
def segment_profile(spark, sf):
    return rounded(ly.segment_profile(sized_documents(spark, sf)), 4)


@query
def distribution_shape(spark, sf):
    return rounded(ly.distribution_shape(load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")), 5)


@query
def mergeable_profile(spark, sf):
    out = ly.mergeable_profile(load(spark, sf, "lineitem"), by=["l_linenumber"])
    return rounded(out.select("column", "rows", "count", "null_count", "sum", "mean", "std", "min", "max"), 4, sum=1)


@query
def mergeable_pairs(spark, sf):
    from lynceus.streaming.profile import merge_pairs, pair_state

    return rounded(merge_pairs(pair_state(lineitem_measures(spark, sf), by=["l_returnflag"])), 5)


@query
def streaming_profile(spark, sf):
    schema = load(spark, sf, "events").schema
    # a stream lists a folder: the pattern picks the one file of the table
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    base = scratch(spark)
    ly.streaming_profile(stream, base + "/state", base + "/progress").awaitTermination()
    out = ly.read_streaming_profile(spark, base + "/state")
    return rounded(out.select("column", "rows", "count", "null_count", "sum", "mean", "std", "min", "max"), 4, sum=1)


@query
def streaming_profile_batches(spark, sf):
    """A stream of ten files in as many batches, whose states are combined by threes."""
    base, e = scratch(spark), load(spark, sf, "events")
    e.withColumn("part", F.col("event_id") % 10).repartition("part").write.partitionBy("part").parquet(base + "/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    ly.streaming_profile(stream, base + "/state", base + "/progress", cols=e.columns, fan=3).awaitTermination()
    out = ly.read_streaming_profile(spark, base + "/state")
    return rounded(out.select("column", "rows", "count", "null_count", "sum", "mean", "std", "min", "max"), 4, sum=1)


@query
def apply_in_chunks(spark, sf):
    def totals(chunk):
        return chunk.groupby("l_returnflag", as_index=False).agg(n=("l_quantity", "size"), quantity=("l_quantity", "sum"))

    li = load(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    parts = ly.apply_in_chunks(li, totals, "l_returnflag string, n bigint, quantity double", 5000, by=["l_returnflag"])
    return parts.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"))


# --- ordered analysis ------------------------------------------------------------------------------------------

@query
def global_index(spark, sf):
    return ly.global_index(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "idx")


@query
def trend(spark, sf):
    return rounded(ly.trend(monthly_lineitem(spark, sf), None, ["month"]), 5)


@query
def trend_events(spark, sf):
    return rounded(ly.trend(load(spark, sf, "events"), ["value"], ["ts", "event_id"], ["event_type"]), 5)


@query
def trend_lineitem(spark, sf):
    """All eight measures of a table in one sort."""
    return rounded(ly.trend(load(spark, sf, "lineitem"), None, LINEITEM_ORDER, ["l_returnflag"]), 4)


@query
def trend_test_lineitem(spark, sf):
    return rounded(ly.trend_test(load(spark, sf, "lineitem"), None, LINEITEM_ORDER), 4)


@query
def local_peaks_lineitem(spark, sf):
    return ly.local_peaks(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], LINEITEM_ORDER, ["l_linestatus"])


@query
def trend_test(spark, sf):
    return rounded(ly.trend_test(load(spark, sf, "events"), ["value"], ["ts", "event_id"], ["event_type"]), 5)


@query
def change_points(spark, sf):
    return rounded(ly.change_points(load(spark, sf, "events"), ["value"], ["ts", "event_id"], ["event_type"]), 5)


@query
def change_points_monthly(spark, sf):
    return rounded(ly.change_points(monthly_lineitem(spark, sf), None, ["month"]), 4)


@query
def acf(spark, sf):
    return rounded(ly.acf(hourly_events(spark, sf), ["total"], ["hour"]))


@query
def acf_events(spark, sf):
    return rounded(ly.acf(load(spark, sf, "events"), ["value"], ["ts", "event_id"], ["event_type"], max_lag=24))


@query
def seasonality(spark, sf):
    return rounded(ly.seasonality(seasonal_lineitem(spark, sf), None, ["month"]).withColumn("peaks", F.concat_ws(",", "peaks")))


@query
def local_peaks(spark, sf):
    return ly.local_peaks(load(spark, sf, "events"), ["value"], ["ts", "event_id"], ["event_type"])


@query
def time_series_report(spark, sf):
    return rounded(ly.time_series_report(seasonal_lineitem(spark, sf), None, ["month"]), 4)


@query
def series_head(spark, sf):
    return ly.series_head(load(spark, sf, "orders"), "o_totalprice", ["o_orderdate", "o_orderkey"])


# --- outliers and tests ----------------------------------------------------------------------------------------

@query
def outliers_iqr(spark, sf):
    return rounded(ly.outliers_iqr(load(spark, sf, "events"), ["value"], ["event_id"]), 5)


@query
def outliers_iqr_documents(spark, sf):
    return rounded(ly.outliers_iqr(load(spark, sf, "documents"), None, ["doc_id"]), 5)


@query
def outliers_zscore(spark, sf):
    return rounded(ly.outliers_zscore(load(spark, sf, "events"), "value", 3.0, ["event_id"]), 5)


@query
def row_anomalies(spark, sf):
    return rounded(ly.row_anomalies(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], None, 1.3), 5)


@query
def outlier_bounds(spark, sf):
    return rounded(ly.outlier_bounds(load(spark, sf, "lineitem")), 4)


@query
def outlier_test(spark, sf):
    return rounded(ly.outlier_test(load(spark, sf, "events"), "value"))


@query
def welch_t_test(spark, sf):
    return rounded(ly.welch_t_test(load(spark, sf, "events"), "value", "event_type"), 5)


@query
def correlation_test(spark, sf):
    return rounded(ly.correlation_test(lineitem_measures(spark, sf), "l_extendedprice", "unit_price"), 4)


@query
def test_hypothesis(spark, sf):
    e = load(spark, sf, "events")
    tests = [("correlation", ["user_id", "value"]), ("group_difference", ["event_type", "value"]), ("anomaly", ["value"]),
             ("trend", ["value"])]
    out = None
    for kind, variables in tests:
        row = ly.test_hypothesis(e, kind, variables, ["ts", "event_id"])
        out = row if out is None else out.unionByName(row)
    return rounded(out, 5)


def hypothesis_numbers(df: DataFrame) -> DataFrame:
    return rounded(df.select("kind", "column1", "column2", "confidence", "interpretation", "statistic", "p_value"), 4)


@query
def hypotheses_correlation(spark, sf):
    found = ly.hypotheses_correlation(lineitem_measures(spark, sf))
    return hypothesis_numbers(found).join(found.select("column1", "column2", F.size("confounders").alias("n_confounders")), ["column1", "column2"])


@query
def hypotheses_group_difference(spark, sf):
    return hypothesis_numbers(ly.hypotheses_group_difference(sized_documents(spark, sf)))


@query
def hypotheses_trend(spark, sf):
    return hypothesis_numbers(ly.hypotheses_trend(monthly_lineitem(spark, sf), ["month"]))


@query
def hypotheses_anomaly(spark, sf):
    return hypothesis_numbers(ly.hypotheses_anomaly(load(spark, sf, "events")))


@query
def hypotheses(spark, sf):
    return hypothesis_numbers(ly.hypotheses(lineitem_measures(spark, sf)))


@query
def confounders(spark, sf):
    return ly.confounders(lineitem_measures(spark, sf), "l_quantity", "l_extendedprice")


# --- meaning of columns ----------------------------------------------------------------------------------------

def described(spark, sf):
    """One wide table with ids, dates, text, money, flags and links."""
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("order_id"), "c_name", "o_orderstatus", F.col("o_totalprice").alias("total_price"),
        F.col("o_orderdate").alias("created"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("contact_email"),
        F.concat(F.lit("https://example.com/"), F.col("c_custkey").cast("string")).alias("link"),
        F.concat(F.lit("$"), F.col("o_custkey").cast("string")).alias("paid"),
        F.concat((F.col("c_nationkey") * 4).cast("string"), F.lit("%")).alias("share_text"),
        F.when(F.col("c_acctbal") > 5000, "yes").otherwise("No").alias("rich"),
        (F.col("c_acctbal") / 10000).alias("churn_rate"), F.col("c_nationkey").alias("item_count"),
        (F.col("o_orderkey") + 1700000000).alias("unix_timestamp"),
        F.when(F.col("o_orderstatus") != "P", F.col("c_mktsegment")).alias("segment"))
    return ly.Table(joined).stored()


@query
def basic_types(spark, sf):
    return ly.basic_types(described(spark, sf))


@query
def semantic_scores(spark, sf):
    return ly.semantic_scores(described(spark, sf))


@query
def semantic_types(spark, sf):
    return ly.semantic_types(described(spark, sf)).drop("alternatives")


@query
def infer_schema(spark, sf):
    found = ly.infer_schema(load(spark, sf, "events"), overrides={"props": "text"}, stored={"value": ("currency", 20.0)})
    return found.select("column", "basic_type", "semantic_type", "confidence", "level", "total_count", "null_count",
                        "unique_count", "numeric_count", "string_count", "needs_review",
                        F.when(F.col("column") == "event_type", F.concat_ws(",", "samples")).alias("samples"))


@query
def overall_confidence(spark, sf):
    return rounded(ly.overall_confidence(ly.infer_schema(load(spark, sf, "customer"))))


# --- relationships ---------------------------------------------------------------------------------------------

def all_tables(spark, sf):
    return {name: load(spark, sf, name) for name in TABLES}


@query
def candidate_keys(spark, sf):
    return ly.candidate_keys(all_tables(spark, sf))


@query
def value_overlap(spark, sf):
    return rounded(ly.value_overlap(load(spark, sf, "customer"), "c_custkey", load(spark, sf, "orders"), "o_custkey"))


@query
def orphans(spark, sf):
    out = ly.orphans(load(spark, sf, "documents"), "doc_id", load(spark, sf, "labels"), "doc_id")
    return rounded(out.withColumn("sample_orphans", F.concat_ws(",", "sample_orphans")).withColumn(
        "possible_reasons", F.concat_ws("; ", "possible_reasons")))


@query
def find_relationships(spark, sf):
    return rounded(ly.find_relationships(all_tables(spark, sf)))


@query
def find_relationships_prefixed(spark, sf):
    tables = {n: load(spark, sf, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    return rounded(ly.find_relationships(tables, key_patterns=(r"(?i)^.*key$",), strip_prefix="^[a-z]{1,2}_"))


@query
def orphan_report(spark, sf):
    report = ly.orphan_report(all_tables(spark, sf))
    return rounded(report.withColumn("possible_reasons", F.concat_ws("; ", "possible_reasons")))


@query
def join_related(spark, sf):
    joined = ly.join_related(load(spark, sf, "documents").select("doc_id", "lang"), load(spark, sf, "labels"), "doc_id", "doc_id")
    return joined.select("doc_id", "lang", "quality", "toxic")


@query
def join_related_inner(spark, sf):
    joined = ly.join_related(load(spark, sf, "orders"), load(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", "one_to_one")
    return rounded(joined.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")), 2)


@query
def compare_datasets(spark, sf):
    a, b = load(spark, sf, "documents").drop("text"), load(spark, sf, "labels")
    return rounded(ly.compare_datasets(a, b), 5)


@query
def catalog_similarity(spark, sf):
    return rounded(ly.catalog_similarity(all_tables(spark, sf)).withColumn("columns", F.concat_ws(",", "columns")))


@query
def dataset_fingerprint(spark, sf):
    return ly.dataset_fingerprint(load(spark, sf, "orders"), "orders")


# --- quality and insights --------------------------------------------------------------------------------------

def untidy(spark, sf):
    """Orders with spelling variants, missing prices, repeated rows and a skewed measure."""
    o = load(spark, sf, "orders")
    label = (
        F.when(F.col("o_orderstatus") == "F", F.lower("o_orderpriority"))
        .when(F.col("o_orderstatus") == "O", F.concat(F.col("o_orderpriority"), F.lit(" "))).otherwise(F.col("o_orderpriority")))
    price = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))
    return o.select(
        F.floor(F.col("o_custkey") / 10).alias("customer_group"), price.alias("price"),
        (F.floor(F.col("o_totalprice") / 100000) * 10).alias("rounded_cost"),
        F.pow(F.col("o_totalprice") / 100000, 4).alias("skewed"), label.alias("label"), "o_orderstatus")


@query
def variable_notes(spark, sf):
    return ly.variable_notes(load(spark, sf, "customer"))


@query
def synthetic_checks(spark, sf):
    return rounded(ly.synthetic_checks(load(spark, sf, "lineitem")), 4)


@query
def eda_overview(spark, sf):
    return ly.eda_overview(load(spark, sf, "orders"))


@query
def eda_findings(spark, sf):
    return rounded(ly.eda_findings(monthly_lineitem(spark, sf), ["month"]), 4)


@query
def quality_issues(spark, sf):
    return rounded(ly.quality_issues(untidy(spark, sf)).drop("suggestion"), 5)


@query
def quality_score(spark, sf):
    return ly.quality_score(untidy(spark, sf))


@query
def quick_insights(spark, sf):
    return rounded(ly.quick_insights(untidy(spark, sf)), 4)


@query
def correlation_insights(spark, sf):
    return rounded(ly.correlation_insights(lineitem_measures(spark, sf)))


@query
def trend_insights(spark, sf):
    return rounded(ly.trend_insights(monthly_lineitem(spark, sf), ["month"]), 4)


@query
def deep_insights(spark, sf):
    found = ly.deep_insights(untidy(spark, sf))
    return found.select("insight", "type", "severity", "confidence", F.concat_ws(",", "columns").alias("columns"))


@query
def recommendations(spark, sf):
    return ly.recommendations(untidy(spark, sf)).withColumn("columns", F.concat_ws(",", "columns"))


def _report_part(part: str, spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    out = ly.full_report(e, order_by=["event_id"], id_cols=["event_id"])[part]
    if part == "hypotheses":
        return hypothesis_numbers(out)
    for f in out.schema.fields:
        if f.dataType.typeName() in ("array", "map"):
            out = out.withColumn(f.name, F.to_json(f.name))
    return rounded(out, 4)


for _part in ("schema", "summary", "numeric", "categorical", "correlations", "outliers", "overview", "notes", "checks", "findings",
              "quality", "issues", "insights", "recommendations", "quick", "kpis", "trends", "hypotheses", "time_series"):
    REGISTRY[f"full_report_{_part}"] = partial(_report_part, _part)


@query
def full_profile_lineitem(spark, sf):
    """Numeric, categorical, duplicate, correlation and outlier facts of a whole table, in one frame."""
    t = ly.Table(load(spark, sf, "lineitem"), name="lineitem", order_by=LINEITEM_ORDER)
    numbers = ly.numeric_stats(t).select(F.col("column").alias("name"), F.lit("median").alias("fact"), F.col("median").alias("value"))
    texts = ly.categorical_stats(t, k=1).select(F.col("column").alias("name"), F.lit("distinct").alias("fact"), F.col("unique_count").cast("double").alias("value"))
    pairs = ly.correlation_matrix(t).select(F.concat_ws(",", "column1", "column2").alias("name"), F.lit("correlation").alias("fact"), "value")
    outside = [(c, "outliers", float(f["outliers"])) for c, f in t.tails["columns"].items()] + [("rows", "duplicates", float(t.duplicates))]
    facts = spark.createDataFrame(outside, "name string, fact string, value double")
    return rounded(reduce(DataFrame.unionByName, [numbers, texts, pairs, facts]), 4)


@query
def full_report_fast(spark, sf):
    """The parts of the short report by name, with the rows of each."""
    report = ly.full_report(load(spark, sf, "events"), order_by=["event_id"], id_cols=["event_id"], fast=True)
    sizes = [report[p].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(p).alias("part"), "rows") for p in report]
    return reduce(DataFrame.unionByName, sizes)


