import math
import random

import pytest
from pyspark.sql import functions as F

import lynceus as ly
from lynceus.functions import cells, patterns
from lynceus.operators import ranks
from lynceus.operators.values import value_counts


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_numbers_and_missing_cells_in_text(spark):
    texts = ["1", "1.0", "1e3", ".5", "5.", "NaN", "inf", "1d", "1,000", "0x10", "", " NULL ", "NA", "na", "Nancy", "n"]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    got = df.select(cells.numeric_view(df, "a").alias("n"), cells.text_view(df, "a").alias("t")).collect()
    assert [r["n"] for r in got] == [1, 1, 1000, 0.5, 5] + [None] * 11
    assert [r["t"] for r in got] == ["1", "1", "1000", "0.5", "5", "NaN", "inf", "1d", "1,000", "0x10", None, None, None, None, "Nancy", "n"]


@pytest.mark.parametrize("number,text", [
    (1.0, "1"), (-0.0, "0"), (1.5, "1.5"), (12345678.25, "12345678.25"), (1e20, "100000000000000000000"), (1.5e21, "1.5e+21"),
    (1e-5, "0.00001"), (1e-7, "1e-7"), (-2.5e-8, "-2.5e-8"), (0.1, "0.1"), (1e300, "1e+300")])
def test_canonical_text_of_numbers(spark, number, text):
    df = spark.createDataFrame([(number,)], "x double")
    assert df.select(ly.canon(F.col("x")).alias("t")).first()["t"] == text


def test_patterns(spark):
    samples = {
        "uuid": "123e4567-e89b-12d3-a456-426614174000", "email": "a@b.co", "phone": "+1 (555) 123-4567", "url": "HTTPS://x.org/a",
        "currency": "$1,200.50", "percent": "45%", "unix_time": "1700000000", "boolean": "Yes", "date": "1/2/24",
        "date_string": "Jan 05, 2024", "alphanumeric": "abc123"}
    df = spark.createDataFrame(list(samples.items()), "name string, text string")
    got = df.select("name", patterns.pattern_flags(F.col("text")).alias("f")).collect()
    for r in got:
        assert r["f"][r["name"]], r["name"]
    marks = df.select("name", patterns.pattern_marks("text").alias("m"), patterns.pattern_flags("text").alias("f")).collect()
    for r in marks:
        assert [bool(r["m"] >> i & 1) for i in range(len(patterns.PATTERN_NAMES))] == [r["f"][p] for p in patterns.PATTERN_NAMES]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 9, 100])
def test_quartiles_take_the_floor_rank(spark, n):
    values = [float(v * 3 % 101) for v in range(n)]
    s = rows(ly.numeric_stats(spark.createDataFrame([(v,) for v in values], "x double")))[0]
    ordered = sorted(values)
    assert (s["p25"], s["p75"]) == (ordered[int(n * 0.25)], ordered[int(n * 0.75)])
    assert s["median"] == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


def test_exact_ranks_narrow_until_the_limit_holds(spark):
    random.seed(1)
    values = [7.0] * 4000 + [random.gauss(0, 50) for _ in range(8000)]  # one value holds a third
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    wanted = [0, 3000, 5999, 6000, 9000, 11999]
    got = ranks.exact_ranks(df, {"x": F.col("x")}, {"x": (len(values), wanted)}, limit=20)
    ordered = sorted(values)
    assert [got["x", r] for r in wanted] == [ordered[r] for r in wanted]


def test_constant_and_missing_columns(spark):
    df = spark.createDataFrame([(5.0, float(i), None) for i in range(20)], "x double, y double, z double")
    assert ly.correlation_matrix(df).count() == 0
    assert ly.outliers_iqr(df, ["x"]).count() == 0
    s = {r["column"]: r for r in rows(ly.numeric_stats(df))}
    assert s["x"]["std"] == 0 and s["z"]["count"] == 0 and s["z"]["mean"] is None and s["z"]["null_count"] == 20


def test_pairs_skip_missing_cells(spark):
    data = [(float(i), float(2 * i) if i % 3 else None, float((i * 7) % 11)) for i in range(30)]
    df = spark.createDataFrame(data, "x double, y double, z double")
    r = {(c["column1"], c["column2"]): c for c in rows(ly.correlation_matrix(df))}
    assert math.isclose(r["x", "y"]["value"], 1.0) and r["x", "y"]["n"] == 20
    t = rows(ly.correlation_test(df, "x", "y"))[0]
    assert t["supported"] and t["p_value"] < 1e-9


def test_ties_and_long_texts_in_top_values(spark):
    long = "word " * 100
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (long,), (long,), (long,)], "c string")
    got = rows(ly.categorical_stats(df, k=4).orderBy("rank"))
    assert [(r["value"], r["value_count"]) for r in got] == [(long, 3), ("c", 2), ("a", 1), ("b", 1)]
    assert got[0]["unique_count"] == 4


def test_value_counts_merge_spellings_of_a_number(spark):
    df = spark.createDataFrame([("1",), ("1.0",), ("1e0",), ("x",), (None,)], "c string")
    got = {r["value"]: r["cnt"] for r in rows(value_counts(df))}
    assert got == {"1": 3, "x": 1, None: 1}


def test_column_types_need_more_than_four_fifths(spark):
    n = spark.range(100).select(
        F.when(F.col("id") < 81, F.col("id").cast("string")).otherwise("x").alias("mostly"),
        F.when(F.col("id") < 80, F.col("id").cast("string")).otherwise("x").alias("barely_not"),
        F.lit("2024-01-05").alias("day"), F.lit(None).cast("string").alias("empty"))
    assert {r["column"]: r["type"] for r in rows(ly.infer_column_types(n))} == {
        "mostly": "number", "barely_not": "string", "day": "date", "empty": "string"}


def test_near_duplicates_and_duplicates(spark):
    df = spark.createDataFrame([("North",), ("north ",), ("NORTH",), ("South",), ("South",)], "c string")
    assert rows(ly.near_duplicate_labels(df, "c"))[0]["spellings"] == 3
    assert rows(ly.duplicate_rows(df))[0]["duplicate_rows"] == 1


def test_quality_score_counts_missing_variants_and_copies(spark):
    df = spark.createDataFrame([("a", None)] * 5 + [("A", 1.0)] * 5, "c string, x double")
    assert rows(ly.quality_score(df))[0]["score"] == 100 - 20 - 5 - 15
    assert {r["issue"] for r in rows(ly.quality_issues(df))} == {"missing", "near_duplicate", "duplicate"}


def test_results_do_not_depend_on_partitioning(spark):
    random.seed(3)
    data = [(i, random.choice("abc"), random.random(), random.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(data, "id int, c string, x double, k int")
    one, many = df.coalesce(1), df.repartition(11)
    for f in (ly.dataset_fingerprint, ly.column_nulls_uniques, ly.categorical_stats):
        assert sorted(map(str, f(one).collect())) == sorted(map(str, f(many).collect()))


def test_meanings(spark):
    data = [(f"123e4567-e89b-12d3-a456-4266141740{i:02d}", f"u{i}@x.org", f"{i % 100}%", f"${i},000", "yes" if i % 2 else "no",
             str(1700000000 + i), f"2024-01-{i % 28 + 1:02d}", None, i / 100.0) for i in range(60)]
    names = ["key", "contact", "part", "paid", "flag", "at", "day", "nothing", "error_rate"]
    df = spark.createDataFrame(data, ", ".join(f"{n} {'double' if n == 'error_rate' else 'string'}" for n in names))
    got = {r["column"]: r for r in rows(ly.infer_schema(df))}
    assert {n: got[n]["semantic_type"] for n in names} == {
        "key": "id", "contact": "email", "part": "percentage", "paid": "currency", "flag": "boolean", "at": "id",
        "day": "date", "nothing": "unknown", "error_rate": "rate"}
    assert got["nothing"]["basic_type"] == "null" and got["nothing"]["confidence"] == 30
    forced = {r["column"]: r for r in rows(ly.infer_schema(df, overrides={"at": "timestamp"}))}
    assert forced["at"]["semantic_type"] == "timestamp" and forced["at"]["confidence"] == 100


def test_associations_without_spread(spark):
    df = spark.createDataFrame([(5.0, c) for c in "aabb"], "x double, c string")
    assert ly.point_biserial(df, "x", "c").first()["point_biserial"] == 0
    assert ly.cramers_v(df.withColumn("d", F.lit("k")), "c", "d").first()["cramers_v"] == 0
    assert ly.cramers_v(df.withColumn("d", F.col("c")), "c", "d").first()["cramers_v"] == 1
    none = df.withColumn("c", F.lit(None).cast("string"))
    assert ly.point_biserial(none, "x", "c").first()["point_biserial"] == 0
    assert ly.cramers_v(none.withColumn("d", F.lit("k")), "c", "d").first()["cramers_v"] == 0


def test_uniformity_leaves_missing_values_out(spark):
    df = spark.createDataFrame([(float(v),) for v in range(0, 101)] + [(None,)] * 500, "x double")
    r = ly.uniformity_check(df).first()
    assert r["n"] == 101 and abs(r["max_deviation"] - (21 - 20.2) / 20.2) < 1e-9
