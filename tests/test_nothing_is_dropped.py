"""Results that once depended on spelling, missing tokens, rank or length."""
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import lynceus as ly
from lynceus.operators.values import grouping_key, value_counts


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_few_values_in_many_spellings(spark):
    spellings = [f"{v}" + (f".{'0' * k}" if k else "") for v in (1, 2, 3, 4) for k in range(10)]
    data = [(s, "x" * (i % 3 + 1)) for i, s in enumerate(spellings * 3)]
    t = ly.Table(spark.createDataFrame(data, "spelled string, label string"), types={"spelled": "string", "label": "string"})
    before = t.few_valued(2, 10)
    assert before == ["spelled", "label"]
    t.keep()
    assert t.few_valued(2, 10) == before
    t.release()


def test_key_among_missing_tokens(spark):
    a = spark.createDataFrame([("NA",)] * 900 + [(f"v{i}",) for i in range(100)], "code_text string")
    found = rows(ly.candidate_keys({"a": a}))
    assert [(r["column"], r["unique_count"], r["total_count"]) for r in found] == [("code_text", 100, 100)]


def test_spelling_variants_among_rare_values(spark):
    common = [(f"label{i}",) for i in range(12) for _ in range(5)]
    clean = spark.createDataFrame(common + [("Rare",)], "label string")
    untidy = spark.createDataFrame(common + [("Rare",), ("rare",)], "label string")
    assert not [r for r in rows(ly.quality_issues(clean)) if r["issue"] == "near_duplicate"]
    issue = [r for r in rows(ly.quality_issues(untidy)) if r["issue"] == "near_duplicate"]
    assert [(r["column"], r["affected_count"]) for r in issue] == [("label", 2)]
    # the duplicate rows weigh nearly the same, so the difference is the penalty for the variants
    assert ly.quality_score(clean).first()["score"] - ly.quality_score(untidy).first()["score"] == 5


def test_blanks_around_a_text_at_the_digest_limit(spark):
    text = "a" * 127
    df = spark.createDataFrame([(text,), ("  " + text.upper() + "  ",), ("b" * 400,), ("B" * 400,)], "label string")
    issue = [r for r in rows(ly.quality_issues(df)) if r["issue"] == "near_duplicate"]
    assert [r["affected_count"] for r in issue] == [4]


def test_value_counts_give_long_texts(spark):
    long = ["q" * 200, "q" * 128 + "z" * 300]
    df = spark.createDataFrame([(long[0],), (long[0],), (long[1],), ("short",), (None,)], "t string")
    got = {r["value"]: (r["cnt"], r["chars"]) for r in rows(value_counts(df))}
    assert got == {long[0]: (2, 200), long[1]: (1, 428), "short": (1, 5), None: (1, None)}


def test_ties_sort_by_beginning_then_digest(spark):
    texts = ["b", "a" * 300, "a" * 128 + "c" * 9, "a" * 128, "c" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = sorted(texts, key=lambda t: t if len(t) <= 128 else t[:128] + hashlib.sha256(t.encode()).hexdigest())
    got = [r["t"] for r in df.orderBy(grouping_key(F.col("t"))).collect()]
    assert got == want == [r["value"] for r in ly.categorical_stats(df).orderBy("rank").collect()]


def test_limits_are_off_by_default(spark):
    data = [(i % 7, float(i % 7), 2.0 * (i % 7) + 1, 3.0 * (i % 7) + 1, 5.0 * (i % 7) + 1, "abcdefg"[i % 7]) for i in range(700)]
    df = spark.createDataFrame(data, "m0 int, m1 double, m2 double, m3 double, m4 double, kind string")
    every = rows(ly.segment_profile(df))
    assert {r["value"] for r in every} >= set("abcfg") and {r["measure"] for r in every} == {"m0", "m1", "m2", "m3", "m4"}
    short = rows(ly.segment_profile(df, max_segments=5, max_measures=3, max_values=5))
    assert len({r["value"] for r in short}) <= 5 and {r["measure"] for r in short} == {"m0", "m1", "m2"}
    assert ly.hypotheses_correlation(df).count() == 10 and ly.hypotheses_correlation(df, limit=5).count() == 5
    assert ly.hypotheses_group_difference(df).count() == 5
    assert ly.hypotheses(df).count() > 10 and ly.hypotheses(df, limit=10).count() == 10


def test_equal_means_of_any_pair(spark):
    data = [("abc"[i % 3], "xy"[i % 2], float(i % 2), 100.0 * ((i // 3) % 2)) for i in range(1800)]
    df = spark.createDataFrame(data, "first string, second string, narrow double, wide double")
    found = [r["column"] for r in rows(ly.synthetic_checks(df)) if r["check"] == "equal_means"]
    assert found == ["first, wide"]


def test_keys_of_large_numbers_and_shared_sets(spark):
    base = 1 << 60
    a = spark.createDataFrame([(base + i, i % 3) for i in range(300)], "ref_id long, x int")
    b = spark.createDataFrame([(base + i, "NA") for i in range(0, 600, 2)], "ref_id long, y string")
    c = spark.createDataFrame([(base + i,) for i in range(1000)], "number long")
    assert {(r["table"], r["column"]) for r in rows(ly.candidate_keys({"a": a, "b": b, "c": c}))} == {
        ("a", "ref_id"), ("b", "ref_id"), ("c", "number")}
    found = rows(ly.find_relationships({"a": a, "b": b}))
    assert [(r["source_table"], r["matched"], r["source_orphans"], r["target_orphans"]) for r in found] == [("a", 150, 150, 150)]


def test_orphans_show_long_texts(spark):
    long = ["k" * 500, "m" * 300]
    a = spark.createDataFrame([(long[0],), (long[1],), ("both",), (None,)], "t string")
    b = spark.createDataFrame([("both",)], "t string")
    found = ly.orphans(a, "t", b, "t").first()
    assert (found["value_count"], found["orphan_count"], found["sample_orphans"]) == (3, 2, long)


def test_join_of_equal_types_keeps_left_rows(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, v string")
    for other in (b, b.withColumn("k", b["k"].cast("string"))):
        got = {(r["k"], r["v"], r["v_right"]) for r in rows(ly.join_related(a, other, "k", "k"))}
        assert got == {(1, "a", "x"), (1, "a", "y"), (2, "b", None), (None, "c", None)}


def test_correlation_of_many_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 100)) + rng.normal(0, 1, (400, 1)) + 1000
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[:, 8], x[5, 9] = 3.0, np.nan, np.inf
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(100)])
    got = {(r["column1"], r["column2"]): (r["value"], r["n"]) for r in rows(ly.correlation_matrix(spark.createDataFrame(frame)))}
    want = frame.replace(np.inf, np.nan)
    r, n = want.corr(min_periods=3), want.notna().astype(int)
    n = n.T @ n
    assert len(got) == 98 * 97 // 2
    for (a, b), (value, count) in got.items():
        assert abs(value - r[a][b]) < 1e-9 and count == n[a][b]


def test_large_keys_are_split_by_size(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 > 0, F.lit("cold")).alias("k"), "id")
    out = ly.apply_in_chunks(
        df, lambda p: pd.DataFrame({"k": p["k"].iloc[:1], "n": [len(p)]}), "k string, n long",
        chunk_rows=10_000, by=["k"], task_rows=2000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # small partitions would be merged again
    try:
        sizes = {}
        for r in rows(out):
            sizes.setdefault(r["k"], []).append(r["n"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {k: sum(v) for k, v in sizes.items()} == {"hot": 6000, "cold": 1500, None: 1500}
    assert len(sizes["hot"]) >= 2 and len(sizes["cold"]) == len(sizes[None]) == 1
