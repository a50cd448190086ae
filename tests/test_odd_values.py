"""Infinite values, ambiguous rows and columns that cannot be hashed."""

from __future__ import annotations

import lynceus as ly


def test_infinite_values_are_missing(spark):
    rows = [(float(i), float((i * 37) % 11)) for i in range(50)] + [(float("inf"), 3.0), (float("-inf"), 4.0), (float("nan"), 5.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    stats = {r["column"]: r for r in ly.numeric_stats(df).collect()}
    assert stats["a"]["count"] == 50 and stats["a"]["mean"] == 24.5
    pairs = ly.correlation_matrix(df).where("column1 = 'a' and column2 = 'b'").collect()
    assert all(r["value"] is None or abs(r["value"]) < 0.9 for r in pairs)


def test_fingerprint_tells_cells_apart(spark):
    one = ly.dataset_fingerprint(spark.createDataFrame([("a|b", "c"), ("x", None)], "p string, q string")).first()
    two = ly.dataset_fingerprint(spark.createDataFrame([("a", "b|c"), ("x", None)], "p string, q string")).first()
    three = ly.dataset_fingerprint(spark.createDataFrame([("a|b", "c"), ("x", "-")], "p string, q string")).first()
    assert len({one["content_hash"], two["content_hash"], three["content_hash"]}) == 3


def test_chunks_of_a_table_with_a_map(spark):
    df = spark.createDataFrame([(i % 2, i, {"k": i}) for i in range(40)], "g int, v int, m map<string,int>")
    out = ly.apply_in_chunks(df, lambda x: x[["g", "v"]], "g int, v int", by=["g"])
    assert sorted(r["v"] for r in out.collect()) == list(range(40))
