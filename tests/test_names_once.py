"""Name matches compute what a name tells once, and nothing matches a missing name."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynceus.functions import names


def test_name_match_type_builds_each_name_once(spark):
    rows = [("CustomerID", "cust_id", "fuzzy"), ("fk_order-id", "order_id", "exact"), ("a_code", "b_code", "value_overlap"),
            ("a_code", "b_num", None), ("item", "sku", "fuzzy"), (None, None, None), (None, "id", None), ("id", "key", "fuzzy")]
    df = spark.createDataFrame(rows, "a string, b string, want string").select("*", names.name_match_type(F.col("a"), F.col("b")).alias("got"))
    assert [r["got"] for r in df.collect()] == [r[2] for r in rows]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 8 and plan.count("rlike") + plan.count("RLIKE") == 14
