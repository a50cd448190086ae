"""The report counts values and group means once, and no pattern runs on the text of keys, times and days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

import lynceus as ly
from lynceus import table
from lynceus.functions import patterns
from lynceus.operators import profile, values


def test_marks_told_from_the_value_are_those_of_its_text(spark):
    edges = [0, 1, 2, 999_999, 1_000_000, 9_999_999, 999_999_999, 1_000_000_000, 9_999_999_999, 4_102_444_800_000,
             4_102_444_800_001, 9_999_999_999_999, 2**63 - 1]
    wholes = [None, -(2**63), *edges, *[-x for x in edges]]
    years = [1, 99, 999, 1000, 1582, 1970, 2024, 9999]
    frames = {
        "whole": spark.createDataFrame([(x,) for x in wholes], "x bigint"),
        "bool": spark.createDataFrame([(True,), (False,), (None,)], "x boolean"),
        "moment": spark.createDataFrame([(dt.datetime(y, 12, 31, 23, 5, 1, us),) for y in years for us in (0, 120)], "x timestamp_ntz")
        .union(spark.sql("SELECT timestamp_ntz'+12345-01-01 00:00:00'")),
        "day": spark.createDataFrame([(dt.date(y, 1, 31),) for y in years], "x date").union(spark.sql("SELECT date'+12345-01-01'")),
        "text": spark.createDataFrame([("2024-01-01",), ("1234567",), ("",), (None,)], "x string"),
    }
    for name, df in frames.items():
        counts = values.raw_counts(df, facts=True)
        # left to the patterns: years below 1000 and above 9999, and texts
        open_ = counts.where("value IS NOT NULL AND long_marks IS NULL").count()
        assert open_ == {"whole": 0, "bool": 0, "moment": 7, "day": 4, "text": 2}[name], name
        got = values.described(counts).select("value", "marks", patterns.pattern_marks(F.col("value")).alias("want")).collect()
        assert [r["value"] for r in got if r["marks"] != r["want"]] == [], name


def test_report_counts_values_and_group_means_once(spark, monkeypatch):
    df = spark.range(1200).select(
        "id", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id)").alias("at"),
        F.expr("concat('k', id % 4)").alias("kind"), F.expr("if(id % 7 = 0, 'K1 ', 'k1')").alias("label"),
        F.expr("cast(id * 37 % 101 as double)").alias("value"))
    calls = {"counts": 0, "means": 0}

    def counting(key, of):
        def call(*args, **more):
            calls[key] += 1
            return of(*args, **more)
        return call

    monkeypatch.setattr(table, "raw_counts", counting("counts", table.raw_counts))
    monkeypatch.setattr(profile, "group_means_agree", counting("means", profile.group_means_agree))
    report = ly.full_report(df, order_by=["id"], id_cols=["id"], fast=True)
    for part in ("schema", "checks", "notes", "findings", "issues"):
        report[part].collect()
    assert calls == {"counts": 1, "means": 1}
    assert report.table._vc is None
    assert report.table.near_duplicates == {"label": 1}
    report.release()
