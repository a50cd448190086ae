import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import lynceus as ly
from lynceus.operators import series as so


def frame(spark, values, parts=4):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, y double")
    return df.repartition(parts)


def brute_change_points(x, gap=5, threshold=2.0):
    n, found = len(x), []
    for i in range(gap, n - gap):
        a, b = x[:i], x[i:]
        pooled = math.sqrt(((len(a) - 1) * a.var() + (len(b) - 1) * b.var()) / (n - 2))
        if pooled:
            s = abs(b.mean() - a.mean()) / (pooled * math.sqrt(1 / len(a) + 1 / len(b)))
            if s > threshold:
                found.append((s, i))
    kept = []
    for s, i in sorted(found, key=lambda f: (-f[0], f[1])):
        if all(abs(i - j) >= gap for j in kept):
            kept.append(i)
    return sorted(kept)


def test_global_index(spark):
    random.seed(5)
    values = [random.randint(0, 9) for _ in range(300)]
    got = ly.global_index(frame(spark, values).repartition(7), ["y", "i"]).orderBy("idx").collect()
    assert [(r["idx"], r["y"], r["i"]) for r in got] == [
        (k, float(v), i) for k, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))]


@pytest.mark.parametrize("kind", ["step", "noise", "hill", "ramp"])
@pytest.mark.parametrize("block", [16, so.BLOCK])
def test_change_points_equal_the_greedy_choice(spark, kind, block):
    rng = np.random.default_rng(2)
    x = {
        "step": np.r_[np.zeros(40), np.full(60, 10.0)] + rng.normal(0, 0.5, 100),
        "noise": rng.normal(0, 1, 150) + rng.choice([0, 2], 150),
        "hill": 10 * np.sin(np.linspace(0, 3, 120)) + rng.normal(0, 0.1, 120),
        "ramp": np.arange(90.0) + rng.normal(0, 0.2, 90),
    }[kind]
    got = ly.change_points(frame(spark, x), ["y"], ["i"], block=block).orderBy("idx").collect()
    assert [r["idx"] for r in got] == brute_change_points(x)


def test_short_and_constant_series(spark):
    assert ly.change_points(frame(spark, [1, 2, 3, 4]), ["y"], ["i"]).count() == 0
    assert ly.change_points(frame(spark, [5] * 30), ["y"], ["i"]).count() == 0
    assert ly.seasonality(frame(spark, [1, 2, 1, 2, 1, 2, 1]), ["y"], ["i"]).count() == 0
    assert ly.trend(frame(spark, [1, 2, 3, 4]), ["y"], ["i"]).count() == 0


@pytest.mark.parametrize("n", [9, 64, 257])
def test_distributed_transform_equals_direct_sums(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(3, 2, n)
    s = so.Series(frame(spark, x), ["y"], ["i"])
    c = x - x.mean()
    want = [float((c[: n - k] * c[k:]).sum()) for k in range(n // 2 + 1)]
    sums = so.autocovariance_sums(s.placed(), s.keys, F.floor(F.col("n") / 2)).orderBy("lag").collect()
    assert [r["lag"] for r in sums] == list(range(n // 2 + 1))
    assert np.allclose([r["total"] for r in sums], want, atol=1e-9)
    for block in (4, 16, so.LAG_BLOCK):
        sums = so.bounded_autocovariance_sums(s.placed(), s.keys, 4, block).orderBy("lag").collect()
        assert [r["lag"] for r in sums] == list(range(5))
        assert np.allclose([r["total"] for r in sums], want[:5], atol=1e-9)


def test_lag_bound_beyond_the_series(spark):
    x = [1.0, 3.0, 2.0, 5.0, 4.0]
    got = ly.acf(frame(spark, x), ["y"], ["i"], max_lag=50)
    assert [r["lag"] for r in got.orderBy("lag").collect()] == [2, 3, 4]


def test_weekly_season(spark):
    x = [math.sin(2 * math.pi * i / 7) for i in range(84)]
    r = ly.seasonality(frame(spark, x), ["y"], ["i"]).first()
    assert r["label"] == "weekly" and r["period"] == 7 and r["peaks"][:3] == [2, 9, 16]


def test_trend_and_peaks_skip_missing_values(spark):
    values = [1, None, 2, 3, None, 9, 4, 5, 6, 7, 8, 10]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, y double").repartition(3)
    kept = [v for v in values if v is not None]
    r = ly.trend(df, ["y"], ["i"]).first()
    assert r["direction"] == "up" and math.isclose(r["slope"], np.polyfit(range(len(kept)), kept, 1)[0])
    assert [p["idx"] for p in ly.local_peaks(df, ["y"], ["i"]).orderBy("idx").collect()] == [3]


def test_series_keys_are_independent(spark):
    data = [("a", i, float(i)) for i in range(20)] + [("b", i, float(-i)) for i in range(200)]
    df = spark.createDataFrame(data, "k string, i int, y double").repartition(6)
    got = {r["k"]: r["direction"] for r in ly.trend(df, ["y"], ["i"], ["k"]).collect()}
    assert got == {"a": "up", "b": "down"}


def test_order_is_required(spark):
    with pytest.raises(ValueError):
        ly.trend(frame(spark, [1, 2, 3]), ["y"])
