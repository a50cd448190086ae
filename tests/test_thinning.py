"""Thinning carries only what can still matter, and is the one-by-one choice with a border at every few positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lynceus.operators import series


def greedy(rows, reach):
    kept = []
    for idx, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all(abs(idx - k) > reach for k in kept):
            kept.append(idx)
    return sorted(kept)


def test_dropped_candidates_leave_with_their_round():
    idx = np.arange(100, dtype=np.int64)
    block = pa.table({"column": ["a"] * 100, "idx": idx, "significance": (idx * 37 % 101).astype(float),
                      "state": np.zeros(100, dtype=np.int32), "own": idx >= 4, "block": np.zeros(100, dtype=np.int64)})
    out = series._thin_block(4)(block)
    assert set(out["state"].to_pylist()) <= {0, 1} and 0 < len(out) < 40
    assert min(out["idx"].to_pylist()) >= 4


def test_thinning_over_many_borders_is_the_greedy_choice(spark):
    rng = np.random.default_rng(5)
    rows = []
    for name, strength in (("noise", rng.integers(3, 9, 150)), ("rise", np.arange(150)), ("fall", -np.arange(150) + 200)):
        rows += [(name, int(i), 0.0, 1.0, float(strength[i]), "increase") for i in range(150) if name == "rise" or i % 11]
    found = spark.createDataFrame(rows, "column string, idx bigint, before_mean double, after_mean double, significance double, direction string")
    got = series.thin_candidates(found, ["column"], 5, block=13).collect()
    for name in ("noise", "rise", "fall"):
        want = greedy([(r[1], r[4]) for r in rows if r[0] == name], 4)
        assert sorted(r["idx"] for r in got if r["column"] == name) == want
