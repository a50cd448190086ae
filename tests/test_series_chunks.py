"""Row-order scans hold one chunk of a partition at a time, and chunks leave no mark on the results."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lynceus.operators import series
from lynceus.table import Table


def test_scan_hands_on_a_chunk_before_it_reads_the_next(monkeypatch):
    class Context:
        partitionId = staticmethod(lambda: 3)
        get = staticmethod(lambda: Context)

    monkeypatch.setattr(series, "TaskContext", Context)
    read = []

    def batches():
        for i in range(6):
            read.append(i)
            yield pa.record_batch({"k": ["a"] * 5, "v": [float(i)] * 5})

    out = series._scan(1, 1, ("neighbours", "sums"), 5)(batches())
    first = next(out)
    assert read == [0] and first.num_rows == 5
    rest = list(out)
    assert [b.column("__segment")[0].as_py() for b in [first, *rest]] == list(range(6))
    assert sum(b.num_rows for b in series._scan(1, 1, (), 4)(batches())) == 30  # batches above a chunk are cut


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_chunks_do_not_change_places_neighbours_and_sums(spark, chunk):
    r = random.Random(6)
    rows = [(i, "ab"[i % 3 == 0], float(r.randint(0, 9)) if r.random() > 0.1 else None) for i in range(200)]
    t = Table(spark.createDataFrame(rows, "i long, k string, v double"))
    s = series.Series(t, ["v"], ["i"], ["k"], ("neighbours", "sums"), chunk)
    got = {(x["k"], x["idx"]): x for x in s.placed().collect()}
    for k in "ab":
        v = [x for _, key, x in rows if key == k and x is not None]
        mean = sum(v) / len(v)
        for i, x in enumerate(v):
            g = got.pop((k, i))
            assert (g["value"], g["n"]) == (x, len(v))
            assert (g["previous"], g["next"]) == (v[i - 1] if i else None, v[i + 1] if i + 1 < len(v) else None)
            assert np.isclose(g["mean"], mean) and np.isclose(g["var"], np.var(v))
            assert np.isclose(g["s1"], sum(y - mean for y in v[:i]), atol=1e-9)
            assert np.isclose(g["s2"], sum((y - mean) ** 2 for y in v[:i]), atol=1e-9)
    assert not got


def test_thinning_reads_a_block_as_arrow():
    r = random.Random(7)
    idx = r.sample(range(300), 120)
    strength = [float(r.randint(1, 20)) for _ in idx]
    block = pa.table({"column": ["v"] * 120, "idx": idx, "significance": strength, "direction": ["up"] * 120,
                      "state": pa.array([0] * 120, pa.int32()), "block": [0] * 120, "own": [True] * 120})
    out = series._thin_block(4)(block)
    kept: list[int] = []
    for _, i in sorted((-s, i) for s, i in zip(strength, idx)):
        if all(abs(i - j) > 4 for j in kept):
            kept.append(i)
    assert out.column_names == ["column", "idx", "significance", "direction", "state"] and out["state"].type == pa.int32()
    assert [i for i, s in zip(out["idx"].to_pylist(), out["state"].to_pylist()) if s == 1] == sorted(kept)
