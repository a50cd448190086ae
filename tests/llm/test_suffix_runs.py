"""Anchors with many surroundings: strings are tested in runs of places, not one by one."""

from __future__ import annotations

import random
import time

import pytest

from lynceus.llm import suffix_dedup
from tests.llm.test_llm import frame, strings_by_hand

PASSAGE = "".join(random.Random(1).choices("abcdefgh ", k=520))


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return spark


def texts(n=150):
    """One passage, whole or cut to 300 to 520 characters, inside, first or last in texts of their own, and near copies."""
    r = random.Random(3)
    own = lambda k: "".join(r.choices("ijklmnop ", k=k))
    out = []
    for i in range(n):
        cut = 0 if i % 3 else r.randrange(220)
        low = r.randrange(cut + 1)
        out.append(own(i % 7 and 450) + PASSAGE[low:len(PASSAGE) - (cut - low)] + own(i % 5 and 450))
    for i in range(20):
        at = r.randrange(len(out[1]))
        out.append(out[1][:at] + "é" + out[1][at + 1:])
    return out


def written(spark):
    time.sleep(1)  # the counters follow the tasks with a delay
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_hot_anchors_by_brute_force_and_with_few_strings(shared, monkeypatch):
    rows = texts()
    df = frame(shared, [(i, t, None, None, None) for i, t in enumerate(rows)])
    plain, shuffled, results = suffix_dedup.repeated_ranges, [], []
    for hot in (64_000, 20):
        monkeypatch.setattr(suffix_dedup, "repeated_ranges", lambda rows, length, hot=hot: plain(rows, length, hot=hot))
        before = written(shared)
        out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
               for r in suffix_dedup.remove_repeats(df).collect()}
        shuffled.append(written(shared) - before)
        results.append([out[i] for i in range(len(rows))])
    assert results == [strings_by_hand(rows, 400)] * 2
    # With a row for each string of 400 bytes it would be over five times as much as without hot anchors.
    assert shuffled[1] < 4 * shuffled[0], shuffled
