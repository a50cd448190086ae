"""Short texts are scored together as each would be alone; the sample is found without looking into all texts."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lynceus.llm import secrets


def test_texts_scored_together_get_the_spans_of_each_alone():
    r, rng = random.Random(6), np.random.default_rng(6)
    words = ["password", "=", ":", "token", "@", "é", " ", "a.b", "9", "1F9c33aa77d0", "qwertzui" * 3, '"', "-", "\n", " ", " "]
    found = 0
    for k in range(40):
        texts = ["".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 60]))) for _ in range(30)]
        texts += ["", " \n ", "x" * secrets.TOGETHER, "key", "@" + "b7" * 9, "b7" * 9 + "@", "=", "c8" * 9]
        r.shuffle(texts)
        emit = rng.normal(size=(len(secrets.FEATURES), 3)) + np.array([-1, -1, k % 4])
        model = secrets.Field(emit, rng.normal(size=(4, 3)))
        together = secrets.spans_of_all(texts, model, shortest=1)
        assert together == [secrets.field_spans(x, model, shortest=1) for x in texts]
        found += sum(map(len, together))
    assert found > 100


def test_least_hashes_are_found_in_a_share_of_the_rows(spark):
    looked = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def wanted(x):
        looked.add(1)
        return x % 3 == 0

    rows = spark.range(100_000).select("id", F.xxhash64("id").alias("h"))
    least = sorted(r[0] for r in rows.where("id % 3 = 0").select("h").collect())
    assert secrets._least(rows, wanted("id"), 100, 100_000) == least[:100]
    assert looked.value < 10_000
    rare = F.col("id") % 1000 == 7
    found = sorted(r[0] for r in rows.where(rare).select("h").collect())
    assert secrets._least(rows, rare, 60, 100_000) == found[:60]
    assert secrets._least(rows, rare, 500, 100_000) == found
    same = rows.select("id", F.lit(2**63 - 1).alias("h"))
    assert secrets._least(same, F.col("id") > 99_995, 3, 100_000) == [2**63 - 1] * 3


def test_fit_takes_the_same_sample_as_a_look_into_all_texts(spark, monkeypatch):
    taken = {}
    monkeypatch.setattr(secrets, "learn", lambda texts: taken.update(texts=texts))
    r = random.Random(7)
    kinds = ["plain words", "PassWord: abc", "an Api_Key", "AKIA", "akia 12", "year 2024", "token 1234", "ſecret 99", "toKen"]
    docs = [(i, r.choice(kinds) + f" {i % 90}") for i in range(3000)] + [(None, "token null")] * 3 + [(5000, None), (5001, "x" * 50 + "token")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    secrets.fit(df, max_docs=20, max_chars=40)
    hashes = {x["doc_id"]: x["h"] for x in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    low = lambda t: any(w in t.lower() for w in secrets.ASSIGN_WORDS) or "AKIA" in t
    short = [(hashes[i], t) for i, t in docs if t is not None and len(t) <= 40]
    marked = [x for x in short if low(x[1])]
    digits = [x for x in short if not low(x[1]) and "2024" in x[1]]
    assert taken["texts"] == [t for some in (marked, digits) for t in sorted(t for _, t in sorted(some)[:20])]
