"""States of a stream, chunks with progress, samples by place, paged and wrapped records, one sort for all measures."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import lynceus as ly
from lynceus.operators import series as so
from lynceus.operators.groups import group_facts
from lynceus.streaming import manifest
from lynceus.streaming.profile import save_batch


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def same_profile(got, want):
    got, want = ({r["column"]: r.asDict() for r in rows} for rows in (got, want))
    assert got.keys() == want.keys()
    for c in want:
        for k in ("rows", "count", "null_count", "sum", "mean", "std", "min", "max"):
            assert close(got[c][k], want[c][k]), (c, k)
        assert abs(got[c]["approx_unique"] - want[c]["approx_unique"]) <= 0.05 * want[c]["approx_unique"] + 1


def batches(spark, n):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, rng.gauss(1e6, 3)]), rng.choice(["a", "b", " NA ", None])) for i in range(40 * n)]
    schema = "id long, x double, label string"
    return [spark.createDataFrame(rows[40 * i:40 * i + 40], schema) for i in range(n)], spark.createDataFrame(rows, schema)


def test_states_stay_logarithmic_and_repeated_batches_count_once(spark, tmp_path):
    parts, whole = batches(spark, 9)
    path = str(tmp_path / "state")
    folder = manifest.Folder(spark, path)
    for i, part in enumerate(parts):
        save_batch(part, i, path, fan=2)
        save_batch(part, i, path, fan=2)  # run again after a failure
        names = folder.names()
        held = [s["level"] for s in manifest.current(folder)["segments"]]
        assert len(held) == bin(i + 1).count("1") and len(set(held)) == len(held)
        assert sum(n.startswith(manifest.SEGMENT) for n in names) <= 2 * 4 + 1  # with those of the version before
        assert sum(n.startswith(manifest.PREFIX) for n in names) <= 2
    same_profile(ly.read_streaming_profile(spark, path).collect(), ly.mergeable_profile(whole).collect())


def test_a_crash_between_state_and_manifest_loses_nothing(spark, tmp_path, monkeypatch):
    parts, whole = batches(spark, 3)
    path = str(tmp_path / "state")
    save_batch(parts[0], 0, path)
    with monkeypatch.context() as m:
        m.setattr(manifest, "replace", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            save_batch(parts[1], 1, path)
    assert manifest.current(manifest.Folder(spark, path))["last_batch"] == 0
    for i in (1, 2):
        save_batch(parts[i], i, path)
    same_profile(ly.read_streaming_profile(spark, path).collect(), ly.mergeable_profile(whole).collect())
    segments = {s["name"] for s in manifest.current(manifest.Folder(spark, path))["segments"]}
    assert {n for n in manifest.Folder(spark, path).names() if n.startswith(manifest.SEGMENT)} == segments


def test_a_stream_that_is_started_again(spark, tmp_path):
    parts, whole = batches(spark, 3)
    source, state, progress = (str(tmp_path / d) for d in ("in", "state", "progress"))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(source)
        ly.streaming_profile(stream, state, progress, fan=2).awaitTermination()
    same_profile(ly.read_streaming_profile(spark, state).collect(), ly.mergeable_profile(whole).collect())


def test_reading_a_state_that_is_not_there(spark, tmp_path):
    with pytest.raises(ValueError):
        ly.read_streaming_profile(spark, str(tmp_path / "none"))


def test_chunks_of_a_hot_key_of_equal_rows_with_progress(spark):
    rows = [("hot", 1)] * 900 + [("b", i) for i in range(300)] + [(None, 2)] * 50
    df = spark.createDataFrame(rows, "k string, x int").repartition(3)
    seen = []

    def count(chunk):
        import pandas as pd
        from pyspark import TaskContext
        return pd.DataFrame({"k": [chunk["k"].iloc[0]], "n": [len(chunk)], "task": [TaskContext.get().partitionId()]})

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ly.apply_in_chunks(df, count, "k string, n long, task int", chunk_rows=40, by=["k"], task_rows=200,
                                 on_progress=lambda done, total: seen.append((done, total))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    totals = {}
    for r in got:
        assert r["n"] <= 40
        totals[r["k"]] = totals.get(r["k"], 0) + r["n"]
    assert totals == {"hot": 900, "b": 300, None: 50}
    assert len({r["task"] for r in got if r["k"] == "hot"}) > 1
    assert [d for d, _ in seen] == sorted(d for d, _ in seen) and seen[-1] == (1250, 1250)


def test_sample_by_place_in_the_files(spark, tmp_path):
    rows = [(i, i * 7919 % 1000, "x" * 50) for i in range(1000)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "id int, k int, wide string").repartition(5).write.parquet(path)
    stored = spark.read.parquet(path)
    want = sorted(rows, key=lambda r: r[1])[::10]
    for df in (stored, spark.createDataFrame(rows, "id int, k int, wide string").repartition(3)):
        got = ly.systematic_sample(df, 100, ["k"])
        assert got.columns == ["id", "k", "wide"] and sorted(map(tuple, got.collect())) == sorted(want)
    plan = ly.systematic_sample(stored, 100, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("wrap", [lambda r: r, lambda r: {"results": r}, lambda r: {"count": 9, "items": r}, lambda r: {"data": r}])
def test_wrapped_pages_stop_at_the_first_short_one(spark, wrap):
    sizes = [3, 3, 1, 3]
    pages = [(p, json.dumps(wrap([{"k": 10 * p + i} for i in range(n)]))) for p, n in enumerate(sizes)]
    df = spark.createDataFrame(pages, "page int, payload string")
    got = ly.merge_pages(df, "page", "payload", limit=3, fields={"k": "int"}).orderBy("page", "position").collect()
    assert [r["k"] for r in got] == [0, 1, 2, 10, 11, 12, 20]


def test_pages_at_a_path_and_pages_that_are_no_json(spark):
    pages = [(1, json.dumps({"a": {"b": [{"k": 1}, {"k": 2}]}})), (2, "no json"), (3, json.dumps({"a": {"b": [{"k": 9}]}}))]
    df = spark.createDataFrame(pages, "page int, payload string")
    got = ly.merge_pages(df, "page", "payload", limit=2, fields={"k": "int"}, array_path="a.b").collect()
    assert sorted(r["k"] for r in got) == [1, 2]


@pytest.mark.parametrize("text,path,want", [
    ('[{"a": 1}, {"a": 2}]', None, [1, 2]), ('{"n": 1, "rows": [{"a": 3}]}', None, [3]), ('{"p": {"q": [{"a": 4}]}, "o": [1]}', "p.q", [4])])
def test_json_arrays_by_root_path_and_first(spark, tmp_path, text, path, want):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(text)
    got = ly.read_json_records(spark, str(tmp_path), path)
    assert got.columns == ["a"] and sorted(r["a"] for r in got.collect()) == sorted(want * 2)


def test_json_without_an_array(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"a": 1}')
    with pytest.raises(ValueError):
        ly.read_json_records(spark, str(tmp_path / "o.json"))


def test_all_measures_in_one_sort(spark):
    """Places, neighbours and running sums of several measures with gaps, over partitions and hot and null keys."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        key = None if i % 50 == 0 else ("hot" if i % 3 else f"k{i % 7}")
        rows.append((key, i, None if rng.random() < 0.3 else float(rng.normal(1e6, 2)), float(i % 5), None))
    df = spark.createDataFrame(rows, "k string, i int, x double, y double, none double").repartition(9)
    s = so.Series(df, ["x", "y", "none"], ["i"], ["k"], ("neighbours", "sums"))
    got = {(r["k"], r["column"], r["idx"]): r for r in s.placed().collect()}
    seen = 0
    for key in {r[0] for r in rows}:
        for c, at in (("x", 2), ("y", 3)):
            values = np.array([r[at] for r in sorted(rows, key=lambda r: r[1]) if r[0] == key and r[at] is not None])
            off = values - values.mean()
            for idx, v in enumerate(values):
                r = got[key, c, idx]
                seen += 1
                assert r["value"] == v and r["n"] == len(values)
                assert r["previous"] == (values[idx - 1] if idx else None)
                assert r["next"] == (values[idx + 1] if idx + 1 < len(values) else None)
                assert math.isclose(r["s1"], off[:idx].sum(), abs_tol=1e-6)
                assert math.isclose(r["s2"], (off[:idx] ** 2).sum(), abs_tol=1e-6)
    assert seen == len(got)
    plan = s.rows._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan


def test_series_without_measures_or_rows(spark):
    df = spark.createDataFrame([("a", 1)], "k string, i string")
    assert ly.trend(df, None, ["i"]).count() == 0
    empty = spark.createDataFrame([], "k string, i int, x double")
    assert ly.trend(empty, ["x"], ["i"], ["k"]).count() == 0 and ly.seasonality(empty, ["x"], ["i"]).count() == 0


def test_groups_of_all_small_categories(spark):
    rows = [("a", True, "1.0", 1.0, 2), ("a", False, "1", 3.0, None), ("NA", True, "x", 5.0, 4), ("b", None, "01", None, 8)] * 3
    t = ly.Table(spark.createDataFrame(rows, "g string, f boolean, m string, x double, y int"))
    got = {(r["column"], r["value"], r["measure"]): (r["size"], r["n"], r["mean"]) for r in
           group_facts(t, ["g", "f", "m"], ["x", "y"]).collect()}
    assert got["g", "a", "x"] == (6, 6, 2.0) and got["g", "b", "x"] == (3, 0, None) and got["g", "b", "y"] == (3, 3, 8.0)
    assert got["f", "1", "x"] == (6, 6, 3.0) and got["m", "1", "y"] == (9, 6, 5.0) and got["m", "x", "y"] == (3, 3, 4.0)
    assert {v for c, v, _ in got if c == "g"} == {"a", "b"} and {v for c, v, _ in got if c == "f"} == {"0", "1"}


def test_tails_of_a_table_in_one_scan(spark):
    rows = [(float(i), 5 * i) for i in range(100)] + [(1000.0, 10_000), (None, None)]
    t = ly.Table(spark.createDataFrame(rows, "x double, y int"))
    assert t.tails["columns"]["x"]["outliers"] == 1 and t.tails["columns"]["y"]["round_ratio"] == 1.0
    assert t.tails["odd_rows"] == 1
    facts = spark.createDataFrame([(None,)], "x double")
    assert ly.Table(facts, types={"x": "number"}).tails["columns"]["x"]["outliers"] == 0


def test_delimited_files_are_split_unless_cells_hold_line_breaks(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('a,b\n"x ""y""",1\n\n" z ","2,3"\n')
    (tmp_path / "broken.csv").write_text('a,b\n"two\nlines",1\nlast,"2"\n')
    plain, broken = (ly.read_delimited(spark, str(tmp_path / f)) for f in ("plain.csv", "broken.csv"))
    assert [tuple(r) for r in plain.collect()] == [('x "y"', "1"), ("z", "2,3")]
    assert [tuple(r) for r in broken.collect()] == [("two\nlines", "1"), ("last", "2")]


def test_relationships_read_only_columns_with_a_partner_by_name(spark, monkeypatch):
    from lynceus.operators import relations

    a = spark.createDataFrame([(i, f"c{i}", f"text {i}") for i in range(200)], "customer_id int, name string, notes string")
    b = spark.createDataFrame([(i, i % 150, i * 1.5) for i in range(400)], "order_id int, customer_id int, total double")
    seen = []
    counted = relations.native_counts
    monkeypatch.setattr(relations, "native_counts", lambda sources, *rest: seen.extend(c for _, c in sources) or counted(sources, *rest))
    got = ly.find_relationships({"a": a, "b": b}).collect()
    assert ("a", "customer_id", "b", "customer_id") in {tuple(r)[:4] for r in got}
    assert "notes" not in seen and "total" not in seen
