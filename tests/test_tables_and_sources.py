import json

import pytest
from pyspark.sql import functions as F

import lynceus as ly
from lynceus.streaming.profile import merge_states, profile_state


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def shop(spark):
    customers = spark.createDataFrame([(i, f"n{i}") for i in range(1, 121)], "customer_id int, name string")
    # one customer holds a third of all sales
    sales = spark.createDataFrame([(k, 100 if k % 3 == 0 else 100 + k % 41) for k in range(300)], "sale_id int, cust_id int")
    towns = spark.createDataFrame([("x", 5), ("y", 5)], "town string, people int")
    return {"customers": customers, "sales": sales, "towns": towns}


def test_overlap_orphans_and_relationships(spark, shop):
    o = rows(ly.value_overlap(shop["customers"], "customer_id", shop["sales"], "cust_id"))[0]
    assert (o["source_unique"], o["target_unique"], o["matched"], o["target_orphans"]) == (120, 41, 21, 20)
    lost = rows(ly.orphans(shop["sales"], "cust_id", shop["customers"], "customer_id"))[0]
    assert lost["orphan_count"] == 20 and lost["sample_orphans"][0] == "121" and len(lost["possible_reasons"]) == 2
    found = rows(ly.find_relationships(shop))
    pair = [r for r in found if {r["source_column"], r["target_column"]} == {"customer_id", "cust_id"}][0]
    assert pair["relationship_type"] == "one_to_many" and pair["match_type"] == "fuzzy" and pair["confidence"] == 60
    assert not [r for r in found if "towns" in (r["source_table"], r["target_table"])]
    assert {r["table"] for r in rows(ly.orphan_report(shop))} == {"customers", "sales"}


def test_left_join_keeps_customers_without_sales(spark, shop):
    joined = ly.join_related(shop["customers"], shop["sales"], "customer_id", "cust_id")
    plain = shop["customers"].join(shop["sales"], F.col("customer_id") == F.col("cust_id"), "left")
    assert joined.count() == plain.count() and joined.where("cust_id IS NULL").count() == 99


def test_delimited_reader(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b'id, note \r\n1,"a ""b"", c"\r\n\r\n2,"two\nlines"\r\n , \r\n3, x \r\n')
    got = rows(ly.read_delimited(spark, str(path)))
    assert [(r["id"], r["note"]) for r in got] == [("1", 'a "b", c'), ("2", "two\nlines"), ("3", "x")]
    assert ly.read_delimited(spark, str(path), header=False).columns == ["Column 1", "Column 2"]
    assert ly.read_auto(spark, str(path)).count() == 3


def test_json_reader(spark, tmp_path):
    records = [{"a": 1, "b": None}, {"a": 2, "b": "x", "c": True}]
    (tmp_path / "root.json").write_text(json.dumps(records))
    (tmp_path / "deep.json").write_text(json.dumps({"meta": 1, "out": {"items": records}}))
    (tmp_path / "first.json").write_text(json.dumps({"meta": 1, "items": records}))
    assert ly.read_json_records(spark, str(tmp_path / "root.json")).columns == ["a", "b"]
    assert ly.read_json_records(spark, str(tmp_path / "root.json"), all_keys=True).columns == ["a", "b", "c"]
    assert ly.read_json_records(spark, str(tmp_path / "deep.json"), "out.items").count() == 2
    assert ly.read_auto(spark, str(tmp_path / "first.json")).count() == 2


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", None), ('say "x"', 1.5)], "t string, v double")
    ly.export_data(df, str(tmp_path / "out.csv"))
    back = rows(ly.read_delimited(spark, str(tmp_path / "out.csv")).orderBy("t"))
    assert back == [{"t": "a,b", "v": None}, {"t": 'say "x"', "v": "1.5"}]


def test_payloads(spark):
    texts = ['{"results": [{"k": 1}, {"k": 2}]}', '[{"k": 3}]', '{"k": 4}', "not json", '{"other": [1]}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, p string")
    got = rows(ly.flatten_json_column(df, "p", {"k": "int"}).orderBy("id", "position"))
    assert [(r["id"], r["k"], r["value"]) for r in got] == [
        (0, 1, None), (0, 2, None), (1, 3, None), (2, 4, None), (3, None, "not json"), (4, None, None)]


def test_pages_stop_after_the_first_short_one(spark):
    pages = [(p, json.dumps([{"k": 10 * p + i} for i in range(n)])) for p, n in enumerate([3, 3, 1, 3])]
    df = spark.createDataFrame(pages, "page int, payload string").repartition(3)
    got = rows(ly.merge_pages(df, "page", "payload", limit=3, fields={"k": "int"}).orderBy("page", "position"))
    assert [r["k"] for r in got] == [0, 1, 2, 10, 11, 12, 20]


def test_merged_profiles_equal_one_pass(spark):
    df = spark.range(1000).select(
        (F.col("id") % 7).alias("part"), (F.col("id") * 1.5 + 1e6).alias("x"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 13).alias("y"))
    whole = {r["column"]: r for r in rows(ly.mergeable_profile(df, cols=["x", "y"]))}
    parts = {r["column"]: r for r in rows(ly.mergeable_profile(df, by=["part"], cols=["x", "y"]))}
    halves = profile_state(df.where("id < 300"), cols=["x", "y"]).unionByName(profile_state(df.where("id >= 300"), cols=["x", "y"]))
    union = {r["column"]: r for r in rows(merge_states(halves))}
    for c in ("x", "y"):
        for other in (parts, union):
            for k in ("rows", "count", "null_count", "sum", "min", "max"):
                assert other[c][k] == pytest.approx(whole[c][k]), (c, k)
            # a merged distinct sketch estimates with its own error, about 2 % at this size
            assert other[c]["approx_unique"] == pytest.approx({"x": 1000, "y": 13}[c], rel=0.05)
            assert other[c]["std"] == pytest.approx(whole[c]["std"], rel=1e-6)


def test_streaming_profile_counts_every_file_once(spark, tmp_path):
    source, state, progress = (str(tmp_path / n) for n in ("in", "state", "progress"))
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    df.where("x < 40").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    ly.streaming_profile(stream, state, progress).awaitTermination()
    df.where("x >= 40").coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        ly.streaming_profile(stream, state, progress).awaitTermination()
    r = rows(ly.read_streaming_profile(spark, state))[0]
    assert r["count"] == 100 and r["sum"] == 4950 and r["max"] == 99


def test_chunks_are_bounded_and_hold_one_key(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 5).cast("string")).alias("k"), "id")

    def size(chunk):
        return chunk.groupby("k", as_index=False).agg(n=("id", "size")).assign(keys=chunk["k"].nunique(), total=len(chunk))

    got = rows(ly.apply_in_chunks(df, size, "k string, n bigint, keys bigint, total bigint", 50, by=["k"]))
    assert max(r["total"] for r in got) <= 50 and {r["keys"] for r in got} == {1} and sum(r["n"] for r in got) == 1000
    assert sum(1 for r in got if r["k"] == "hot") > 6


def test_samples(spark):
    df = spark.range(1000).repartition(5)
    assert sorted(r["id"] for r in ly.systematic_sample(df, 300, ["id"]).collect()) == list(range(0, 1000, 4))
    assert ly.tiered_sample(df, ["id"]).count() == 1000


def test_report(spark):
    df = spark.range(200).select("id", (F.col("id") * 2.0).alias("price"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"))
    report = ly.full_report(df, order_by=["id"])
    assert {"schema", "numeric", "insights", "hypotheses", "time_series"} <= set(report)
    assert report["hypotheses"].where("kind = 'correlation'").first()["column1"] == "id"
    assert report["kpis"].where("kpi = 'total'").first()["column"] == "price"
    report.release()
