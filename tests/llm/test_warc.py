"""WARC archives: exact round trip, revisits by brute force, and what a damaged archive still gives."""

from __future__ import annotations

import gzip
import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lynceus.llm import warc
from lynceus.llm.oracles import ORACLES
from workload.check import connect, spark_rows, sql_rows

PAGES = "page_id long, url string, html string"
LONG = "<p>" + "word " * 300_000


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return spark


def expected(rows):
    """Rows of the contract; repeats of the largest id of equal payloads are all responses."""
    best = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            best.setdefault(data, []).append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in best.get(data, []) if x is not None]
        to = max(ids) if ids and i != max(ids) else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip_of_odd_rows(shared, compress):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "http://a/ b\r\nX: y", big), (5, None, big), (3, "http://c", big), (3, "http://c", big), (None, "u", big),
            (7, "", ""), (8, "u", None), (9, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", other), (11, "u", other),
            (None, "u", "y" * 2000), (None, "u", "y" * 2000), (-4, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\n\r\n\r\n"), (12, "u", LONG),
            (None, None, None)]
    df = shared.createDataFrame(rows, PAGES).select("*", *(F.lit(1).alias(c) for c in ("id", "digest", "first", "name", "data")))
    got = warc.archived(df, compress=compress, max_file_bytes=3000).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_empty_table(shared):
    assert warc.op12(shared.createDataFrame([], PAGES)).collect() == []


def test_query_against_sql(shared):
    sf = "/root/testdata/sf0.001"
    assert spark_rows(entry.queries()["op12_warc"](shared, sf)) == sql_rows(connect(sf), ORACLES["op12_warc"])


def test_ids_that_are_texts(shared):
    ids = ["a b", "x>y", "+", "%41", "é", "", None]
    df = shared.createDataFrame([(i, "u", "same" * 300) for i in ids], "page_id string, url string, html string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archived(df).collect()}
    top = max(x for x in ids if x is not None)
    assert got == {(i, "response" if i == top else "revisit", None if i == top else top) for i in ids}


def records(n, compress):
    r = random.Random(3)
    out = []
    for i in range(n):
        html = f"page {i} " + "".join(r.choice("abc <>\r\n") for _ in range(r.randint(0, 400)))
        one = warc.page_record(f"<urn:page:{i}>", f"http://x/{i}", html.encode(), "2020-01-01T00:00:00Z")
        out.append(gzip.compress(one) if compress else one)
    return out


def scanned(data):
    return list(warc.scan(pa.BufferReader(data)))


def names(found):
    return [f["warc-record-id"] for _, _, some, _ in found for f, _ in some]


def covers(found, size):
    at = 0
    for offset, length, some, reason in found:
        assert offset == at and length > 0 and bool(some) != bool(reason)
        at += length
    assert at == size


@pytest.mark.parametrize("compress", [True, False])
def test_whatever_is_damaged_the_other_records_are_recovered(compress):
    r = random.Random(11)
    whole = records(12, compress)
    assert names(scanned(b"".join(whole))) == [f"<urn:page:{i}>" for i in range(12)]
    for _ in range(300):
        parts, hurt = list(whole), set()
        for i in r.sample(range(12), r.randint(1, 3)):
            x, hurt = bytearray(parts[i]), hurt | {i}
            how = r.choice(["flip", "cut", "insert", "drop", "zero"])
            at = r.randrange(len(x))
            if how == "flip":
                x[at] ^= 1 << r.randrange(8)
            elif how == "cut":
                del x[at:at + r.randint(1, 50)]
            elif how == "insert":
                x[at:at] = r.randbytes(r.randint(1, 50))
            elif how == "drop":
                x.clear()
            else:
                x[at:at + 20] = bytes(len(x[at:at + 20]))
            parts[i] = bytes(x)
        data = b"".join(parts)
        found = scanned(data)
        covers(found, len(data))
        left = set(names(found))
        # harmless damage (a byte of a gzip header, letters of a field that has no check) may leave a record sound
        assert {f"<urn:page:{i}>" for i in range(12) if i not in hurt} <= left
        for _, _, some, _ in found:
            for fields, payload in some:
                digest = fields.get("warc-payload-digest")  # its name may have been hurt
                assert digest is None or hashlib.sha1(payload).hexdigest() == warc._hex_digest(digest)


def test_gaps_are_logged(shared, tmp_path):
    a, b, c = records(3, True)
    (tmp_path / "one.warc.gz").write_bytes(b"junk" + a + b[:-9] + c)
    (tmp_path / "two.warc.gz").write_bytes(b"no archive at all")
    (tmp_path / "three.warc").write_bytes(b"")
    read = warc.read_archives(warc.list_archives(shared, str(tmp_path)))
    gaps = {(r["path"].rsplit("/", 1)[1], r["offset"], r["length"]) for r in warc.quarantine(read).collect()}
    assert gaps == {("one.warc.gz", 0, 4), ("one.warc.gz", 4 + len(a), len(b) - 9), ("two.warc.gz", 0, 17)}
    kept = warc.resolved(read).collect()
    assert {r["record_id"] for r in kept} == {"<urn:page:0>", "<urn:page:2>"}
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in kept)


def test_a_revisit_of_a_lost_response(shared, tmp_path):
    payload = b"x" * 2000
    lost = warc.page_record("<urn:page:9>", "u", payload, "2020-01-01T00:00:00Z").replace(b"xx", b"xy", 1)
    again = warc.page_record("<urn:page:1>", "u", payload, "2020-01-01T00:00:00Z", "<urn:page:9>", "u")
    (tmp_path / "a.warc").write_bytes(lost + again)
    got = warc.resolved(warc.read_archives(warc.list_archives(shared, str(tmp_path)))).collect()
    assert [(r["type"], r["refers_to"], r["payload_bytes"]) for r in got] == [("revisit", "<urn:page:9>", None)]
