import gzip
import hashlib
import os

import duckdb

from gleaner.llm import op6_warc as op6

SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, payload string"


def sha(x):
    return "sha256:" + hashlib.sha256(x.encode()).hexdigest()


def records(spark):
    rows = [
        ("r1", "response", "http://a/", "2024-01-02", None, "A\r\n\r\nbody é"),
        ("r2", "response", "http://b/\r\nx: y", "2024-01-01", sha("A\r\n\r\nbody é"), "A\r\n\r\nbody é"),
        ("r3", "revisit", "http://a/", "2024-01-03", sha("A\r\n\r\nbody é"), None),
        ("r4", "revisit", "http://c/", "2024-01-03", sha("nowhere"), None),
        ("r5", "revisit", None, None, None, None),
        ("r6", "response", "http://d/", "2024-01-01", None, None),
        ("r7", "response", "http://d/", "2024-01-01", None, ""),
        (None, "response", "http://e/", "2024-01-01", None, "E"),
        ("r8", "response", "http://f/", "2024-01-01", None, "F" * 300000),
        ("r9", "response", "http://g/", "2024-01-01", None, "G"),
        ("r9", "response", "http://g/", "2024-01-01", None, "G"),
        ("r10", "metadata", "http://g/", "2024-01-01", None, "kept as it is"),
    ]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as bucket", "'h' as header", "true as resolved")


def test_resolution(spark):
    out = {(r.target_uri, r.warc_date, r.warc_type): r for r in op6.resolve(records(spark)).collect()}
    first = out["http://b/ x: y", "2024-01-01", "response"]
    later, seen = out["http://a/", "2024-01-02", "revisit"], out["http://a/", "2024-01-03", "revisit"]
    assert later.refers_to == seen.refers_to == first.record_id and seen.refers_to_uri == first.target_uri
    assert bytes(first.payload).decode() == "A\r\n\r\nbody é" and not later.payload and later.resolved and seen.resolved
    for key in (("http://c/", "2024-01-03", "revisit"), (op6.NO_URI, "", "revisit")):
        assert not out[key].resolved and out[key].refers_to is None
    assert {out["http://d/", "2024-01-01", k].warc_type for k in ("response", "revisit")} == {"response", "revisit"}
    assert out["http://g/", "2024-01-01", "metadata"].payload == b"kept as it is"


def test_archives_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    listed = op6.write_archives(records(spark), folder, roll=200)
    files = listed.collect()
    assert sorted(x.archive for x in files) == sorted(os.listdir(f"{tmp_path}/w"))
    assert sum(x.n_records for x in files) == 12 and all(x.n_bytes == os.path.getsize(f"{tmp_path}/w/{x.archive}") for x in files)
    got = sorted(map(tuple, op6.read_archives(listed, folder).collect()), key=str)
    assert got == sorted(map(tuple, op6.resolve(records(spark)).collect()), key=str)
    assert len({x[0] for x in got}) == 12
    # of the repeated record one stays a response, the other refers to it
    g = {x[1]: x for x in got if x[2] == "http://g/" and x[1] != "metadata"}
    assert len(g) == 2 and g["revisit"][5] == g["response"][0]
    for x in files:
        data = gzip.open(f"{tmp_path}/w/{x.archive}").read()
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and data.endswith(b"\r\n\r\n")
        assert data.count(b"WARC-Type: response") <= data.count(b"HTTP/1.1 200 OK")
    none = op6.write_archives(records(spark).limit(0), folder)
    assert none.count() == 0 and op6.read_archives(none, folder).count() == 0


def test_any_bytes_and_many_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op6, "COPIES", 7)
    raw = bytes(range(256)) * 20 + b"\r\n\r\n"
    rows = [("a", "response", "http://a/", "2024-01-01", "d", bytearray(raw))] * 50 + [("b", "revisit", "http://b/", "2024-01-02", "d", None)] * 8
    df = spark.createDataFrame(rows, SCHEMA.replace("payload string", "payload binary"))
    folder = f"file://{tmp_path}/w"
    got = op6.read_archives(op6.write_archives(df, folder), folder).collect()
    assert [bytes(x.payload) for x in got if x.warc_type == "response"] == [raw]
    assert len(got) == 58 == len({x.record_id for x in got}) and len({x.refers_to for x in got if x.warc_type == "revisit"}) == 1


def test_payloads_meet_one_shuffle(spark):
    originals, revisits, others = op6.parts(records(spark))
    assert originals._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert "Exchange" not in others._jdf.queryExecution().executedPlan().toString()
    # what revisits move has no payload
    text = revisits._jdf.queryExecution().optimizedPlan().toString()
    assert all("payload#" not in x for x in text.split("\n") if x.lstrip(" :+-").startswith("Aggregate"))


def test_empty_and_null_pages(spark, tmp_path):
    pages = spark.createDataFrame([(None, None, None), (1, "u", "x"), (1, "u", "x")], "page_id bigint, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = op6.op6_warc_revisits(spark, str(tmp_path))
    assert got.count() == 6
    con = duckdb.connect()
    con.sql(f"create view pages as from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(str, con.sql(op6.SQL).fetchall())) == sorted(str(tuple(r)) for r in got.collect())
    pages.limit(0).write.parquet(f"{tmp_path}/e/pages.parquet")
    assert op6.op6_warc_revisits(spark, f"{tmp_path}/e").count() == 0


def test_one_id_with_two_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "y"), (1, "u", "y"), (2, "v", "z")], "page_id bigint, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = op6.op6_warc_revisits(spark, str(tmp_path)).collect()
    assert sorted(r.payload for r in got if r.warc_type == "response") == ["x", "y", "z"] and len(got) == 8
    df = spark.createDataFrame([(None, "response", "u", "2024-01-01", None, x) for x in "abcdefgh"], SCHEMA)
    assert sorted(bytes(r.payload).decode() for r in op6.resolve(df).collect() if r.warc_type == "response") == list("abcdefgh")
