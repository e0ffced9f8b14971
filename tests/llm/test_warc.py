import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from barwright.llm import queries, warc


def brute(rows, least=100):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least:
            first[body] = min(first.get(body, i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = body in first and first[body] != i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=repr)


def through(spark, df, path, **how):
    warc.write(df, path, **how)
    got = warc.resolve(warc.captures(warc.read(spark, path)))
    return sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()
    got = queries.op2_warc(spark, sf_dir).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == brute(rows)


LONG = "x" * 150
ROWS = [(1, "http://a", LONG), (2, "http://b", LONG), (0, "http://c", LONG), (3, None, None), (4, "http://d\r\nX: y", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + LONG), (8, "u", "ü\0漢" * 60), (9, "u", "ü\0漢" * 60), (10, "u", "z" * 3_000_000)]


@pytest.mark.parametrize("how", [{}, {"codec": "none"}, {"broadcast_rows": -1}, {"broadcast_rows": 1}])
def test_round_trip(spark, tmp_path, how):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("rid", F.lit("clash")).withColumn("digest", F.lit("clash"))
    assert through(spark, df, str(tmp_path / "w"), **how) == brute(ROWS)


def test_repeated_rows_null_ids_and_no_rows(spark, tmp_path):
    rows = [(1, "u", LONG), (1, "u", LONG), (None, "u", LONG), (None, "u", None), (2, "u", LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = through(spark, df, str(tmp_path / "w"))
    assert [r[3] for r in got].count("response") == 3 and len(got) == 5
    assert all(r[4] == 1 for r in got if r[3] == "revisit")
    assert through(spark, df.limit(0), str(tmp_path / "e")) == []


def test_captures_are_whole(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:3], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"))
    for r in warc.captures(warc.read(spark, str(tmp_path / "w"))).collect():
        assert len(r["requests"]) == 1 and len(r["metadata"]) == 1 and r["requests"][0]["target_uri"].startswith("http://")
        payload = bytes(r["response"]["payload"])
        assert payload == (LONG.encode() if r["response"]["rtype"] == "response" else b"")


def test_foreign_archives():
    """A member per record, and a record that no other refers to."""
    record = lambda kind, i, block: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    parts = [record("warcinfo", 1, b"software: x"), record("response", 2, b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\nmore"), record("response", 3, b"")]
    for content in (b"".join(parts), b"".join(map(gzip.compress, parts)), gzip.compress(b"".join(parts))):
        assert [(f["warc-type"], len(b)) for f, b in warc.parse(content)] == [("warcinfo", 11), ("response", 31), ("response", 0)]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.parse(b"".join(parts)[:-40]))


def test_long_pages_have_files_of_their_own(spark, tmp_path):
    df = spark.range(40).select("id", F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("page "), F.when(F.col("id") % 4 == 0, 500_000).otherwise(100))).alias("html")).coalesce(1)
    warc.write(df, str(tmp_path / "w"), codec="none")
    sizes = sorted(p.stat().st_size for p in (tmp_path / "w").glob("part-*"))
    assert len(sizes) == 5 and sizes[-1] < 8 << 20  # 10 captures of 2.5 MB, 3 a file, and 30 short ones in one
    got = warc.resolve(warc.captures(warc.read(spark, str(tmp_path / "w"), payload=False)))
    assert got.count() == 40 and got.agg(F.sum("payload_bytes")).first()[0] == df.agg(F.sum(F.octet_length("html"))).first()[0]


def test_revisits_without_their_response(spark):
    meta = [("m", None, None, 7)]
    rows = [("c1", ("revisit", "c1", None, None, None, None, None, "ab", None), meta), ("c2", ("revisit", "c2", None, None, None, None, None, None, None), [("m", None, None, 8)])]
    one = "struct<rtype: string, record_id: string, refers_to: string, target_uri: string, date: string, payload_bytes: bigint, payload_digest: string, header_digest: string, payload: binary>"
    side = "array<struct<record_id: string, target_uri: string, date: string, page_id: bigint>>"
    got = warc.resolve(spark.createDataFrame(rows, f"capture_id string, response {one}, metadata {side}")).collect()
    assert sorted(map(tuple, got)) == [(7, None, "ab", "revisit", None), (8, None, None, "revisit", None)]
