import base64
import hashlib

import pytest

from loomline.llm import shared, warc


def slow(rows, least=0):
    raw = {i: (h or "").encode() for i, h in rows}
    last = {}
    for i, b in raw.items():
        last[b] = max(last.get(b, i), i)
    out = {}
    for i, b in raw.items():
        first = last[b] if len(b) >= least else i
        out[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first == i else "revisit", None if first == i else first)
    return out


def taken(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


def test_query_equals_brute_force(spark, sf_dir):
    from loomline.llm.queries import op3_warc

    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert taken(op3_warc(spark, sf_dir)) == slow(rows)


TRAP = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [
    (1, TRAP), (2, "x" + TRAP * 3 + "WARC/1.1\r\n"), (3, ""), (4, None), (5, "é\r\n\r\n"), (6, "é\r\n\r\n"), (7, "WARC/1.1\r\n"), (8, "\r\n\r\nWARC/1.1\r\n\r\n"),
    (9, "z" * 300_000), (10, TRAP), (11, " "), (12, "WARC/1.1\r\nContent-Length: x\r\n\r\n"),
]


@pytest.mark.parametrize(("split", "per_file", "least", "compression"), [("128m", 20_000, 0, "gzip"), ("997", 3, 0, "none"), ("4k", 50, 4, "none")])
def test_magic_in_payloads_and_any_split(spark, split, per_file, least, compression):
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nX: 1", h, 0) for i, h in ROWS], "page_id long, url string, html string, at int")
    path = warc.write(pages.repartition(2), shared.new_path(spark, "warc"), least, per_file, compression)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = warc.read(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == slow(ROWS, least)
    assert len(rows) == len(ROWS)
    html = dict(ROWS)
    assert all(r.payload == (html[r.page_id] or "") for r in rows if r.record_type == "response")
    assert {r.url for r in rows} == {f"http://a/{i} X: 1" for i, _ in ROWS}


def test_rows_without_ids_and_empty_tables(spark):
    pages = spark.createDataFrame([(None, None, "a"), (None, "u", "a"), (3, "u", "b"), (3, "u", "b"), (None, "u", "b")], "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in warc.read(spark, warc.write(pages, shared.new_path(spark, "warc"))).collect()), key=str)
    assert got == sorted([(0, "response", None)] * 2 + [(3, "response", None)] * 2 + [(0, "revisit", 3)], key=str)
    assert warc.read(spark, warc.write(pages.limit(0), shared.new_path(spark, "warc"))).count() == 0
