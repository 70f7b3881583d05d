"""WARC: round trips, revisits, segments out of order, broken records, foreign archives."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from quillstream.llm import warc
from quillstream.storage import table_path

SEP = "\r\n\r\n"
PAGES = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>one</p>"),
    (3, None, None),
    (4, "http://a/4", ""),
    (5, "http://a/5\r\nX: y", "x" * 300_001),
    (6, "http://a/6", f"WARC/1.1\r\nContent-Length: 3{SEP}abc{SEP}0{SEP}WARC/1.1\r\n" + "é" * 20_000),
    (7, "http://a/7", "\r\n" * 9_000),
    (8, "http://a/8", "x" * 300_001),
    (8, "http://a/8", "x" * 300_001),
    (9, "http://a/9", "y" * 9_000),
    (9, "http://a/9", "y" * 9_000),
    (None, "http://a/n", "<p>one</p>"),
    (None, "http://a/m", "z" * 20_000),
]
SCHEMA = "page_id long, url string, html string"


def want(rows, least=0):
    """(id, size, digest, type, refers_to) by reading the rule."""
    out = []
    for i, _, t in rows:
        data = (t or "").encode()
        ids = [j for j, _, u in rows if (u or "") == (t or "") and j is not None]
        first = min(ids, default=None)
        again = first is not None and i != first and len(data) >= least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def told(spark, path):
    found = table_path(spark, "captures")
    warc.captures(spark, path).write.parquet(found)
    rows = warc.resolve(spark.read.parquet(found)).collect()
    assert all(r["fault"] is None for r in rows)
    return sorted(((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, least):
    path = table_path(spark, "warc")
    warc.write(spark.createDataFrame(PAGES, SCHEMA).withColumn("digest", F.lit("mine")), path, least=least)
    assert told(spark, path) == want(PAGES, least)
    texts = {(r["key"], r["payload_bytes"]): bytes(r["payload"]) for r in warc.captures(spark, path).filter("record_type = 'response'").collect()}
    assert texts[6, len(PAGES[5][2].encode())] == PAGES[5][2].encode() and texts[7, 18_000] == b"\r\n" * 9_000
    cut = warc.records(spark, path).filter("segmented").select(F.col("fields")["warc-type"].alias("t"), F.octet_length("block").alias("n")).collect()
    assert max(r["n"] for r in cut) <= warc.SEGMENT_BYTES and sum(r["t"] == "continuation" for r in cut) > 40


def test_empty_table(spark):
    path = table_path(spark, "warc")
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert told(spark, path) == []


def record(block: bytes, **fields) -> bytes:
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\n{head}content-length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def archive(tmp_path, *files):
    for i, parts in enumerate(files):
        # One gzip member for each record, as other writers do.
        (tmp_path / f"{i}.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    return str(tmp_path)


HTTP = b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\n"


def test_segments_of_several_files_meet_in_order(spark, tmp_path):
    block = HTTP + b"4;x=1\r\nab\r\n\r\n3\r\n\xff\xfe\x00\r\n0\r\nTrailer: t\r\n\r\n"
    a, b, c = block[:20], block[20:70], block[70:]
    seg = lambda data, n, **more: record(data, WARC_Type="continuation", WARC_Record_ID=f"<s{n}>", WARC_Segment_Origin_ID="<o>", WARC_Segment_Number=n, **more)
    path = archive(tmp_path, [record(b"info", WARC_Type="warcinfo", WARC_Record_ID="<i>"), seg(c, 3, WARC_Segment_Total_Length=len(block))], [seg(b, 2), record(a, WARC_Type="response", WARC_Record_ID="<o>", WARC_Segment_Number=1)])
    rows = {r["record_id"]: r for r in warc.captures(spark, path).collect()}
    assert set(rows) == {"<i>", "<o>"}
    assert bytes(rows["<o>"]["payload"]) == b"ab\r\n\xff\xfe\x00" and rows["<o>"]["fault"] is None


@pytest.mark.parametrize(
    "parts, fault",
    [
        ([(b"abc", 1, None), (b"def", 3, 6)], "segments"),
        ([(b"abc", 1, None), (b"def", 2, 7)], "total length"),
        ([(b"abc", 1, None), (b"def", 2, None)], "total length"),
        ([(b"def", 2, 3)], "segments"),
        ([(b"abc", 1, None), (b"def", 2, 6), (b"xyz", 2, 6)], "segments"),
    ],
)
def test_broken_segments_are_told(spark, tmp_path, parts, fault):
    made = [record(d, WARC_Type="response" if n == 1 else "continuation", WARC_Record_ID="<o>" if n == 1 else f"<{n}>", WARC_Segment_Number=n, **({"WARC_Segment_Origin_ID": "<o>"} if n > 1 else {}), **({"WARC_Segment_Total_Length": t} if t else {})) for d, n, t in parts]
    (row,) = warc.captures(spark, archive(tmp_path, made)).collect()
    assert row["fault"] == fault


def test_broken_records_leave_the_others(spark, tmp_path):
    good = record(b"HTTP/1.1 200 OK\r\n\r\nbody", WARC_Type="response", WARC_Record_ID="<g>", WARC_Payload_Digest="sha1:AAAA")
    cut = record(HTTP + b"5\r\nab\r\n0\r\n\r\n", WARC_Type="response", WARC_Record_ID="<c>")
    lost = record(b"", WARC_Type="revisit", WARC_Record_ID="<r>", WARC_Refers_To="<none>")
    path = archive(tmp_path, [b"noise\r\n\r\nmore\r\n\r\n", good, cut, lost, record(b"x" * 50, WARC_Type="response", WARC_Record_ID="<t>")[:-30]])
    found = table_path(spark, "captures")
    warc.captures(spark, path).write.parquet(found)
    rows = {r["record_id"]: r["fault"] for r in warc.resolve(spark.read.parquet(found)).collect()}
    assert rows == {None: "head", "<g>": "digest", "<c>": "transfer framing", "<r>": "target", "<t>": "truncated"}


@pytest.mark.parametrize("data", [b"", b"5\r\nab", b"x\r\n", b"2\r\nabX0\r\n\r\n", b"0\r\n", b"-1\r\n"])
def test_broken_framing(data):
    with pytest.raises(ValueError):
        warc.dechunk(data)
