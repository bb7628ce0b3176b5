import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from flowspark.llm import warc
from flowspark.session import scratch_folder

ROWS = [
    (1, "http://a.example/x", "<p>same</p>"), (2, "http://b.example/", "<p>same</p>"), (3, None, None), (4, "bad\r\nurl x", ""),
    (5, "http://ü.example/é", "été " * 100), (6, "http://c.example/", "x" * 300_000), (None, "http://n.example/", "<p>same</p>"),
    (7, "http://d.example/", "only null ids"), (2, "http://b.example/", "<p>same</p>"),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, path string")
    found = warc.archive_round_trip(df, "page_id", "url", "html", payloads=True).collect()
    assert len(found) == len(ROWS) and all(r.problem is None for r in found)
    winners = {"<p>same</p>": 2, "": 4}
    by_id = {}
    for r in found:
        by_id.setdefault(r.record_id.rsplit(":", 1)[1], []).append(r)
    for page, url, html in ROWS:
        r = by_id[str(page)][0]
        data = (html or "").encode()
        winner = winners.get(html or "", page)
        assert r.payload_bytes == len(data) and r.payload_digest == warc.sha1_base32(data)
        assert r.record_type == ("response" if winner == page else "revisit")
        assert r.payload == (data if winner == page else None)
        assert (r.refers_to_id or "").rsplit(":", 1)[-1] == ("" if winner == page else str(winner))
        assert (r.target_uri is None) == (url is None)
    assert by_id["4"][0].target_uri == "bad%0D%0Aurl%20x"


def test_dictionary_leads_the_archive(spark):
    path = scratch_folder(spark, "test-archives")
    df = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"),
                                 F.repeat(F.concat(F.lit("<p>text "), "id", F.lit("</p>")), 20).alias("html")).coalesce(1)
    warc.write_archives(df, "page_id", "url", "html", path)
    heads = [bytes(r.content[:4]) for r in spark.read.format("binaryFile").load(path).collect() if r.length]
    assert heads and all(h == struct.pack("<I", warc.DICTIONARY_FRAME) for h in heads)
    assert warc.read_archives(spark, path).where("problem is null").count() == 400


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(df, "page_id", "url", "html").count() == 0


def record(**changes):
    data = warc.record_bytes("response", "urn:x-page:1", "http://x/", None, warc.sha1_base32(b"body"), 4, b"body")
    for old, new in changes.get("swap", []):
        assert old in data
        data = data.replace(old, new)
    return data


@pytest.mark.parametrize("swap, problem", [
    ([(b"WARC/1.1", b"HTTP/1.1")], "no version line"), ([(b"WARC-Date: ", b"X-Date: ")], "no warc-date"),
    ([(b"\r\n\r\nbody", b"\r\n\r\nbodyy")], "stated"), ([(b"\r\n\r\nbody", b"\r\n\r\nbodx")], "digest differs"),
    ([(b"WARC-Type: response", b"WARC-Type response")], "bad header line"),
])
def test_faults_are_reported(swap, problem):
    assert problem in warc.parse_record(record(swap=swap))["problem"]


def test_frames():
    data = record()
    plain = zstandard.ZstdCompressor(write_checksum=True).compress(data)
    streamed = zstandard.ZstdCompressor().compressobj()
    unsized = streamed.compress(data) + streamed.flush()
    skip = struct.pack("<II", 0x184D2A53, 3) + b"abc"
    found = list(warc.frames(memoryview(plain + skip + unsized + warc.SEPARATOR)))
    assert [f[1] for f in found] == [data, data] and [f[0] for f in found] == [0, len(plain) + len(skip)]
    cut = list(warc.frames(memoryview(plain + unsized[:-3])))
    assert cut[0][1] == data and cut[1][1] is None and "cut off" in cut[1][2]
    assert list(warc.frames(memoryview(b"not an archive")))[0][2] == "not a Zstandard frame"
    assert list(warc.frames(memoryview(b""))) == []


def test_compressed_dictionary():
    samples = [f"record {i} with common words {i % 7}".encode() * 3 for i in range(500)]
    content = zstandard.train_dictionary(2048, samples).as_bytes()
    packed = zstandard.ZstdCompressor().compress(content)
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content)).compress(record())
    for stored in (content, packed):
        head = struct.pack("<II", warc.DICTIONARY_FRAME, len(stored)) + stored
        assert [f[1] for f in warc.frames(memoryview(head + frame))] == [record()]
    assert hashlib.sha1(b"").hexdigest() and warc.sha1_base32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
