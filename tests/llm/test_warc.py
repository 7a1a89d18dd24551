import base64
import hashlib
import time

import numpy as np
import pytest
import zstandard

from lodestack.llm import warc

SCHEMA = "page_id long, url string, html string, digest int, archive string"
BIG = "<p>the same page</p>" * 80


def pages(spark, rows):
    return spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)


def test_round_trip_and_revisits(spark):
    rows = [(i, f"http://x/{i} y", f"<html>{'w%d ' % i * 40}é</html>" * 8) for i in range(60)]
    rows += [(100, "a\nb", BIG), (7000, None, BIG), (101, "", BIG), (102, "u", "tiny"), (103, "u", "tiny"), (104, "u", None), (105, "u", ""), (None, "n", BIG), (106, "%20", "x" * 300_000), (7000, "again", BIG)]
    df = pages(spark, rows).repartition(3)
    dictionary = warc.train_dictionary(df)
    archives = warc.write_archives(df, dictionary, size=20_000)
    assert archives.count() > 3
    got = sorted(map(tuple, warc.read_archives(archives).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "error").collect()), key=str)
    want = []
    for i, url, html in rows:
        body = (html or "").encode()
        again = html == BIG and i != 7000
        want.append((i, url, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", 7000 if again else None, None if again else bytearray(body), None))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    df = pages(spark, [])
    assert warc.read_archives(warc.write_archives(df, warc.train_dictionary(df))).collect() == []


def archive(*records, dictionary=b""):
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return warc.dictionary_frame(dictionary) + b"".join(zstandard.ZstdCompressor(dict_data=data).compress(r) for r in records)


def record(body=b"hello", **kwargs):
    return warc.record_bytes(1, "u", body, hashlib.sha1(body).hexdigest(), None, False)


@pytest.mark.parametrize(
    "bad, says",
    [
        (record().replace(b"Content-Length: 5", b"Content-Length: 6"), "digest"),
        (record()[:-5] + b"\r\n\r\n", "content-length"),
        (record().replace(b"WARC-Date", b"X-Date"), "warc-date"),
        (record().replace(b"WARC/1.1", b"WORC/1.1"), "line"),
        (record().replace(b"hello", b"jello"), "digest"),
    ],
)
def test_bad_records_are_named(spark, bad, says):
    df = spark.createDataFrame([("f", archive(record(), bad, record(b"more")))], "path string, content binary")
    rows = warc.read_archives(df, strict=False).collect()
    assert [r.error is None for r in rows] == [True, False, True] and says in rows[1].error
    with pytest.raises(warc.BadArchive):
        for _, raw in warc.frames(rows and df.first().content):
            warc.parse_record(raw)


def test_dictionary_comes_from_the_leading_frame(spark):
    dictionary = zstandard.train_dictionary(4096, [f"sample {i} text {i * 7}".encode() * 20 for i in range(400)]).as_bytes()
    whole = archive(record(b"sample 5 text 35" * 9), record(b""), dictionary=dictionary)
    assert warc.take_dictionary(whole)[0] == dictionary
    assert [warc.parse_record(r)["payload"] for _, r in warc.frames(whole)] == [b"sample 5 text 35" * 9, b""]
    for damaged in (whole[:6], whole[:40], whole[: len(whole) - 3], whole[:8] + b"xx", whole[:20] + bytes(40) + whole[60:], whole + warc.dictionary_frame(b"")[:5], whole + b"\x50\x2a\x4d\x18\xff\xff\x00\x00"):
        with pytest.raises(warc.BadArchive):
            list(warc.frames(damaged))
        df = spark.createDataFrame([("f", damaged)], "path string, content binary")
        assert warc.read_archives(df, strict=False).collect()[-1].error


def plain_record(kind, block, content_type="text/plain", **more):
    headers = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:0a1b2c3d-0000-4000-8000-000000000001>", "WARC-Date": "2024-05-01T00:00:00Z", "Content-Type": content_type, **more, "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark):
    body = b"hello world"
    http = "application/http; msgtype=response"
    sha = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    records = [
        plain_record("warcinfo", b"software: x\r\n", "application/warc-fields"),
        plain_record("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "application/http; msgtype=request"),
        plain_record("response", b"HTTP/1.1 200 OK\r\nServer: a\r\n b\r\n\r\n" + body, http, **{"WARC-Payload-Digest": sha, "WARC-Target-URI": "http://x/"}),
        plain_record("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5;a=b\r\nhello\r\n6\r\n world\r\n0\r\n\r\n", http, **{"WARC-Payload-Digest": sha}),
        plain_record("revisit", b"", http, **{"WARC-Payload-Digest": sha, "WARC-Refers-To-Target-URI": "http://x/"}),
        plain_record("metadata", b""),
    ]
    skipped = b"\x53\x2a\x4d\x18\x03\x00\x00\x00abc"
    df = spark.createDataFrame([("f", archive(*records[:3]) + skipped + archive(*records[3:]))], "path string, content binary")
    got = warc.read_archives(df).collect()
    assert [(r.record_type, r.payload_bytes, r.page_id) for r in got] == [("warcinfo", 13, None), ("request", 27, None), ("response", 11, None), ("response", 11, None), ("revisit", None, None), ("metadata", 0, None)]
    assert got[2].payload == got[3].payload == body and got[2].url == "http://x/" and got[0].record_id.startswith("<urn:uuid:")
    for bad in (records[2].replace(b"hello", b"jello"), records[3].replace(b"5;a", b"z;a"), plain_record("response", b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n" + body, http)):
        with pytest.raises(warc.BadArchive):
            warc.parse_record(bad)


def test_long_archives_take_linear_time():
    noise = np.random.default_rng(0).bytes(1 << 16)
    whole = archive(*[record(noise)] * 1600)
    began = time.perf_counter()
    assert len(whole) > 100 << 20 and sum(1 for _ in warc.frames(whole)) == 1600
    assert time.perf_counter() - began < 10
