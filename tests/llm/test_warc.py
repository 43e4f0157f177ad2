"""WARC archives: round trips, odd payloads, segments, foreign files, torn files and bounded memory."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import tracemalloc
import zlib

import pytest
from pyspark.sql import functions as F

from sedra.llm import warc


def b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [
    (5, "http://a.b/c d\r\nX: 1", "<p>ü😀</p>"), (3, "http://a.b/é", "<p>ü😀</p>"), (9, None, None), (7, "u", ""), (1, "u", "WARC/1.1\r\n\r\n\r\n\x00tail\r\n\r\n"),
    (None, "u", "<p>ü😀</p>"), (None, "u", "alone"), (4, "u", "alone4"), (4, "u", "alone4"), (4, "u", "<p>ü😀</p>"), (2, "u", "x" * 300_000), (8, "u", "x" * 300_000), (6, "u", "x" * 299_999),
]


def expected(pages, least=0):
    whole = [(k, (x or "").encode()) for k, _, x in pages]
    out = []
    for k, x in whole:
        first = min((j for j, y in whole if y == x and j is not None), default=None)
        again = len(x) >= least and k != first
        out.append((k, len(x), b32(x), "revisit" if again else "response", first if again else None, True))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 7])
@pytest.mark.parametrize("segment", [warc.SEGMENT, 1000])
def test_round_trip(spark, least, segment):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(4)
    for name in ("k", "u", "x", "same", "n", "record_id", "digest", "refers_to", "a.b"):
        df = df.withColumn(name, F.lit("own"))
    path = warc.new_table(spark)
    warc.write(warc.deduplicated(df, least=least), path, segment=segment)
    got = warc.summaries(warc.read(spark, path, chunk=777))
    rows = [(warc.key_of(F.col("record_id"), "long"), "payload_bytes", "payload_digest", "type", warc.key_of(F.col("refers_to"), "long"), "intact")]
    assert sorted(map(tuple, got.select(*rows[0]).collect()), key=repr) == expected(PAGES, least)
    # The chunks are the payload, in order, and each carries the digest so far.
    at = {}
    for r in sorted(warc.read(spark, path, chunk=777).where("record_id = 'urn:key:2'").collect(), key=lambda r: r.chunk):
        before = at.get("data", b"")
        assert r.offset == len(before) and r.size == len(r.data) <= 777
        at["data"] = before + r.data
        assert r.digest == b32(at["data"]) and r.last == (len(at["data"]) == 300_000)
    assert at["data"] == b"x" * 300_000
    assert warc.read(spark, path, data=False).where("data is not null").count() == 0


def test_archive_and_empty_table(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    out = warc.archive(df)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    assert sorted(map(tuple, out.collect()), key=repr) == expected(PAGES)
    assert warc.archive(df.where("false")).count() == 0


def test_files_are_plain_gzip_members(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(warc.deduplicated(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)), path, segment=1000)
    text = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("part-*"))
    assert text.count(b"WARC-Type: response") == sum(r[3] == "response" for r in expected(PAGES))
    assert text.count(b"WARC-Segment-Total-Length") == 2  # two long payloads
    assert b"WARC-Target-URI: http://a.b/c%20d%0D%0AX:%201\r\n" in text
    with pytest.raises(ValueError):
        warc.write(warc.deduplicated(spark.createDataFrame(PAGES, "page_id long, url string, html string")), path + "2", segment=1 << 24)


def record(kind, ident, block, *more, content="text/plain"):
    head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"warc-record-id:<{ident}>", f"Content-Type: {content}", *more, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


FOREIGN = [
    record("warcinfo", "i", b"software: x\r\n"),
    record("resource", "r", b"\r\n\r\nplain", f"WARC-Payload-Digest: sha1:{b32(b'other')}"),
    record("response", "s", b"HTTP/1.1 404 Not\r\nA: b\r\n\r\nbody", "WARC-Target-URI: u", content="application/http; msgtype=response"),
    record("continuation", "t#2", b"tail", "WARC-Segment-Origin-ID: <t>", "WARC-Segment-Number: 2", "WARC-Segment-Total-Length: 9"),
    record("metadata", "m", b""),
]


@pytest.mark.parametrize("zipped", [False, True])
@pytest.mark.parametrize("piece", [1, 7, 1000])
def test_reader_of_foreign_files(zipped, piece):
    raw = b"".join(gzip.compress(r) for r in FOREIGN) if zipped else b"".join(FOREIGN)
    reader, got = warc.Reader("f", 4), []
    for i in range(0, len(raw), piece):
        got += reader.feed(raw[i : i + piece])
    got += reader.close()
    payloads = {}
    for r in got:
        payloads[r[1]] = payloads.get(r[1], b"") + r[8]
    assert payloads == {"r": b"\r\n\r\nplain", "s": b"body", "t": b"tail", "m": b""}
    ends = {r[1]: r for r in got if r[11]}
    assert ends["r"][12] is False and ends["s"][12] is None and ends["s"][9] == b32(b"body") and ends["t"][9] is None and ends["m"][9] == b32(b"")


def test_torn_and_bad_files():
    reader = warc.Reader("f", 4)
    whole = record("resource", "r", b"0123456789")
    got = [*reader.feed(whole[:-8]), *reader.close()]
    assert b"".join(r[8] for r in got) == b"012345" and got[-1][11:] == (True, False)
    with pytest.raises(ValueError):
        list(warc.Reader("f").feed(b"HTTP/1.1 200 OK\r\n\r\n"))
    with pytest.raises(ValueError):
        reader = warc.Reader("f")
        list(reader.feed(whole[:20]))
        list(reader.close())


def test_streamed_files_equal_short_ones(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "u", "".join(rng.choices("ab \n", k=rng.randrange(3000)))) for i in range(200)], "page_id long, url string, html string").repartition(3)
    path = warc.new_table(spark)
    warc.write(warc.deduplicated(df), path)
    rows = lambda whole: sorted(map(tuple, warc.read(spark, path, chunk=100, whole=whole).drop("file").collect()))
    assert rows(warc.WHOLE) == rows(0)


def test_memory_is_bounded():
    """A payload of 200 MB is read within a few chunks' memory."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    raw = [z.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <r>\r\nContent-Length: %d\r\n\r\n" % (200 << 20))]
    raw += [z.compress(bytes(1 << 20)) for _ in range(200)] + [z.compress(b"\r\n\r\n"), z.flush()]
    want = b32(bytes(200 << 20))
    tracemalloc.start()
    reader, n, last = warc.Reader("f"), 0, None
    for block in raw:
        for r in reader.feed(block):
            n, last = n + r[7], r
    assert n == 200 << 20 and last[11] and last[9] == want
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
