"""WARC archives by way of a chunked record table.

Writing: a payload leaves a row as segments of up to SEGMENT bytes, each a WARC record of its own (the first a response,
the rest continuations of it, as ISO 28500 has it), and each a gzip member of its own. So an oversized payload is
compressed and handed on a segment at a time. A member's last byte is the high byte of its length, which is zero for so
short a record: that byte is the line end that Spark's text writer puts after each row. So archives are put in place by
Spark's own writer, on any file system, and a task that is lost or run twice leaves nothing behind.

Reading: a file is fed to a streaming reader in blocks, through an inflater of bounded output. It gives the rows of the
chunked record table: record, chunk number, offset, the bytes, and the SHA-1 of the payload so far, which is carried from
chunk to chunk and from a segment to its continuation. It holds a head and a chunk, whatever a record's or a file's
length.

Payloads that are equal are stored once: the record with the least key is the response, and the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedra.llm.shared import BATCH_BYTES, cut, in_batches, join_hot, new_table

SEGMENT = 1 << 20  # payload bytes of a record; below 2^24, so that a member ends in a zero byte
CHUNK = 1 << 20  # payload bytes of a row of the record table
BLOCK = 1 << 20  # bytes of a file that are read at once
WHOLE = 64 << 20  # bytes up to which Spark's binary reader reads a file
LEVEL = 3  # of compression
HEAD = 1 << 20  # bytes of a head at most
#: The profile of revisits, and the content types of records.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP, INFO = "application/http;msgtype=response", "application/warc-fields"

_END = b"\r\n\r\n"


def base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _safe(value: str) -> str:
    """A header's value on one line of ASCII: control characters, blanks and what lies beyond ASCII are percent-coded."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def _member(fields: list[tuple[str, str | int | None]], block: list[bytes | memoryview], level: int) -> bytes:
    """A record as a gzip member; fields without a value are left out."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {sum(map(len, block))}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = [z.compress(p) for p in (head.encode(), *block, _END)] + [z.flush()]
    return b"".join(out)


def members(record_id: str, url: str | None, payload: memoryview, digest: str, refers_to: str | None, date: str, segment: int = SEGMENT, level: int = LEVEL) -> Iterator[bytes]:
    """The gzip members of one record: a revisit, or a response and its continuations."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", None if url is None else _safe(url))]
    told = [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", HTTP)]
    if refers_to is not None:
        yield _member([("WARC-Type", "revisit"), *own, ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE), *told], [head], level)
        return
    parts = max(1, -(-len(payload) // segment))
    for k in range(parts):
        piece = payload[k * segment : (k + 1) * segment]
        number = [("WARC-Segment-Number", k + 1 if parts > 1 else None)]
        if k == 0:
            yield _member([("WARC-Type", "response"), *own, *told, *number], [head, piece], level)
        else:
            ends = len(head) + len(payload) if k == parts - 1 else None  # of all blocks
            ids = [("WARC-Record-ID", f"<{record_id}#{k + 1}>"), ("WARC-Segment-Origin-ID", f"<{record_id}>"), *own[1:]]
            yield _member([("WARC-Type", "continuation"), *ids, *number, ("WARC-Segment-Total-Length", ends)], [piece], level)


def record_id(key: Column) -> Column:
    """A URI for a key of any type; null has one, too."""
    return F.coalesce(F.concat(F.lit("urn:key:"), F.url_encode(key.cast("string"))), F.lit("urn:null"))


def key_of(record: Column, kind: str) -> Column:
    return F.when(record.startswith("urn:key:"), F.url_decode(F.substring(record, 9, 1 << 30))).cast(kind)


def deduplicated(df: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least: int = 0) -> DataFrame:
    """(record_id, url, payload, digest, refers_to) for each row of df: refers_to names the record of the least key among equal payloads of `least` bytes or more, and is null for that one itself.

    Payloads are equal if SHA-1 and SHA-256 are. A null payload is empty; a null key comes after all others. Of repeated
    rows of the least key none can be told from another: all are responses. Payloads are moved once, common ones in
    salted parts.
    """
    rows = df.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("x"))
    rows = rows.withColumn("same", F.concat(F.sha1("x"), F.sha2("x", 256)))
    first = cut(rows.groupBy("same").agg(F.min("k").alias("least"), F.count("*").alias("n")))
    again = (F.octet_length("x") >= least) & ~F.col("k").eqNullSafe(F.col("least"))
    out = join_hot(rows, first, "same")
    return out.select(record_id(F.col("k")).alias("record_id"), F.col("u").alias("url"), F.col("x").alias("payload"), F.substring("same", 1, 40).alias("digest"), F.when(again, record_id(F.col("least"))).alias("refers_to"))


def write(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", segment: int = SEGMENT, level: int = LEVEL) -> None:
    """Write records (record_id, url, payload, digest: hexadecimal SHA-1, refers_to) as gzipped WARC files, one a task, each begun by a warcinfo record.

    `date` is the records' WARC-Date. Payloads of over `segment` bytes become a response and continuations.
    """
    if not 0 < segment < (1 << 24) - (1 << 16):
        raise ValueError(f"segment of {segment} bytes: need less than 2^24, head included")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:warcinfo>"), ("WARC-Date", date), ("Content-Type", INFO)], [b"format: WARC File Format 1.1\r\n"], level)]
        size = len(out[0])
        some = False
        for b in batches:
            some = some or b.num_rows > 0
            for ident, url, payload, digest, refers_to in zip(*(b[c] for c in ("record_id", "url", "payload", "digest", "refers_to")), strict=True):
                for m in members(ident.as_py(), url.as_py(), memoryview(payload.as_buffer()), base32(digest.as_py()), refers_to.as_py(), date, segment, level):
                    out.append(m)
                    size += len(m)
                    if size >= BATCH_BYTES:
                        yield _values(out)
                        out, size = [], 0
        if out and some:
            yield _values(out)

    rows = in_batches(records.select("record_id", "url", "payload", "digest", "refers_to"), run, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", "\0").text(path)


def _values(out: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in out], pa.binary())], names=["value"])  # the writer's line end is the last byte


class Reader:
    """Turns the bytes of one file, fed in pieces of any size, into rows of the record table; close() tells of a record that the file ends in."""

    def __init__(self, file: str, chunk: int = CHUNK, data: bool = True) -> None:
        self.file, self.chunk, self.data = file, chunk, data
        self.buffer = bytearray()
        self.zipped: bool | None = None
        self.inflate = None
        self.left: int | None = None  # bytes of the block to come; None between records
        self.head: dict[str, str] = {}
        self.in_http = False
        self.origin = ""  # the record whose payload the digest and the numbers below are of
        self.sha = hashlib.sha1()
        self.at = self.number = 0
        self.want: str | None = None

    def feed(self, data: bytes) -> Iterator[tuple]:
        if self.zipped is None and data:
            self.zipped = data[0] == 0x1F
        for piece in self._plain(data) if self.zipped else [data]:
            self.buffer += piece
            yield from self._rows()

    def _plain(self, data: bytes) -> Iterator[bytes]:
        """The inflated bytes, CHUNK at a time, of members one after the other."""
        more = True
        while data or more:
            self.inflate = self.inflate or zlib.decompressobj(31)
            out = self.inflate.decompress(data, CHUNK)
            more = len(out) == CHUNK  # there may be some that needs no more input
            data = self.inflate.unconsumed_tail
            if self.inflate.eof:
                data, self.inflate, more = self.inflate.unused_data, None, False
            if out:
                yield out

    def _cut(self, most: int) -> bytes | None:
        """Takes a head off the buffer; None if its end isn't there yet."""
        end = self.buffer.find(_END, 0, most)
        if end < 0:
            if len(self.buffer) >= min(most, HEAD):
                raise ValueError(f"{self.file}: a head without an end: {bytes(self.buffer[:80])!r}")
            return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + len(_END)]
        return out

    def _rows(self) -> Iterator[tuple]:
        while True:
            if self.left is None:
                while self.buffer[:2] == b"\r\n":
                    del self.buffer[:2]
                raw = self._cut(HEAD)
                if raw is None:
                    return
                self._begin(raw.decode("utf-8", "replace"))
            if self.in_http:
                before = len(self.buffer)
                if self._cut(self.left) is None:
                    return
                self.left -= before - len(self.buffer)
                self.in_http = False
            kept = self.head["warc-type"] != "warcinfo"
            while self.left > self.chunk and len(self.buffer) >= self.chunk:
                row = self._row(self.chunk, False)
                if kept:
                    yield row
            if len(self.buffer) < self.left:
                return
            row = self._row(self.left, True)
            self.left = None
            if kept:
                yield row

    def _begin(self, raw: str) -> None:
        version, *lines = raw.split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"{self.file}: not a record: {version[:80]!r}")
        self.head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        self.left = int(self.head["content-length"])
        self.in_http = self.head.get("content-type", "").replace(" ", "").startswith("application/http") and self.left > 0
        goes_on = self.head["warc-type"] == "continuation" and self.head.get("warc-segment-origin-id") == self.origin and int(self.head["warc-segment-number"]) == self.segment + 1
        self.segment = int(self.head.get("warc-segment-number", 1))
        if not goes_on:
            self.origin = self.head.get("warc-segment-origin-id") or self.head["warc-record-id"]
            self.sha, self.at, self.number = hashlib.sha1(), 0, 0
            self.want = self.head.get("warc-payload-digest", "").removeprefix("sha1:") or None
            self.kind, self.uri, self.refers_to = (self.head.get(k) for k in ("warc-type", "warc-target-uri", "warc-refers-to"))
            self.whole = self.segment == 1

    def _row(self, size: int, ends: bool) -> tuple:
        data = bytes(self.buffer[:size])
        del self.buffer[:size]
        self.sha.update(data)
        self.left -= size
        last = ends and ("warc-segment-number" not in self.head or "warc-segment-total-length" in self.head)
        digest = base64.b32encode(self.sha.digest()).decode() if self.whole else None
        intact = None if self.want is None or not last else self.kind == "revisit" or digest == self.want
        row = (self.file, self.origin.strip("<>"), self.kind, self.uri, self.refers_to and self.refers_to.strip("<>"), self.number, self.at, size, data if self.data else None, digest, self.want, last, intact)
        self.at, self.number = self.at + size, self.number + 1
        return row

    def close(self) -> Iterator[tuple]:
        """The end of the file: what there is of a torn record is its last row, and not intact."""
        if self.left is not None and not self.in_http:
            row = self._row(len(self.buffer), True)
            yield (*row[:-2], True, False)
        elif bytes(self.buffer).strip():
            raise ValueError(f"{self.file}: ends within a head")


TABLE = "file string, record_id string, type string, uri string, refers_to string, chunk int, offset long, size int, data binary, digest string, declared string, last boolean, intact boolean"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (*[pa.string()] * 5, pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in TABLE.split(", ")])


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += 512 + len(r[8] or b"")
        if size >= BATCH_BYTES:
            yield _batch(out)
            out, size = [], 0
    if out:
        yield _batch(out)


def read(spark: SparkSession, path: str, data: bool = True, chunk: int = CHUNK, whole: int = WHOLE) -> DataFrame:
    """The chunked record table of the WARC files in a folder, gzipped or not: a row for each chunk of a record's payload, warcinfo records left out.

    digest is the SHA-1 (base32) of the payload up to the chunk's end, declared the record's own statement; at the last
    chunk, intact tells whether they agree (null without a statement). A record without payload has one empty chunk. HTTP
    heads are not of the payload. Continuations that follow their record in the file go on with its numbers; one that
    stands alone is numbered from 0 and has no digest. A torn record ends with a last row that is not intact; what is no
    WARC record at all is an error. Without `data`, the column is null. Files of up to `whole` bytes are read by Spark;
    longer ones are streamed from file systems that pyarrow opens.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(BLOCK).cast("long"))).alias("start")
    short = files.where(F.col("length") <= whole).select(F.col("path").alias("file"), "content", start).select("file", F.expr(f"substring(content, cast(start as int) + 1, {BLOCK})").alias("block"))
    long = files.where(F.col("length") > whole).select(F.col("path").alias("file"))

    def rows(blocks: Iterator[tuple[str, bytes]]) -> Iterator[tuple]:
        now: Reader | None = None
        for file, block in blocks:
            if now is None or now.file != file:
                if now is not None:
                    yield from now.close()
                now = Reader(file, chunk, data)
            yield from now.feed(block)
        if now is not None:
            yield from now.close()

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows((f.as_py(), x.as_py()) for b in batches for f, x in zip(b["file"], b["block"], strict=True)))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        def blocks() -> Iterator[tuple[str, bytes]]:
            for file in (f for b in batches for f in b["file"].to_pylist()):
                system, inner = FileSystem.from_uri(file.replace("file:/", "file:///", 1) if file.startswith("file:/") and not file.startswith("file:///") else file)
                with system.open_input_stream(inner, compression=None) as f:
                    while block := f.read(BLOCK):
                        yield file, block

        yield from _batches(rows(blocks()))

    table = in_batches(short, blocks_of, TABLE)
    return table if long.isEmpty() else table.unionByName(in_batches(long.repartition("file"), streamed, TABLE))


def summaries(table: DataFrame) -> DataFrame:
    """(record_id, type, uri, refers_to, payload_bytes, payload_digest, intact) for each record of read(): both of the full payload, which a revisit has from its response. Where that isn't in the table, the bytes are null and the digest is the declared one."""
    ends = table.where("last").select("record_id", "type", "uri", "refers_to", (F.col("offset") + F.col("size")).alias("n_bytes"), "digest", "declared", "intact")
    again = F.col("type") == "revisit"
    told = F.when(again, F.col("declared")).otherwise(F.col("digest"))
    ends = cut(ends.withColumn("meant", F.concat_ws(" ", F.when(again, F.col("refers_to")).otherwise(F.col("record_id")), told)))
    # A response goes before whatever revisits it, and orphans have a row without bytes.
    named = cut(ends.groupBy("meant").agg(F.max(F.when(~again, F.col("n_bytes"))).alias("full"), F.count("*").alias("n")))
    return join_hot(ends, named, "meant").select("record_id", "type", "uri", "refers_to", F.when(again, F.col("full")).otherwise(F.col("n_bytes")).alias("payload_bytes"), told.alias("payload_digest"), "intact")


def archive(df: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least: int = 0) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to, intact) for each row of df, read back from the archives that write() makes of it in the shared folder.

    A null payload is empty, a null url is left out, and a null key stays null. Repeated rows stay repeated; an empty
    table gives none. Columns other than key, payload and url are not read.
    """
    spark, path = df.sparkSession, new_table(df.sparkSession)
    kind = df.select(key).schema[0].dataType.simpleString()
    write(deduplicated(df, key, payload, url, least), path)
    out = summaries(read(spark, path, data=False))
    return out.select(key_of(F.col("record_id"), kind).alias(key), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), key_of(F.col("refers_to"), kind).alias("refers_to"), "intact")


def archive_sql() -> str:
    """DuckDB SQL for the query's rows: base32 is worked out from five hexadecimal digits, which are four of its own."""
    digits = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    four = " || ".join(f"substr({digits}, ((v >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
    value = " + ".join(f"((instr('0123456789abcdef', substr(h, 5 * i + {k}, 1)) - 1) << {20 - 4 * k})" for k in range(1, 6))
    return f"""with p as (select page_id, coalesce(html, '') as x from pages),
    d as (select page_id, strlen(x)::bigint as payload_bytes, sha1(x) as h, min(page_id) over (partition by x) as least from p),
    b as (select *, array_to_string(list_transform(list_transform(range(8), lambda i: {value}), lambda v: {four}), '') as payload_digest from d)
    select page_id, payload_bytes, payload_digest, case when page_id is not distinct from least then 'response' else 'revisit' end as record_type,
    case when page_id is distinct from least then least end as refers_to, true as intact from b"""
