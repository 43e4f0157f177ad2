"""Token counts by a separator scan over flat, unindexed token files.

A file is token ids of fixed width, each document closed by an end-of-document id, and nothing else: no index, no header.
Blocks of a file are searched independently: a vectorised comparison finds the separators of a block, which gives the
tokens before the first and after the last, and the lengths between. A prefix scan over the slim block summaries then
stitches the boundaries: running sums give a block's offset and its first document's number, and a running maximum the
separator before it, however many blocks back. The scan is in two levels, so that one huge file is no single task's.
Blocks' payloads are never shuffled.

Documents become such files without a shuffle: a task writes its documents' tokens to flat files, and their keys, in the
same order, to files of fixed-width records beside them. Document and count meet by their place in the order alone.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedra.llm.shared import cut, exists, in_batches, new_table

WIDTH = 2  # bytes of an id
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 24  # of a flat file, but for a longer document
WHOLE = 1 << 28  # bytes up to which a file is read whole; beyond, by ranges
SUPER = 1024  # blocks that the lower level of the scan takes together
RUN = 1 << 12  # white space from which a run is cut out of the text
#: Fixed value: the pre-tokenisation pattern of the 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256  # the id that the 50k byte-level vocabulary leaves free

#: Fixed value: what the pattern takes for white space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LONG_RUN = re.compile(rf"[{WHITE}]{{{RUN},}}")

_encodings: dict[bytes, object] = {}


def encoding(ranks_file: bytes):
    """The tiktoken encoding of a rank file's content, kept while the worker lives."""
    import tiktoken

    if ranks_file not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        _encodings[ranks_file] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[ranks_file]


def encode(own, text: str | None) -> np.ndarray:
    """A text's token ids; null and empty give none.

    The pattern takes a run of white space but for its last character as one piece, by trying the whole run first, which
    fails where runs are very long. So long runs are cut out and handed over as the piece that they are.
    """
    parts, at = [], 0
    for run in _LONG_RUN.finditer(text or ""):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        parts += [own.encode_to_numpy(text[at : run.start()], disallowed_special=()), own._encode_single_piece(text[run.start() : stop].encode())]
        at = stop
    if text:
        parts.append(own.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate([np.empty(0, np.uint16), *parts]).astype(np.uint16)


def write_documents(df: DataFrame, ranks_file: bytes, path: str, end: int = END, file_tokens: int = FILE_TOKENS, text: str = "text", key: str = "doc_id") -> None:
    """The documents as flat token files `path/kind=tokens/file=N/part-*`, and `path/kind=keys/file=N/part-*` with their keys (whole numbers) as records of a byte that tells null, eight of the key, and a separator, in the same order.

    A null text is empty: a separator alone. Spark's own writer puts the files in place when a task is done, so a task
    that is lost or run twice leaves nothing behind. Nothing is shuffled; rows are sorted within a task, on disk if need be.
    """
    source = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("x"))
    shipped = df.sparkSession.sparkContext.broadcast(ranks_file)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(shipped.value)
        seq = size = file = 0
        for b in batches:
            kind, files, order, value = [], [], [], []
            for k, x in zip(b["k"].to_pylist(), b["x"], strict=True):
                ids = encode(own, x.as_py())
                if size and size + len(ids) >= file_tokens:
                    file, size = file + 1, 0
                kind += ["tokens", "keys"]
                files += [file, file]
                order += [seq, seq]
                value += [ids.astype("<u2").tobytes(), bytes([k is None]) + (k or 0).to_bytes(8, "little", signed=True)]
                size, seq = size + len(ids) + 1, seq + 1
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(files, pa.int32()), pa.array(order, pa.int64()), pa.array(value, pa.binary())], names=["kind", "file", "seq", "value"])

    rows = in_batches(source, run, "kind string, file int, seq long, value binary").sortWithinPartitions("kind", "file", "seq")
    write_flat_files(rows.select("kind", "file", "value"), path, "value", end, ["kind", "file"])


def _keys(blocks: DataFrame) -> DataFrame:
    """(file, doc_index, key) from blocks of write_documents()' key files, whole records each."""
    record = np.dtype([("null", "u1"), ("key", "<i8"), ("end", "<u2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, number, payload in zip(b["file"], b["block"], b["payload"], strict=True):
                rows = np.frombuffer(payload.as_py(), record)
                first = number.as_py() * BLOCK_TOKENS
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(rows), pa.string()), pa.array(np.arange(first, first + len(rows))), pa.array(np.ascontiguousarray(rows["key"]), pa.int64(), mask=rows["null"] == 1)], names=["file", "doc_index", "key"])

    return in_batches(blocks, run, "file string, doc_index long, key long")


_AT = r"kind=\w+/(file=\d+/part-\d+)"  # what a document file's name and its key file's have in common


def count_documents(df: DataFrame, ranks_file: bytes, end: int = END, block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, closed) for each row of df, counted in flat files in the shared folder that write_documents() makes of it.

    Keys must be whole numbers. Null and empty texts have no tokens; repeated rows stay repeated. An empty table gives
    none. Which file a document is in depends on df's partitions, and no result does. Other columns are not read.
    """
    spark = df.sparkSession
    path = new_table(spark)
    write_documents(df, ranks_file, path, end, file_tokens, text, key)
    read = lambda kind, width: flat_file_blocks(spark, f"{path}/kind={kind}", width, block_tokens if kind == "tokens" else BLOCK_TOKENS)
    if not exists(spark, f"{path}/kind=tokens"):
        return spark.createDataFrame([], "key long, n_tokens long, closed boolean").withColumnRenamed("key", key)
    place = F.regexp_extract("file", _AT, 1).alias("at")
    counts = count_tokens(read("tokens", WIDTH), end).select(place, "doc_index", "n_tokens", "closed")
    keys = _keys(read("keys", 9 + WIDTH)).select(place, "doc_index", F.col("key").alias(key))
    return keys.join(counts, ["at", "doc_index"]).select(key, "n_tokens", "closed")


def flat_file_blocks(spark: SparkSession, path: str, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS, whole: int = WHOLE) -> DataFrame:
    """(file, block, payload) of flat token files in a folder, in blocks of whole tokens; what is left of a torn token ends a file's last block.

    Files of up to `whole` bytes are read by Spark's binary reader, a file at a time. Longer ones are read by ranges, on
    a file system that pyarrow can open; so a file may have any size there.
    """
    step = width * block_tokens
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("start")
    number = (F.col("start") / step).cast("long").alias("block")
    cuts = files.where((F.col("length") > 0) & (F.col("length") <= whole)).select(F.col("path").alias("file"), "content", start)
    short = cuts.select("file", number, F.expr(f"substring(content, cast(start as int) + 1, {step})").alias("payload"))
    long = files.where(F.col("length") > whole).select("path", "length")
    if long.isEmpty():
        return short
    ranges = long.select("path", start).repartition("path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for b in batches:
            for file, start in zip(b["path"].to_pylist(), b["start"].to_pylist(), strict=True):
                system, inner = FileSystem.from_uri(file.replace("file:/", "file:///", 1) if file.startswith("file:/") and not file.startswith("file:///") else file)
                with system.open_input_file(inner) as f:
                    f.seek(start)
                    payload = f.read(step)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start // step], pa.int64()), pa.array([payload], pa.binary())], names=["file", "block", "payload"])

    return short.unionByName(in_batches(ranges, run, "file string, block long, payload binary"))


def write_flat_files(tokens: DataFrame, path: str, payload: str = "payload", end: int = END, by: Sequence[str] = ()) -> None:
    """Write rows of little-endian 16-bit ids (binary) as flat token files by Spark's own text writer, with the separator for a line end; in folders by the columns `by`, if there are any."""
    line = end.to_bytes(WIDTH, "little").decode("latin-1")
    tokens.select(*by, F.col(payload).cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", line).partitionBy(*by).text(path)


def scan_block(payload: bytes, end: int = END, width: int = WIDTH) -> tuple[int, np.ndarray]:
    """Whole tokens of a block, and the places of its separators."""
    ids = np.frombuffer(payload, f"<u{width}", len(payload) // width)
    return len(ids), np.flatnonzero(ids == end)


def _placed(slim: DataFrame) -> DataFrame:
    """slim (file, block, n, seps, last) with what is before each block: its offset, the separators so far, and the place after the last one. Runs of SUPER blocks are summed first, then scanned, then each is scanned within."""
    until = lambda *by: Window.partitionBy("file", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = slim.withColumn("super", F.floor(F.col("block") / SUPER))
    # The place of a run's last separator, from the run's begin; the offset within a run is known before the run's own.
    inner = runs.withColumn("in_offset", F.coalesce(F.sum("n").over(until("super", "block")), F.lit(0)))
    inner = inner.withColumn("in_seps", F.coalesce(F.sum("seps").over(until("super", "block")), F.lit(0))).withColumn("in_open", F.max(F.col("in_offset") + F.col("last")).over(until("super", "block")))
    outer = inner.groupBy("file", "super").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max(F.col("in_offset") + F.col("last")).alias("last"))
    outer = outer.withColumn("out_offset", F.coalesce(F.sum("n").over(until("super")), F.lit(0)))
    outer = outer.select("file", "super", "out_offset", F.coalesce(F.sum("seps").over(until("super")), F.lit(0)).alias("out_seps"), F.max(F.col("out_offset") + F.col("last")).over(until("super")).alias("out_open"))
    both = inner.join(outer, ["file", "super"])
    offset = (F.col("out_offset") + F.col("in_offset")).alias("offset")
    return both.select("file", "block", "n", "seps", "last", "torn", offset, (F.col("out_seps") + F.col("in_seps")).alias("index"), (F.coalesce(F.col("out_offset") + F.col("in_open"), "out_open", F.lit(-1)) + 1).alias("open"))


def count_tokens(blocks: DataFrame, end: int = END, width: int = WIDTH) -> DataFrame:
    """(file, doc_index, start, n_tokens, closed) for each document of the blocks' files (file, block, payload).

    n_tokens is without the separator; start is the offset of the first token in the file. What follows the last
    separator of a file is a document that is not closed, if it has tokens or part of one; a token that is torn is not
    counted. Files without blocks give no rows; two separators in a row close an empty document.
    """
    source = blocks.select("file", "block", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ends, torn = [], [], []
            for p in b["payload"]:
                own, places = scan_block(p.as_py(), end, width)
                n.append(own)
                ends.append(places)
                torn.append(len(p.as_py()) % width > 0)
            counts = np.array([len(e) for e in ends], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *ends]), pa.int64()))
            yield pa.RecordBatch.from_arrays([b["file"], b["block"], pa.array(n, pa.int64()), lists, pa.array(torn, pa.bool_())], names=["file", "block", "n", "ends", "torn"])

    scanned = cut(in_batches(source, run, "file string, block long, n long, ends array<long>, torn boolean"))
    placed = _placed(scanned.select("file", "block", "n", F.size("ends").cast("long").alias("seps"), F.array_max("ends").alias("last"), "torn"))
    docs = scanned.select("file", "block", "ends").join(placed.select("file", "block", "offset", "index", "open"), ["file", "block"]).select("file", "offset", "index", "open", "ends", F.posexplode("ends").alias("at", "stop"))
    start = F.when(F.col("at") == 0, F.col("open")).otherwise(F.col("offset") + F.get("ends", F.col("at") - 1) + 1)
    closed = docs.select("file", (F.col("index") + F.col("at")).alias("doc_index"), start.alias("start"), (F.col("offset") + F.col("stop") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    ends = placed.groupBy("file").agg(F.sum("n").alias("total"), F.sum("seps").alias("doc_index"), (F.coalesce(F.max(F.col("offset") + F.col("last")), F.lit(-1)) + 1).alias("start"), F.bool_or("torn").alias("torn"))
    tail = ends.where("total > start or torn").select("file", "doc_index", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail)
