"""Files of a folder on any file system that Spark reads: listing, upload, deletion, text extraction."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedra.sources import pdf, xlsx
from sedra.sources.numbering import numbered
from sedra.sources.shared import BATCH_BYTES, bound_batches

#: File types that are known, and of these the ones with text to extract.
KNOWN_TYPES = ("pdf", "docx", "xlsx", "png", "jpg", "jpeg", "txt", "other")
READABLE = ("pdf", "docx", "xlsx", "txt")

#: The table of uploaded files.
FILE_SCHEMA = "id long, name string, file string, file_type string, uploaded_at timestamp"

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def checked_name(name: str | None) -> str:
    """A file's name, refused if empty or if it could leave the folder."""
    if not name or not name.strip():
        raise ValueError("a file name is needed")
    if "/" in name or "\\" in name or name in (".", ".."):
        raise ValueError(f"not a plain file name: {name!r}")
    return name


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of a folder's regular files; content is read only where it is used.

    Spark's reader leaves out files without a byte, so those are added from the file system's own list.
    """
    fs, target = _fs(spark, folder)
    if not fs.exists(target):
        fs.mkdirs(target)
    rows = spark.read.format("binaryFile").load(folder)
    empty = [(str(s.getPath().toString()), s.getModificationTime()) for s in fs.listStatus(target) if s.isFile() and s.getLen() == 0 and not s.getPath().getName().startswith(("_", "."))]
    if not empty:
        return rows
    more = spark.createDataFrame(empty, "path string, at long").select("path", F.timestamp_millis("at").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    return rows.unionByName(more)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, url) of the regular files of a folder, which is made if it isn't there."""
    return scan(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("url"))


def upload(spark: SparkSession, folder: str, name: str, content: bytes) -> str:
    fs, _ = _fs(spark, folder)
    path = f"{folder.rstrip('/')}/{checked_name(name)}"
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def delete(spark: SparkSession, folder: str, name: str) -> bool:
    """False if there is no such file. Its rows in a collection are deleted by Collection.delete_sources()."""
    fs, target = _fs(spark, f"{folder.rstrip('/')}/{checked_name(name)}")
    return bool(fs.exists(target) and fs.delete(target, False))


def _docx(content: bytes) -> str:
    """Paragraphs outside tables, a line each; then each table's cells, a space after each, a newline after the table."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def of(paragraph) -> str:
        out = []
        for node in paragraph.iter():
            if node.tag == f"{_W}t":
                out.append(node.text or "")
            elif node.tag == f"{_W}tab":
                out.append("\t")
            elif node.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n")
        return "".join(out)

    lines = [of(p) + "\n" for p in body.findall(f"{_W}p")]
    for table in body.findall(f"{_W}tbl"):
        for row in table.findall(f"{_W}tr"):
            lines += ["\n".join(of(p) for p in cell.findall(f"{_W}p")) + " " for cell in row.findall(f"{_W}tc")]
        lines.append("\n")
    return "".join(lines)


_STREAM = re.compile(rb"<<(?P<dict>(?:[^<>]|<(?!<)|>(?!>)|<<[^<>]*>>)*)>>\s*stream\r?\n(?P<data>.*?)endstream", re.S)
_SHOWN = re.compile(rb"\((?P<text>(?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[(?P<array>(?:\((?:[^()\\]|\\.)*\)|[^\]])*)\]\s*TJ|(?P<line>T\*|T[dD]\b|\bET\b)", re.S)
_LITERAL = re.compile(rb"\(((?:[^()\\]|\\.)*)\)", re.S)
_PDF_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3})")


def _plain_pdf_pages(content: bytes) -> list[str]:
    """What the content streams of a PDF without a page tree show, a page a stream: Flate or plain streams, literal strings in Latin-1."""
    import zlib

    def literal(raw: bytes) -> str:
        named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        return _PDF_ESCAPE.sub(lambda m: named.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), raw).decode("latin-1")

    pages = []
    for m in _STREAM.finditer(content):
        data = m["data"]
        if b"/FlateDecode" in m["dict"]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        elif b"/Filter" in m["dict"]:
            continue
        if b"BT" not in data:
            continue
        shown = []
        for s in _SHOWN.finditer(data):
            if s["text"] is not None:
                shown.append(literal(s["text"]))
            elif s["array"] is not None:
                shown.append("".join(literal(x) for x in _LITERAL.findall(s["array"])))
            elif shown and not shown[-1].endswith("\n"):
                shown.append("\n")
        pages.append("".join(shown))
    return pages


def _pdf(content: bytes, pages_of: Callable[[bytes], list[str]] | None, ocr: Callable[[bytes, int], str] | None) -> str:
    """Each page's text and a newline; a blank page goes to `ocr`, if there is one."""
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    pages = pages_of(content) if pages_of else pdf.pages_of(content) or _plain_pdf_pages(content)
    return "".join((ocr(content, k) if ocr and not page.strip() else page) + "\n" for k, page in enumerate(pages))


def extract(files: DataFrame, pages_of: Callable[[bytes], list[str]] | None = None, ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """(path, file_type, text, error) for each row of scan(): text or the reason why there is none, never both.

    The type is the extension, lower-cased. `pages_of` is a PDF library's page reader in the place of
    sedra.sources.pdf. `ocr` reads page k of a PDF that has no text there.
    """
    bound_batches(files.sparkSession)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    # Only readable types are handed their content.
    typed = files.select("path", kind.alias("file_type"), F.when(kind.isin(*READABLE), F.col("content")).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, chars = [], 0
            for path, kind, content in zip(b["path"], b["file_type"], b["content"], strict=True):
                try:
                    if kind not in READABLE:
                        raise ValueError(f"unsupported file format: .{kind}")
                    text = {"pdf": lambda c: _pdf(c, pages_of, ocr), "docx": _docx, "xlsx": xlsx.text_of, "txt": lambda c: c.decode("utf-8", "replace")}[kind](bytes(content))
                    rows.append((path, kind, text, None))
                except Exception as e:
                    rows.append((path, kind, None, f"error extracting text from {path}: {e}"))
                chars += len(rows[-1][2] or "")
                if chars > BATCH_BYTES:  # a small file may hold a long text
                    yield pd.DataFrame(rows, columns=["path", "file_type", "text", "error"])
                    rows, chars = [], 0
            yield pd.DataFrame(rows, columns=["path", "file_type", "text", "error"])

    return typed.mapInPandas(run, "path string, file_type string, text string, error string")


def file_table(files: DataFrame, first_id: int = 1) -> DataFrame:
    """The table of uploaded files (FILE_SCHEMA) from scan(); types out of KNOWN_TYPES become `other`. Ids go by path, numbered by ranges of it."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    own = files.select("path", F.when(kind.isin(*KNOWN_TYPES), kind).otherwise("other").alias("file_type"), F.col("modificationTime").alias("uploaded_at"))
    return numbered(own, "path").select((F.col("number") + first_id).cast("long").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("file"), "file_type", "uploaded_at")
