"""Files, collections, ingest in batch and as a stream, chats."""

from __future__ import annotations

import io
import tracemalloc
import zipfile
import zlib
from concurrent.futures import ThreadPoolExecutor
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from sedra.operators.collection import SCHEMA, Collection, vectorized_status
from sedra.plans import chats
from sedra.plans.ingest import IngestConfig, ingest
from sedra.plans.search import Retriever
from sedra.sources import files, xlsx
from sedra.streaming.ingest import ingest_stream


def docx(paragraphs, cells=()) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr></w:tbl>" if cells else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{"".join(map(p, paragraphs))}{table}</w:body></w:document>')
    return out.getvalue()


def workbook(sheets, strings) -> bytes:
    """Sheets (file name, rows' XML) in the workbook's order, which is not that of their files' names."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="s{k}" sheetId="{k + 1}" r:id="r{k}"/>' for k in range(len(sheets))) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="{"/xl/" if k else ""}worksheets/{name}"/>' for k, (name, _) in enumerate(sheets)) + "</Relationships>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si>{s}</si>" for s in strings)}</sst>')
        for name, rows in sheets:
            z.writestr(f"xl/worksheets/{name}", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def pdf(*pages, packed=False) -> bytes:
    out = b"%PDF-1.4\n"
    for k, text in enumerate(pages):
        data = f"BT /F1 12 Tf 10 10 Td ({text}) Tj ET".encode("latin-1") if text else b"q Q BT ET"
        body = zlib.compress(data) if packed else data
        out += f"{k + 1} 0 obj << /Length {len(body)} {'/Filter /FlateDecode ' if packed else ''}>>\nstream\n".encode() + body + b"\nendstream\nendobj\n"
    return out + b"%%EOF"


@pytest.fixture
def folder(spark, tmp_path):
    at = f"file://{tmp_path}/landing"
    files.upload(spark, at, "a.DOCX", docx(["Hello there.", "Second paragraph."], ["c1", "c2"]))
    files.upload(spark, at, "b.txt", "Some plain text. More of it.".encode())
    files.upload(spark, at, "c.pdf", pdf("A page \\(one\\)", ""))
    files.upload(spark, at, "d.png", b"\x89PNG")
    files.upload(spark, at, "e.docx", b"broken")
    return at


def texts(df):
    return {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in df.collect()}


def test_listing_upload_delete(spark, folder):
    assert {r.name for r in files.list_files(spark, folder).collect()} == {"a.DOCX", "b.txt", "c.pdf", "d.png", "e.docx"}
    assert files.delete(spark, folder, "d.png") and not files.delete(spark, folder, "d.png")
    for bad in ("", None, "../x", "a/b", ".."):
        with pytest.raises(ValueError):
            files.upload(spark, folder, bad, b"")
    assert files.list_files(spark, f"{folder}/new").count() == 0
    table = files.file_table(files.scan(spark, folder)).collect()
    assert [r.id for r in table] == [1, 2, 3, 4] and [r.file_type for r in table] == ["docx", "txt", "pdf", "docx"]


def test_extract(spark, folder):
    got = texts(files.extract(files.scan(spark, folder)))
    assert got["a.DOCX"][0] == "Hello there.\nSecond paragraph.\nc1 c2 \n"
    assert got["b.txt"][0] == "Some plain text. More of it."
    assert got["c.pdf"][0].startswith("A page (one)\n")
    assert got["d.png"][0] is None and "unsupported" in got["d.png"][1] and got["e.docx"][0] is None
    read = files.extract(files.scan(spark, folder), pages_of=lambda content: ["", "text"], ocr=lambda content, k: f"seen {k}")
    assert texts(read)["c.pdf"][0] == "seen 0\ntext\n"


def test_workbook(spark, tmp_path):
    first = '<row r="1"><c r="A1" t="s"><v>1</v></c><c r="C1"><v>2.5</v></c></row><row r="2"/><row r="3"><c r="AB3" t="b"><v>1</v></c></row>'
    second = '<row><c t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c t="str"><f>A1</f><v>x\ty</v></c><c t="e"><v>#N/A</v></c><c/></row>'
    strings = ["<t>unused</t>", "<r><t>two </t></r><r><t>runs</t></r><rPh><t>reading</t></rPh>"]
    content = workbook([("sheet2.xml", first), ("sheet1.xml", second), ("sheet3.xml", "")], strings)
    want = "two runs\t\t2.5\n" + "\t" * 27 + "TRUE\n\ninline\tx y\t#N/A\t\n"
    assert xlsx.text_of(content) == want and xlsx.text_of(workbook([], [])) == ""
    folder = f"file://{tmp_path}/landing"
    files.upload(spark, folder, "a.XLSX", content)
    files.upload(spark, folder, "b.xlsx", content[:100])
    found = texts(files.extract(files.scan(spark, folder)))
    assert found["a.XLSX"] == (want, None) and found["b.xlsx"][0] is None and "error" in found["b.xlsx"][1]


def test_long_workbook_is_streamed():
    """A sheet of 300,000 rows takes the memory of its text, not of its tree."""
    rows = "".join(f'<row r="{k}"><c r="A{k}"><v>{k}</v></c><c r="B{k}" t="s"><v>0</v></c></row>' for k in range(1, 300_001))
    content = workbook([("sheet1.xml", rows)], ["<t>s</t>"])
    del rows
    tracemalloc.start()
    text = xlsx.text_of(content)
    assert text.count("\n") == 300_000 and text.startswith("1\ts\n2\ts\n") and tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_packed_pdf():
    assert [p.strip() for p in files._plain_pdf_pages(pdf("one", "two", packed=True))] == ["one", "two"]


def test_ingest_again_does_not_double(spark, folder, tmp_path):
    own = Collection(spark, f"file://{tmp_path}/store")
    first = {r.path.rsplit("/", 1)[1]: (r.n_chunks, r.error is None) for r in ingest(spark, folder, own, IngestConfig(40, 5)).collect()}
    n = own.stats().first().n
    assert first["a.DOCX"][0] > 0 and first["d.png"] == (0, False) and n > 0
    ingest(spark, folder, own, IngestConfig(40, 5))
    assert own.stats().first().n == n and own.rows().select("id").distinct().count() == n
    ingest(spark, folder, own, IngestConfig(40, 5), name="b.txt", replace=False)
    assert own.stats().first().n > n
    status = {r.name: r.vectorized for r in vectorized_status(files.list_files(spark, folder), own.rows()).collect()}
    assert status["a.DOCX"] and not status["d.png"]
    own.delete_sources(own.rows().select(F.col("metadata.source_file").alias("source_file")).where("source_file like '%b.txt'"))
    assert own.rows().where("metadata.file_name = 'b.txt'").count() == 0 and own.stats().first().n > 0
    found = Retriever.of(own).search(spark.createDataFrame([(1, "second paragraph")], "query_id long, query string"), n_final=1).first()
    assert "paragraph" in found.document
    with pytest.raises(FileNotFoundError):
        ingest(spark, folder, own, name="none.txt")
    with pytest.raises(ValueError):
        Collection(spark, f"file://{tmp_path}/store", embedder="other")
    with pytest.raises(ValueError):
        IngestConfig(method="none")


def test_emptied_and_broken_files_lose_their_rows(spark, folder, tmp_path):
    own = Collection(spark, f"file://{tmp_path}/store")
    ingest(spark, folder, own, IngestConfig(40, 5))
    names = lambda: {r[0] for r in own.rows().select("metadata.file_name").distinct().collect()}
    assert names() == {"a.DOCX", "b.txt", "c.pdf"}
    files.upload(spark, folder, "b.txt", b"")
    files.upload(spark, folder, "a.DOCX", b"broken now")
    report = {r.path.rsplit("/", 1)[1]: r.n_chunks for r in ingest(spark, folder, own, IngestConfig(40, 5)).collect()}
    assert names() == {"c.pdf"} and report["b.txt"] == report["a.DOCX"] == 0 and report["c.pdf"] > 0
    seen = ingest(spark, folder, own, IngestConfig(40, 5), "c.pdf", ocr=lambda content, k: "read by eye").first()
    assert seen.n_chunks == 1 and own.rows().where("document like '%read by eye%'").count() == 1


def test_collection_log(spark, tmp_path):
    """Writes leave earlier files alone, readers keep what they began with, writers at once both count, and compacting changes no row."""
    own = Collection(spark, f"file://{tmp_path}/store")
    row = lambda source, text: (f"{source}:{text}", [1.0], (source, source, 1, 1, "now"), text)
    table = lambda *rows: spark.createDataFrame([row(*r) for r in rows], "id string, embedding array<double>, metadata struct<source_file:string,file_name:string,length:int,token:int,created_at:string>, document string")
    gone = lambda *names: spark.createDataFrame([(n,) for n in names], "source_file string")
    held = lambda c: sorted(r.id for r in c.rows().collect())
    assert held(own) == []
    own.append(table(("a", "1"), ("b", "1"), (None, "1")))
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    before = own.rows()
    other = Collection(spark, f"file://{tmp_path}/store")
    own.replace_sources(table(("a", "2")), gone("a", None))
    other.append(table(("b", "2")))
    assert held(own) == held(other) == ["None:1", "a:2", "b:1", "b:2"] and sorted(r.id for r in before.collect()) == ["None:1", "a:1", "b:1"]
    assert all(p.stat().st_mtime_ns == t for p, t in stamps.items())
    now = own._newest()
    assert not own._create(now, {}) and own._newest() == now
    own.delete_sources(gone("b"))
    own.append(table(("b", "3")))
    want = held(own)
    assert want == ["None:1", "a:2", "b:3"]
    reader, folders = own.rows(), lambda: len([p for p in (tmp_path / "store" / "documents").iterdir() if p.is_dir()])
    own.compact()
    assert held(own) == held(other) == want and own.vacuum() == 0 and sorted(r.id for r in reader.collect()) == want
    other.append(table(("a", "4")))
    assert own.vacuum(0) > 0 and folders() == 2 and held(own) == held(other) == held(Collection(spark, f"file://{tmp_path}/store")) == sorted([*want, "a:4"])
    assert held(Collection(spark, name="of its own")) == []


def test_dead_writers_and_torn_manifests(spark, tmp_path):
    """What a writer leaves that dies before its manifest is in place counts for nothing; a manifest that can't be read is passed over."""
    own = Collection(spark, f"file://{tmp_path}/store")
    folder = tmp_path / "store" / "documents"
    one = own._write(spark.createDataFrame([("a", [1.0], None, "a")], SCHEMA))
    (folder / ".dead.tmp").write_text('{"embed')
    own._publish({"rows": one})
    for torn in ("", '{"embedder": "hash', "[]"):
        (folder / f"manifest-{own._newest() + 1:08d}.json").write_text(torn)
        assert own.rows().count() == Collection(spark, f"file://{tmp_path}/store").rows().count() == 1
    own.append(spark.createDataFrame([("b", [1.0], None, "b")], SCHEMA))
    assert own._newest() == 5 and own.rows().count() == 2
    own.compact()
    assert own.vacuum(0) and own.rows().count() == 2 and not (folder / ".dead.tmp").exists()
    for f in folder.glob("manifest-*"):
        f.write_text("")
    with pytest.raises(ValueError):
        Collection(spark, f"file://{tmp_path}/store")


def test_writers_at_once_all_land(spark, tmp_path):
    own = [Collection(spark, f"file://{tmp_path}/store") for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        steps = list(pool.map(lambda c: [c._publish({"rows": f"{c.path}/step-{uuid4().hex}"}) for _ in range(5)], own))
    assert sorted(sum(steps, [])) == list(range(1, 41)) and all(s == sorted(s) for s in steps)
    assert [e[0] for e in own[0]._entries(own[0]._log())] == list(range(1, 41))


def test_a_thousand_writes_cost_linear_bytes(spark, tmp_path):
    own = Collection(spark, f"file://{tmp_path}/store")
    size = {}
    for n in range(1, 1001):
        own._publish({"rows": f"{own.path}/step-{n:032x}"})
        if n in (250, 1000):
            size[n] = sum(p.stat().st_size for p in (tmp_path / "store" / "documents").glob("manifest-*"))
    log = own._log()
    assert [e[0] for e in own._entries(log)] == list(range(1, 1001)) and len(log) <= 11
    assert size[1000] < 5.5 * size[250] and size[1000] < 1000 * 1500  # about log n copies of an entry


def test_stream(spark, folder, tmp_path):
    own = Collection(spark, f"file://{tmp_path}/store")
    go = lambda: ingest_stream(spark, folder, own, f"file://{tmp_path}/progress", IngestConfig(40, 5)).awaitTermination()
    go()
    n = own.stats().first().n
    go()
    assert n > 0 and own.stats().first().n == n
    files.upload(spark, folder, "f.txt", b"Late text.")
    go()
    assert own.stats().first().n == n + 1


def test_chats(spark):
    own = spark.createDataFrame([(0, 0, "user", "Hi"), (0, 1, "assistant", "Yes"), (4, 0, "user", "Ho")], "conv_id long, turn long, role string, text string")
    opened = chats.start(own, spark.createDataFrame([("user", "New")], "role string, text string"))
    assert opened.where("conv_id = 5").count() == 1
    sent = chats.send(opened, spark.createDataFrame([(0, 2, "user", "b"), (0, 1, "user", "a"), (9, 1, "user", "lost")], "conv_id long, seq int, role string, text string"))
    assert [r.text for r in sent.where("conv_id = 0").orderBy("turn").collect()] == ["Hi", "Yes", "a", "b"] and sent.where("conv_id = 9").count() == 0
    named = chats.rename(chats.titles(sent), spark.createDataFrame([(4, "Named")], "conv_id long, title string"))
    assert {r.conv_id: r.title for r in named.collect()} == {0: "Hi", 4: "Named", 5: "New"}
    assert chats.delete(sent, spark.createDataFrame([(0,)], "conv_id long")).where("conv_id = 0").count() == 0
    assert chats.start(own.where("false"), spark.createDataFrame([("user", "x")], "role string, text string")).first().conv_id == 0


def test_every_toxic_source_is_deleted(spark, data):
    from sedra.queries import QUERIES

    source = {r.doc_id: r.source for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source").collect()}
    toxic = {source[r.doc_id] for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic = 1").collect() if r.doc_id in source}
    left = {r.source for r in QUERIES["delete_by_source"](spark, data).collect()}
    assert toxic and left == set(source.values()) - toxic
