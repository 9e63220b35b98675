import pytest
from pyspark.sql import functions as F

from lexiloom.sources import files, labelled, pages
from lexiloom.streaming.ingest import ingest_stream


@pytest.fixture
def folder(tmp_path):
    contents = {
        "a.txt": "Plain text.".encode(), "latin.TXT": "Café déjà".encode("latin-1"), "bom.txt": b"\xef\xbb\xbfhello",
        "zero.txt": b"", "ascii.txt": b" \n\t\x0b ", "nbsp.txt": "  ".encode(), "report.docx": b"binary",
        "noext": b"text", "scan.pdf": b"%PDF-1.7", "empty.pdf": b"",
    }
    deep = tmp_path / "in" / "deep"
    deep.mkdir(parents=True)
    for name, content in contents.items():
        (deep / name).write_bytes(content)
    return str(tmp_path / "in")


def test_files_become_documents_or_quarantine_rows(spark, folder):
    import os

    found = [(f"file:{root}/{n}", os.path.getsize(f"{root}/{n}")) for root, _, names in os.walk(folder) for n in names]
    read = files.read_files(spark, folder, spark.createDataFrame(found, "path string, length long"))
    assert files.read_files(spark, folder).where("length(content) = 0").count() == 0
    docs = {r.file_name: r for r in files.ingest_documents(read).collect()}
    assert {n: r.raw_text for n, r in docs.items()} == {
        "a.txt": "Plain text.", "latin.TXT": "Café déjà", "bom.txt": "﻿hello",
    }
    assert docs["a.txt"].page_count == 1 and docs["a.txt"].metadata == {"format": "Plain Text"} and docs["a.txt"].file_type == "txt"
    errors = {r.path.rsplit("/", 1)[1]: r for r in files.ingest_errors(read).collect()}
    assert {n: r.error_code for n, r in errors.items()} == {
        "zero.txt": "EMPTY_FILE", "ascii.txt": "EMPTY_FILE", "nbsp.txt": "ONLY_WHITESPACE", "report.docx": "UNSUPPORTED_FORMAT",
        "noext": "UNSUPPORTED_FORMAT", "empty.pdf": "EMPTY_FILE",
    }
    assert "Unsupported file format '.docx'" in errors["report.docx"].message and "empty" in errors["zero.txt"].message
    assert [r.file_name for r in files.pdf_files(read).collect()] == ["scan.pdf"]
    assert {(r.page_number, r.text) for r in files.text_pages(files.ingest_documents(read)).collect()} == {(1, d.raw_text) for d in docs.values()}


def test_oversized_files_become_quarantine_rows(spark, folder, tmp_path):
    (tmp_path / "in" / "huge.txt").write_bytes(b"x" * 5000)
    (tmp_path / "in" / "huge.pdf").write_bytes(b"x" * 5000)
    (tmp_path / "in" / "huge.bin").write_bytes(b"x" * 5000)
    old = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # Spark itself fails on a longer file
    try:
        read = files.read_files(spark, str(tmp_path / "in"), max_bytes=1000)
        errors = {r.path.rsplit("/", 1)[1]: r.error_code for r in files.ingest_errors(read).collect()}
        assert (errors["huge.txt"], errors["huge.pdf"], errors["huge.bin"]) == ("FILE_TOO_LARGE", "FILE_TOO_LARGE", "UNSUPPORTED_FORMAT")
        assert {r.file_name for r in files.ingest_documents(read).collect()} == {"a.txt", "latin.TXT", "bom.txt"}
        assert [r.file_name for r in files.pdf_files(read).collect()] == ["scan.pdf"]
        plan = files.read_files(spark, str(tmp_path / "in"), max_bytes=1000)._jdf.queryExecution().executedPlan().toString()
        assert "LessThanOrEqual(length,1000)" in plan
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", old)


def test_extension(spark):
    names = [("A.TXT", ".txt"), ("a.tar.gz", ".gz"), (".txt", ""), ("..txt", ""), ("x/.hid.pdf", ".pdf"), ("d.d/noext", ""), ("a.", ".")]
    rows = spark.createDataFrame(names, "name string, expected string")
    assert rows.where(files.extension(F.col("name")) != F.col("expected")).count() == 0
    by_path = spark.createDataFrame([("upload", "dir/b.txt")], "file_name string, path string")
    assert files.route(by_path).first().route == "text"


def test_pdf_status_and_blank_documents(spark):
    status = spark.createDataFrame([("a.pdf", "ok"), ("b.pdf", "encrypted"), ("c.pdf", "no_pages")], "path string, status string")
    assert {(r.path, r.error_code) for r in files.pdf_errors(status).collect()} == {("b.pdf", "ENCRYPTED_PDF"), ("c.pdf", "NO_PAGES")}
    docs = spark.createDataFrame([(1, "  "), (2, "x"), (3, None)], "doc_id long, raw_text string")
    assert sorted(r.doc_id for r in files.blank_documents(docs).collect()) == [1, 3]


def test_pages_are_joined(spark):
    many = spark.range(1, 302).select(F.lit(1).alias("doc_id"), F.col("id").alias("page_number"), F.concat(F.lit(" p"), "id").alias("text"))
    few = spark.createDataFrame([(2, 2, "tail "), (2, 1, " "), (2, 3, "end")], "doc_id int, page_number long, text string")
    about = spark.createDataFrame([(1, "Book", "")], "doc_id int, title string, author string")
    docs = {r.doc_id: r for r in pages.assemble_pages(many.unionByName(few), metadata=about).collect()}
    assert docs[1].page_count == 301 and docs[1].raw_text.startswith("p1\n\np2\n\np3") and docs[1].raw_text.endswith("p301")
    assert docs[1].warnings == ["Large document detected (301 pages): all pages are kept."]
    capped = pages.assemble_pages(many, page_cap=300).first()
    assert capped.raw_text.endswith("p300") and capped.warnings == ["Large document detected (301 pages): only pages up to 300 are kept."]
    assert pages.page_breakdown(many).count() == 301
    assert docs[1].metadata["title"] == "Book" and docs[1].metadata["author"] == "Unknown"
    assert docs[2].raw_text == "tail\n\nend" and docs[2].char_count == 7 and docs[2].page_count == 3
    assert len(docs[2].warnings) == 1 and "selectable text" in docs[2].warnings[0]
    assert docs[2].metadata["title"] == "Untitled" and docs[2].metadata["producer"] == ""
    listed = pages.page_breakdown(few).orderBy("page_number").collect()
    assert [(r.page_number, r.char_count) for r in listed] == [(1, 0), (2, 4), (3, 3)]


def test_labelled_csv(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text('category,text\nA,"long enough, ""quoted""\nsecond line"\nB,ten chars.\nB,  eleven chars \n,no category here\n')
    rows = {(r.category, r.text) for r in labelled.read_labelled_csv(spark, str(path)).collect()}
    assert rows == {("A", 'long enough, "quoted"\nsecond line'), ("B", "eleven chars")}
    path.write_text("label,text\nA,b\n")
    with pytest.raises(ValueError):
        labelled.read_labelled_csv(spark, str(path))
    with pytest.raises(Exception):
        labelled.read_labelled_csv(spark, str(tmp_path / "missing.csv"))


def test_stream_picks_up_new_files_once(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):
        ingest_stream(spark, folder, out).awaitTermination()
    assert spark.read.parquet(f"{out}/documents").count() == 3
    assert spark.read.parquet(f"{out}/ingest_errors").count() == 4
    (tmp_path / "in" / "deep" / "late.txt").write_text("Came later.")
    ingest_stream(spark, folder, out).awaitTermination()
    assert spark.read.parquet(f"{out}/documents").count() == 4
    stats = spark.read.parquet(f"{out}/document_statistics")
    assert stats.where(F.col("doc_id").endswith("late.txt")).first().word_count == 2
