"""Reading text files: routing by extension, decoding, quarantine of bad input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed_values import TEXT_METADATA

# Accepted formats.
TEXT_EXTENSION = ".txt"
PDF_EXTENSION = ".pdf"
ASCII_SPACE = " \t\n\r\x0b\x0c"


# A file's content is one value of a row, which cannot hold more than 2 GB.
MAX_FILE_BYTES = 1 << 30


def read_files(spark: SparkSession, path: str, manifest: DataFrame | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """All files below a folder: ``path, file_name, content, size``.

    Files of more than ``max_bytes`` come without content: they are listed by
    length, and the limit on the length of those that are read is pushed into
    the scan, so an oversized file is never opened and reaches the quarantine.
    A scan leaves out files of length 0. With a ``manifest`` (``path, length``,
    a storage inventory) those listed there are added, so that they reach the
    quarantine too; without one they are not reported.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = every.where(F.col("length") <= max_bytes).select("path", "content", F.col("length").alias("size"))
    large = every.where(F.col("length") > max_bytes).select("path", F.lit(None).cast("binary").alias("content"), F.col("length").alias("size"))
    files = files.unionByName(large)
    if manifest is not None:
        empty = manifest.where(F.col("length") == 0).select("path").distinct()
        missing = empty.join(every.select("path"), "path", "left_anti")
        files = files.unionByName(missing.select("path", F.lit(b"").alias("content"), F.lit(0).cast("long").alias("size")))
    return with_file_name(files).select("path", "file_name", "content", "size")


def with_file_name(files: DataFrame) -> DataFrame:
    return files.withColumn("file_name", F.regexp_extract("path", r"([^/]*)$", 1))


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; leading dots of a name start no extension."""
    return F.regexp_extract(F.lower(name), r"^(?:.*/)?\.*[^./][^/]*?(\.[^./]*)$", 1)


def file_extension(file_name: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(extension(file_name), F.lit("")), extension(path))


def route(files: DataFrame) -> DataFrame:
    """Add ``extension`` and ``route``: text, pdf or unsupported."""
    kind = (
        F.when(F.col("extension") == TEXT_EXTENSION, "text")
        .when(F.col("extension") == PDF_EXTENSION, "pdf")
        .otherwise("unsupported")
    )
    return files.withColumn("extension", file_extension(F.col("file_name"), F.col("path"))).withColumn("route", kind)


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are valid UTF-8, else Latin-1. A byte-order mark stays."""
    as_utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(content, "ISO-8859-1"))


def without_large(files: DataFrame, max_bytes: int) -> DataFrame:
    """Files as ``read_files`` gives them, from a table that holds all contents."""
    size = F.length("content").cast("long")
    return files.withColumn("size", size).withColumn("content", F.when(F.col("size") <= max_bytes, F.col("content")))


def _error_code(sized: bool) -> Column:
    """The first thing wrong with a routed, decoded file; null if nothing is."""
    too_large = F.col("content").isNull() & (F.col("size") > 0) if sized else F.lit(False)
    return (
        F.when(F.col("route") == "unsupported", "UNSUPPORTED_FORMAT")
        .when(too_large, "FILE_TOO_LARGE")
        .when((F.col("route") == "pdf") & (F.length("content") == 0), "EMPTY_FILE")
        .when(F.col("route") == "pdf", F.lit(None).cast("string"))
        .when(F.btrim("text", F.lit(ASCII_SPACE)) == "", "EMPTY_FILE")
        .when(T.strip(F.col("text")) == "", "ONLY_WHITESPACE")
    )


def _error_message() -> Column:
    return (
        F.when(
            F.col("error_code") == "UNSUPPORTED_FORMAT",
            F.concat(F.lit("Unsupported file format '"), F.col("extension"), F.lit("': only .pdf and .txt are read.")),
        )
        .when(F.col("error_code") == "FILE_TOO_LARGE", F.lit("The file is too large to be read in one piece."))
        .when(F.col("error_code") == "EMPTY_FILE", F.lit("The file is empty (0 bytes of text)."))
        .otherwise(F.lit("The file contains only whitespace."))
    )


def _checked(files: DataFrame) -> DataFrame:
    decoded = route(files).withColumn("text", decode_text(F.coalesce("content", F.lit(b""))))
    return decoded.withColumn("error_code", _error_code("size" in files.columns))


def ingest_documents(files: DataFrame) -> DataFrame:
    """The readable text files as documents of one page."""
    good = _checked(files).where((F.col("route") == "text") & F.col("error_code").isNull())
    constants = [F.lit(x) for pair in TEXT_METADATA.items() for x in pair]
    return good.select(
        F.col("path").alias("doc_id"),
        "path",
        "file_name",
        F.lit("txt").alias("file_type"),
        F.col("text").alias("raw_text"),
        F.lit(1).cast("long").alias("page_count"),
        F.create_map(*constants).alias("metadata"),
        F.array().cast("array<string>").alias("warnings"),
    )


def text_pages(documents: DataFrame) -> DataFrame:
    """Ingested text files as page rows: a text file is one page."""
    return documents.select("doc_id", F.lit(1).cast("long").alias("page_number"), F.col("raw_text").alias("text"))


def ingest_errors(files: DataFrame) -> DataFrame:
    """Quarantine rows: a bad file never fails the job."""
    bad = _checked(files).where(F.col("error_code").isNotNull())
    return bad.select("path", "error_code", _error_message().alias("message"))


def pdf_files(files: DataFrame) -> DataFrame:
    """Files whose pages a PDF reader has to deliver as page rows."""
    checked = _checked(files)
    return checked.where((F.col("route") == "pdf") & F.col("error_code").isNull()).select("path", "file_name", "content")


# What a PDF reader can report about a document, as error codes.
PDF_STATUS_ERRORS = {
    "missing": "FILE_NOT_FOUND",
    "empty": "EMPTY_FILE",
    "corrupt": "CORRUPT_PDF",
    "encrypted": "ENCRYPTED_PDF",
    "no_pages": "NO_PAGES",
}


def pdf_errors(status: DataFrame) -> DataFrame:
    """Quarantine rows from a table ``path, status`` written by the PDF reader."""
    codes = F.create_map(*[F.lit(x) for pair in PDF_STATUS_ERRORS.items() for x in pair])
    bad = status.withColumn("error_code", codes[F.col("status")]).where(F.col("error_code").isNotNull())
    return bad.select(
        "path", "error_code", F.concat(F.lit("The PDF cannot be read: "), F.col("status"), F.lit(".")).alias("message")
    )


def blank_documents(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    """Documents without any text, which analysis rejects."""
    return docs.where(T.strip(F.coalesce(F.col(text), F.lit(""))) == "").select(
        "doc_id", F.lit("BLANK_TEXT").alias("error_code"), F.lit("No text could be extracted.").alias("message")
    )
