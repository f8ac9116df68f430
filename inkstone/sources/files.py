"""Files as rows: scans, type tests, pluggable PDF decoding, and one-file-per-row sinks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charsets as cs
from ..functions import text as tx

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, modificationTime, length, content; content is read only where it is used."""
    return spark.read.format("binaryFile").load(paths)


def read_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text): whole files, leniently decoded, with line feeds for any line ending."""
    return read_files(spark, paths).select("path", tx.normalize_newlines(tx.decode_lenient(F.col("content"))).alias("text"))


def inline_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("inline", text)], "path string, text string")


def missing_files(requested: DataFrame, present: DataFrame) -> DataFrame:
    """The requested paths that no scan found."""
    return requested.join(present.select("path"), "path", "left_anti")


# --- names and types -------------------------------------------------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def base_name(path: Column) -> Column:
    """What stands before the first dot of the name."""
    return F.regexp_extract(file_name(path), r"^([^.]*)", 1)


def extension(path: Column) -> Column:
    """What stands after the last dot, in lower case; '' without a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def is_office(ext: Column) -> Column:
    return ext.isin(*cs.OFFICE_EXTENSIONS)


def is_text(ext: Column) -> Column:
    return ext.isin(*cs.TEXT_EXTENSIONS)


def is_text_like(ext: Column) -> Column:
    """A text extension, or none."""
    return (ext == "") | is_text(ext)


def is_pdf_content(content: Column) -> Column:
    """`%PDF-` anywhere in the first 64 bytes."""
    return F.instr(F.decode(F.substring(content, 1, 64), "ISO-8859-1"), "%PDF-") > 0


def is_pdf_start(content: Column) -> Column:
    """The first five bytes are `%PDF-`."""
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")


def is_pdf_name(ext: Column) -> Column:
    return ext == "pdf"


def route(ext: Column) -> Column:
    return F.when(is_pdf_name(ext), F.lit("pdf")).when(is_office(ext), F.lit("office")).when(is_text_like(ext), F.lit("text")).otherwise(F.lit("unsupported"))


# --- PDF -------------------------------------------------------------------------------------------------------------


def decode_utf16le(data: bytes) -> str:
    """A decoder's UTF-16 page text; lone surrogates become U+FFFD, a terminator is dropped."""
    return data.decode("utf-16-le", "replace").removesuffix("\0")


def decode_pdfs(files: DataFrame, decoder: Callable[[bytes], list[str]], id_col: str = "path") -> DataFrame:
    """One row per page: id, page_no from 1, page_count, text, error. A document that fails gives one row with an error and no text."""
    source = files.select(F.col(id_col).alias("id"), "content")
    kind = source.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, content in frame.itertuples(index=False):
                try:
                    pages = decoder(bytes(content))
                    rows = [(doc, i + 1, len(pages), t, None) for i, t in enumerate(pages)]
                except Exception as e:  # noqa: BLE001  a decoder may fail in any way; the row says so
                    rows = [(doc, 0, 0, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["id", "page_no", "page_count", "text", "error"])

    return source.mapInPandas(run, f"id {kind}, page_no int, page_count int, text string, error string").withColumnRenamed("id", id_col)


# --- sinks -----------------------------------------------------------------------------------------------------------


def write_files(rows: DataFrame, path_col: str = "out_path", data_col: str = "data") -> DataFrame:
    """Write each row to a file of its own, by a temporary name that is renamed when complete; (path, status, message) per row.

    A path with a scheme (hdfs, s3, gs, file) goes to that file system, any other to a folder that all executors mount.
    """
    source = rows.select(F.col(path_col).alias("path"), F.col(data_col).cast("binary").alias("data"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = []
            for path, data in frame.itertuples(index=False):
                try:
                    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
                    part = f"{name}.part-{os.getpid()}"
                    store.create_dir(os.path.dirname(name), recursive=True)
                    with store.open_output_stream(part) as f:
                        f.write(bytes(data or b""))
                    store.move(part, name)
                    said.append((path, "done", None))
                except (OSError, pa.ArrowException) as e:
                    said.append((path, "write_error", getattr(e, "strerror", None) or str(e)))
            yield pd.DataFrame(said, columns=["path", "status", "message"])

    return source.mapInPandas(run, "path string, status string, message string")
