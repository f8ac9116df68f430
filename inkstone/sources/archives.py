"""Zip archives as a source: a row for each entry, read by ranges of the file.

The scan gives paths and lengths only. Each archive is dealt out in parts of SPLIT bytes; a task opens the file, reads the central directory at
its end, and then the entries that begin in its part. So no archive is ever a row or in memory as a whole, of any size, and a large one
is read by many tasks.
"""

from __future__ import annotations

import os
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charsets as cs

#: Bytes of an archive that one task reads.
SPLIT = 64 << 20
#: Bytes of entries that a task hands on at once.
_BATCH = 16 << 20
#: Bytes of an archive without entries.
_LEAST = 22
_SCHEMA = "path string, ord int, name string, is_dir boolean, size long, data binary, status string"


def _unsafe(name: str) -> bool:
    return not name or name.startswith("/") or "\0" in name or "\\" in name or "../" in name or "/.." in name


def _open(path: str):
    if re.match(r"\w+:/", path):
        store, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    else:
        store, name = fs.LocalFileSystem(), os.path.abspath(path)
    return store.open_input_file(name)


def _entries(path: str, part: int, split: int, most: int) -> Iterator[tuple]:
    """Rows of the entries that begin in a part of a file."""
    try:
        with _open(path) as file:
            if file.size() < _LEAST:
                raise zipfile.BadZipFile(path)
            z = zipfile.ZipFile(file)
            for i, info in enumerate(z.infolist()):
                name = info.filename.replace("\\", "/")
                if info.header_offset // split != part or _unsafe(name):
                    continue
                data, status = b"", "done"
                if info.file_size > most:
                    # told by the directory, before anything is read
                    status = "too_large"
                elif not info.is_dir():
                    try:
                        data = z.read(info)
                    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                        status = "unreadable"
                yield path, i, name, info.is_dir(), info.file_size, data, status
    except (zipfile.BadZipFile, EOFError):
        if part == 0:
            yield path, -1, None, False, 0, None, "no_archive"


def read_archives(spark: SparkSession, paths: str | list[str], split: int = SPLIT, most: int = cs.MAX_ENTRY_BYTES) -> DataFrame:
    """path, ord, name, is_dir, size, data and status (done, too_large, unreadable, no_archive) of the entries of zip archives.

    Unsafe names are left out; entries beyond `most` bytes and unreadable ones are rows without data; a file that is no archive is one row;
    the scan has no row for a file without bytes.
    Paths may lie in any file system that Spark lists and pyarrow opens.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    last = F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / split)
    parts = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part")).repartition("path", "part")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in _SCHEMA.split(", ")]
        for frame in frames:
            rows, held = [], 0
            for path, part in frame.itertuples(index=False):
                for row in _entries(path, part, split, most):
                    rows.append(row)
                    held += len(row[5] or b"")
                    if held > _BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return parts.mapInPandas(run, _SCHEMA)
