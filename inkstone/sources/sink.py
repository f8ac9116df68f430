"""A file sink with a commit over the whole job: all files of a batch appear, or none does.

1. `stage_files` writes each row to a file with a name of its own in a staging folder, and then a log (path, staged name, size, SHA-256) as a
   Parquet table there. Spark commits that table task by task, so it names the files of the attempts that won; what failed or killed
   attempts left behind is in no log.
2. `commit_files` moves what the log names to its place, in parallel. A move that was done before is seen by the file that is there, so
   a commit that was cut short (a lost executor or driver) is simply called again and goes on.
3. `abort_files` removes the staging folder. Before the log is complete, nothing has been moved.
4. `read_back` reads files by the paths of a table, such as the result of a commit, in parallel.

Folders are shared by driver and executors: with a scheme (hdfs, s3, gs, file) on that file system, else a folder that all mount. Only names and
sizes go through the log; the driver handles no file.

Defined cases: of rows with the same path, the one with the greatest `order_col` is written (ties, or no such column: the greatest
SHA-256); null data is an empty file; rows with a null path are left out; an empty batch commits nothing; a path that can't be written gives its
row the status write_error, and the others are written all the same.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "path string, staged string, length long, sha256 string, ord {kind}"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path's name there."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _sha256(store: fs.FileSystem, name: str) -> str:
    digest = hashlib.sha256()
    with store.open_input_stream(name) as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def stage_files(rows: DataFrame, staging: str, path_col: str = "out_path", data_col: str = "data", order_col: str | None = None) -> None:
    """Write the rows' files and their log to the staging folder, which must not hold another batch."""
    order = F.col(f"`{order_col}`") if order_col else F.lit(0)
    source = rows.select(F.col(f"`{path_col}`").alias("path"), F.col(f"`{data_col}`").cast("binary").alias("data"), order.alias("ord")).where("path is not null")
    kind = source.schema["ord"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = file_system(staging)
        store.create_dir(f"{base}/data", recursive=True)
        for frame in frames:
            names, sizes, digests = [], [], []
            for data in frame["data"]:
                content = b"" if data is None else bytes(data)
                # a name of its own for each attempt: what another attempt of the task wrote is never touched
                names.append(uuid.uuid4().hex)
                with store.open_output_stream(f"{base}/data/{names[-1]}") as f:
                    f.write(content)
                sizes.append(len(content))
                digests.append(hashlib.sha256(content).hexdigest())
            yield pd.DataFrame({"path": frame["path"], "staged": names, "length": sizes, "sha256": digests, "ord": frame["ord"]})

    source.mapInPandas(run, LOG.format(kind=kind)).write.mode("error").parquet(f"{staging}/log")


def is_staged(staging: str) -> bool:
    """Whether the log of the batch is complete, so that it can be committed."""
    store, base = file_system(staging)
    return store.get_file_info(f"{base}/log/_SUCCESS").type == fs.FileType.File


def commit_files(spark: SparkSession, staging: str) -> DataFrame:
    """Move the batch's files to their places: (path, length, sha256, status, message) per path. May be called again after a failure."""
    if not is_staged(staging):
        raise ValueError(f"no complete batch in {staging}")
    chosen = spark.read.parquet(f"{staging}/log").groupBy("path").agg(F.max(F.struct("ord", "sha256", "staged", "length")).alias("x")).select("path", "x.staged", "x.length", "x.sha256")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = file_system(staging)
        for frame in frames:
            said = []
            for path, staged, length, sha256 in frame.itertuples(index=False):
                message = None
                try:
                    target, name = file_system(path)
                    target.create_dir(os.path.dirname(name), recursive=True)
                    here = f"{base}/data/{staged}"
                    if store.get_file_info(here).type == fs.FileType.File:
                        if target == store:
                            store.move(here, name)
                        else:
                            part = f"{name}.part-{uuid.uuid4().hex}"
                            fs.copy_files(here, part, source_filesystem=store, destination_filesystem=target)
                            target.move(part, name)
                            store.delete_file(here)
                    elif target.get_file_info(name).size != length or _sha256(target, name) != sha256:
                        # neither staged nor in place: somebody else took it
                        message = "staged file is missing"
                except (OSError, pa.ArrowException) as e:
                    message = getattr(e, "strerror", None) or str(e)
                said.append((path, length, sha256, "write_error" if message else "done", message))
            yield pd.DataFrame(said, columns=["path", "length", "sha256", "status", "message"])

    done = chosen.mapInPandas(run, "path string, length long, sha256 string, status string, message string")
    # written, so that the moves are made once and not each time that the result is looked at
    result = f"{staging}/result-{uuid.uuid4().hex}"
    done.write.parquet(result)
    return spark.read.parquet(result)


def read_back(files: DataFrame, path_col: str = "path") -> DataFrame:
    """files with what is at their paths now: found_length and found_sha256 (both null where no file is).

    Each file is read where its row is, so that no listing goes through the driver; empty files, which Spark's own scans leave out, have their row.
    """
    columns = files.columns
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in files.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lengths, digests = [], []
            for path in frame[path_col]:
                length = digest = None
                if path is not None:
                    store, name = file_system(path)
                    info = store.get_file_info(name)
                    if info.type == fs.FileType.File:
                        length, digest = info.size, _sha256(store, name)
                lengths.append(length)
                digests.append(digest)
            yield frame.assign(found_length=pd.array(lengths, "Int64"), found_sha256=digests)

    return files.mapInPandas(run, f"{kinds}, found_length long, found_sha256 string").select(*(F.col(f"`{c}`") for c in columns), "found_length", "found_sha256")


def abort_files(staging: str) -> None:
    """Remove the staging folder, with what any attempt left there."""
    store, base = file_system(staging)
    if store.get_file_info(base).type == fs.FileType.Directory:
        store.delete_dir(base)


def save_files(rows: DataFrame, staging: str, path_col: str = "out_path", data_col: str = "data", order_col: str | None = None) -> DataFrame:
    """Stage and commit; a batch that was staged there before is committed as it is, one that was left half staged is made anew."""
    if not is_staged(staging):
        abort_files(staging)
        stage_files(rows, staging, path_col, data_col, order_col)
    return commit_files(rows.sparkSession, staging)
