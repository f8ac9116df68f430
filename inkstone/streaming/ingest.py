"""Continuous ingestion: files dropped into a folder are converted as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..sources import files as fs


def stream_files(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New files of a folder, as read_files has them; a trigger takes at most max_files."""
    return spark.readStream.schema(fs.FILES).format("binaryFile").option("maxFilesPerTrigger", max_files).load(folder)


def stream_text(spark: SparkSession, folder: str, convert: Callable[[Column], Column], out: str, checkpoint: str) -> StreamingQuery:
    """Text-like files to a Parquet table of path, text and status; runs until what is there has been taken."""
    rows = stream_files(spark, folder).withColumn("ext", fs.extension(F.col("path")))
    text = tx.normalize_newlines(tx.decode_lenient(F.col("content")))
    rows = rows.where(fs.is_text_like(F.col("ext"))).select("path", convert(text).alias("text"), F.lit("done").alias("status"))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
