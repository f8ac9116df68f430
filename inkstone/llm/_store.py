"""Shared-folder tables and skew-safe joins used by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured size stays below this; beyond it a shuffle join runs.
BROADCAST_BYTES = 64 << 20
#: A key is hot if it holds more than this share of the rows; so at most 1024 keys are hot.
HOT_SHARE = 1 / 1024
#: Spark's setting that removes the files of a query's shuffles when it has ended; else they stay until the driver collects garbage.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/inkstone/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors. Its shuffles' files go when it is written."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the files of a table of materialise that nothing reads any more."""
    spark = table.sparkSession
    for path in {x.rsplit("/", 1)[0] for x in table.inputFiles() if "/inkstone/" in x}:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """name, with underscores after it until no column of df begins with it."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name


def bound_arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches within 4000 rows and 16 MB, so that Python workers hold a few MB of text at a time; lower settings stay."""
    for name, most in (("maxRecordsPerBatch", 4000), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = str(spark.conf.get(key, None)).lower().rstrip("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """broadcast(df) if its measured size (rows * row_bytes) is within BROADCAST_BYTES, else df for a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def join_hot(big: DataFrame, small: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join of big with small on one key column, where small has unique keys and `weight`, the rows that big has of each key.

    Keys with more than HOT_SHARE of big's `total` rows (1024 at most, so a proven bound) are joined by broadcast
    and never shuffled; the others go through a shuffle join in which no key holds more than that share.
    Rows of big whose key is null find nothing. The key is kept once, `weight` is dropped.
    """
    limit = max(int(total * HOT_SHARE), 64)
    cols = [c for c in small.columns if c not in (key, weight)]
    hot = small.where(F.col(weight) > limit).select(F.col(key).alias("_hot_key"), *(F.col(c).alias(f"_hot_{c}") for c in cols))
    rest = small.where(F.col(weight) <= limit).drop(weight)
    tagged = big.join(F.broadcast(hot), big[key] == F.col("_hot_key"), "left")
    cold_key = F.when(F.col("_hot_key").isNull(), F.col(key))
    cold = tagged.withColumn("_cold_key", cold_key)
    keyed = cold.where(F.col("_cold_key").isNotNull())
    done = cold.where(F.col("_cold_key").isNull()).select(*big.columns, *(F.col(f"_hot_{c}").alias(c) for c in cols))
    joined = keyed.select(*big.columns).join(rest, key, "left").select(*big.columns, *cols)
    return done.unionByName(joined)


def two_level_rank(df: DataFrame, group: list[str], order: list[Column], buckets: Column, name: str) -> DataFrame:
    """A gapless rank from 0 within each group, without sorting a whole group in one task.

    `buckets` is an integer expression that splits a group into parts; parts are ranked on their own and shifted by the
    row counts of the parts before, which come from a small aggregate.
    """
    from pyspark.sql import Window

    split = df.withColumn("_part", buckets)
    sizes = split.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    local = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)) - 1
    ranked = split.withColumn("_local", local)
    return ranked.join(shifts, [*group, "_part"]).withColumn(name, (F.col("_shift") + F.col("_local")).cast("long")).drop("_part", "_shift", "_local")
