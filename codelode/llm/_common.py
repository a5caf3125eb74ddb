"""What the corpus operators share: reading tables, cutting lineage, sizing partitions."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python slab holds at a time; numpy needs some 40 times as much beside it.
SLAB_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, of which tasks and their Python workers hold several, where the session has no bound of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under sf_dir, by Spark's own reader, so any store will do."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir), as a URI with its scheme.

    Where the setting is unset, a local session (one machine) gets a folder of its own; on a cluster that would be another folder on
    each machine, so it is an error there. clear() deletes what a session wrote.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", at := "file:///tmp/checkpoints/codelode")
    return f"{_own_dir(spark, at)}/{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession, at: str) -> str:
    """The session's folder; a path without scheme is one of the default file system, also for readers other than Spark's."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    whole = "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole
    return f"{whole.rstrip('/')}/codelode-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session; results that are not written yet need them."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark, at))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: what follows neither repeats its work nor depends on its executors."""
    spark = df.sparkSession
    small_batches(spark)
    at = shared_dir(spark)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes in a text column, for choosing numbers of blocks."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()["b"]


def parts(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def clean_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slabs(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slab's texts stay under limit bytes; a longer text is a slab of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        ends = np.cumsum(size)
        while at < len(size):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
