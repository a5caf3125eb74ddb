"""File trees as tables: listing, size and encoding rules, and text tables in Spark's own formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of this size or more are left out.
MAX_LISTED = 1 << 20


def read_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """file_path (below root), content and size of every text file under root that is smaller than 1 MiB.

    The size rule is pushed to the listing, so larger files are never opened; files that are no UTF-8 or hold a NUL are skipped.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).where(F.col("length") < MAX_LISTED)
    text = raw.where(F.is_valid_utf8(F.col("content").cast("string")) & (F.position(F.lit(b"\x00"), F.col("content")) == 0))
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + _quoted(root), "")
    return text.select(F.regexp_replace(below, "^/+", "").alias("file_path"), F.col("content").cast("string").alias("content"), F.col("length").alias("size"))


def _quoted(root: str) -> str:
    import re

    plain = re.sub("^[a-z0-9]+:/*", "/", root)
    return re.sub(r"([\\.+*?^${}()|\[\]])", r"\\\1", plain.rstrip("/"))


def source_files(files: DataFrame, size: str = "size", path: str = "file_path") -> DataFrame:
    """Listed files that are small enough, by path."""
    return files.where(F.col(size) < MAX_LISTED).orderBy(path)


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """Files with binary content as text; what is no UTF-8 or holds a NUL is left out."""
    return files.where(F.is_valid_utf8(F.col(content).cast("string")) & ~F.contains(F.col(content).cast("string"), F.lit("\0"))).withColumn(content, F.col(content).cast("string"))


def read_table(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """A table in any of Spark's formats."""
    return spark.read.format(kind).options(**options).load(path)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    """Write by directory, so that scans of one project and snapshot read nothing else; in overwrite mode only what df has."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
