"""Folders on the file system that driver and executors share, and small files on it written in one go."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINTS = "spark.checkpoint.dir"


def _path(spark: SparkSession, at: str):
    return spark._jvm.org.apache.hadoop.fs.Path(at)


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local session, which is one machine, may leave that unset."""
    at = spark.conf.get(CHECKPOINTS, None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINTS} to a folder that driver and executors share")
        spark.conf.set(CHECKPOINTS, at := "file:///tmp/checkpoints/codelode")
    return f"{at.rstrip('/')}/codelode-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df as Parquet in a folder of its own, read again."""
    at = folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def exists(spark: SparkSession, at: str) -> bool:
    path = _path(spark, at)
    return _system(spark, path).exists(path)


def names(spark: SparkSession, at: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    path = _path(spark, at)
    fs = _system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def remove(spark: SparkSession, at: str) -> None:
    path = _path(spark, at)
    _system(spark, path).delete(path, True)


def write_json(spark: SparkSession, at: str, value: object) -> bool:
    """Write a file aside and rename it, so that readers see all of it or none. False if there is one of that name already."""
    path = _path(spark, at)
    fs, aside = _system(spark, path), _path(spark, f"{at.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    if fs.exists(path):
        return False
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    if fs.rename(aside, path):
        return True
    fs.delete(aside, False)
    return False


def read_json(spark: SparkSession, at: str):
    return json.loads(spark.read.text(at, wholetext=True).first()[0])
