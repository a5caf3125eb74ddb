"""Snapshots of a file tree: comparing them, carrying unchanged files forward, activating one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.text import null_if_empty


def classify(old: DataFrame, new: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """path and change: A, M, D or U (unchanged), by one full outer join on the path."""
    a, b = old.select(path, F.col(digest).alias("__old")), new.select(path, F.col(digest).alias("__new"))
    kind = F.when(F.col("__old").isNull(), "A").when(F.col("__new").isNull(), "D").when(F.col("__old") != F.col("__new"), "M").otherwise("U")
    return a.join(b, path, "full").select(path, kind.alias("change"))


def change_type(status: Column) -> Column:
    """added, modified or deleted; an unknown letter is a modification."""
    return F.when(status.startswith("A"), "added").when(status.startswith("D"), "deleted").otherwise("modified")


def carry_forward(rows: DataFrame, unchanged: DataFrame, snapshot: Column, path: str = "path", prefix: str = "id") -> DataFrame:
    """Rows of unchanged files under a new snapshot, with new ids made from it; old_id keeps the old one for remapping."""
    new_id = F.sha2(F.concat_ws(":", snapshot, F.col(prefix).cast("string")), 256)
    return rows.join(unchanged.select(path), path, "left_semi").withColumn("old_id", F.col(prefix)).withColumn(prefix, new_id).withColumn("snapshot_id", snapshot)


def remap(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows with old ids in a column exchanged for new ones (ids: old_id, new_id); unknown ones become null."""
    out = rows.join(ids, rows[column] == ids["old_id"], "left").withColumn(column, F.col("new_id"))
    return out.drop("old_id", "new_id")


def incremental_base(active_snapshot: str | None, same_version: bool, diff_ok: bool) -> str:
    """incremental, or full where there is no base to start from."""
    return "incremental" if active_snapshot and same_version and diff_ok else "full"


def activate(snapshots: DataFrame, snapshot_id: str, as_of: Column) -> DataFrame:
    """snapshots with one active per project and branch: snapshot_id takes over from the one before."""
    target = snapshots.where(F.col("snapshot_id") == snapshot_id).select(F.col("project_id").alias("__p"), F.col("branch").alias("__b")).limit(1)
    rows = snapshots.join(F.broadcast(target), (F.col("project_id") == F.col("__p")) & (F.col("branch") == F.col("__b")), "left")  # one row
    own = F.col("snapshot_id") == snapshot_id
    same = F.col("__p").isNotNull()
    return rows.select(*[{"is_active": F.when(same, own).otherwise(F.col("is_active")), "activated_at": F.when(own, as_of).otherwise(F.col("activated_at")), "status": F.when(own, "active").when(same & F.col("is_active"), "superseded").otherwise(F.col("status"))}.get(c, F.col(c)).alias(c) for c in snapshots.columns])


def write_pointer(spark: SparkSession, folder: str, project: str, branch: str, snapshot_id: str) -> None:
    """Point a branch at a snapshot: a file written aside and renamed, so readers see the old or the new one. One writer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{project}/{branch}.json")
    aside = jvm.org.apache.hadoop.fs.Path(f"{folder}/{project}/.{branch}.{uuid.uuid4().hex}")
    fs = at.getFileSystem(conf)
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps({"snapshot_id": snapshot_id}).encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(aside, at):
        raise OSError(f"cannot rename {aside} to {at}")


def read_pointer(spark: SparkSession, folder: str, project: str, branch: str) -> str:
    return json.loads(spark.read.text(f"{folder}/{project}/{branch}.json", wholetext=True).first()[0])["snapshot_id"]


def dedup_contents(files: DataFrame, content: str = "content", project: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """Contents stored once per project and hash, and files that refer to them by hash."""
    rows = files.withColumn("content_hash", F.sha2(content, 256))
    store = rows.groupBy(project, "content_hash").agg(F.first(content).alias(content))
    return store, rows.drop(content)


def optional(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with empty optional texts as null."""
    return rows.withColumns({c: null_if_empty(F.col(c)) for c in columns})
