"""Commits into a large store in three phases: commits that are new, their edges to parents, their file changes. Each can run again.

A commit's id is a hash of its project and its own hash, so what is there already is found by keys alone. Before such a join the store's
keys pass a filter of the batch's keys: bitmaps of hashed keys, 4 KB a bucket, of which there are as many as the batch needs. So of a
large store only what may match is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap, and bits that each key of a batch gets: one key in so many of the others passes by chance.
BITS, BITS_A_KEY = 32_768, 16


def commit_id(project: Column, commit_hash: Column) -> Column:
    return F.sha2(F.concat_ws(":", project, commit_hash), 256)


def bitmaps(keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """bucket and bitmap of the hashed keys, a row for each bucket that has any."""
    place = F.pmod(F.xxhash64(key), F.lit(buckets * BITS))
    return keys.where(F.col(key).isNotNull()).groupBy(F.floor(place / BITS).cast("int").alias("__bucket")).agg(F.bitmap_construct_agg(place % BITS).alias("__bitmap"))


def may_be_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Those of rows whose key may be among keys (same column): all that are, and few others. Keys are read twice, rows once."""
    n = keys.count()
    buckets = max(1, -(-n * BITS_A_KEY // BITS))
    place = F.pmod(F.xxhash64(key), F.lit(buckets * BITS))
    byte = F.conv(F.hex(F.substring(F.col("__bitmap"), (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("__bit", (place % BITS).cast("int")).withColumn("__bucket", F.floor(place / BITS).cast("int")).join(bitmaps(keys, key, buckets), "__bucket")
    return held.where(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1).drop("__bit", "__bucket", "__bitmap")


def new_commits(batch: DataFrame, stored: DataFrame, key: str = "commit_hash") -> DataFrame:
    """The commits of a batch that the store lacks, one a key."""
    known = may_be_in(stored.select(key), key, batch.select(key))
    return batch.where(F.col(key).isNotNull()).dropDuplicates([key]).join(known, key, "left_anti")


def resolved_edges(new: DataFrame, stored: DataFrame, key: str = "commit_hash", parents: str = "parent_hashes") -> DataFrame:
    """key, parent and ordinal of each parent of new commits that the batch or else the store knows; unknown parents are skipped."""
    edges = new.select(key, F.posexplode(parents).alias("ordinal", "parent"))
    own = new.select(F.col(key).alias("parent"))
    outside = edges.select("parent").join(own, "parent", "left_anti").distinct()
    known = own.unionByName(may_be_in(stored.select(F.col(key).alias("parent")), "parent", outside)).distinct()
    return edges.join(known, "parent", "left_semi").select(key, "parent", "ordinal")


def ingest(store, project: str, log: DataFrame, changes: DataFrame) -> dict[str, int]:
    """Add commits (as git.parse_log gives them) and their file changes (as git.merge_changes does) to a store; returns how many rows each phase added.

    Commits come first, then edges, then changes, so that what is there is never without what it refers to; a phase that broke off adds
    what is missing when it runs again, and a second run adds nothing. Changes are those of commits of the log.
    """
    own = F.lit(project)
    mine = store.where("commits", project_id=project)
    fresh = new_commits(log, mine)
    fields = ("commit_hash", "author_name", "author_email", "author_date", "committer_name", "committer_email", "committer_date", "message")
    before = {t: store.count(t, project_id=project) for t in ("commits", "commit_parents", "commit_file_diffs")}
    store.insert("commits", fresh.select(commit_id(own, F.col("commit_hash")).alias("id"), own.alias("project_id"), *fields))
    edges = resolved_edges(log.where("commit_hash IS NOT NULL").dropDuplicates(["commit_hash"]), store.where("commits", project_id=project))
    edges = edges.select(own.alias("project_id"), commit_id(own, F.col("commit_hash")).alias("commit_id"), commit_id(own, F.col("parent")).alias("parent_commit_id"), "ordinal")
    store.insert("commit_parents", edges, ["project_id", "commit_id", "ordinal"])
    first = edges.where("ordinal = 0").select("commit_id", F.col("parent_commit_id").alias("__first"))
    of_log = changes.join(log.select("commit_hash").distinct(), "commit_hash", "left_semi").withColumn("commit_id", commit_id(own, F.col("commit_hash"))).join(first, "commit_id", "left")
    kind = F.when(F.col("status") == "A", "added").when(F.col("status") == "D", "deleted").otherwise("modified")
    rows = of_log.select(
        F.sha2(F.concat_ws(":", "commit_id", "path"), 256).alias("id"), own.alias("project_id"), "commit_id", F.col("__first").alias("parent_commit_id"), F.when(F.col("status") != "A", F.col("path")).alias("old_file_path"),
        F.when(F.col("status") != "D", F.col("path")).alias("new_file_path"), kind.alias("change_type"), "patch", "additions", "deletions",
    )
    store.insert("commit_file_diffs", rows, ["id"])
    return {t: store.count(t, project_id=project) - n for t, n in before.items()}
