"""Git output as tables: commit logs, name-status and numstat lists, and their merge to per-file changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of the log format, and the largest patch kept.
RECORD, UNIT, MAX_PATCH = "\x1e", "\x1f", 5 << 20
FIELDS = ("commit_hash", "parent_hashes", "author_name", "author_email", "author_date", "committer_name", "committer_email", "committer_date", "message")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a log file whose records end with RS and whose fields are separated by US."""
    return parse_log(spark.read.option("lineSep", RECORD).text(path), "value")


def parse_log(records: DataFrame, column: str) -> DataFrame:
    """A row per log record, in order of fields; records with too few fields are left out."""
    parts = F.split(F.regexp_replace(F.col(column), r"^\n+", ""), UNIT, len(FIELDS))
    rows = records.select(parts.alias("f")).where(F.size("f") == len(FIELDS))
    out = rows.select(*[F.col("f")[i].alias(n) for i, n in enumerate(FIELDS)])
    return out.withColumns({"parent_hashes": F.filter(F.split("parent_hashes", " "), lambda p: p != ""), "author_date": F.try_to_timestamp("author_date"), "committer_date": F.try_to_timestamp("committer_date"), "message": F.rtrim(F.regexp_replace("message", r"\n+$", ""))})


def parent_edges(commits: DataFrame, known: DataFrame) -> DataFrame:
    """child, parent and ordinal of each parent that is among the known commits; others are skipped."""
    edges = commits.select(F.col("commit_hash").alias("child"), F.posexplode("parent_hashes").alias("ordinal", "parent"))
    return edges.join(known.select(F.col("commit_hash").alias("parent")), "parent", "left_semi").select("child", "parent", "ordinal")


def name_status(rows: DataFrame, column: str) -> DataFrame:
    """status and path from the NUL-separated output of a diff; unknown letters count as M."""
    parts = F.filter(F.split(F.col(column), "\x00"), lambda p: p != "")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("p") / 2) - 1), lambda i: F.struct(F.col("p")[i * 2].alias("status"), F.col("p")[i * 2 + 1].alias("path")))
    out = rows.select(parts.alias("p")).where(F.size("p") >= 2).select(F.explode(pairs).alias("x")).select("x.*")
    return out.withColumn("status", F.when(F.substring("status", 1, 1).isin("A", "M", "D"), F.substring("status", 1, 1)).otherwise("M"))


def merge_changes(status: DataFrame, numstat: DataFrame, patches: DataFrame) -> DataFrame:
    """Per commit and path: status (M where only counts are known), additions and deletions (0 if unknown), patch (null over 5 MB)."""
    keys = ["commit_hash", "path"]
    out = status.join(numstat, keys, "full").join(patches, keys, "left")
    kept = F.when(F.octet_length("patch") <= MAX_PATCH, F.col("patch"))
    return out.select(*keys, F.coalesce("status", F.lit("M")).alias("status"), F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"), kept.alias("patch"))


#: The letters of Git's escapes and the bytes that they stand for.
ESCAPES = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D", '"': "22", "\\": "5C"}


def unquote_path(path: Column) -> Column:
    """A path as Git quotes it, without the quotes; escapes, octal bytes among them, are read in one pass from the left."""
    parts = F.regexp_extract_all(F.regexp_extract(path, r'(?s)^"(.*)"$', 1), F.lit(r"(?s)\\[0-7]{3}|\\.|[^\\]+|\\"), F.lit(0))
    known = F.create_map(*[F.lit(x) for k, v in ESCAPES.items() for x in ("\\" + k, v)])
    one = lambda p: F.when(p.rlike(r"^\\[0-7]{3}$"), F.right(F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0"), F.lit(2))).otherwise(F.coalesce(F.try_element_at(known, p), F.hex(F.encode(p, "UTF-8"))))
    return F.when(path.rlike(r'(?s)^".*"$') & (F.length(path) > 1), F.decode(F.unhex(F.array_join(F.transform(parts, one), "")), "UTF-8")).otherwise(path)
