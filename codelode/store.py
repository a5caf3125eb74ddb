"""The logical tables on Parquet: reads with declared schemas, and writes that readers never see half done.

Rows of a snapshot lie under their snapshot's directories; a change rewrites the directories of the snapshots concerned. Rows are
added as files of their own; a change to a table without snapshots replaces it: a new version is written aside, then a pointer file
names it. A snapshot is dropped from all tables at once: it is marked first, so that a clean-up that broke off is taken up again. One
writer at a time is assumed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from codelode.functions.predicates import page
from codelode.operators import scratch, snapshots, tables
from codelode.schema import BY_SNAPSHOT, schema

_SNAPSHOT = ("project_id", "index_snapshot_id")
#: The status of a snapshot that is being dropped.
DELETING = "deleting"


def _absent(e: AnalysisException) -> bool:
    """Whether an error says that a path is not there, which is all that an unwritten table means."""
    return e.getCondition() == "PATH_NOT_FOUND"


class Store:
    """Tables below a folder (any URI that Spark reads)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str) -> str | None:
        if name in BY_SNAPSHOT:
            return f"{self.root}/{name}"
        try:
            return f"{self.root}/{name}/{snapshots.read_pointer(self.spark, f'{self.root}/_current', name, 'version')}"
        except AnalysisException as e:
            if not _absent(e):
                raise
            return None

    def table(self, name: str) -> DataFrame:
        """A table; an empty one if nothing was written yet."""
        at = self._at(name)
        try:
            return self.spark.read.schema(schema(name)).parquet(at) if at else self.spark.createDataFrame([], schema(name))
        except AnalysisException as e:
            if not _absent(e):
                raise
            return self.spark.createDataFrame([], schema(name))

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with the table's columns, in order; missing ones are null."""
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])

    def replace(self, name: str, rows: DataFrame) -> None:
        """Make rows the whole table (not one of snapshots, whose rows are inserted, changed and deleted by snapshot)."""
        if name in BY_SNAPSHOT:
            raise ValueError(f"{name} is written by snapshot")
        version = uuid.uuid4().hex
        self._shaped(name, rows).write.parquet(f"{self.root}/{name}/{version}")
        snapshots.write_pointer(self.spark, f"{self.root}/_current", name, "version", version)

    def _write_snapshots(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_SNAPSHOT).parquet(f"{self.root}/{name}")

    def _here(self, own: list[tuple]) -> Column:
        here = F.lit(False)
        for project, snapshot in own:
            here = here | (F.col("project_id").eqNullSafe(project) & F.col("index_snapshot_id").eqNullSafe(snapshot))
        return here

    def insert(self, name: str, rows: DataFrame, keys: list[str] | None = None) -> None:
        """Add rows; with keys only those whose key is not there yet, one a key. Rows that are there stay."""
        rows = self._shaped(name, rows)
        if keys:
            have = self.table(name)
            if name in BY_SNAPSHOT and set(_SNAPSHOT) <= set(keys):
                have = have.where(self._here([tuple(r) for r in rows.select(*_SNAPSHOT).distinct().collect()]))  # few: a batch is of one or a few snapshots
            rows = tables.insert_missing(have, rows, keys)
        if name in BY_SNAPSHOT:
            rows.write.mode("append").partitionBy(*_SNAPSHOT).parquet(f"{self.root}/{name}")
        elif (at := self._at(name)) is None:
            self.replace(name, rows)
        else:
            rows.write.mode("append").parquet(at)

    def replace_snapshots(self, name: str, rows: DataFrame) -> None:
        """Make rows all that the snapshots which they name have in a table; other snapshots stay."""
        self._write_snapshots(name, self._shaped(name, rows))

    def drop_snapshot(self, project: str, snapshot: str) -> None:
        """Drop a snapshot: its rows in every table of artifacts, its jobs' link to it, then itself.

        It is marked as deleting first and its own row goes last, so that after a crash clean_up() finds and finishes it; every step can be
        done again.
        """
        own = (F.col("project_id") == project) & (F.col("id") == snapshot)
        self.update("index_snapshots", own, status=F.lit(DELETING), is_active=F.lit(False))
        for name in BY_SNAPSHOT:
            self._remove(*self._paths(name, project, snapshot))
        self.update("indexing_jobs", (F.col("project_id") == project) & (F.col("index_snapshot_id") == snapshot), index_snapshot_id=F.lit(None).cast("string"))
        self.delete("index_snapshots", own)

    def clean_up(self) -> list[tuple[str, str]]:
        """Finish the dropping of snapshots that are marked; returns which."""
        marked = [tuple(r) for r in self.where("index_snapshots", status=DELETING).select("project_id", "id").collect()]
        for project, snapshot in marked:
            self.drop_snapshot(project, snapshot)
        return marked

    def _change(self, name: str, touched: DataFrame, change) -> None:
        """Apply change to a table; of one of snapshots, to the snapshots of touched only, whose number is small."""
        if name not in BY_SNAPSHOT:
            self.replace(name, change(self.table(name)))
            return
        own = [tuple(r) for r in touched.select(*_SNAPSHOT).distinct().collect()]
        if not own:
            return
        aside = f"{self.root}/_aside/{uuid.uuid4().hex}"
        self._shaped(name, change(self.table(name).where(self._here(own)))).write.parquet(aside)
        rows = self.spark.read.schema(schema(name)).parquet(aside)
        left = {tuple(r) for r in rows.select(*_SNAPSHOT).distinct().collect()}
        self._write_snapshots(name, rows)
        for project, snapshot in own:  # dynamic overwriting leaves the directories that got no row
            if (project, snapshot) not in left:
                self._remove(*self._paths(name, project, snapshot))
        self._remove(aside)

    def _paths(self, name: str, project: str, snapshot: str) -> list[str]:
        if not scratch.exists(self.spark, f"{self.root}/{name}"):
            return []
        at = self.table(name).where(F.col("project_id").eqNullSafe(project) & F.col("index_snapshot_id").eqNullSafe(snapshot))
        return [r["d"] for r in at.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("d")).distinct().collect()]

    def _remove(self, *paths: str) -> None:
        for at in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI.create(at))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def upsert(self, name: str, rows: DataFrame, keys: list[str], order: str) -> None:
        rows = self._shaped(name, rows)
        if name in BY_SNAPSHOT:
            if not set(_SNAPSHOT) <= set(keys):
                raise ValueError(f"keys of {name} have {' and '.join(_SNAPSHOT)}")
        self._change(name, rows, lambda have: tables.upsert(have, rows, keys, order))

    def update(self, name: str, where: Column, **values: Column) -> None:
        if name in BY_SNAPSHOT and set(values) & set(_SNAPSHOT):
            raise ValueError("rows do not move between snapshots")
        self._change(name, self.table(name).where(where) if name in BY_SNAPSHOT else None, lambda have: tables.update(have, where, **values))

    def delete(self, name: str, where: Column) -> None:
        self._change(name, self.table(name).where(where) if name in BY_SNAPSHOT else None, lambda have: tables.delete(have, where))

    def where(self, name: str, **equal: object) -> DataFrame:
        """Rows by equality of columns; None means null, a list means any of its values."""
        rows = self.table(name)
        for c, v in equal.items():
            rows = rows.where(F.col(c).isNull() if v is None else F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v)
        return rows

    def get(self, name: str, **equal: object) -> dict | None:
        """One row by equality of columns, None if there is none."""
        row = self.where(name, **equal).limit(1).collect()
        return row[0].asDict(True) if row else None

    def listing(self, name: str, order: list[Column], limit: int | None = None, offset: int | None = None, most: int = 100, **equal: object) -> DataFrame:
        """A page of rows in order."""
        n, skip = page(limit, offset, 20, most)
        return self.where(name, **equal).orderBy(*order).offset(skip).limit(n)

    def count(self, name: str, **equal: object) -> int:
        return self.where(name, **equal).count()
