"""Changes to tables as new tables: Parquet has no rows to change in place, so each returns what to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Those of rows whose key the table lacks, one a key (ON CONFLICT DO NOTHING); nulls in keys never conflict."""
    return rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first of rows with a key, in order; a partial aggregate, so no group is sorted."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table with rows put in by key, the one greatest in order where several share one (ON CONFLICT DO UPDATE)."""
    new = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*table.columns))


def update(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """The table with values set where a condition is true."""
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column) -> DataFrame:
    """The table without the rows for which a condition is true."""
    return table.where(~F.coalesce(where, F.lit(False)))


def claim(jobs: DataFrame, job_id: int, worker: str, as_of: Column) -> DataFrame:
    """jobs with a queued job taken by a worker; a job in another state stays as it is."""
    return update(jobs, (F.col("job_id") == job_id) & (F.col("status") == "queued"), status=F.lit("running"), worker_id=F.lit(worker), started_at=as_of)


def finish(jobs: DataFrame, job_id: int, status: str, as_of: Column) -> DataFrame:
    """jobs with a running job completed or failed."""
    return update(jobs, (F.col("job_id") == job_id) & (F.col("status") == "running"), status=F.lit(status), finished_at=as_of)
