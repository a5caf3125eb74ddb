"""Snapshots, jobs and latency: top-1 per project, job health, dashboard figures, stale and orphaned work.

Times are compared with an explicit as_of. Top-1 uses max_by over a struct, a partial aggregate that holds one row a key, rather
than a window that sorts each project's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("queued", "running")
#: Order of health states by severity.
SEVERITY = ("failed", "stale", "never", "indexing", "healthy")


def since(column: Column, as_of: Column, interval: str) -> Column:
    """Whether a time is at most interval (as SQL, e.g. '24 hours') before as_of."""
    return column >= as_of - F.expr(f"INTERVAL {interval}")


def latest(rows: DataFrame, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Per group, the columns keep of the row greatest in order; null orders lose, later columns break ties."""
    rank = F.struct(*[c for o in order for c in (F.col(o).isNotNull().alias(f"has_{o}"), F.col(o).alias(f"by_{o}"))])
    top = rows.groupBy(*by).agg(F.max_by(F.struct(*keep), rank).alias("top"))
    return top.select(*by, *[F.col(f"top.{k}").alias(k) for k in keep])


def latest_failure(jobs: DataFrame, project: str, key: str, status: str, finished: str) -> DataFrame:
    """Per project the latest failed job that no completed job finished after."""
    done = jobs.where(F.col(status) == "completed").groupBy(project).agg(F.max(finished).alias("__done"))
    failed = jobs.where(F.col(status) == "failed").join(done, project, "left").where(F.col("__done").isNull() | (F.col("__done") <= F.col(finished)))
    return latest(failed, [project], [finished, key], [key, finished])


def project_health(projects: DataFrame, snapshots: DataFrame, jobs: DataFrame) -> DataFrame:
    """project_id with its active snapshot, active job and unresolved failure.

    projects (project_id), snapshots (project_id, snapshot_id, is_active, activated_at), jobs (project_id, job_id, status,
    created_at, finished_at).
    """
    snap = latest(snapshots.where("is_active"), ["project_id"], ["activated_at", "snapshot_id"], ["snapshot_id", "activated_at"])
    active = latest(jobs.where(F.col("status").isin(*ACTIVE)), ["project_id"], ["created_at", "job_id"], ["job_id", "status"]).withColumnsRenamed({"job_id": "active_job_id", "status": "active_job_status"})
    failed = latest_failure(jobs, "project_id", "job_id", "status", "finished_at").withColumnsRenamed({"job_id": "failed_job_id", "finished_at": "failed_at"})
    out = projects.select("project_id").join(snap, "project_id", "left").join(active, "project_id", "left").join(failed, "project_id", "left")
    return out.withColumn("active_job_status", F.coalesce("active_job_status", F.lit("")))


def health_status(active_job: Column, failed_job: Column, activated_at: Column, as_of: Column, stale_after: str = "30 days") -> Column:
    """failed, indexing, never, stale or healthy."""
    return F.when(active_job.isNotNull(), "indexing").when(failed_job.isNotNull(), "failed").when(activated_at.isNull(), "never").when(~since(activated_at, as_of, stale_after), "stale").otherwise("healthy")


def severity(status: Column) -> Column:
    """Place of a health state, worst first."""
    out = F.lit(len(SEVERITY))
    for i, s in enumerate(SEVERITY):
        out = F.when(status == s, i).otherwise(out)
    return out


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with one rounding, by the exact errors of product and sum (Veltkamp, Dekker, Knuth)."""
    high = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    product, ha, hb = a * b, high(a), high(b)
    off = (a - ha) * (b - hb) - (((product - ha * hb) - (a - ha) * hb) - ha * (b - hb))
    total = product + c
    back = total - product
    return total + (((product - (total - back)) + (c - back)) + off)


def p95(rows: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """query_count and p95_latency_ms, the interpolated 95th percentile rounded half to even; 0 without rows.

    Interpolated as quantile_cont does, lo * (1 - d) + hi * d with the last product and the sum rounded once, so that values on a half
    round alike. Equal values are counted first; groups are ranked by a window, which spills, rather than held in a map.
    """
    counts = rows.groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    held = F.when(F.col("__v").isNull(), 0).otherwise(F.col("__n"))
    group = Window.partitionBy(*by)
    ranked = counts.withColumns({"__upto": F.sum(held).over(group.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)), "__at": (F.sum(held).over(group) - 1) * 0.95})
    first = lambda place: F.min(F.when(F.col("__upto") > place, F.col("__v")))
    out = ranked.groupBy(*by).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("query_count"), first(F.floor("__at")).alias("lo"), first(F.ceil("__at")).alias("hi"), F.first(F.col("__at") - F.floor("__at")).alias("d"))
    return out.select(*by, "query_count", F.rint(F.coalesce(_fused(F.col("lo"), 1 - F.col("d"), F.col("hi") * F.col("d")), F.lit(0.0))).cast("long").alias("p95_latency_ms"))


def stale_running(jobs: DataFrame, as_of: Column, status: str = "status", started: str = "started_at", after: str = "5 minutes") -> DataFrame:
    """Running jobs that started longer than `after` before as_of."""
    return jobs.where((F.col(status) == "running") & ~since(F.col(started), as_of, after))


def orphaned_snapshots(snapshots: DataFrame, jobs: DataFrame) -> DataFrame:
    """Snapshots still building that are not active and that no queued or running job works on."""
    busy = jobs.where(F.col("status").isin(*ACTIVE)).select("snapshot_id")
    return snapshots.where((F.col("status") == "building") & ~F.col("is_active")).join(busy, "snapshot_id", "left_anti")


def dead_workers(heartbeats: DataFrame, as_of: Column, worker: str = "worker_id", at: str = "ts", ttl: str = "30 seconds") -> DataFrame:
    """Workers whose last heartbeat is older than the time to live: worker, last_seen."""
    return heartbeats.groupBy(worker).agg(F.max(at).alias("last_seen")).where(~since(F.col("last_seen"), as_of, ttl))


def reap(jobs: DataFrame, heartbeats: DataFrame, as_of: Column) -> DataFrame:
    """jobs with stale running ones of dead or silent workers failed as of as_of."""
    alive = heartbeats.groupBy("worker_id").agg(F.max("ts").alias("__seen")).where(since(F.col("__seen"), as_of, "30 seconds")).select(F.col("worker_id").alias("__alive"))
    rows = jobs.join(alive, F.col("worker_id") == F.col("__alive"), "left")
    dead = (F.col("status") == "running") & ~since(F.col("started_at"), as_of, "5 minutes") & F.col("__alive").isNull()
    return rows.withColumn("finished_at", F.when(dead, as_of).otherwise(F.col("finished_at"))).withColumn("status", F.when(dead, "failed").otherwise(F.col("status"))).drop("__alive")
