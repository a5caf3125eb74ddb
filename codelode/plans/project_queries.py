"""Projects, snapshots, jobs, access and latency. customer is projects, orders is jobs and snapshots, events is the query log.

Job status: F failed, O completed, P running (even keys) or queued (odd ones). Snapshots are the orders that cost over 100,000;
those of a completed order are active. As-of times are fixed, so results do not depend on when a query runs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import access, health
from codelode.plans.registry import query

AS_OF = "2001-08-01 00:00:00"
LOG_AS_OF = "2024-01-30 23:58:00"


def _as_of(text=AS_OF):
    return F.lit(text).cast("timestamp_ntz")


def _jobs(t):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderkey") % 2 == 0, "running").otherwise("queued")
    return t("orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("finished_at"))


def _snapshots(t):
    return t("orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("snapshot_id"), (F.col("o_orderstatus") == "O").alias("is_active"), F.col("o_orderdate").alias("activated_at"), F.when(F.col("o_orderstatus") == "P", "building").otherwise("ready").alias("status"))


_JOBS = "SELECT o_custkey AS project_id, o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'completed' WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'queued' END AS status, o_orderdate AS created_at, o_orderdate AS finished_at FROM orders"
_SNAPS = "SELECT o_custkey AS project_id, o_orderkey AS snapshot_id, o_orderstatus = 'O' AS is_active, o_orderdate AS activated_at, CASE WHEN o_orderstatus = 'P' THEN 'building' ELSE 'ready' END AS status FROM orders WHERE o_totalprice > 100000"
_LATEST = f"SELECT project_id, snapshot_id, activated_at FROM ({_SNAPS}) WHERE is_active QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY activated_at DESC NULLS LAST, snapshot_id DESC) = 1"
_ACTIVE = f"SELECT project_id, job_id, status FROM ({_JOBS}) WHERE status IN ('queued', 'running') QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) = 1"
_FAILED = f"SELECT project_id, job_id, finished_at FROM ({_JOBS}) j WHERE status = 'failed' AND NOT EXISTS (SELECT 1 FROM ({_JOBS}) k WHERE k.project_id = j.project_id AND k.status = 'completed' AND k.finished_at > j.finished_at) QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY finished_at DESC, job_id DESC) = 1"


@query(_LATEST)
def latest_snapshot_per_project(t):
    return health.latest(_snapshots(t).where("is_active"), ["project_id"], ["activated_at", "snapshot_id"], ["snapshot_id", "activated_at"])


@query(_ACTIVE)
def active_job_per_project(t):
    return health.latest(_jobs(t).where(F.col("status").isin(*health.ACTIVE)), ["project_id"], ["created_at", "job_id"], ["job_id", "status"])


@query(_FAILED)
def failed_job_no_later_success(t):
    return health.latest_failure(_jobs(t), "project_id", "job_id", "status", "finished_at")


def _health(t):
    return health.project_health(t("customer").select(F.col("c_custkey").alias("project_id")), _snapshots(t), _jobs(t))


_HEALTH = f"SELECT c_custkey AS project_id, s.snapshot_id, s.activated_at, a.job_id AS active_job_id, coalesce(a.status, '') AS active_job_status, f.job_id AS failed_job_id, f.finished_at AS failed_at FROM customer LEFT JOIN ({_LATEST}) s ON s.project_id = c_custkey LEFT JOIN ({_ACTIVE}) a ON a.project_id = c_custkey LEFT JOIN ({_FAILED}) f ON f.project_id = c_custkey"
_STATUS = f"SELECT project_id, CASE WHEN active_job_id IS NOT NULL THEN 'indexing' WHEN failed_job_id IS NOT NULL THEN 'failed' WHEN activated_at IS NULL THEN 'never' WHEN activated_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 'stale' ELSE 'healthy' END AS status FROM ({_HEALTH})"


@query(_HEALTH)
def project_health(t):
    return _health(t)


def _status(t):
    return _health(t).select("project_id", health.health_status(F.col("active_job_id"), F.col("failed_job_id"), F.col("activated_at"), _as_of()).alias("status"))


@query(f"SELECT status, count(*) AS projects FROM ({_STATUS}) GROUP BY status")
def health_status(t):
    return _status(t).groupBy("status").agg(F.count("*").alias("projects"))


@query(f"SELECT project_id, c_name AS name, status FROM ({_STATUS}) JOIN customer ON c_custkey = project_id ORDER BY CASE status WHEN 'failed' THEN 0 WHEN 'stale' THEN 1 WHEN 'never' THEN 2 WHEN 'indexing' THEN 3 ELSE 4 END, name, project_id LIMIT 100")
def health_sort(t):
    names = t("customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"))
    return _status(t).join(names, "project_id").orderBy(health.severity(F.col("status")), "name", "project_id").limit(100).select("project_id", "name", "status")


@query(f"SELECT count(*) FILTER (status IN ('queued', 'running')) AS active_jobs, count(*) FILTER (status = 'failed' AND finished_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS failed_24h, count(DISTINCT project_id) AS projects FROM ({_JOBS}) JOIN customer ON c_custkey = project_id WHERE c_nationkey = 7")
def dashboard_counts(t):
    mine = _jobs(t).join(t("customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("project_id")), "project_id")
    recent = (F.col("status") == "failed") & health.since(F.col("finished_at"), _as_of(), "24 hours")
    return mine.agg(F.count_if(F.col("status").isin(*health.ACTIVE)).alias("active_jobs"), F.count_if(recent).alias("failed_24h"), F.count_distinct("project_id").alias("projects"))


@query(f"SELECT count(*) AS query_count, CAST(round_even(coalesce(quantile_cont(value, 0.95), 0), 0) AS BIGINT) AS p95_latency_ms FROM events WHERE ts >= TIMESTAMP '{LOG_AS_OF}' - INTERVAL 24 HOUR")
def query_stats_p95(t):
    return health.p95(t("events").where(health.since(F.col("ts"), _as_of(LOG_AS_OF), "24 hours")), "value")


@query("SELECT user_id, count(*) AS query_count, CAST(round_even(coalesce(quantile_cont(value, 0.95), 0), 0) AS BIGINT) AS p95_latency_ms FROM events GROUP BY user_id")
def query_stats_by_project(t):
    return health.p95(t("events"), "value", ["user_id"])


@query(f"SELECT job_id, project_id FROM ({_JOBS}) WHERE status = 'running' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTE")
def stale_running(t):
    return health.stale_running(_jobs(t), _as_of()).select("job_id", "project_id")


@query(f"SELECT s.snapshot_id, s.project_id FROM ({_SNAPS}) s WHERE s.status = 'building' AND NOT s.is_active AND NOT EXISTS (SELECT 1 FROM ({_JOBS}) j WHERE j.job_id = s.snapshot_id AND j.status IN ('queued', 'running') AND j.job_id % 3 = 0)")
def orphaned_building(t):
    jobs = _jobs(t).where("job_id % 3 = 0").withColumn("snapshot_id", F.col("job_id"))
    return health.orphaned_snapshots(_snapshots(t), jobs).select("snapshot_id", "project_id")


@query("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 30 SECOND")
def heartbeat_dead(t):
    return health.dead_workers(t("events"), _as_of("2024-01-30 23:00:00"), "user_id")


@query("""SELECT u.s_suppkey AS user_id, u.s_name AS username, (SELECT count(*) FROM customer m WHERE m.c_nationkey = u.s_nationkey) AS project_count,
coalesce((SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) FROM orders WHERE o_custkey = u.s_suppkey), []) AS platform_roles FROM supplier u WHERE u.s_name ILIKE '%9%' ORDER BY username, user_id LIMIT 40""")
def user_list_admin(t):
    users = t("supplier").where(F.col("s_name").ilike("%9%")).select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("username"), "s_nationkey")
    members = users.select("user_id", "s_nationkey").join(t("customer"), F.col("s_nationkey") == F.col("c_nationkey")).select("user_id")
    roles = t("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("role"))
    return access.list_users(users.drop("s_nationkey"), members, roles).orderBy("username", "user_id").limit(40)


def _members(t):
    role = F.when(F.col("c_custkey") % 7 == 0, "owner").when(F.col("c_custkey") % 7 == 1, "admin").when(F.col("c_custkey") % 7 == 2, "guest").otherwise("member")
    return t("customer").select(F.col("c_nationkey").alias("user_id"), F.col("c_custkey").alias("project_id"), role.alias("role"))


def _keys(t):
    return t("supplier").select(
        F.col("s_suppkey").alias("api_key_id"), F.when(F.col("s_suppkey") % 2 == 0, "project").otherwise("personal").alias("key_type"), F.when(F.col("s_suppkey") % 5 == 0, "none").when(F.col("s_suppkey") % 3 == 0, "read").otherwise("write").alias("role"),
        (F.col("s_suppkey") % 11 != 0).alias("is_active"), F.when(F.col("s_suppkey") % 4 == 1, F.lit("1999-01-01").cast("timestamp_ntz")).alias("expires_at"), F.col("s_suppkey").alias("project_id"), F.col("s_nationkey").alias("created_by"),
    )


_MEMBERS = "SELECT c_nationkey AS user_id, c_custkey AS project_id, CASE c_custkey % 7 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' WHEN 2 THEN 'guest' ELSE 'member' END AS role FROM customer"
_KEYS = "SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS own, CASE WHEN s_suppkey % 5 = 0 THEN 0 WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END AS rank, s_suppkey % 11 <> 0 AS is_active, CASE WHEN s_suppkey % 4 = 1 THEN TIMESTAMP '1999-01-01' END AS expires_at, s_nationkey AS created_by FROM supplier"


@query(f"""WITH k AS (SELECT * FROM ({_KEYS}) WHERE is_active AND (expires_at IS NULL OR expires_at > TIMESTAMP '2000-01-01') AND rank > 0),
m AS (SELECT *, CASE role WHEN 'owner' THEN 2 WHEN 'admin' THEN 2 WHEN 'member' THEN 1 ELSE 0 END AS rank FROM ({_MEMBERS}))
SELECT id AS api_key_id, id AS project_id, CASE rank WHEN 2 THEN 'write' ELSE 'read' END AS effective_role FROM k WHERE own
UNION ALL SELECT k.id, m.project_id, CASE least(k.rank, m.rank) WHEN 2 THEN 'write' ELSE 'read' END FROM k JOIN m ON k.created_by = m.user_id WHERE NOT k.own AND m.rank > 0""")
def access_view(t):
    return access.key_access(_keys(t), _members(t), _as_of("2000-01-01"))


@query(f"SELECT project_id, CASE WHEN project_id % 50 = 0 THEN 'owner' WHEN role IN ('owner', 'admin', 'member') THEN role END AS effective_role, project_id % 50 = 0 OR role IN ('owner', 'admin') AS may_manage FROM ({_MEMBERS})")
def access_check(t):
    role = access.effective_role(F.col("project_id") % 50 == 0, F.col("role"))
    return _members(t).withColumn("effective_role", role).select("project_id", "effective_role", access.sufficient(F.col("effective_role"), "admin").alias("may_manage"))


@query("""WITH c AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 3 END AS project_id, s_suppkey % 3 <> 0 AS live, s_suppkey = 25 AS is_default FROM supplier)
SELECT c_custkey AS project_id, coalesce(o.id, g.id, d.id) AS config_id, CASE WHEN o.id IS NOT NULL THEN 'custom' WHEN g.id IS NOT NULL THEN 'selected' WHEN d.id IS NOT NULL THEN 'default' END AS origin
FROM customer LEFT JOIN (SELECT project_id, max(id) AS id FROM c WHERE live AND project_id IS NOT NULL GROUP BY 1) o ON o.project_id = c_custkey
LEFT JOIN (SELECT id FROM c WHERE live AND project_id IS NULL) g ON g.id = c_custkey % 200 CROSS JOIN (SELECT max(id) AS id FROM c WHERE live AND project_id IS NULL AND is_default) d""")
def provider_fallback(t):
    k = F.col("s_suppkey")
    configs = t("supplier").select(k.alias("config_id"), F.when(k % 2 == 0, k * 3).alias("project_id"), (k % 3 != 0).alias("is_active"), (k == 25).alias("is_default"))
    return access.resolve_provider(t("customer").select(F.col("c_custkey").alias("project_id"), (F.col("c_custkey") % 200).alias("selected_id")), configs)


@query("SELECT n_nationkey AS user_id, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS has_role FROM nation")
def platform_role_exists(t):
    held = t("supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("held", F.lit(True))
    return t("nation").join(held, "n_nationkey", "left").select(F.col("n_nationkey").alias("user_id"), F.coalesce("held", F.lit(False)).alias("has_role"))


@query(f"SELECT m.project_id, n_name AS username, m.role, r_name AS platform FROM ({_MEMBERS}) m JOIN nation ON n_nationkey = m.user_id JOIN region ON r_regionkey = n_regionkey WHERE m.role <> 'guest' AND r_name <> 'ASIA'")
def members_active(t):
    users = t("nation").join(t("region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return _members(t).where("role <> 'guest'").join(users, F.col("user_id") == F.col("n_nationkey")).select("project_id", F.col("n_name").alias("username"), "role", F.col("r_name").alias("platform"))


@query(f"SELECT project_id, role, CASE WHEN role IN ('owner', 'admin') THEN c_name END AS email FROM ({_MEMBERS}) JOIN customer ON c_custkey = project_id")
def masked_emails(t):
    from codelode.functions.text import masked_email

    names = t("customer").select(F.col("c_custkey").alias("project_id"), "c_name")
    return _members(t).join(names, "project_id").select("project_id", "role", masked_email(F.col("c_name"), F.col("role")).alias("email"))


@query(f"SELECT count(*) AS owners FROM ({_MEMBERS}) JOIN nation ON n_nationkey = user_id WHERE role = 'owner' AND n_regionkey = 1")
def count_project_owners(t):
    return _members(t).where("role = 'owner'").join(t("nation").where("n_regionkey = 1"), F.col("user_id") == F.col("n_nationkey")).agg(F.count("*").alias("owners"))


@query("SELECT event_type AS method, hour(ts) AS path, count(*) AS requests FROM events GROUP BY ALL")
def request_counts(t):
    return t("events").groupBy(F.col("event_type").alias("method"), F.hour("ts").cast("long").alias("path")).agg(F.count("*").alias("requests"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def recent_job_events(t):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return t("events").select("user_id", "event_id", place.alias("n")).where("n <= 20").drop("n")


@query(f"SELECT job_id, CASE WHEN status = 'queued' AND job_id = 101 THEN 'running' WHEN status = 'running' AND job_id = 102 THEN 'completed' ELSE status END AS status FROM ({_JOBS})")
def guarded_transitions(t):
    from codelode.operators import tables

    jobs = _jobs(t).withColumn("worker_id", F.lit(None).cast("string"))
    return tables.finish(tables.claim(jobs, 101, "w1", _as_of()), 102, "completed", _as_of()).select("job_id", "status")


@query(f"SELECT job_id, CASE WHEN status = 'running' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTE AND e.user_id IS NULL THEN 'failed' ELSE status END AS status FROM ({_JOBS}) LEFT JOIN (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '{LOG_AS_OF}' - INTERVAL 7 DAY) e ON e.user_id = project_id")
def reap_dead_jobs(t):
    from pyspark.sql import functions as G

    offset = G.expr(f"TIMESTAMP_NTZ '{AS_OF}' - TIMESTAMP_NTZ '{LOG_AS_OF}'")
    beats = t("events").select(F.col("user_id").alias("worker_id"), (F.col("ts") + offset + G.expr("INTERVAL 7 DAYS - INTERVAL 30 SECONDS")).alias("ts"))
    jobs = _jobs(t).withColumn("worker_id", F.col("project_id"))
    return health.reap(jobs, beats, _as_of()).select("job_id", "status")


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) AS n FROM events GROUP BY event_type")
def event_properties(t):
    k = F.from_json("props", "k long")["k"]
    return t("events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) INTERSECT SELECT doc_id FROM documents WHERE lang <> 'fr'")
def changed_on_disk(t):
    d = t("documents").select("doc_id", "lang")
    changed = d.where("doc_id % 3 = 0").select("doc_id").join(t("labels").where("quality = 0").select("doc_id"), "doc_id", "left_anti")
    return changed.intersect(d.where("lang <> 'fr'").select("doc_id"))
