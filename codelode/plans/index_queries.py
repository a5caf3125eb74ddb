"""Incremental maintenance and import resolution, over documents as a file tree in two versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codelode.functions import json as J
from codelode.operators import commit_ingest, ranges, resolve, snapshots, tables
from codelode.operators.constraints import Check, Reference, Unique, violations
from codelode.plans.registry import query


def _tree(t):
    d = t("documents").select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id")).alias("path"), F.sha2("text", 256).alias("hash"), "doc_id")
    old = d.where("doc_id % 11 <> 0").select("path", "hash", F.col("doc_id").alias("id"))
    new = d.where("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.sha2("path", 256)).otherwise(F.col("hash")).alias("hash"))
    return old, new


_CHANGE = "SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'A' WHEN doc_id % 7 = 0 THEN 'D' WHEN doc_id % 5 = 0 THEN 'M' ELSE 'U' END AS change FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 7 <> 0"


@query(_CHANGE)
def diff_classify(t):
    return snapshots.classify(*_tree(t))


@query(f"SELECT path, sha256('s2:' || regexp_extract(path, '[0-9]+$')) AS id, 's2' AS snapshot_id FROM ({_CHANGE}) WHERE change = 'U'")
def copy_forward(t):
    old, new = _tree(t)
    unchanged = snapshots.classify(old, new).where("change = 'U'")
    return snapshots.carry_forward(old, unchanged, F.lit("s2")).select("path", "id", "snapshot_id")


@query(f"SELECT path, 'symbol' || regexp_extract(path, '[0-9]+$') AS name, CASE WHEN (regexp_extract(path, '[0-9]+$')::BIGINT) % 5 <> 0 AND change = 'U' THEN sha256('s2:' || regexp_extract(path, '[0-9]+$')) END AS symbol_id FROM ({_CHANGE}) WHERE change IN ('U', 'M')")
def copy_forward_remap(t):
    old, new = _tree(t)
    change = snapshots.classify(old, new)
    ids = snapshots.carry_forward(old, change.where("change = 'U'"), F.lit("s2")).select("old_id", F.col("id").alias("new_id"))
    rows = old.join(change.where("change IN ('U', 'M')").select("path"), "path", "left_semi").select("path", F.concat(F.lit("symbol"), "id").alias("name"), F.col("id").alias("symbol_id"))
    return snapshots.remap(rows, ids, "symbol_id")


@query("SELECT o_orderkey AS snapshot_id, o_custkey AS project_id, CASE WHEN o_custkey = 1 THEN o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_custkey = 1) ELSE o_orderstatus = 'O' END AS is_active FROM orders")
def snapshot_activate(t):
    rows = t("orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("project_id"), F.lit("main").alias("branch"), (F.col("o_orderstatus") == "O").alias("is_active"), F.col("o_orderdate").alias("activated_at"), F.lit("ready").alias("status"))
    newest = rows.where("project_id = 1").agg(F.max("snapshot_id").alias("m")).first()["m"]
    return snapshots.activate(rows, newest, F.lit("2002-01-01").cast("timestamp_ntz")).select("snapshot_id", "project_id", "is_active")


@query("SELECT o_orderkey AS id, o_custkey AS project_id FROM orders")
def idempotent_insert(t):
    """What is there are the finished orders; the batch is all orders, twice."""
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), "o_orderstatus")
    have, batch = rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), rows.drop("o_orderstatus")
    return have.unionByName(tables.insert_missing(have, batch.unionByName(batch), ["id"]))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey BETWEEN 50 AND 99 THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders")
def upsert_rows(t):
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return tables.upsert(rows, rows.where("id BETWEEN 50 AND 99").withColumn("price", F.col("price") * 2), ["id"], "price")


@query("SELECT s_suppkey AS id, CASE WHEN s_nationkey = 3 THEN 'retired' ELSE 'active' END AS state FROM supplier WHERE s_acctbal >= 500")
def update_delete_rows(t):
    rows = t("supplier").select(F.col("s_suppkey").alias("id"), F.lit("active").alias("state"), "s_nationkey", "s_acctbal")
    return tables.delete(tables.update(rows, F.col("s_nationkey") == 3, state=F.lit("retired")), F.col("s_acctbal") < 500).select("id", "state")


_FILES = "SELECT DISTINCT 'src/m' || (p_partkey % 300) || CASE p_partkey % 4 WHEN 0 THEN '/index.ts' WHEN 1 THEN '.ts' WHEN 2 THEN '.d.ts' ELSE '.tsx' END AS path FROM part"


def _files(t):
    k = F.col("p_partkey")
    return t("part").select(F.concat(F.lit("src/m"), k % 300, F.when(k % 4 == 0, "/index.ts").when(k % 4 == 1, ".ts").when(k % 4 == 2, ".d.ts").otherwise(".tsx")).alias("path")).distinct()


@query(f"""WITH f AS ({_FILES}), i AS (SELECT l_orderkey, l_linenumber, count(*) AS n, 'src/m' || (min(l_partkey) % 330) AS target FROM lineitem GROUP BY 1, 2),
stem AS (SELECT regexp_replace(path, '\\.[^./]*$', '') AS key, path, path LIKE '%.d.ts' AS late FROM f UNION ALL SELECT regexp_replace(path, '\\.d\\.ts$', ''), path, true FROM f WHERE path LIKE '%.d.ts'),
st AS (SELECT key, arg_min(path, (late, path)) AS path FROM stem GROUP BY key), ix AS (SELECT regexp_replace(path, '/index.ts$', '') AS key, path FROM f WHERE path LIKE '%/index.ts')
SELECT l_orderkey, l_linenumber, coalesce(st.path, ix.path, target) AS target_file_path FROM i LEFT JOIN st ON st.key = target LEFT JOIN ix ON ix.key = target""")
def import_resolve(t):
    i = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.concat(F.lit("src/m"), F.min("l_partkey") % 330).alias("target_file_path"))
    rows = i.select("*", F.lit("typescript").alias("language"), F.lit("./x").alias("import_name"), F.lit("INTERNAL").alias("import_type"))
    return resolve.resolve_imports(rows, _files(t)).select("l_orderkey", "l_linenumber", "target_file_path")


def _imports(t):
    """The first import of each type and name, in the order of lines."""
    kind = F.when(F.col("l_returnflag") == "A", "INTERNAL").when(F.col("l_returnflag") == "N", "STDLIB").otherwise("EXTERNAL")
    rows = t("lineitem").select(kind.alias("import_type"), F.concat(F.lit("pkg"), F.col("l_partkey") % 40).alias("name"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return tables.first_wins(rows, ["import_type", "name"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"])


@query("SELECT import_type, name FROM (SELECT DISTINCT CASE WHEN l_returnflag = 'A' THEN 'INTERNAL' WHEN l_returnflag = 'N' THEN 'STDLIB' ELSE 'EXTERNAL' END AS import_type, 'pkg' || (l_partkey % 40) AS name FROM lineitem)")
def import_dedup(t):
    return _imports(t).select("import_type", "name")


@query("""SELECT import_type, name, l_orderkey, l_linenumber, l_suppkey FROM (SELECT CASE WHEN l_returnflag = 'A' THEN 'INTERNAL' WHEN l_returnflag = 'N' THEN 'STDLIB' ELSE 'EXTERNAL' END AS import_type, 'pkg' || (l_partkey % 40) AS name, l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY import_type, name ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey) = 1""")
def first_wins_dedup(t):
    return _imports(t).select("import_type", "name", "l_orderkey", "l_linenumber", "l_suppkey")


_SPANS = "SELECT p_partkey AS symbol_id, p_brand AS file, p_size AS start_line, p_size + (p_partkey % 17) AS end_line, p_partkey AS ordinal, p_type AS kind FROM part"


def _spans(t):
    k = F.col("p_partkey")
    return t("part").select(k.alias("symbol_id"), F.col("p_brand").alias("file"), F.col("p_size").alias("start_line"), (F.col("p_size") + k % 17).alias("end_line"), k.alias("ordinal"), F.col("p_type").alias("kind"))


def _points(t):
    refs = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.concat(F.lit("Brand#"), F.min("l_suppkey") % 25 + 1).alias("file"), F.min("l_quantity").cast("int").alias("line"))
    return refs.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), "file", "line")


@query(f"""WITH s AS ({_SPANS}), r AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, 'Brand#' || (min(l_suppkey) % 25 + 1) AS file, min(l_quantity)::INT AS line FROM lineitem GROUP BY 1, l_orderkey, l_linenumber)
SELECT r.ref_id, (SELECT arg_min(s.symbol_id, (s.end_line - s.start_line, s.ordinal)) FROM s WHERE s.file = r.file AND r.line BETWEEN s.start_line AND s.end_line) AS symbol_id FROM r""")
def symbol_enclosing_range_join(t):
    return resolve.enclosing_symbol(_points(t), _spans(t)).select("ref_id", "symbol_id")


@query(f"""WITH s AS ({_SPANS}), r AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, 'Brand#' || (min(l_suppkey) % 25 + 1) AS file, min(l_quantity)::INT AS line FROM lineitem GROUP BY 1, l_orderkey, l_linenumber)
SELECT r.ref_id, EXISTS (SELECT 1 FROM s WHERE s.file = r.file AND s.kind = 'PROMO' AND r.line BETWEEN s.start_line AND s.end_line) AS inside FROM r""")
def inside_any_class(t):
    points, classes = _points(t), _spans(t).where("kind = 'PROMO'")
    return ranges.marked(points, classes, ["file"], "line", "start_line", "end_line", "inside").select("ref_id", "inside")


@query("SELECT o_orderkey AS commit_hash, CASE o_orderstatus WHEN 'F' THEN 'deleted' WHEN 'O' THEN 'added' ELSE 'modified' END AS change_type FROM orders")
def change_types(t):
    letter = F.when(F.col("o_orderstatus") == "F", "D").when(F.col("o_orderstatus") == "O", "A").otherwise("R100")
    return t("orders").select(F.col("o_orderkey").alias("commit_hash"), snapshots.change_type(letter).alias("change_type"))


@query("SELECT coalesce(a.k, b.k) AS commit_hash, coalesce(a.status, 'M') AS status, coalesce(b.additions, 0) AS additions, coalesce(b.deletions, 0) AS deletions FROM (SELECT o_orderkey AS k, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT l_orderkey AS k, sum(l_quantity)::BIGINT AS additions, sum(l_linenumber)::BIGINT AS deletions FROM lineitem GROUP BY 1) b ON a.k = b.k")
def diff_stat_merge(t):
    from codelode.sources.git import merge_changes

    status = t("orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("commit_hash"), F.lit("p").alias("path"), F.col("o_orderstatus").alias("status"))
    numstat = t("lineitem").groupBy(F.col("l_orderkey").alias("commit_hash")).agg(F.sum("l_quantity").cast("long").alias("additions"), F.sum("l_linenumber").alias("deletions")).withColumn("path", F.lit("p"))
    patches = numstat.select("commit_hash", "path", F.lit("diff").alias("patch"))
    return merge_changes(status, numstat, patches).select("commit_hash", "status", "additions", "deletions")


@query("""SELECT event_id, user_id AS to_user FROM events e WHERE event_type = 'signup' UNION ALL
SELECT e.event_id, m.c_custkey FROM events e JOIN customer m ON m.c_nationkey = e.user_id % 25 WHERE e.event_type <> 'signup'""")
def event_route(t):
    """Every event: signups go to their user, all others to the members of their project."""
    from codelode.streaming import events as E

    known = F.create_map(*[F.lit(x) for x in ("signup", "member:added", "view", "job:queued", "click", "job:started", "purchase", "job:completed", "error", "job:failed")])
    kind = F.when(F.col("event_type").isNotNull(), F.coalesce(known[F.col("event_type")], F.lit("job:progress")))
    body = F.struct(kind.alias("event"), (F.col("user_id") % 25).cast("string").alias("project_id"), F.col("event_id").cast("string").alias("job_id"), F.struct(F.col("user_id").cast("string").alias("user_id")).alias("data"))
    parsed = E.parse_events(t("events").select(F.to_json(body).alias("value"))).withColumn("event_id", F.col("job_id").cast("long"))
    members = t("customer").select(F.col("c_nationkey").cast("string").alias("project_id"), F.col("c_custkey").alias("user_id"))
    return E.route(parsed, members, ["event_id"]).select("event_id", "to_user")


@query("""SELECT user_id AS job_id, arg_max(status, (rank, -event_id)) AS status, -max((rank, -event_id))[2] AS seq FROM (SELECT *, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS rank FROM events) GROUP BY user_id""")
def job_state_fold(t):
    from codelode.streaming import events as E

    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    return E.job_states(t("events").select(F.col("user_id").alias("job_id"), status.alias("status"), F.col("event_id").alias("seq")))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(t):
    from codelode.streaming import events as E

    return E.windowed_counts(t("events"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(t):
    from codelode.streaming import events as E

    return E.sessions(t("events"))


_COMMITS = """WITH c AS (SELECT o_orderkey AS commit_hash, o_orderdate AS day, lag(o_orderkey) OVER w AS p1, lag(o_orderkey, 2) OVER w AS p2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
stored AS (SELECT * FROM c WHERE day < '1999-01-01' AND day >= '1996-01-01'), batch AS (SELECT * FROM c WHERE day >= '1998-01-01'), new AS (SELECT * FROM batch WHERE commit_hash NOT IN (SELECT commit_hash FROM stored))"""


def _commits(t):
    """Orders as commits, whose parents are the two orders before of the customer; what is stored, and a batch that overlaps it."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    parents = F.array_compact(F.array(F.lag("o_orderkey").over(w), F.lag("o_orderkey", 2).over(w)))
    rows = t("orders").select(F.col("o_orderkey").alias("commit_hash"), F.col("o_orderdate").alias("day"), parents.alias("parent_hashes"))
    return rows.where("day < '1999-01-01' AND day >= '1996-01-01'"), rows.where("day >= '1998-01-01'")


@query(f"{_COMMITS} SELECT commit_hash, (p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT AS parents FROM new")
def commit_ingest_new(t):
    stored, batch = _commits(t)
    return commit_ingest.new_commits(batch, stored).select("commit_hash", F.size("parent_hashes").alias("parents"))


@query(f"""{_COMMITS}, e AS (SELECT commit_hash, p1 AS parent, 0 AS ordinal FROM new WHERE p1 IS NOT NULL UNION ALL SELECT commit_hash, p2, 1 FROM new WHERE p2 IS NOT NULL)
SELECT commit_hash, parent, ordinal FROM e WHERE parent IN (SELECT commit_hash FROM stored UNION ALL SELECT commit_hash FROM new)""")
def commit_ingest_edges(t):
    stored, batch = _commits(t)
    return commit_ingest.resolved_edges(commit_ingest.new_commits(batch, stored), stored)


@query("""SELECT 'order of a known customer with money' AS "constraint", json_object('v0', o_custkey)::VARCHAR AS value, count(*) AS rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey
UNION ALL SELECT 'one signup a user', json_object('v0', user_id)::VARCHAR, count(*) FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING count(*) > 1
UNION ALL SELECT 'tax below six in a hundred', NULL, count(*) FROM lineitem WHERE NOT l_tax < 0.06 HAVING count(*) > 0
UNION ALL SELECT 'line of an order', json_object('v0', l_orderkey)::VARCHAR, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
UNION ALL SELECT 'label of a document', json_object('v0', doc_id)::VARCHAR, count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY doc_id""")
def constraint_violations(t):
    declared = [
        Reference("order of a known customer with money", "orders", "o_custkey", "customer", "c_custkey", "c_acctbal > 0"), Unique("one signup a user", "events", ("user_id",), "event_type = 'signup'"), Check("tax below six in a hundred", "lineitem", "l_tax < 0.06"),
        Reference("line of an order", "lineitem", "l_orderkey", "orders", "o_orderkey"), Reference("label of a document", "labels", "doc_id", "documents", "doc_id"), Unique("order keys", "orders", ("o_orderkey",)), Check("sizes", "part", "p_size > 0"),
    ]
    return violations({n: t(n) for n in ("orders", "customer", "events", "lineitem", "labels", "documents", "part")}, declared)


@query("""SELECT event_id, json_merge_patch(props, CASE event_type WHEN 'error' THEN '{"k": null}' WHEN 'view' THEN NULL ELSE json_object('v', json_object('type', event_type, 'user', user_id)) END)::VARCHAR AS props FROM events WHERE event_type <> 'view'
UNION ALL SELECT event_id, json(props)::VARCHAR FROM events WHERE event_type = 'view'""")
def json_merge(t):
    patch = F.when(F.col("event_type") == "error", '{"k": null}').when(F.col("event_type") != "view", F.to_json(F.struct(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")).alias("v"))))
    return t("events").select("event_id", J.merged(F.col("props"), patch).alias("props"))


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) > 0 AS has_bytes FROM documents")
def has_bytes(t):
    from codelode.functions.predicates import has_bytes as given

    return t("documents").select("doc_id", given(F.encode("text", "UTF-8")).alias("has_bytes"))
