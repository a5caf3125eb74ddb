"""Relational operators on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.operators import access, graph, health, resolve, snapshots, tables, vectors


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_text_functions(spark):
    lines = lambda s: one(spark, T.count_lines(F.lit(s)))
    assert [lines(s) for s in ("", "a", "a\n", "a\nb", "\n")] == [0, 1, 1, 2, 1]
    assert one(spark, T.line_range(F.lit("a\nb\nc\n"), 2, 9)) == "b\nc"
    assert one(spark, T.line_range(F.lit("a"), 3, 4)) == ""
    assert one(spark, T.estimate_tokens(F.lit("éé"))) == 1
    assert one(spark, T.normalize_newlines(F.lit("\ufeffa\r\nb\rc"))) == "a\nb\nc"
    assert one(spark, T.signature(F.lit("func a() { x }"))) == "func a()"
    assert one(spark, T.signature(F.lit("const f = a => b => c"))) == "const f = a => b =>"
    assert one(spark, T.extension(F.lit("a.b/C.TS"))) == ".ts" and one(spark, T.extension(F.lit("a.b/C"))) == ""
    assert one(spark, T.strip_extension(F.lit("a.b/c"))) == "a.b/c"
    assert one(spark, T.redact_credentials(F.lit("https://me:pw@h/x"))) == "https://***@h/x"
    assert one(spark, T.normalize_repo_url(F.lit("git@Host.com:a/b.git"))) == one(spark, T.normalize_repo_url(F.lit("https://host.com/a/b/"))) == "host.com/a/b"
    assert one(spark, T.go_module(F.lit("// x\nmodule github.com/a/b\n\ngo 1.22"))) == "github.com/a/b"
    urls = {"/a": True, "./a": True, "a/b": True, "//h/a": False, "https://h": False, "<dynamic>": False, "": False}
    assert {u: one(spark, T.is_relative_url(F.lit(u))) for u in urls} == urls


def test_percentile_and_health(spark):
    logs = spark.createDataFrame([(10.0,), (50.0,), (100.0,)], "v double")
    assert health.p95(logs, "v").first()["p95_latency_ms"] == 95
    assert health.p95(logs.where("v < 0"), "v").first().asDict() == {"query_count": 0, "p95_latency_ms": 0}
    t = lambda d: dt.datetime(2024, 1, d)
    jobs = spark.createDataFrame([(1, 1, "failed", t(1), t(2)), (1, 2, "completed", t(1), t(3)), (2, 3, "failed", t(1), t(2)), (2, 4, "completed", t(1), t(2)), (3, 5, "running", t(4), None), (4, 6, None, None, None)], "project_id int, job_id int, status string, created_at timestamp, finished_at timestamp")
    snaps = spark.createDataFrame([(1, 7, True, None), (1, 8, True, t(1)), (2, 9, False, t(1))], "project_id int, snapshot_id int, is_active boolean, activated_at timestamp")
    rows = health.project_health(spark.createDataFrame([(i,) for i in range(1, 6)], "project_id int"), snaps, jobs)
    assert values(rows, "project_id", F.coalesce("snapshot_id", F.lit(0)), "active_job_status", F.coalesce("failed_job_id", F.lit(0))) == [(1, 8, "", 0), (2, 0, "", 3), (3, 0, "running", 0), (4, 0, "", 0), (5, 0, "", 0)]


def test_reaper(spark):
    now = dt.datetime(2024, 1, 1, 12)
    ago = lambda s: now - dt.timedelta(seconds=s)
    jobs = spark.createDataFrame([(1, "w1", "running", ago(600), None), (2, "w2", "running", ago(600), None), (3, "w3", "running", ago(60), None), (4, "w2", "queued", None, None)], "job_id int, worker_id string, status string, started_at timestamp, finished_at timestamp")
    beats = spark.createDataFrame([("w1", ago(10)), ("w1", ago(100)), ("w2", ago(31))], "worker_id string, ts timestamp")
    assert values(health.reap(jobs, beats, F.lit(now)), "job_id", "status") == [(1, "running"), (2, "failed"), (3, "running"), (4, "queued")]
    assert values(health.dead_workers(beats, F.lit(now)), "worker_id") == [("w2",)]


def test_bfs(spark):
    edges = spark.createDataFrame([("a", "b", "i", None), ("b", "c", "i", None), ("x", "a", "i", None), ("a", None, "lodash", "lodash"), ("a", None, "fs", None), ("c", "d", "i", None)], "source string, target string, import_name string, package string")
    nodes, met, cut = graph.bfs(edges, "a", 2)
    assert values(nodes, "file_path", "depth", "is_external") == [("a", 0, False), ("b", 1, False), ("c", 2, False), ("ext:fs", 1, True), ("ext:lodash", 1, True), ("x", 1, False)] and not cut
    assert met.count() == 5
    nodes, met, cut = graph.bfs(edges, "a", 9, max_nodes=3)
    assert cut and values(nodes, "file_path") == [("a",), ("ext:fs",), ("b",)][:1] + sorted([("b",), ("ext:fs",)])
    assert values(met, "source", "target") == [("a", "b"), ("a", "ext:fs")]
    assert graph.bfs(edges, "nowhere", 3)[0].count() == 1


def test_file_tree(spark):
    files = spark.createDataFrame([("src/a.go", 3), ("src/lib/b.go", 5), ("README", 1), ("", 0)], "path string, size int")
    nodes = graph.path_nodes(files.withColumnRenamed("path", "p"), "p", ["size"])
    ordered = [(r["path"], r["type"], r["size"]) for r in nodes.orderBy(*graph.tree_order()).collect()]
    assert ordered == [("src", "directory", None), ("README", "file", 1), ("src/lib", "directory", None), ("src/a.go", "file", 3), ("src/lib/b.go", "file", 5)]


def test_access(spark):
    sufficient = lambda role, need: one(spark, access.sufficient(F.lit(role), need))
    assert sufficient("owner", "admin") and not sufficient("member", "admin") and not sufficient("stranger", "member") and not sufficient(None, "member") and not sufficient("owner", "stranger")


def test_tables(spark):
    have = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (3, "d")], "k int, v string")
    assert tables.insert_missing(have, new, ["k"]).count() == 1
    assert values(tables.upsert(have, new, ["k"], "v"), "k", "v") == [(1, "a"), (2, "x"), (3, "d")]
    assert values(tables.update(have, F.col("k") == 1, v=F.lit("z")), "k", "v") == [(1, "z"), (2, "b")]
    assert values(tables.delete(have, F.col("v") == "a"), "k") == [(2,)]


def test_incremental_equals_full(spark):
    """Carrying unchanged files forward and parsing the rest gives what parsing everything gives."""
    from codelode.parse.engine import explode, parse

    old = spark.createDataFrame([(f"p/f{i}.py", f"def f{i}():\n    return {i}\n") for i in range(6)], "file_path string, content string")
    new = spark.createDataFrame([(f"p/f{i}.py", f"def f{i}():\n    return {i * (3 if i == 2 else 1)}\n") for i in range(1, 8)], "file_path string, content string")
    hashed = lambda df: df.select(F.col("file_path").alias("path"), F.sha2("content", 256).alias("hash"))
    change = snapshots.classify(hashed(old), hashed(new))
    assert values(change.groupBy("change").count(), "change", "count") == [("A", 2), ("D", 1), ("M", 1), ("U", 4)]
    symbols = lambda df: explode(parse(df), "symbols").select("file", "name", "symbol_hash")
    fresh = symbols(new.join(change.where("change IN ('A', 'M')").select(F.col("path").alias("file_path")), "file_path", "left_semi"))
    carried = symbols(old).join(change.where("change = 'U'").select(F.col("path").alias("file")), "file", "left_semi")
    assert values(fresh.unionByName(carried), "file", "name", "symbol_hash") == values(symbols(new), "file", "name", "symbol_hash")


def test_snapshot_pointer(spark, tmp_path):
    for s in ("s1", "s2"):
        snapshots.write_pointer(spark, f"file://{tmp_path}", "p", "main", s)
        assert snapshots.read_pointer(spark, f"file://{tmp_path}", "p", "main") == s
    assert snapshots.incremental_base(None, True, True) == "full" and snapshots.incremental_base("s", True, True) == "incremental"


def test_import_resolution(spark):
    paths = spark.createDataFrame([(p,) for p in ("src/utils.ts", "src/utils.d.ts", "src/components/Button.tsx", "src/lib/index.ts", "src/types.d.ts", "internal/h/b.go", "internal/h/a.go", "com/acme/User.java", "app/Models/User.php", "pkg/mod/__init__.py", "exact.css")], "path string")
    rows = [
        ("typescript", "./utils", "INTERNAL", "src/utils", "src/utils.ts", "INTERNAL"), ("tsx", "./b", "INTERNAL", "src/components/Button", "src/components/Button.tsx", "INTERNAL"), ("typescript", "./lib", "INTERNAL", "src/lib", "src/lib/index.ts", "INTERNAL"),
        ("typescript", "./types", "INTERNAL", "src/types", "src/types.d.ts", "INTERNAL"), ("typescript", "./exact.css", "INTERNAL", "exact.css", "exact.css", "INTERNAL"), ("typescript", "./none", "INTERNAL", "src/none", "src/none", "INTERNAL"),
        ("typescript", "react", "EXTERNAL", "", "", "EXTERNAL"), ("go", "acme.io/x/internal/h", "EXTERNAL", "", "internal/h/a.go", "INTERNAL"), ("go", "acme.io/x-fork/internal/h", "EXTERNAL", "", "", "EXTERNAL"), ("go", "fmt", "STDLIB", "", "", "STDLIB"),
        ("java", "com.acme.User", "EXTERNAL", "", "com/acme/User.java", "INTERNAL"), ("php", "\\app\\Models\\User", "EXTERNAL", "", "app/Models/User.php", "INTERNAL"), ("python", "pkg.mod", "EXTERNAL", "", "pkg/mod/__init__.py", "INTERNAL"), ("python", ".x", "EXTERNAL", "", "", "EXTERNAL"),
    ]
    imports = spark.createDataFrame([r[:4] for r in rows], "language string, import_name string, import_type string, target_file_path string")
    got = {(r["language"], r["import_name"]): (r["target_file_path"], r["import_type"]) for r in resolve.resolve_imports(imports, paths.repartition(3), "acme.io/x").collect()}
    assert got == {(r[0], r[1]): (r[4], r[5]) for r in rows}


def test_enclosing_symbol(spark):
    symbols = spark.createDataFrame([("f", "outer", 1, 20, 0), ("f", "inner", 5, 9, 1), ("f", "twin", 5, 9, 2), ("g", "other", 1, 99, 0)], "file string, symbol_id string, start_line int, end_line int, ordinal int")
    points = spark.createDataFrame([(1, "f", 6), (2, "f", 15), (3, "f", 50), (4, "h", 1)], "ref_id int, file string, line int")
    assert {r["ref_id"]: r["symbol_id"] for r in resolve.enclosing_symbol(points, symbols).collect()} == {1: "inner", 2: "outer", 3: None, 4: None}


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "vec_id int, embedding array<float>")
    assert values(vectors.wrong_dims(rows, 2), "vec_id") == [(5,), (6,)]
    top = vectors.top_k(rows.where("vec_id < 5"), [1.0, 0.0], 3)
    assert [(r["vec_id"], r["score"]) for r in top.collect()] == [(1, 1.0), (3, 0.707107), (2, 0.0)]
    made = vectors.embed(spark.createDataFrame([("a b a",), ("a a b",), ("",), (None,)], "t string"), "t", 8).collect()
    assert made[0]["embedding"] == made[1]["embedding"] and made[2]["embedding"] == made[3]["embedding"] == [0.0] * 8
    assert abs(sum(x * x for x in made[0]["embedding"]) - 1) < 1e-6


def test_p95_on_a_half_rounds_as_quantile_cont(spark):
    """51.41 and 51.51 around the 95th percentile of 43 values give 51.5 or a little less, as the sum is rounded."""
    import duckdb

    from codelode.operators import health

    values = [50.0 + i / 100 for i in range(39)] + [51.41, 51.51, 51.6, 51.7]
    df = spark.createDataFrame([(g, v) for g in (1, 2) for v in values] + [(2, None), (3, None)], "g int, v double")
    rows = ", ".join(f"({v}::DOUBLE)" for v in values)
    want = duckdb.sql(f"SELECT round_even(quantile_cont(v, 0.95), 0)::BIGINT FROM (VALUES {rows}) t(v)").fetchall()[0][0]
    got = sorted(map(tuple, health.p95(df, "v", ["g"]).collect()))
    assert got == [(1, 43, want), (2, 44, want), (3, 1, 0)]
    assert health.p95(df.where("false"), "v").collect() == [(0, 0)]
    halves = spark.createDataFrame([(1, v) for v in (0.5, 1.5, 2.5)], "g int, v double")
    assert [r["p95_latency_ms"] for r in health.p95(halves.where("v < 1"), "v", ["g"]).collect()] == [0]


def test_top_k_batch_gives_k_rows_a_task(spark, monkeypatch):
    """Merged over small slices, with ties across them, it is the exact answer, and a task's rows do not grow with its vectors."""
    import numpy as np

    from codelode.operators import vectors
    from tests.plan_rows import most_rows

    x = np.random.default_rng(4).integers(-1, 2, (5000, 4)).astype(float)  # 81 different ones: ties everywhere
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(2)
    queries = rows.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding")
    got = vectors.top_k_batch(rows, queries, 7)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = {}
    for q in range(0, 5000, 100):
        score = np.where(np.linalg.norm(x, axis=1) > 0, np.round(unit @ unit[q], 6), -2)
        want[q] = [(int(i), float(score[i])) for i in np.lexsort((np.arange(5000), -score))[:7]]
    found = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == {q: [(i, round(s, 6) + 0.0) for i, s in v] for q, v in want.items()}
    sent = vectors.top_k_batch(rows, queries, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in sent and most_rows(got) <= 5000
