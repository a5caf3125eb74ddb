"""A store from end to end: indexing in full and by change, and the read surface over it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codelode.api import Api
from codelode.indexing import index
from codelode.store import Store
from tests.test_parse import SAMPLES

TREE = {**SAMPLES, "src/other.ts": "export const other = 1;\n", "Makefile": "all:\n\techo hi\n", "notes.unknown": "plain text\n" * 3, "pkg/util.py": "def go(x):\n    return x\n", "lib/a.rb": "def a\nend\n", "empty.py": ""}


def frame(spark, tree):
    return spark.createDataFrame(list(tree.items()), "file_path string, content string")


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    """A store indexed twice (the second time by change), and one indexed once with the same final tree."""
    final = {k: v for k, v in TREE.items() if k != "x.sql"} | {"pkg/mod.py": TREE["pkg/mod.py"] + "\n\ndef added():\n    return LIMIT\n", "new.go": "package main\n\nfunc New() {}\n"}
    step, once = (Store(spark, f"file://{tmp_path_factory.mktemp('store')}") for _ in range(2))
    index(step, "p", "main", "c1", frame(spark, TREE))
    index(step, "p", "main", "c2", frame(spark, final))
    index(once, "p", "main", "c2", frame(spark, final))
    return step, once


NATURAL = {
    "files": ["file_path", "language", "file_hash", "line_count", "size_bytes"], "symbols": ["name", "qualified_name", "kind", "start_line", "end_line", "symbol_hash"], "code_chunks": ["chunk_type", "chunk_hash", "start_line", "end_line", "semantic_role"],
    "dependencies": ["source_file_path", "target_file_path", "import_name", "import_type"], "exports": ["exported_name", "export_kind", "line"], "symbol_references": ["target_name", "reference_kind", "start_line", "start_column"],
    "jsx_usages": ["component_name", "line"], "network_calls": ["client_kind", "method", "start_line"], "vectors": ["file_path", "chunk_type", "start_line", "embedding"],
}


@pytest.mark.parametrize("name", sorted(NATURAL))
def test_incremental_equals_full(stores, name):
    rows = []
    for s in stores:
        api = Api(s)
        df = api.rows(name, "p")
        assert df.count() > 0 and df.select("id").distinct().count() == df.count()
        rows.append(sorted(map(repr, df.select(*NATURAL[name]).collect())))
    assert rows[0] == rows[1]


def test_links_hold_after_carrying(stores):
    for s in stores:
        api = Api(s)
        ids = {t: {r["id"] for r in api.rows(t, "p").select("id").collect()} for t in ("files", "symbols")}
        for t in ("symbols", "code_chunks", "exports", "symbol_references", "jsx_usages", "network_calls"):
            assert {r["file_id"] for r in api.rows(t, "p").select("file_id").collect()} <= ids["files"]
        for t, c in (("code_chunks", "symbol_id"), ("symbols", "parent_symbol_id"), ("exports", "symbol_id"), ("symbol_references", "source_symbol_id"), ("symbol_references", "resolved_target_symbol_id")):
            assert {r[c] for r in api.rows(t, "p").select(c).where(f"{c} is not null").collect()} <= ids["symbols"]


def test_read_surface(stores):
    api = Api(stores[0])
    found = api.search("p", "LIMIT")
    assert found.total().first()["total"] == found.rows.count() > 0
    assert [r["file_path"] for r in api.search("p", "func", include="*.go").page().collect()][:1] == ["cmd/main.go"]
    assert {r["name"] for r in api.symbols("p", "run").rows.collect()} >= {"run", "Run"} and api.symbols("p", kind="class").page().count() >= 3
    a = api.symbols("p", "A", "sensitive").page().first()
    assert a["name"] == "A" and [r["name"] for r in api.symbol_children("p", a["id"]).collect()] == ["run"] and api.symbol("p", a["id"]).count() == 1
    out, back = api.file_dependencies("p", "pkg/util.py")
    assert out.count() == 0 and [r["source_file_path"] for r in back.collect()] == ["pkg/mod.py"]
    nodes, edges, cut = api.dependency_graph("p", "pkg/mod.py", 1)
    assert {r["file_path"] for r in nodes.collect()} == {"pkg/mod.py", "pkg/util.py", "ext:os"} and edges.count() == 2 and not cut
    assert api.structure("p").first()["path"] == "a" and api.structure("p").where("type = 'file'").count() == len(TREE)
    assert api.file("p", "cmd/main.go")["language"] == "go" and api.file("p", "x.sql") is None
    assert [r["export_kind"] for r in api.artifacts("p", "src/App.tsx", "exports").collect()] == ["DEFAULT", "NAMED", "TYPE_ONLY", "EXPORT_ALL"]
    assert api.similar("p", "plain text", 1).first()["file_path"] == "notes.unknown"
    assert api.external_packages("p").count() > 0 and api.dependencies("p").count() > 0
    assert api.search("nobody", "x").page().count() == 0 and api.active_snapshot("nobody") is None
    plan = api.rows("symbols", "p")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project_id" in plan


def test_control_tables(spark, tmp_path):
    s, now = Store(spark, f"file://{tmp_path}"), dt.datetime(2024, 1, 2)
    row = lambda cols, *values: spark.createDataFrame(list(values), cols)
    s.insert("projects", row("id string, name string", ("p1", "b"), ("p2", "a")), ["id"])
    s.insert("projects", row("id string, name string", ("p1", "again")), ["id"])
    s.insert("project_members", row("id string, project_id string, user_id string, role string", ("m1", "p1", "u1", "owner"), ("m2", "p2", "u1", "member")))
    s.insert("users", row("id string, username string, display_name string, is_active boolean", ("u1", "ann", "Ann", True), ("u2", "bob", "Bob", False)))
    s.insert("indexing_jobs", row("id string, project_id string, status string, created_at timestamp, finished_at timestamp", ("j1", "p1", "failed", now, now), ("j2", "p2", "queued", now, None)))
    s.insert("query_log", row("id string, project_id string, latency_ms int, created_at timestamp", *[(f"q{i}", "p1", v, now) for i, v in enumerate((10, 50, 100))]))
    s.insert("api_keys", row("id string, key_type string, key_hash string, role string, project_id string, is_active boolean, created_by string", ("k", "personal", "h", "write", None, True, "u1")))
    api, at = Api(s), F.lit(now + dt.timedelta(hours=1))
    assert api.dashboard("u1", at) == {"projects": 2, "active_jobs": 1, "failed_jobs_24h": 1, "query_count": 3, "p95_latency_ms": 95}
    assert api.dashboard("u1", F.lit(now + dt.timedelta(hours=25)))["failed_jobs_24h"] == 0 and api.dashboard("u2", at)["projects"] == 0
    assert [(r["name"], r["health"]) for r in api.projects("u1", at).collect()] == [("b", "failed"), ("a", "indexing")]
    assert [(r["username"], r["project_count"]) for r in api.users(by="username").collect()] == [("ann", 2), ("bob", 0)] and api.users("an%", True).count() == 1
    assert (api.key_access("h", "p1", at), api.key_access("h", "p2", at), api.key_access("h", "p3", at)) == ("write", "read", None)
    s.update("indexing_jobs", F.col("id") == "j2", status=F.lit("running"))
    s.delete("users", ~F.col("is_active"))
    assert s.get("indexing_jobs", id="j2")["status"] == "running" and s.count("users") == 1 and s.get("users", id="u2") is None and s.where("api_keys", project_id=None).count() == 1
    assert s.listing("projects", [F.asc("name")], 1, 1).first()["name"] == "b" and s.where("projects", id=["p1", "p9"]).count() == 1
    s.upsert("projects", row("id string, name string", ("p2", "z")), ["id"], "name")
    assert s.get("projects", id="p2")["name"] == "z" and api.jobs("p1").count() == 1


def test_commits(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    commit = "id string, project_id string, commit_hash string, author_email string, message string, committer_date timestamp"
    day = lambda d: dt.datetime(2024, 1, d)
    s.insert("commits", spark.createDataFrame([(f"c{i}", "p", f"{i}abcdefgh", "a@b", f"fix {i}\n\nbody", day(i)) for i in range(1, 5)], commit), ["id"])
    s.insert("commit_parents", spark.createDataFrame([("p", "c2", "c1", 0), ("p", "c3", "c2", 0), ("p", "c4", "c2", 1), ("p", "c4", "c3", 0)], "project_id string, commit_id string, parent_commit_id string, ordinal int"))
    s.insert("commit_file_diffs", spark.createDataFrame([("d1", "p", "c2", None, "a.py", "patch", 3, 1), ("d2", "p", "c3", "a.py", "b.py", "patch", 1, 1)], "id string, project_id string, commit_id string, old_file_path string, new_file_path string, patch string, additions int, deletions int"))
    api = Api(s)
    page = api.commits("p", "FIX", since="2024-01-02", role="admin").page(2).collect()
    assert [(r["id"], r["short_hash"], r["subject"], r["author_email"]) for r in page] == [("c4", "4abcdef", "fix 4", "a@b"), ("c3", "3abcdef", "fix 3", "a@b")]
    assert api.commits("p").page().first()["author_email"] is None and api.commits("p").total().first()["total"] == 4
    assert [r["id"] for r in api.commit_parents("p", "c4").collect()] == ["c3", "c2"] and [r["id"] for r in api.commit_children("p", "c2").collect()] == ["c4", "c3"]
    assert [r["commit_id"] for r in api.file_history("p", "a.py").collect()] == ["c3", "c2"] and "patch" not in api.commit_diffs("p", "c2").columns
    assert api.commit_stats("p", "c2").first().asDict() == {"files_changed": 1, "additions": 3, "deletions": 1} and api.commit_stats("p", "c1").first()["additions"] == 0
