"""Changes to tables of snapshots, appended rows, errors that are not absence, and quoted paths."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from codelode.sources.git import unquote_path
from codelode.store import Store


def files(spark, rows):
    return spark.createDataFrame(rows, "id string, project_id string, index_snapshot_id string, file_path string")


def test_snapshot_tables_can_be_changed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.insert("files", files(spark, [("1", "p", "a", "x"), ("2", "p", "a", "y"), ("3", "p", "b", "x"), ("4", "q", "c", "z")]))
    paths = lambda: {(r["id"], r["file_path"]) for r in store.table("files").select("id", "file_path").collect()}
    store.delete("files", F.col("id") == "2")
    assert paths() == {("1", "x"), ("3", "x"), ("4", "z")}
    store.delete("files", F.col("index_snapshot_id") == "b")
    assert paths() == {("1", "x"), ("4", "z")}
    store.update("files", F.col("project_id") == "q", file_path=F.lit("new"))
    assert paths() == {("1", "x"), ("4", "new")}
    store.upsert("files", files(spark, [("1", "p", "a", "again"), ("5", "p", "d", "w")]), ["project_id", "index_snapshot_id", "id"], "file_path")
    assert {p for p in paths() if p[0] != "1"} == {("4", "new"), ("5", "w")} and len(paths()) == 3
    store.delete("files", F.col("id") == "none")
    assert len(paths()) == 3
    with pytest.raises(ValueError):
        store.replace("files", files(spark, []))
    with pytest.raises(ValueError):
        store.update("files", F.lit(True), project_id=F.lit("r"))


def test_rows_are_appended(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    row = lambda *ids: spark.createDataFrame([(i, "p") for i in ids], "id string, project_id string")
    store.insert("query_log", row("1"))
    first = set(store.table("query_log").inputFiles())
    store.insert("query_log", row("2"))
    store.insert("query_log", row("2", "3"), keys=["id"])
    assert first < set(store.table("query_log").inputFiles())
    assert sorted(r["id"] for r in store.table("query_log").collect()) == ["1", "2", "3"]


def test_only_absence_is_an_empty_table(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.count("files") == store.count("query_log") == 0

    def broken(*_):
        raise AnalysisException("broken", errorClass=None)

    monkeypatch.setattr("codelode.operators.snapshots.read_pointer", broken)
    with pytest.raises(AnalysisException):
        store.count("query_log")


def test_quoted_paths(spark):
    cases = {"plain.txt": "plain.txt", '"caf\\303\\251.txt"': "café.txt", '"a\\\\t"': "a\\t", '"a\\tb"': "a\tb", '"q\\"q"': 'q"q', '""': "", '"': '"', '"\\346\\227\\245 x"': "日 x"}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", unquote_path(F.col("p")).alias("u")).collect()
    assert {r["p"]: r["u"] for r in got} == cases


def test_inserts_add_to_snapshots(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    keys = ["project_id", "index_snapshot_id", "id"]
    paths = lambda: sorted((r["id"], r["file_path"]) for r in store.table("files").select("id", "file_path").collect())
    store.insert("files", files(spark, [("1", "p", "a", "x")]))
    store.insert("files", files(spark, [("2", "p", "a", "y"), ("2", "p", "b", "z")]))
    assert paths() == [("1", "x"), ("2", "y"), ("2", "z")]
    store.insert("files", files(spark, [("1", "p", "a", "other"), ("3", "p", "a", "w"), ("3", "p", "a", "w")]), keys)
    store.insert("files", files(spark, [("3", "p", "a", "again")]), ["id"])
    assert paths() == [("1", "x"), ("2", "y"), ("2", "z"), ("3", "w")]
    store.replace_snapshots("files", files(spark, [("9", "p", "a", "only")]))
    assert paths() == [("2", "z"), ("9", "only")]


def test_dropping_a_snapshot_is_taken_up_again(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    store.insert("index_snapshots", spark.createDataFrame([("a", "p", True, "active"), ("b", "p", False, "ready")], "id string, project_id string, is_active boolean, status string"))
    store.insert("indexing_jobs", spark.createDataFrame([("j", "p", "a", "done")], "id string, project_id string, index_snapshot_id string, status string"))
    for name in ("files", "symbols", "vectors"):
        store.insert(name, spark.createDataFrame([("1", "p", "a"), ("2", "p", "b")], "id string, project_id string, index_snapshot_id string"))
    real, calls = store._remove, []

    def breaks(*paths):
        calls.extend(paths)
        if len(calls) > 1:
            raise OSError("the driver went away")
        real(*paths)

    monkeypatch.setattr(store, "_remove", breaks)
    with pytest.raises(OSError):
        store.drop_snapshot("p", "a")
    monkeypatch.setattr(store, "_remove", real)
    assert store.get("index_snapshots", id="a")["status"] == "deleting" and not store.get("index_snapshots", id="a")["is_active"]
    assert store.clean_up() == [("p", "a")] and store.clean_up() == []
    for name in ("files", "symbols", "vectors"):
        assert [r["id"] for r in store.table(name).collect()] == ["2"]
    assert store.get("index_snapshots", id="a") is None and store.get("indexing_jobs", id="j")["index_snapshot_id"] is None and store.count("index_snapshots") == 1
