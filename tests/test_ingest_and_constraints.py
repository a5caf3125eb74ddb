"""Commit ingest in phases, declared constraints, and JSON changed in part."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codelode.functions import json as J
from codelode.operators import commit_ingest
from codelode.operators.constraints import Check, Reference, Unique, violations
from codelode.store import Store

LOG = "commit_hash string, parent_hashes array<string>, author_name string, author_email string, author_date timestamp, committer_name string, committer_email string, committer_date timestamp, message string"


def log(spark, commits):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(h, parents, "a", "a@b", day, "c", "c@d", day, f"message {h}") for h, parents in commits], LOG)


def changes(spark, rows):
    return spark.createDataFrame([(h, p, s, 1, 2, "patch") for h, p, s in rows], "commit_hash string, path string, status string, additions int, deletions int, patch string")


def found(store):
    hashes = {r["id"]: r["commit_hash"] for r in store.table("commits").collect()}
    edges = sorted((hashes[r["commit_id"]], hashes[r["parent_commit_id"]], r["ordinal"]) for r in store.table("commit_parents").collect())
    files = sorted((hashes[r["commit_id"]], hashes.get(r["parent_commit_id"]), r["old_file_path"], r["new_file_path"], r["change_type"]) for r in store.table("commit_file_diffs").collect())
    return sorted(hashes.values()), edges, files


FIRST = ([("a", []), ("b", ["a"]), ("m", ["b", "gone"]), ("b", ["a"])], [("a", "x", "A"), ("b", "x", "M"), ("m", "y", "D"), ("zz", "other", "A")])
SECOND = ([("m", ["b", "gone"]), ("c", ["m"]), ("d", ["c", "b"]), (None, ["c"])], [("c", "x", "M"), ("m", "y", "D")])


def test_ingest_and_a_second_run(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    run = lambda part: commit_ingest.ingest(store, "p", log(spark, part[0]), changes(spark, part[1]))
    assert run(FIRST) == {"commits": 3, "commit_parents": 2, "commit_file_diffs": 3}
    assert run(FIRST) == {"commits": 0, "commit_parents": 0, "commit_file_diffs": 0}
    assert run(SECOND) == {"commits": 2, "commit_parents": 3, "commit_file_diffs": 1}
    commits, edges, files = found(store)
    assert commits == ["a", "b", "c", "d", "m"] and edges == [("b", "a", 0), ("c", "m", 0), ("d", "b", 1), ("d", "c", 0), ("m", "b", 0)]
    assert sorted(files, key=str) == sorted([("a", None, None, "x", "added"), ("b", "a", "x", "x", "modified"), ("m", "b", "y", None, "deleted"), ("c", "m", "x", "x", "modified")], key=str)
    assert commit_ingest.ingest(store, "q", log(spark, FIRST[0]), changes(spark, []))["commits"] == 3  # another project's commits are its own


def test_a_run_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    real = store.insert

    def breaks(name, *args):
        if name == "commit_file_diffs":
            raise OSError("the driver went away")
        real(name, *args)

    monkeypatch.setattr(store, "insert", breaks)
    with pytest.raises(OSError):
        commit_ingest.ingest(store, "p", log(spark, FIRST[0]), changes(spark, FIRST[1]))
    monkeypatch.setattr(store, "insert", real)
    assert commit_ingest.ingest(store, "p", log(spark, FIRST[0]), changes(spark, FIRST[1])) == {"commits": 0, "commit_parents": 0, "commit_file_diffs": 3}


def test_the_filter_keeps_what_matches_and_little_else(spark):
    stored = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    batch = spark.range(199_000, 203_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    kept = commit_ingest.may_be_in(stored, "k", batch)
    assert kept.join(batch, "k", "left_semi").count() == 1000 and kept.count() < 1000 + 0.1 * 199_000
    assert commit_ingest.may_be_in(stored, "k", batch.limit(0)).count() == 0 and commit_ingest.may_be_in(stored.limit(0), "k", batch).count() == 0


def test_constraints(spark):
    configs = spark.createDataFrame([(1, "p", True, True), (2, "p", True, False), (3, "q", True, True), (4, None, True, True), (5, None, True, True), (6, "p", False, True)], "id int, project string, is_active boolean, is_default boolean")
    projects = spark.createDataFrame([("p", 1, 5), ("q", 6, -1), ("r", None, None), ("s", 9, 3), ("t", 9, 2)], "name string, selected long, size int")
    declared = [
        Reference("selected is there and active", "projects", "selected", "configs", "id", "is_active"), Unique("one default a project", "configs", ("project",), "is_active AND is_default"), Unique("names", "projects", ("name",)),
        Check("size is positive", "projects", "size > 0"), Unique("pairs", "configs", ("project", "is_default")),
    ]
    got = {(r["constraint"], r["value"]): r["rows"] for r in violations({"configs": configs, "projects": projects}, declared).collect()}
    assert got == {("selected is there and active", '{"v0":6}'): 1, ("selected is there and active", '{"v0":9}'): 2, ("size is positive", None): 1, ("pairs", '{"v0":"p","v1":true}'): 2}
    assert violations({"configs": configs.limit(0), "projects": projects.limit(0)}, declared).count() == 0


MERGES = [
    ('{"a":1,"b":{"c":2,"d":3}}', '{"b":{"c":null,"e":[1]},"z":"x"}', '{"a":1,"b":{"d":3,"e":[1]},"z":"x"}'), ('{"a":1}', None, '{"a":1}'), ('{"a":1}', "nope{", '{"a":1}'), (None, '{"q":1}', '{"q":1}'), (None, None, None),
    ('{"a":{"b":{"c":{"d":1,"e":2}}}}', '{"a":{"b":{"c":{"d":5}}}}', '{"a":{"b":{"c":{"d":5}}}}'), ("[1]", '{"a":1}', '{"a":1}'), ('{"a":null,"k":1}', '{"b":2}', '{"a":null,"b":2,"k":1}'), ('{"a":1}', "null", "null"), ('{"a":1}', '{"a":null}', "{}"),
]


def test_json_merge(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(MERGES)], "i int, a string, b string")
    got = df.select("i", J.merged(F.col("a"), F.col("b")).alias("m"), J.merged(F.col("a"), F.col("b"), 1).alias("flat"), J.replaced(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()
    assert [r["m"] for r in got] == [m for *_, m in MERGES]
    assert got[0]["flat"] == '{"a":1,"b":{"c":null,"e":[1]},"z":"x"}' and [r["r"] for r in got[1:5]] == ['{"a":1}', '{"a":1}', '{"q":1}', None]
