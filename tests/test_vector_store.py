"""Vectors in buckets: which files a change rewrites, last write wins, batches that break off or are repeated."""

import os

import pytest
from pyspark.sql import functions as F

from codelode.operators import scratch
from codelode.operators.vector_store import VectorStore

COLUMNS = "id string, embedding array<float>, snapshot string, path string"


def rows(spark, some):
    return spark.createDataFrame([(i, v, s, p, n) for n, (i, v, s, p) in enumerate(some)], f"{COLUMNS}, at int")


def content(store):
    return {r["id"]: (r["embedding"], r["snapshot"], r["path"]) for r in store.table().collect()}


@pytest.fixture
def store(spark, tmp_path):
    s = VectorStore.create(spark, f"file://{tmp_path}/v", COLUMNS, 2, buckets=8)
    s.upsert(rows(spark, [(f"k{i}", [float(i), 0.0], "s1", f"p{i % 5}") for i in range(100)]), "first")
    return s


def test_last_write_wins_and_untouched_files_stay(spark, store):
    before = set(store.table().inputFiles())
    n = store.upsert(rows(spark, [("k1", [9.0, 9.0], "s2", "old"), ("k1", [8.0, 8.0], "s2", "new"), ("z", [1.0, 1.0], None, None)]), "second", order="at")
    got, after = content(store), set(store.table().inputFiles())
    assert len(got) == 101 and got["k1"] == ([8.0, 8.0], "s2", "new") and got["z"] == ([1.0, 1.0], None, None) and got["k2"] == ([2.0, 0.0], "s1", "p2")
    assert 1 <= n <= 2 and len(before - after) <= 2 and len(before & after) >= 6
    assert store.upsert(rows(spark, [("k1", [0.0, 0.0], "again", "x")]), "second") == 0 and content(store)["k1"][2] == "new"


def test_a_batch_that_broke_off_is_done_again(spark, store, monkeypatch):
    old, real = content(store), scratch.write_json
    new = rows(spark, [("k3", [7.0, 7.0], "s3", "n")])

    def broken(*_):
        raise OSError("the driver went away")

    monkeypatch.setattr(scratch, "write_json", broken)
    with pytest.raises(OSError):
        store.upsert(new, "late")
    assert content(store) == old
    monkeypatch.setattr(scratch, "write_json", real)
    other = rows(spark, [("k3", [6.0, 6.0], "s2", "m"), *[(f"o{i}", [1.0, 2.0], "s", "p") for i in range(40)]])
    store.upsert(other, "between")
    assert store.upsert(new, "late") == 1 and content(store) == {**old, **{f"o{i}": ([1.0, 2.0], "s", "p") for i in range(40)}, "k3": ([7.0, 7.0], "s3", "n")}


def test_half_written_folders_are_written_again(spark, store, tmp_path):
    os.makedirs(tmp_path / "v/data/half.1/bucket=0")
    (tmp_path / "v/data/half.1/bucket=0/part-0.parquet").write_bytes(b"no parquet")
    store.upsert(rows(spark, [(f"h{i}", [1.0, 2.0], "s", "p") for i in range(50)]), "half")
    assert len(content(store)) == 150


def test_bad_vectors_write_nothing(spark, store):
    for bad in ([("k1", [1.0], "s", "p")], [("k1", None, "s", "p")], [(None, [1.0, 2.0], "s", "p")]):
        with pytest.raises(ValueError):
            store.upsert(rows(spark, bad), "bad")
    assert len(content(store)) == 100


def test_patch_delete_get_and_vacuum(spark, store, tmp_path):
    ids = spark.createDataFrame([("k1",), ("k2",), ("none",)], "id string")
    store.patch(ids, "patch", snapshot=F.lit("s9"), path=F.concat("path", F.lit("!")))
    got = content(store)
    assert len(got) == 100 and got["k1"] == ([1.0, 0.0], "s9", "p1!") and got["k3"][1] == "s1"
    store.delete(F.col("path") == "p3", "delete")
    assert len(content(store)) == 80 and store.delete(F.col("path") == "none", "nothing") == 0
    some = store.get(["k1", "k3", "k4", "nobody"])
    assert {r["id"] for r in some.collect()} == {"k1", "k4"} and len(some.inputFiles()) <= 4
    store.delete(F.col("snapshot").isNotNull(), "all")
    assert content(store) == {} and store.vacuum() and content(store) == {}
    store.upsert(rows(spark, [("k1", [1.0, 2.0], "s", "p")]), "anew")
    assert list(content(store)) == ["k1"] and store.vacuum() == []


def test_another_collection_is_refused(spark, store):
    assert VectorStore.create(spark, store.root, COLUMNS, 2, buckets=8).table().count() == 100
    with pytest.raises(ValueError):
        VectorStore.create(spark, store.root, COLUMNS, 3, buckets=8)
