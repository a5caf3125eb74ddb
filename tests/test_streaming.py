"""Streams give what their batch forms give."""

import datetime as dt
import json

from pyspark.sql import functions as F

from codelode.sources import files, git
from codelode.streaming import events as E


def test_events(spark, tmp_path):
    lines = [
        {"event": "job:started", "project_id": "p1", "job_id": "j1", "origin": "w"}, {"event": "job:started", "project_id": "p2", "job_id": "j2", "origin": "api"}, {"event": "job:started", "job_id": "none"}, {"event": "odd", "project_id": "p1"},
        {"event": "member:added", "project_id": "p1", "data": {"user_id": "u3", "role": "member"}, "timestamp": "2"}, {"event": "member:removed", "project_id": "p1", "data": {"user_id": "u1"}, "timestamp": "3"},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join([*map(json.dumps, lines[:3]), "{broken"]))
    (tmp_path / "in/b.json").write_text("\n".join(map(json.dumps, lines[3:])))
    members = spark.createDataFrame([("p1", "u1", "owner"), ("p1", "u2", "member"), ("p2", "u2", "member")], "project_id string, user_id string, role string")
    batch = E.parse_events(spark.read.text(f"{tmp_path}/in"), own_origin="api")
    routed = lambda df: sorted((r["to_user"], r["event"], r["project_id"]) for r in df.collect())
    want = [("u1", "job:started", "p1"), ("u1", "member:removed", "p1"), ("u2", "job:started", "p1"), ("u3", "member:added", "p1")]
    assert routed(E.route(batch, members)) == want
    stream = E.route(E.parse_events(E.read_events(spark, f"{tmp_path}/in", 1), own_origin="api"), members)
    assert routed(E.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/ck")) == want
    assert sorted((r["project_id"], r["user_id"]) for r in E.apply_membership(members, batch).collect()) == [("p1", "u2"), ("p1", "u3"), ("p2", "u2")]


def test_windows_and_states(spark, data, tmp_path):
    table = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(2):
        table.where(f"event_id % 2 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/ev")
    got = E.run_available(E.windowed_counts(stream, late="40 days"), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert got.count() == 0  # no window closes before the watermark passes it
    got = E.run_available(E.windowed_counts(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/ev"), late="0 seconds"), f"{tmp_path}/out2", f"{tmp_path}/ck2")
    want = {(r["window_start"], r["event_type"]): r["n"] for r in E.windowed_counts(table).collect()}
    closed = {(r["window_start"], r["event_type"]): r["n"] for r in got.collect()}
    assert closed and all(want[k] == n for k, n in closed.items())
    moves = spark.createDataFrame([("j", "running", 2), ("j", "queued", 1), ("j", "failed", 4), ("j", "completed", 3), ("k", "queued", 9)], "job_id string, status string, seq long")
    assert sorted(map(tuple, E.job_states(moves).collect())) == [("j", "completed", 3), ("k", "queued", 9)]


def test_liveness(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    beats = [("a", 0), ("b", 0), ("a", 20), ("a", 40), ("b", 5), ("c", 200), ("c", 210), ("c", 300)]
    for i, (w, s) in enumerate(beats):
        spark.createDataFrame([(w, t0 + dt.timedelta(seconds=s))], "worker_id string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/hb/{i:02d}")
    stream = spark.readStream.schema("worker_id string, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/hb")
    got = E.run_available(E.liveness(stream), f"{tmp_path}/out", f"{tmp_path}/ck")
    seen = sorted({(r["worker_id"], r["status"]) for r in got.collect()})
    assert {("a", "dead"), ("b", "dead"), ("a", "alive"), ("b", "alive")} <= set(seen)


def test_sources(spark, tmp_path):
    (tmp_path / "tree/sub").mkdir(parents=True)
    (tmp_path / "tree/a.txt").write_text("hé")
    (tmp_path / "tree/sub/b.txt").write_text("b")
    (tmp_path / "tree/nul.txt").write_bytes(b"a\0b")
    (tmp_path / "tree/bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "tree/big.txt").write_bytes(b"x" * (1 << 20))
    assert sorted(map(tuple, files.read_tree(spark, f"{tmp_path}/tree").select("file_path", "content").collect())) == [("a.txt", "hé"), ("sub/b.txt", "b")]
    log = "\x1e\n".join("\x1f".join(f) for f in [("h2", "h1 h0", "A", "a@x", "2024-01-02T00:00:00+00:00", "A", "a@x", "2024-01-02T00:00:00+00:00", "subject\n\nbody\n"), ("h1", "", "B", "b@x", "2024-01-01T00:00:00+00:00", "B", "b@x", "bad date", "m")]) + "\x1e"
    (tmp_path / "log").write_text(log)
    commits = git.read_log(spark, f"{tmp_path}/log")
    got = {r["commit_hash"]: r for r in commits.collect()}
    assert got["h2"]["parent_hashes"] == ["h1", "h0"] and got["h2"]["message"] == "subject\n\nbody" and got["h1"]["committer_date"] is None
    assert [tuple(r) for r in git.parent_edges(commits, commits).collect()] == [("h2", "h1", 0)]
    raw = spark.createDataFrame([("M\0a.py\0A\0b c.py\0R100\0x\0",), ("",)], "v string")
    assert [tuple(r) for r in git.name_status(raw, "v").collect()] == [("M", "a.py"), ("A", "b c.py"), ("M", "x")]
    assert spark.createDataFrame([('"a\\tb\\"c"',), ("plain",)], "p string").select(git.unquote_path(F.col("p"))).collect()[0][0] == 'a\tb"c'
