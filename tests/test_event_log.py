"""The event log through crashes and restarts, and delivery by live membership in one running stream."""

import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from codelode.streaming import event_log, membership
from codelode.streaming import events as E


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    os.rename(f"{folder}/.{name}", f"{folder}/{name}.json")


def job(i, project="p"):
    return {"event": "job:progress", "project_id": project, "job_id": f"j{i}", "timestamp": f"2024-01-01T00:00:{i:02d}Z"}


def member(kind, user, at, project="p"):
    return {"event": f"member:{kind}", "project_id": project, "timestamp": f"2024-01-01T00:00:{at:02d}Z", "data": {"user_id": user, "role": "member"}}


def publish(spark, tmp_path):
    events = E.parse_events(E.read_events(spark, f"file://{tmp_path}/in", per_trigger=1))
    event_log.publish(events, f"{tmp_path}/log", "w1", f"file://{tmp_path}/ck-w", available_now=True).awaitTermination()


def consume(spark, tmp_path):
    return E.run_available(event_log.read_log(spark, f"{tmp_path}/log"), f"file://{tmp_path}/out", f"file://{tmp_path}/ck-r")


def forget_last_commit(checkpoint):
    """As after a crash between the sink's commit and Spark's."""
    last = max((int(os.path.basename(p)) for p in glob.glob(f"{checkpoint}/commits/[0-9]*")))
    os.remove(f"{checkpoint}/commits/{last}")
    os.remove(f"{checkpoint}/commits/.{last}.crc")


def jobs(df):
    return sorted(json.loads(r["value"])["job_id"] for r in df.collect())


def test_restarts_neither_lose_nor_repeat(spark, tmp_path):
    for k in range(3):
        put(f"{tmp_path}/in", f"a{k}", [job(3 * k + i) for i in range(3)] + [{"event": "nonsense"}])
    publish(spark, tmp_path)
    assert jobs(consume(spark, tmp_path)) == sorted(f"j{i}" for i in range(9))
    put(f"{tmp_path}/in", "b", [job(20), job(21)])
    publish(spark, tmp_path)
    forget_last_commit(f"{tmp_path}/ck-w")
    publish(spark, tmp_path)
    assert jobs(consume(spark, tmp_path)) == sorted([f"j{i}" for i in range(9)] + ["j20", "j21"])
    forget_last_commit(f"{tmp_path}/ck-r")
    assert len(jobs(consume(spark, tmp_path))) == 11
    manifests = glob.glob(f"{tmp_path}/log/w1/*.json")
    assert sum(len(json.load(open(m))["files"]) for m in manifests) == len(glob.glob(f"{tmp_path}/log/w1/part-*")) and not glob.glob(f"{tmp_path}/log/w1/*.json.*")


def test_a_broken_batch_leaves_nothing(spark, tmp_path):
    event_log.register(spark)
    put(f"{tmp_path}/in", "a", [job(1)])
    bad = E.read_events(spark, f"file://{tmp_path}/in").select(F.lit("no json").alias("value"))
    with pytest.raises(Exception, match="JSON|Expecting|json"):
        bad.writeStream.format("event_log").option("path", f"{tmp_path}/log").option("writer", "w").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert not glob.glob(f"{tmp_path}/log/w/*.json") and consume(spark, tmp_path).count() == 0


def test_several_writers(spark, tmp_path):
    for w in ("x", "y"):
        put(f"{tmp_path}/in-{w}", "a", [job(1 if w == "x" else 2)])
        event_log.publish(E.parse_events(E.read_events(spark, f"file://{tmp_path}/in-{w}")), f"{tmp_path}/log", w, f"file://{tmp_path}/ck-{w}", available_now=True).awaitTermination()
        assert len(jobs(consume(spark, tmp_path))) == (1 if w == "x" else 2)


@pytest.mark.parametrize("shards", [1, 3])
def test_a_removed_member_gets_nothing_more(spark, tmp_path, shards):
    """One stream over several micro-batches, stopped and started again in between."""
    out, before = f"{tmp_path}/out", spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def run():
        stream = membership.deliver(E.parse_events(E.read_events(spark, f"file://{tmp_path}/in", per_trigger=1)), shards)
        df = E.run_available(stream, f"file://{out}", f"file://{tmp_path}/ck")
        return {(r["to_user"], r["event"], json.loads(r["body"]).get("job_id")) for r in df.collect()}, df.count()

    try:
        put(f"{tmp_path}/in", "a", [member("added", "ann", 1), member("added", "bob", 2), member("added", "eve", 2, "q"), job(3)])
        want = {("ann", "job:progress", "j3"), ("ann", "member:added", None), ("bob", "job:progress", "j3"), ("bob", "member:added", None), ("eve", "member:added", None)}
        assert run() == (want, 5)
        put(f"{tmp_path}/in", "b", [job(6), member("removed", "bob", 5), job(4)])  # the removal lies between the two
        want |= {("ann", "job:progress", "j4"), ("bob", "job:progress", "j4"), ("ann", "job:progress", "j6"), ("bob", "member:removed", None)}
        assert run() == (want, 9)
        put(f"{tmp_path}/in", "c", [job(7), job(8, "q")])
        assert run() == (want | {("ann", "job:progress", "j7"), ("eve", "job:progress", "j8")}, 11)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_refreshes_replace_members_and_are_asked_for(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    members = spark.createDataFrame([("p", "cat", "owner"), ("p", "dan", "member"), ("q", None, None)], "project_id string, user_id string, role string")
    lists = [r.asDict() for r in membership.refreshes(members).collect()]
    assert {r["project_id"]: len(json.loads(r["body"])) for r in lists} == {"p": 2, "q": 0}
    put(f"{tmp_path}/in", "a", [member("added", "ann", 1), *[{**r, "timestamp": "2024-01-01T00:00:02Z"} for r in lists], job(3)])
    parsed = E.read_events(spark, f"file://{tmp_path}/in").select(F.from_json("value", E.EVENT + ", body string").alias("e")).select("e.*")
    query = membership.deliver(parsed, refresh_seconds=1).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    try:
        got, deadline = [], time.monotonic() + 90
        while time.monotonic() < deadline and not {"p", "q"} <= {r["project_id"] for r in got if r["event"] == membership.STALE}:
            time.sleep(1)
            got = spark.read.schema(membership.OUT).parquet(f"file://{tmp_path}/out").collect() if glob.glob(f"{tmp_path}/out/_spark_metadata/0") else []
    finally:
        query.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert {r["to_user"] for r in got if r["event"] == "job:progress"} == {"cat", "dan"} and {r["project_id"] for r in got if r["event"] == membership.STALE} == {"p", "q"}
