"""Joins of many rows with many."""

from collections import Counter

from pyspark.sql import functions as F

from codelode.operators import access, fanout


def test_every_pair(spark):
    a = [(k, i) for k, n in ((1, 5000), (2, 3), (3, 1)) for i in range(n)] + [(None, 7), (2, 1)]
    b = [(k, f"u{i}") for k, n in ((1, 3000), (2, 4), (4, 9)) for i in range(n)] + [(None, "x"), (2, None)]
    left, right = spark.createDataFrame(a, "k int, i long"), spark.createDataFrame(b, "k int, u string")
    got = fanout.every_pair(left, right, ["k"])
    assert got.columns == ["k", "i", "u"] and got.where("k = 1").distinct().count() == got.where("k = 1").count() == 5000 * 3000
    assert Counter(map(tuple, got.where("k != 1").collect())) == Counter((k, i, u) for k, i in a for j, u in b if k == j and k == 2)
    most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 0.7 * got.count()  # one key, several tasks
    assert fanout.every_pair(left.where("false"), right, ["k"]).count() == 0


def test_a_tasks_share_of_key_access_is_a_part(spark):
    """Keys and memberships of a single user are dealt to several tasks."""
    keys = spark.range(6000).selectExpr("id AS api_key_id", "'personal' AS key_type", "'write' AS role", "true AS is_active", "CAST(NULL AS timestamp_ntz) AS expires_at", "id AS project_id", "1 AS created_by")
    members = spark.range(6000).selectExpr("1 AS user_id", "id AS project_id", "CASE id % 3 WHEN 0 THEN 'owner' WHEN 1 THEN 'member' ELSE 'guest' END AS role")
    got = access.key_access(keys, members, F.lit("2000-01-01").cast("timestamp_ntz"))
    shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 6000 * 4000 and max(shares) < 0.7 * sum(shares)
    assert {tuple(r) for r in got.groupBy("effective_role").count().collect()} == {("write", 6000 * 2000), ("read", 6000 * 2000)}


def test_pairs_come_in_runs_from_a_bounded_number_of_tasks(spark, monkeypatch):
    """No explode, which would hold all pairs of a tile as rows; columns asked for only; nulls stay; tasks do not grow with the pairs for ever."""
    monkeypatch.setattr(fanout, "PAIRS", 1000)
    monkeypatch.setattr(fanout, "TASKS", 6, raising=False)
    left = spark.createDataFrame([("a", i if i else None) for i in range(300)] + [("b", 1)], "k string, i int")
    right = spark.createDataFrame([("a", i, f"u{i}") for i in range(400)] + [("b", 5, None)], "k string, j long, u string")
    whole = fanout.every_pair(left, right, ["k"])
    assert whole.rdd.getNumPartitions() == 6 and "Generate" not in whole._jdf.queryExecution().executedPlan().toString()
    want = {("a", i or None, j, f"u{j}") for i in range(300) for j in range(400)} | {("b", 1, 5, None)}
    assert whole.count() == len(want) and set(map(tuple, whole.collect())) == want
    monkeypatch.setattr(fanout, "RUN", 70)
    some = fanout.every_pair(left, right, ["k"], ["u", "i"])
    assert some.columns == ["u", "i"] and Counter(map(tuple, some.collect())) == Counter((u, i) for _, i, _, u in want)
