"""Range joins in bins against brute force."""

import random

import pytest

from codelode.operators import ranges


@pytest.fixture(scope="module")
def sides(spark):
    """Nested, equal, one-line, huge and empty spans, null bounds and files; one file has most of the points."""
    r = random.Random(3)
    spans = [(f"f{r.randrange(4)}", a := r.randrange(-50, 500), a + r.choice([0, 0, 1, 3, 30, 200]), i) for i in range(300)] + [("f0", -(10**12), 10**12, 300), ("f1", 9, 5, 301), ("f1", None, 5, 302), (None, 0, 9, 303), ("f2", 7, 7, 304), ("f2", 7, 7, 305)]
    points = [(i, r.choice(["f0", "f0", "f0", "f1", "f2", "f9"]), r.randrange(-60, 700)) for i in range(500)] + [(500, "f0", None), (501, None, 3), (502, "f2", 7), (502, "f2", 7), (503, "f0", 10**13)]
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl).repartition(3)
    return points, spans, df(points, "ref long, file string, line long"), df(spans, "file string, first long, last long, id long")


def _around(points, spans):
    return [(k, [(e - s, i) for f, s, e, i in spans if f == file and f is not None and s is not None and line is not None and s <= line <= e]) for k, file, line in points]


def test_tightest(sides):
    points, spans, p, s = sides
    got = ranges.tightest(p, s.withColumn("nth", s["id"]), ["file"], "ref", "line", "first", "last", "id", "nth")
    assert sorted((r["ref"], r["id"]) for r in got.collect() if r["id"] is not None) == sorted((k, min(hits)[1]) for k, hits in _around(points, spans) if hits)
    assert got.count() == len(points)


def test_inside_any(sides):
    points, spans, p, s = sides
    inside = {k for k, hits in _around(points, spans) if hits}
    args = (p, s, ["file"], "ref", "line", "first", "last")
    assert sorted(r["ref"] for r in ranges.inside_any(*args).collect()) == sorted(k for k, *_ in points if k in inside)
    assert sorted(r["ref"] for r in ranges.inside_any(*args, inside=False).collect()) == sorted(k for k, *_ in points if k not in inside)
    assert ranges.inside_any(p, s.where("id < 0"), *args[2:]).count() == 0


def test_joins_are_by_bin(sides):
    _, _, p, s = sides
    df = ranges.tightest(p, s.withColumn("nth", s["id"]), ["file"], "ref", "line", "first", "last", "id", "nth")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "__bin" in plan and "Cross" not in plan
    levels = ranges.levels_of(s, "first", "last")
    assert len(levels) <= 64 and ranges.binned_spans(s.where("first <= last"), "first", "last").groupBy("id").count().where("count > 2").count() == 0


def test_rows_do_not_grow_with_spans_over_a_place(spark):
    """20,000 spans and as many points of one file, all over each other: 4 * 10^8 pairs, of which none is made."""
    from tests.plan_rows import most_rows

    n = 20_000
    spans = spark.range(n).selectExpr("'f' AS file", "-id AS first", "id AS last", "id")
    points = spark.range(n).selectExpr("id AS ref", "'f' AS file", "id % 5000 AS line")
    df = ranges.tightest(points, spans.withColumn("nth", spans["id"]), ["file"], "ref", "line", "first", "last", "id", "nth")
    assert df.where("id = line").count() == n
    assert most_rows(df) < 60 * n
    assert ranges.marked(points, spans.where("id < 100"), ["file"], "line", "first", "last", "inside").where("inside").count() == 100 * 4


def test_bins_fill_spans(spark):
    edge = 2**63 - 1
    spans = [(a, b) for a in range(-9, 10) for b in range(-9, 26)] + [(edge - 5, edge), (-edge - 1, -edge + 5)]
    rows = ranges.filling_bins(spark.createDataFrame(spans, "a long, b long"), "a", "b").select("a", "b", "__level", "__bin").collect()
    held = {}
    for a, b, level, at in rows:
        held.setdefault((a, b), []).extend(range(at << level, (at + 1) << level))
    assert {k: sorted(v) for k, v in held.items()} == {(a, b): list(range(a, b + 1)) for a, b in spans if a <= b}
