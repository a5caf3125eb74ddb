"""Clustering, sharding and the prefix trie: SQL on the given tables, and brute force on hard cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codelode.llm import centroids, oracles, prefix_trie, queries, sharding
from tests.compare import connect, rows


@pytest.mark.parametrize("name", ["op11_centroids", "op12_stratified_shards", "op13_prefix_trie"])
def test_matches_sql(spark, data, name):
    got, want = queries.queries()[name](spark, data).toPandas(), connect(data).execute(oracles.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# --- clustering


def brute_kmeans(vectors, k, rounds, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x * 1024) < centroids.LARGEST for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    at = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        own = defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign()):
            own[j].append(v)
        at = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(at)]
    last = assign()
    inertia = Counter()
    for d, j in last:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, last)), key=repr)


def test_kmeans_of_hard_vectors(spark):
    r = random.Random(5)
    some = [[r.uniform(-3, 3) for _ in range(4)] for _ in range(120)]
    vectors = [(i, v) for i, v in enumerate(some)] + [(1000 + i, some[0]) for i in range(60)] + [(7, some[1]), (7, some[1]), (None, some[2]), (None, [0.5, 0.25, -0.001, 0.0]), ((1 << 60) + 1, some[3])]
    vectors += [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0]), (2003, [float("nan"), 0.0, 0.0, 0.0]), (2004, [float("inf"), 0.0, 0.0, 0.0]), (2005, [1e30, 0.0, 0.0, 0.0]), (2006, [1.0] * 5), (2007, [180_000.0, -180_000.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<double>, v string, cluster int").repartition(5)
    got = centroids.kmeans(df, k=6, rounds=4, dims=4).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute_kmeans(vectors, 6, 4, 4)
    few = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((x["vec_id"], x["cluster"], x["distance"]) for x in centroids.kmeans(few, dims=2).collect()) == [(1, 0, 0), (2, 0, 0)]
    none = centroids.kmeans(df.where("vec_id = 2000"), dims=4)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_distances_up_to_a_long(spark):
    x = (centroids.LARGEST - 1) / 1024
    df = spark.createDataFrame([(i, [x if i % 2 else -x] * 64) for i in range(8)] + [(9, [0.0] * 64)], "vec_id long, embedding array<double>")
    got = centroids.kmeans(df, k=1, rounds=0).collect()
    assert max(r["distance"] for r in got) > 1 << 62 and all(r["inertia"] == (1 << 63) - 1 for r in got)


# --- sharding


def documents(spark, some):
    return spark.createDataFrame(some, "doc_id long, text string, source string, shard string, place int")


def test_shards_have_the_mixture(spark):
    """A source with most rows, many of one row each, rows without id, source or text, repeated rows and clashing columns."""
    some = [(i, f"text é {i}", "hot", "x", 0) for i in range(4000)] + [(10_000 + i, "same", f"one{i}", "x", 0) for i in range(400)] + [(20_000 + i, "t" * i, "small", "x", 0) for i in range(80)]
    some += [(None, None, None, "x", 0)] * 300 + [(5, "repeated", "hot", "x", 0)] * 300
    df = documents(spark, some).repartition(7)
    got = sharding.sharded(df).toPandas()
    assert list(got.columns) == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    counts = got.groupby("shard").size()
    assert len(got) == len(some) and len(counts) == 8 and counts.max() - counts.min() <= 1
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    expected = Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in some)
    assert Counter(zip(got["size"], got["text_crc32"])) == expected and set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
    again = sharding.sharded(documents(spark, list(reversed(some)))).toPandas()
    key = lambda f: sorted(map(repr, f.astype(object).itertuples(index=False)))
    assert key(got) == key(again)
    source = {i: s for i, _, s, *_ in some}
    mix = Counter((shard, (source[int(i)] or "")[:3]) for i, shard in zip(got["doc_id"], got["shard"]) if i == i)
    assert all(abs(mix[s, "sma"] - 10) <= 1 and abs(mix[s, "one"] - 50) <= 25 and abs(mix[s, "hot"] - 4300 / 8) <= 26 for s in range(8))
    assert sharding.sharded(df.where("doc_id < 0")).count() == 0


def test_few_rows_and_written_shards(spark, tmp_path):
    got = sharding.sharded(documents(spark, [(i, "a", "s", None, None) for i in range(3)])).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (2, 0), (5, 0)]
    df = spark.createDataFrame([(i, f"text {i}", f"src{i % 3}", "k", i) for i in range(200)], "doc_id long, text string, source string, `a.b` string, slot int").repartition(6)
    sharding.write_shards(df, at := f"file://{tmp_path}/shards")
    back = spark.read.parquet(at)
    placed = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.place(df).collect()}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in back.collect()} == placed and "a.b" in back.columns
    assert back.where(F.concat(F.lit("text "), "doc_id") == F.col("text")).count() == 200 and len(list((tmp_path / "shards").glob("shard=*"))) == 8


# --- conversations


def brute_trie(conversations):
    """{(conv_id, depth): the rest of the node} of {conv_id: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, own in members.items():
        words = len([w for w in "".join(" " if c in " \t\n\v\f\r" else "x" for c in k[-1][1]).split(" ") if w]) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(own) - 1) * words
            leaves[k[:d]] += k not in children
    ends = {k: hashlib.sha256(",".join(str(c) for c in sorted(own) if len(conversations[c]) == len(k)).encode()).hexdigest() for k, own in members.items()}
    return {(min(own), len(k)): (min(members[k[:-1]]) if k else None, len(own), children[k], leaves[k], saved[k], ends[k]) for k, own in members.items()}


def rebuilt(turns):
    """The contract's rebuilt conversations from rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, n, role, text in turns:
        if c is not None:
            own[c].append((n is not None, n or 0, role or "", text or ""))
    whole = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in whole}
    return {c: whole.get(c - c % 20, [])[: h[c]] + x[h[c] :] for c, x in whole.items()}


def found(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def table(spark, turns):
    return spark.createDataFrame([(*t, "k", 1) for t in turns], "conv_id long, turn long, role string, text string, path string, n int").repartition(5)


@pytest.mark.parametrize("limit", [1, 30, 20_000])
def test_trie_of_hard_conversations(spark, limit):
    """Hot first turns, long shared prefixes, equal conversations, ones that end inside others, nulls, ties and missing heads."""
    r = random.Random(7)
    some = []
    for c in range(300):
        turns = [("user", "hello there friend")] if c % 3 else [("user", f"own {c % 50} x")]
        if c % 3 == 1:
            turns += [("assistant", f"step {i}") for i in range(12)]
        turns += [(r.choice(["user", "assistant"]), r.choice(["yes", "no", "maybe so", ""])) for _ in range(r.randrange(4))]
        some += [(c, i, *t) for i, t in enumerate(turns)]
    some += [(c, i, "user", f"all {i}") for c in range(400, 460) for i in range(6)]
    some += [(500, None, None, None), (500, None, "user", "first"), (500, 3, "b", "tie two"), (500, 3, "b", "tie one"), (500, 3, "a", "tie"), (500, 3, "a", "tie"), (501, 1, "", ""), (None, 1, "user", "nobody"), ((1 << 60) + 1, 0, "u", "big"), (621, 0, "u", "x")]
    want = brute_trie(rebuilt(some))
    assert found(prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.conversations_of(table(spark, some))), limit)) == want
    assert any(n == () for n in map(tuple, rebuilt(some).values())), "a turnless conversation is among them"


def test_trie_of_nothing_and_of_one(spark, monkeypatch):
    assert prefix_trie.shared_prefixes(table(spark, [(1, 0, "u", "x")]).where("conv_id = 0")).count() == 0
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    same = [(c, i, "u", f"w {i}") for c in range(25) for i in range(3)]
    plain = defaultdict(list)
    for c, _, role, text in same:
        plain[c].append((role, text))
    assert found(prefix_trie.trie(prefix_trie.conversations_of(table(spark, same)))) == brute_trie(plain)


def test_deep_conversation_and_long_text(spark):
    some = [(c, i, "u", f"t{i}") for c in (1, 2) for i in range(3000)] + [(2, 3000, "u", "end"), (3, 0, "u", "word " * 300_000)]
    whole = defaultdict(list)
    for c, _, role, text in some:
        whole[c].append((role, text))
    got = found(prefix_trie.trie(prefix_trie.conversations_of(table(spark, some)), 1000))
    assert len(got) == 1 + 3000 + 1 + 1 and got[1, 1][1] == 2 and got[1, 1][4] == 3000 and got[2, 3001][0] == 1 and got[3, 1][4] == 0 and got[1, 0][2] == 2
