"""Decontamination, quality rules, window dedup, near duplicates, importance resampling and the pipeline."""

import hashlib
import random
import re
import shutil
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from codelode.llm import decontaminate, importance, near_dup, quality_rules, queries, substring
from codelode.llm._tokens import windows, words
from tests.compare import connect, rows

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, block int"


def sentence(r: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{int(vocabulary * r.random() ** 2)}" for _ in range(n))


def table(spark, texts: list, ids: list | None = None):
    """Documents with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else f"s{(i or 0) % 2}", None, "clash", 1) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


# words


def test_words_and_windows():
    texts = ["", None, " a  b\tc\n", "é\x0bx y", "", "one"]
    w = words(pa.array(texts))
    plain = [WORD.findall(t or "") for t in texts]
    assert w.count.tolist() == [len(p) for p in plain]
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == [x for p in plain for x in p]
    h = words(pa.array(["a b A b a", "b a"])).hashes()
    assert h[0] == h[4] == h[6] and h[1] == h[3] == h[5] and h[0] != h[2]
    low = words(pa.array(["Ab aB É é"])).hashes(lower=True)
    assert low[0] == low[1] and low[2] != low[3]
    at, hs = windows(h, np.array([0, 0, 0, 0, 0, 1, 1]), 2)
    assert at.tolist() == [0, 1, 2, 3, 5] and hs[3] == hs[4] and len(set(hs.tolist())) == 4


# decontamination


def test_lcs():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


def test_leaks(spark):
    r = random.Random(3)
    items = [sentence(r, n, 3000) for n in (15, 24, 33, 48, 60)]
    texts = [sentence(r, r.randrange(5, 300), 3000) for _ in range(150)]
    planted = {10: 0, 20: 1, 30: 2, 40: 3, 50: 4, 60: 2, 70: 3}
    for d, i in planted.items():
        own = items[i].split()
        if d >= 60:  # paraphrases: words dropped and put in
            own = [w for k, w in enumerate(own) if k % 9] + ["extra"]
        at = r.randrange(len(texts[d].split()) + 1)
        texts[d] = " ".join([*texts[d].split()[:at], *own, *texts[d].split()[at:]])
    texts[50] = texts[50].upper()
    texts += [None, "", "short", sentence(r, 30_000, 3000)]
    docs = table(spark, texts)
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs, bench).collect()}
    assert got == set(planted.items())
    assert {x["doc_id"] for x in decontaminate.remove_leaks(docs, bench).collect()} == set(range(len(texts))) - set(planted)
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    with_answers = bench.selectExpr("item_id", "text", "'absent words' answer")
    assert decontaminate.find_leaks(docs, with_answers, answer_col="answer").count() == 0


def test_leaks_of_the_tables(spark, data):
    """All verbatim benchmark passages are found, and nothing else."""
    norm = lambda t: f" {' '.join(WORD.findall(t.lower()))} "
    items = [(r["item_id"], norm(r["text"])) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = {(r["doc_id"], i) for r in spark.read.parquet(f"{data}/documents.parquet").collect() for i, t in items if t.strip() in norm(r["text"])}
    assert {(r["doc_id"], r["item_id"]) for r in queries.op3_latent_decontamination(spark, data).collect()} == want


def test_long_items(spark):
    r = random.Random(4)
    items = [sentence(r, n, 3000) for n in (100, 134, 300, 1500)]
    texts = [sentence(r, 400, 3000) for _ in range(60)]
    for d, i in {5: 0, 15: 1, 25: 2, 35: 3, 45: 0, 55: 1}.items():
        own = items[i].split()
        if d >= 45:
            own = [f"new{k}" if k % 10 < 3 else w for k, w in enumerate(own)]
        texts[d] = " ".join([*texts[d].split()[: 3 * d], *own, *texts[d].split()[3 * d :]])
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(table(spark, texts), bench).collect()}
    assert got == {(5, 0), (15, 1), (25, 2), (35, 3), (45, 0), (55, 1)}


def test_paraphrases_at_every_offset(spark):
    """Items with 30 % of their words exchanged are found wherever they start, as by brute force over whole documents."""
    r = random.Random(6)
    items = [sentence(r, n, 3000) for n in (44, 48, 60, 90)]
    texts, planted = [], []
    for i, item in enumerate(items):
        for at in range(48):
            own = [f"new{at}x{k}" if k % 10 in (2, 5, 8) else w for k, w in enumerate(item.split())]
            texts.append(" ".join([*(f"b{r.randrange(10**6)}" for _ in range(at)), *own, *sentence(r, 60, 3000).split()]))
            planted.append(i)
    bench = spark.createDataFrame([(i, x, " ".join(x.split()[:2] + x.split()[-2:])) for i, x in enumerate(items)], "item_id long, text string, answer string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(table(spark, texts), bench, answer_col="answer").collect()}
    ids = lambda t: words(pa.array([t])).hashes(lower=True).tolist()
    brute = {(d, i) for d, i in enumerate(planted) if decontaminate.lcs(ids(items[i]), ids(texts[d])) >= 0.6 * len(items[i].split())}
    assert got == brute and len(brute) == len(texts)


def test_axes_are_fitted_on_all_documents(spark, monkeypatch):
    r = random.Random(7)
    fitted, axes = [], decontaminate.axes
    monkeypatch.setattr(decontaminate, "FIT_BYTES", 1000)  # texts exceed it, as large tables do
    monkeypatch.setattr(decontaminate, "axes", lambda docs, *args, **kw: fitted.append(docs.count()) or axes(docs, *args, **kw))
    texts = [sentence(r, 40, 3000) for _ in range(200)]
    bench = spark.createDataFrame([(1, texts[7])], "item_id long, text string")
    assert [(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(table(spark, texts), bench).collect()] == [(7, 1)]
    assert fitted == [200]


def test_axes_are_the_singular_vectors(spark):
    r = random.Random(2)
    texts = [" ".join([sentence(r, 64, 12), *["topic%d" % (i % 3)] * 20]) for i in range(60)]
    idf = np.ones(decontaminate.BUCKETS, np.float32)
    u, s = decontaminate.axes(table(spark, texts), idf, rank=20)
    x = np.zeros((0, decontaminate.BUCKETS))
    for t in texts:
        b = (words(pa.array([t])).hashes(lower=True) % np.uint64(decontaminate.BUCKETS)).astype(int)
        x = np.vstack([x, *[np.bincount(b[i : i + 64], minlength=decontaminate.BUCKETS) for i in range(0, len(b), 64)]])
    want = np.linalg.svd(x, compute_uv=False)[:3]
    assert np.allclose(s[:3], want, rtol=0.02)
    assert np.allclose(u.T @ u, np.eye(20), atol=1e-6)


# quality rules


def brute_counts(text: str) -> tuple:
    w = WORD.findall(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_quality_counts():
    r = random.Random(4)
    texts = [None, "", " \n\n", "a b c a b c", "x\nx\n x\n", "é|ü & <#>", "a a a a", *["\n".join(sentence(r, r.randrange(1, 9), 6) for _ in range(r.randrange(1, 12))) for _ in range(60)]]
    c = quality_rules.count_slab(pa.array(texts))
    assert list(zip(*(c[k].tolist() for k in quality_rules.COUNTS))) == [brute_counts(t or "") for t in texts]


def test_quality_verdicts(spark):
    r = random.Random(5)
    texts = [sentence(r, 200, 4000) for _ in range(130)] + ["%%% ".join(sentence(r, 200, 4000).split()), "few words", None, "", sentence(r, 60_000, 90_000)]
    got = {x["doc_id"]: x for x in quality_rules.judge(table(spark, texts)).collect()}
    assert all(got[i]["kept"] for i in range(130)) and not got[130]["kept"] and not got[130]["base_failed"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (131, 132, 133))
    assert got[134]["n_words"] == 60_000
    assert quality_rules.judge(spark.createDataFrame([], DOCS)).count() == 0


def test_sketch_quantiles(spark):
    """Quartiles of merged sketches are within a 32nd of the exact ones, whatever was merged."""
    r = np.random.default_rng(0)
    values = np.concatenate([r.integers(0, 60, 500), r.integers(1000, 90_000, 900)])
    df = spark.createDataFrame([(f"s{i % 7}", int(v)) for i, v in enumerate(values)], "source string, v long")
    from pyspark.sql import functions as F

    rows_ = df.select(F.lit("en").alias("lang"), "source", F.lit("m").alias("metric"), quality_rules.bucket(F.col("v")).alias("bucket")).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))
    q = quality_rules.quartiles(rows_, ["lang"]).first()
    for k, name in ((0.25, "q1"), (0.75, "q3")):
        exact = np.sort(values)[int(np.ceil(k * len(values))) - 1]
        assert exact * (1 - 1 / 32) - 1 <= q[name] <= exact


# window dedup


def brute_windows(texts: list, size: int) -> list:
    each = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in each for i in range(len(w) - size + 1))
    out = []
    for w in each:
        gone = {i + k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(size)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_window_dedup(spark):
    r = random.Random(6)
    passage = sentence(r, 50)
    texts = [sentence(r, r.randrange(0, 80)) for _ in range(40)] + [None, "", passage, f"a {passage} b", f"{sentence(r, 9)} {passage}", "x " * 100, sentence(r, 20_000, 10**6)]
    texts += [texts[0], " ".join(passage.split()[5:45])]
    for size in (35, 5):
        got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_text"]) for x in substring.remove_repeats(table(spark, texts), window=size).collect()}
        assert [got[i] for i in range(len(texts))] == brute_windows(texts, size)
    hashed = substring.remove_repeats(table(spark, ["a  b", None], [7, 7]), digest=True).collect()
    assert sorted(x["kept_sha256"] for x in hashed) == sorted(hashlib.sha256(t).hexdigest() for t in (b"a b", b""))
    assert substring.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_packed_hashes():
    x = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (substring.unpacked(substring.packed(x)) == x).all()
    assert substring._cuts(x, 7)[0] == 0 and substring._cuts(x, 7)[-1] == 1000 and len(substring._cuts(x, 1)) == 2


# near duplicates


def brute_components(texts: list, ids: list, percent: int = 85) -> dict:
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, d in enumerate(ids):
        if d is not None:
            c = find(i)
            least[c] = d if least[c] is None else min(least[c], d)
    return {i: (len(sets[i]), least[find(i)]) for i in range(len(texts))}


def test_near_duplicates(spark):
    r = random.Random(8)
    texts, ids = [None, "", "  ", "one two", "One TWO", "one two three"], [50, 51, 52, 40, 41, 42]
    for base in range(12):
        own = sentence(r, r.choice([8, 30, 120])).split()
        for copy in range(r.randrange(1, 9)):
            w = list(own)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
            texts.append(" ".join(w))
            ids.append(1000 - 10 * base + copy)
    chain = sentence(r, 100, 10**6).split()
    for k in range(8):  # each is near the next, the ends are not near each other
        chain = [*chain[3:], *(f"c{k}{i}" for i in range(3))]
        texts.append(" ".join(chain))
        ids.append(2000 - k)
    want = brute_components(texts, ids)
    got = near_dup.near_duplicates(table(spark, texts, ids).repartition(3)).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == {d: want[i] for i, d in enumerate(ids)}
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    kept = near_dup.keep_one(table(spark, texts, ids)).collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(x["doc_id"] for x in got if x["kept"]) and kept[0]["kept"] == "clash"


def test_repeated_and_null_ids(spark):
    text = "a b c d e f g h"
    rows_ = near_dup.near_duplicates(table(spark, [text, text, text, "other words are in this one"], [5, 5, None, None])).collect()
    assert Counter((x["doc_id"], x["component_id"], x["kept"]) for x in rows_) == {(5, 5, True): 2, (None, 5, False): 1, (None, None, True): 1}
    assert near_dup.keep_one(table(spark, [text, text, text, None], [5, 5, 4, 6])).count() == 2


def test_pairs_within_the_distance_always_meet():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 16, (400, near_dup.POSITIONS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = r.choice(near_dup.POSITIONS, r.integers(0, near_dup.WITHIN + 1), replace=False)
        row[at] = r.integers(0, 1 << 16, len(at))
    ka, kb = near_dup.chunk_keys(a), near_dup.chunk_keys(b)
    shared = ka == kb
    assert shared.any(1).all()
    assert (near_dup.first_shared(a, b) == shared.argmax(1)).all()
    assert near_dup.CHUNKS * 2 > near_dup.WITHIN


def test_pairs_between_80_and_85(spark):
    r = random.Random(12)
    texts = []
    for _ in range(40):  # five words changed, each in five of 221 shingles: 196 of 246 are shared; the four-word ones are 201 of 241
        own = sentence(r, 225, 10**6).split()
        texts += [" ".join(own), " ".join(f"x{k}" if k in (20, 60, 100, 140) else w for k, w in enumerate(own))]
        texts.append(" ".join(f"y{k}" if k in (30, 70, 110, 150, 190) else w for k, w in enumerate(own)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    share = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for k in range(0, 120, 3) for i, j in ((k, k + 1), (k, k + 2))]
    assert all(0.8 <= x < 0.85 for x in share[::2]) and all(0.79 < x < 0.8 for x in share[1::2])
    want = brute_components(texts, list(range(120)), percent=80)
    got = near_dup.near_duplicates(table(spark, texts), similarity=0.8).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want
    kept = corpus_pipeline.near_duplicates(spark, table(spark, texts), "").collect()
    assert {x["doc_id"] for x in kept} == {d for d, (_, c) in want.items() if c == d} and len(kept) == 80


def test_limits_of_other_similarities():
    r = np.random.default_rng(6)
    for similarity in (0.8, 0.85, 0.9):
        within, chunks = near_dup.limits(similarity)
        assert 2 * chunks > within and (r.random((10**5, 64)) > similarity).sum(1).max() <= within + 1
        a = r.integers(0, 1 << 16, (200, 64)).astype(np.uint16)
        b = a.copy()
        for row in b:
            row[r.choice(64, within, replace=False)] ^= 1
        assert (near_dup.first_shared(a, b, chunks) < 64).all()
        assert ((near_dup.chunk_keys(a, chunks) == near_dup.chunk_keys(b, chunks)).any(1)).all()
    assert near_dup.limits(0.85) == (23, 12)


def test_parity_never_exceeds_the_difference():
    r = np.random.default_rng(4)
    pool = r.integers(0, 1 << 62, 3000).astype(np.uint64)
    sets = [np.unique(r.choice(pool, r.integers(1, 1500))) for _ in range(30)]
    bits = near_dup.parity(sets)
    for i in range(30):
        for j in range(i):
            assert np.bitwise_count(bits[i] ^ bits[j]).sum() <= len(np.setxor1d(sets[i], sets[j]))


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 6), (20, 20), *[(100, i) for i in range(101, 160)], (159, 200), (-5, 200)]
    got = {r["node"]: r["comp"] for r in near_dup.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **{i: 6 for i in range(6, 11)}, **{i: -5 for i in [-5, 100, *range(101, 160), 200]}}


def test_search_across_components_leaves_nothing_out(spark, monkeypatch):
    """With a reporting limit of one pair and small tiles the components are the same."""
    monkeypatch.setattr(near_dup, "KEEP", 1)
    monkeypatch.setattr(near_dup, "TILE", 3)
    r = random.Random(9)
    own = sentence(r, 60, 10**6).split()
    texts = []
    for _ in range(25):
        w = list(own)
        for _ in range(r.choice([1, 2])):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(w))
    want = brute_components(texts, list(range(25)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dup.near_duplicates(table(spark, texts)).collect()}
    assert got == want


# importance resampling


def test_resampling(spark):
    r = random.Random(10)
    texts = [sentence(r, 120, 300) + (" awful nasty" if i % 5 == 0 else "") for i in range(600)] + [None, ""]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 600, 2)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in importance.resample(table(spark, texts), labels).collect()}
    clean = [i for i in range(600) if i % 5]
    assert np.mean([got[i]["kept"] for i in clean]) > 0.95 and np.mean([got[i]["kept"] for i in range(0, 600, 5)]) < 0.3
    assert got[600]["log_weight"] == got[601]["log_weight"] == 0 and got[600]["n_features"] == 0
    top = importance.resample(table(spark, texts), labels, k=100).where("kept").collect()
    assert {x["doc_id"] for x in top} == set(sorted(got, key=lambda i: -got[i]["gumbel_key"])[:100])
    assert importance.resample(table(spark, texts[:9]), labels.limit(0)).count() == 9
    assert importance.resample(spark.createDataFrame([], DOCS), labels).count() == 0


def test_weights_by_brute_force():
    ratio = np.random.default_rng(0).normal(size=1 << 10).astype(np.float32)
    doc, b = importance.features(pa.array(["a b a b", None, "X1 y!!"]), 1 << 10)
    assert sorted(set(doc.tolist())) == [0, 2] and len(set(zip(doc.tolist(), b.tolist()))) == len(doc)
    again, c = importance.features(pa.array(["X1 y!!"]), 1 << 10)
    assert np.isclose(ratio[b[doc == 2]].sum(), ratio[c].sum())
    same = importance.shapes(words(pa.array(["Ab Cde x1 Y2 éa!! ab!!"])))
    assert same[0] == same[1] and same[2] != same[3] and same[4] == same[5]


def test_kth_largest(spark):
    values = [5, 5, -3, 2**62, -(2**62), 0, 7, 7, 7]
    df = spark.createDataFrame([(v,) for v in values], "key long")
    assert [importance.kth_largest(df, "key", k) for k in range(0, 11)] == [None, *sorted(values, reverse=True), None]


def test_gumbel_sampling_follows_the_weights(spark):
    df = spark.range(40_000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN ln(3.0D) ELSE 0.0D END w")
    keyed = df.withColumn("key", df["w"] + importance.gumbel())
    top = [r["doc_id"] % 2 for r in keyed.orderBy(keyed["key"].desc()).limit(2000).collect()]
    assert 0.22 < np.mean(top) < 0.28  # one in four is of the lighter kind


# queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_oracle(spark, data, name):
    got = queries.queries()[name](spark, data).toPandas()
    want = connect(data).execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    r = random.Random(11)
    item = sentence(r, 40, 5000)
    base = sentence(r, 150)
    texts = [base, base + " tail", base, "12345 !!", None, "", f"{sentence(r, 50)} {item} {sentence(r, 30)}", "write to a@b.cd " + sentence(r, 60), *[sentence(r, 90, 5000) for _ in range(30)]]
    docs = spark.createDataFrame([(i, t, None if i == 8 else "en", f"s{i}", len(t or "")) for i, t in enumerate(texts)] + [(0, base, "en", "again", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            now = spark.read.parquet(f"{tmp_path}/{name}")
            seen.append({x["doc_id"]: x for x in now.collect()})
            assert now.count() == len(seen[-1]) or name == "language"
    everything = set(range(len(texts)))
    assert [set(s) for s in seen] == [everything - {3, 4, 5}, everything - {1, 2, 3, 4, 5}, everything - {1, 2, 3, 4, 5, 6}, everything - {1, 2, 3, 4, 5, 6}]
    assert seen[0][8]["lang"] == "en" and seen[3][7]["text"].startswith("write to [EMAIL] ") and seen[3][7]["n_chars"] == len(seen[3][7]["text"])
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in final} == set(seen[3])
    assert sorted(map(tuple, out.collect())) != [] and len(corpus_pipeline.STAGES) == 5
    shutil.rmtree(f"{tmp_path}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
