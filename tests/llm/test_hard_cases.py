"""Adversarial, very long, very deep and foreign inputs of the corpus operators, and their recall on planted cases."""

import gzip
import hashlib
import math
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codelode.llm import decontaminate, html_text, importance, langid, near_dup, packing, pii, substring, warc
from codelode.llm._tokens import windows, words
from tests.llm.test_corpus_operators import WORD, brute_components, sentence, table


def thue_morse(k: int) -> tuple[str, str]:
    """A word of 2^k letters and its complement: equal under every polynomial hash modulo a power of two."""
    t = [bin(i).count("1") & 1 for i in range(1 << k)]
    return "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)


def test_hashes_tell_structured_words_apart():
    a, b = thue_morse(11)
    h = words(pa.array([f"{a} {b} {a[:64]} {b[:64]} {a[:65]}"])).hashes()
    assert len(set(h.tolist())) == 5
    every = [f"{x}{y}" for x in "abcdefgh" for y in range(5000)]
    assert len(set(words(pa.array([" ".join(every)])).hashes().tolist())) == len(every)
    w = words(pa.array([" ".join("xy"[bin(i).count("1") & 1] for i in range(4096))]))
    plain = ["xy"[bin(i).count("1") & 1] for i in range(4096)]
    for size in (1, 2, 5, 35, 64):
        at, hs = windows(w.hashes(), w.doc, size)
        assert len(set(hs.tolist())) == len({tuple(plain[i : i + size]) for i in at.tolist()})


def test_window_dedup_of_a_million_equal_rows(spark):
    copy = " ".join(f"w{i}" for i in range(100))
    other = "x " + " ".join(f"w{i}" for i in range(40)) + " y"
    short = "a b c"
    rows = [(7, copy, 1_000_000), (1, other, 1), (2, short, 5000), (3, short, 1), (None, None, 3), (4, " ".join(f"z{i}" for i in range(50)), 1)]
    docs = substring.repeated(spark.createDataFrame(rows, "doc_id long, text string, copies long"))
    start = time.time()
    got = {(x["doc_id"], x["n_words"], x["n_removed"], x["kept_text"]): x["count"] for x in substring.remove_repeats(docs).groupBy("doc_id", "n_words", "n_removed", "kept_text").count().collect()}
    assert time.time() - start < 60
    assert got == {(7, 100, 100, ""): 1_000_000, (1, 42, 40, "x y"): 1, (2, 3, 0, short): 5000, (3, 3, 0, short): 1, (None, 0, 0, ""): 3, (4, 50, 0, rows[5][1]): 1}


def test_window_dedup_of_structured_words_and_null_ids(spark):
    a, b = thue_morse(10)
    r = random.Random(1)
    tail = sentence(r, 34, 10**6)
    texts = [f"{a} {tail}", f"{b} {tail}", *[sentence(r, 40, 10**6) for _ in range(3000)]]
    docs = table(spark, texts, [None] * len(texts))
    got = Counter((x["n_words"], x["n_removed"]) for x in substring.remove_repeats(docs).collect())
    assert got == {(35, 0): 2, (40, 0): 3000}
    blocks = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(24)).alias("b")).distinct().count()
    assert blocks == 24


def test_windows_are_confirmed_on_their_words(spark):
    """With Rabin-Karp hashes of four bits most windows collide, and none is removed for it."""
    r = random.Random(2)
    passage = sentence(r, 40, 10**6)
    texts = [sentence(r, 60, 10**6) for _ in range(50)] + [passage, f"{sentence(r, 5, 10**6)} {passage}"]
    got = {x["doc_id"]: x["n_removed"] for x in substring.remove_repeats(table(spark, texts), hash_bits=4).collect()}
    assert got == {**{i: 0 for i in range(50)}, 50: 40, 51: 40}


def test_near_duplicates_of_structured_words(spark):
    a, b = thue_morse(10)
    texts = [a, b, "", "", "  ", None]
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(table(spark, texts)).collect()}
    assert got == {i: i for i in range(6)}
    kept = near_dup.keep_one(table(spark, [*texts, a], [None, None, None, None, 7, 7, None])).collect()
    assert len(kept) == 6  # rows without words all stay, and one of the two that repeat


def test_near_duplicate_recall_at_the_threshold(spark):
    """Pairs of similarity 0.85 to 0.87: every link is found, as by brute force."""
    r = random.Random(3)
    texts = []
    for _ in range(400):  # k words changed apart from one another, each in five of n shingles: similarity (n - 5k) / (n + 5k)
        k = r.randrange(2, 7)
        n = next(n for n in range(10 * k, 1000) if 100 * (n - 5 * k) >= 85 * (n + 5 * k)) + r.randrange(3)
        own = sentence(r, n + 4, 10**7).split()
        at = {4 + (n - 4) // k * i for i in range(k)}
        texts += [" ".join(own), " ".join(f"x{j}" if j in at else w for j, w in enumerate(own))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    share = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(texts), 2)]
    assert np.mean([0.85 <= x < 0.875 for x in share]) > 0.9
    want = brute_components(texts[:120], list(range(120)))
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(table(spark, texts)).collect()}
    assert all(got[i] == c for i, (_, c) in want.items())
    assert all((got[2 * i + 1] == 2 * i) == (x >= 0.85) for i, x in enumerate(share))


def test_chance_of_a_lost_link():
    for similarity in (0.8, 0.85):
        within, chunks = near_dup.limits(similarity, near_dup.LOST)
        lost = sum(math.comb(64, k) * (1 - similarity) ** k * similarity ** (64 - k) for k in range(within + 1, 65))
        assert lost <= near_dup.LOST <= 2e-6 and 2 * chunks > within


def finder(items: list[str], texts: list[str]):
    """decontaminate's search of a slab, without Spark: batch of hashes to {(doc_id, item_id): (cosine, lcs)}, and the batch of texts."""
    latent = np.random.default_rng(2).standard_normal((decontaminate.BUCKETS, 64)).astype(np.float32)
    asked = pa.table({"item_id": list(range(len(items))), "text": items, "answer": pa.array([None] * len(items), pa.string())})
    shared = type("Shared", (), {"value": (latent, decontaminate.prepare(asked, latent, np.ones(decontaminate.BUCKETS, np.float32)))})
    raw = [words(pa.array([t])).hashes().tobytes() for t in texts]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "hashes"])

    def found() -> dict:
        out = [x for b in decontaminate._finder(shared, decontaminate.LCS)(iter([batch])) for x in b.to_pylist()]
        return {(x["doc_id"], x["item_id"]): (round(x["cosine"], 5), x["lcs"]) for x in out}

    return found


def test_pieces_of_texts_give_what_whole_texts_give(monkeypatch):
    r = random.Random(9)
    items = [sentence(r, n, 2000) for n in (4, 12, 20, 45, 70, 150, 400)]
    texts = []
    for d in range(60):
        own = sentence(r, r.choice((0, 1, 9, 200, 3000)), 2000).split()
        w = [x if r.random() > 0.2 else "other" for x in items[d % len(items)].split()] if d % 4 else []
        at = r.randrange(len(own) + 1)
        texts.append(" ".join([*own[:at], *w, *own[at:]]))
    find, got = finder(items, texts), []
    for size in (1 << 30, 4096, 7, 1):
        monkeypatch.setattr(decontaminate, "PIECE", size)
        got.append(find())
    assert len(got[0]) > 30 and all(x == got[0] for x in got)


def test_memory_of_a_long_text_and_a_thousand_items():
    r = random.Random(10)
    items = [sentence(r, 40, 30000) for _ in range(1000)]
    long = sentence(r, 10000, 30000).split() * 40
    long[300_000:300_040] = items[3].split()
    find = finder(items, [" ".join(long)])
    tracemalloc.start()
    got = find()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(got) == {(0, 3)} and peak < 250 << 20, peak


def test_verbatim_items_of_any_length(spark):
    r = random.Random(4)
    items = [" ".join(f"i{k}x{r.randrange(4000)}" for _ in range(n)) for k, n in enumerate((3, 5, 8, 15, 40, 120, 140, 160, 200, 400, 2000))]
    texts = [sentence(r, 120, 3000) for _ in range(3 * len(items))]
    for i, item in enumerate(items):
        own = texts[3 * i].split()
        at = r.randrange(len(own))
        texts[3 * i] = " ".join([*own[:at], item.upper(), *own[at:]])
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(table(spark, texts), bench).collect()} == {(3 * i, i) for i in range(len(items))}


def test_recall_by_level_of_paraphrase(spark):
    """Of planted paraphrases that keep an LCS of 0.6, at least nine in ten are found at every level, and nothing else is."""
    r = random.Random(5)
    items = [sentence(r, n, 4000) for n in (16, 20, 24, 32, 40, 48, 60, 90) for _ in range(4)]
    texts, planted = [sentence(r, 200, 4000) for _ in range(300)], {}
    for level in (0.1, 0.2, 0.3, 0.35):
        for i, item in enumerate(items):
            w = item.split()
            for k in r.sample(range(len(w)), round(level * len(w))):
                w[k] = sentence(r, 1, 4000)
            host = sentence(r, 150, 4000).split()
            at = r.randrange(len(host))
            planted[len(texts)] = (i, level)
            texts.append(" ".join([*host[:at], *w, *host[at:]]))
    ids = lambda t: words(pa.array([t])).hashes(lower=True).tolist()
    sure = {d: (i, level) for d, (i, level) in planted.items() if decontaminate.lcs(ids(items[i]), ids(texts[d])) >= 0.6 * len(items[i].split())}
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(table(spark, texts), bench).collect()}
    for level in (0.1, 0.2, 0.3, 0.35):
        own = [(d, i) for d, (i, lv) in sure.items() if lv == level]
        assert np.mean([x in got for x in own]) >= 0.9, level
    assert {d for d, _ in got} <= set(planted)


def test_index_of_items_finds_what_brute_force_finds():
    g = np.random.default_rng(6)
    unit = lambda v: (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    v = unit(g.standard_normal((20_000, 64)))
    centers, members = decontaminate.cells(v)
    assert sorted(np.concatenate(members).tolist()) == list(range(len(v)))
    n = len(v)
    items = decontaminate.Items(2, list(range(n)), v, np.full(n, 0.7, np.float32), [], np.zeros(n), [], np.zeros(n), centers, members)
    x = unit(v[g.integers(0, n, 2000)] + 0.09 * g.standard_normal((2000, 64)))
    p, j = items.near(x)
    brute = {(a, b) for a, b in zip(*(y.tolist() for y in np.nonzero(x @ v.T >= 0.7)))}
    got = set(zip(p.tolist(), j.tolist()))
    assert got <= brute and len(got) >= 0.9 * len(brute) and len(brute) > 1500


def test_ids_are_those_of_tokenizers(spark):
    """With the tokenizer as it is loaded, added tokens in texts and very long runs of one kind."""
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    r = random.Random(7)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "", "x" + " " * 5_000_000 + "y <|endoftext|>", "a" * 5_000_000, "\n" * 1_000_000 + "\t z", "é " * 20_000, sentence(r, 3000)]
    encode = packing.encoder(path, True)
    for t, ids in zip(texts, encode(texts)):
        assert ids == own.encode(t, add_special_tokens=False).ids
    rows = packing.pack(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), path, added_tokens=True)
    total = {x["doc_id"]: (x["n"], x["t"]) for x in rows.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()}
    assert total == {i: (len(ids) + 1,) * 2 for i, ids in enumerate(encode(texts))}


def test_foreign_archives(spark, tmp_path):
    def plain(kind: str, block: bytes, **more: str) -> bytes:
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:35f0-{kind}>", "Content-Length": str(len(block))} | {k.replace("_", "-"): v for k, v in more.items()}
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    info = plain("warcinfo", b"software: x\r\n")
    page = plain("response", b"HTTP/1.1 200 OK\r\nServer: y\r\n\r\nbody", WARC_Target_URI="http://a/%41", WARC_Block_Digest="sha256:" + hashlib.sha256(b"HTTP/1.1 200 OK\r\nServer: y\r\n\r\nbody").hexdigest())
    again = plain("revisit", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Refers_To="<urn:uuid:35f0-response>")
    folded = plain("metadata", b"k: v").replace(b"WARC-Record-ID: ", b"X-Long: one\r\n two\r\nWARC-Record-ID: ")
    wrong = plain("resource", b"abc", WARC_Block_Digest="md5:00")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info + page + wrong + again, mtime=0) + gzip.compress(folded, mtime=0) + b"tail")
    (tmp_path / "b.warc").write_bytes(info + wrong + warc.record(5, "u", b"own") + b"WARC/1.0\r\nno colon\r\n\r\n")
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_archives(spark, f"file://{tmp_path}").collect()
    good = Counter((x["record_type"], x["page_id"], bytes(x["payload"]), x["payload_bytes"]) for x in rows if x["gap_bytes"] is None and x["record_type"] != "revisit")
    assert good == {("metadata", None, b"k: v", 4): 1, ("response", None, b"body", 4): 1, ("response", 5, b"own", 3): 1, ("warcinfo", None, b"software: x\r\n", 13): 2}
    assert {x["record_id"] for x in rows if x["page_id"] is None and x["record_type"]} == {f"<urn:uuid:35f0-{k}>" for k in ("warcinfo", "response", "revisit", "metadata")}
    assert [(x["payload"], x["payload_bytes"], x["payload_digest"], x["refers_to"]) for x in rows if x["record_type"] == "revisit"] == [(None, None, None, None)]
    assert [x["url"] for x in rows if x["url"] and x["page_id"] is None] == ["http://a/%41"]
    assert sum(x["gap_bytes"] is not None for x in rows) == 4  # the wrong digests, the tail and the cut record


_P = "The river rose in the night and the lower fields were under water by morning."
_Q = "Nobody in the village had seen it so high, and the old bridge did not hold."
#: Layouts of kinds that the generator of training pages does not write, labelled by hand: the main text's blocks.
FOREIGN = {
    "blog": (f'<!DOCTYPE html><html lang=en><head><title>x</title></head><body class="home blog single has-sidebar header-fixed"><div id="page" class="site"><header id="masthead" class="site-header"><h1 class="site-title"><a href=/>My blog</a></h1></header><nav id="site-navigation" class="main-navigation"><ul><li><a href=a>About</a></li><li><a href=b>Contact</a></li></ul></nav><div id="content" class="site-content"><main id="main" class="site-main"><article id="post-7" class="post type-post hentry"><header class="entry-header"><h1 class="entry-title">The flood</h1></header><div class="entry-content"><p>{_P}</p><p>{_Q}</p></div><footer class="entry-footer">Posted in <a href=c>News</a></footer></article></main><aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href=d>Older one</a></li></ul></section></aside></div><footer id="colophon" class="site-footer">Powered by a blog engine</footer></div></body></html>', ["The flood", _P, _Q]),
    "wiki": (f'<html><body class="mediawiki"><div id="content" class="mw-body" role="main"><h1 id="firstHeading">River</h1><div id="bodyContent"><p>{_P} <a href=/w/x>Water</a> is wet.</p><h2>History</h2><p>{_Q}</p><ul><li>First flood</li><li>Second flood</li></ul></div></div><div id="mw-navigation"><div id="mw-panel"><div class="portal" role="navigation"><h3>Navigation</h3><ul><li><a href=1>Main page</a></li><li><a href=2>Random</a></li></ul></div></div></div><div id="footer" role="contentinfo"><ul><li>This page was last edited long ago.</li></ul></div></body></html>', ["River", _P + " Water is wet.", "History", _Q, "First flood", "Second flood"]),
    "news": (f'<body><div class="topbar"><a href=1>Sport</a> <a href=2>Politics</a></div><div class="cookie-banner" role="dialog"><p>We use cookies to improve your visit.</p><button>OK</button></div><main><article><h1>Bridge gone</h1><p>{_P}</p><div class="advertisement"><span>Advertisement</span></div><p>{_Q}</p><figure><img src=a><figcaption>The bridge</figcaption></figure></article><section class="comments"><h2>Comments</h2><div class="comment"><p>So sad to read this.</p></div></section></main><footer><p>All rights reserved.</p></footer></body>', ["Bridge gone", _P, _Q, "The bridge"]),
    "tables": (f'<html><body><table width=100%><tr><td colspan=2 class="header">MY HOMEPAGE</td></tr><tr><td width=150 class="nav"><a href=1>Home</a><br><a href=2>Links</a></td><td><h2>Diary</h2><p>{_P}</p><p>{_Q}</p></td></tr><tr><td colspan=2 class="footer">Best viewed at 800x600</td></tr></table></body></html>', ["Diary", _P, _Q]),
    "manual": (f'<body><div class="related" role="navigation"><h3>Navigation</h3><ul><li><a href=1>index</a></li></ul></div><div class="document"><div class="documentwrapper"><div class="body" role="main"><section id="x"><h1>Install</h1><p>{_P}</p><pre>get it</pre><p>{_Q}</p></section></div></div><div class="sphinxsidebar" role="navigation"><h3>Table of Contents</h3><ul><li><a href=2>Install</a></li></ul></div></div><div class="footer" role="contentinfo">Copyright someone.</div></body>', ["Install", _P, "get it", _Q]),
    "grid": (f'<body><nav class="navbar navbar-expand-lg"><a class="navbar-brand" href=/>Brand</a><ul class="navbar-nav"><li class="nav-item"><a class="nav-link" href=1>Home</a></li></ul></nav><div class="container"><div class="row"><div class="col-md-8"><h1>Notes</h1><p class="lead">{_P}</p><p>{_Q}</p></div><div class="col-md-4 sidebar"><h4>Archives</h4><ol><li><a href=2>March</a></li></ol></div></div></div><footer class="footer mt-auto"><p>Copyright us</p></footer></body>', ["Notes", _P, _Q]),
    "beside": (f'<body class="has-sidebar header-fixed"><div class="main-with-sidebar"><p>{_P}</p><p>{_Q}</p></div></body>', [_P, _Q]),
    "short": ("<p>Hello there.</p>", ["Hello there."]),
    "hidden": (f"<body><article><h1>T</h1><p>{_P}</p><p hidden>Not shown at all.</p></article></body>", ["T", _P]),
    "formula": ("<body><article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be given here as it is.</p></article></body>", ["Let x=1 be given here as it is."]),
    "loose": (f"<h1>Title</h1>{_P}<p>{_Q}", ["Title", _P, _Q]),
    "app": (f'<body><div id="root"><div class="App"><div class="Header_header__x1"><a href=/>Logo</a></div><div class="Article_content__y2"><h1>Story</h1><p>{_P}</p><p>{_Q}</p></div><div class="Footer_footer__z3"><a href=1>Imprint</a></div></div></div></body>', ["Story", _P, _Q]),
    "letter": (f'<body><main><h1>Piece</h1><p>{_P}</p><div class="newsletter-signup"><p>Get our letter every week.</p><form><input><button>Subscribe</button></form></div><p>{_Q}</p><div class="share-buttons"><a href=1>Share</a><a href=2>Tweet</a></div><div class="author-bio"><p>Ann writes about water.</p></div></main></body>', ["Piece", _P, _Q]),
}


def test_foreign_layouts():
    """The score that the README states: blocks labelled right, pages right as a whole."""
    model, right, blocks, pages = html_text.default_model(), 0, 0, 0
    for page, want in FOREIGN.values():
        own = html_text.blocks(page)
        labels = model.viterbi(own)
        right += sum((b.text in want) == bool(y) for b, y in zip(own, labels))
        blocks += len(own)
        pages += [b.text for b, y in zip(own, labels) if y] == want
    assert right >= 0.94 * blocks and pages >= 10
    for name in ("beside", "short", "hidden", "formula", "loose"):
        page, want = FOREIGN[name]
        assert html_text.main_text(page, model) == "\n\n".join(want)


@pytest.mark.parametrize("page", ["<div>x" * 100_000, '<div class="a b">x' * 50_000 + "</section>" * 50_000, "<li><ul>" + "<blockquote>" * 40_000 + "<li>y</li>" * 40_000])
def test_deep_pages_take_linear_time(page):
    model, begin = html_text.default_model(), time.monotonic()
    html_text.main_text(page, model)
    assert time.monotonic() - begin < 15


def test_many_matches_in_one_text(spark):
    texts = [" ".join(f"ann{i}@mail.org" for i in range(n)) for n in (1, 127, 128, 129, 50_000)]
    begin = time.monotonic()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.report(docs).collect():
        at, want = 0, []
        for w in texts[r["doc_id"]].split(" "):
            want.append(f"email:{at}:{at + len(w)}")
            at += len(w) + 1
        assert r["spans"] == ",".join(want) and len(r["scores"].split(",")) == len(want)
    assert {len(r["text"]) for r in pii.redact(docs).collect()} == {8 * len(t.split()) - 1 for t in texts}
    assert time.monotonic() - begin < 60


def test_running_values(spark):
    values = [[], [5], [1] * 127, list(range(300)), [-3, 7, -3, 2] * 200]
    rows = spark.createDataFrame([(v,) for v in values], "v array<int>").select("v", pii.running(F.col("v"), lambda t, x: t + x).alias("s"), pii.running(F.col("v"), lambda t, x: F.greatest(t, x)).alias("m")).collect()
    for r in rows:
        assert r["s"] == np.cumsum(r["v"]).tolist() and r["m"] == [max(0, *r["v"][: i + 1]) for i in range(len(r["v"]))]


def test_scores_follow_context(spark):
    docs = spark.createDataFrame([(1, "call +1 (555) 123-4567"), (2, "see +1 (555) 123-4567"), (3, "ssn 123-45-6789"), (4, "123-45-6789")], "doc_id long, text string")
    assert {r["doc_id"]: r["scores"] for r in pii.report(docs).collect()} == {1: "0.9", 2: "0.7", 3: "0.8", 4: ""}


def brute_resample(texts: list, good: set, noise: dict, buckets: int) -> tuple[dict, dict]:
    """Log weights and the order of keys, computed from words, shapes and counts of its own; only the buckets' numbers are shared."""
    bags = []
    for t in texts:
        doc, b = importance.features(pa.array([t]), buckets)
        bags.append(set(b.tolist()))
    raw, own = Counter(x for b in bags for x in b), Counter(x for i in good for x in bags[i])
    share = len(good) / len(texts)
    ratio = {}
    for x, n in raw.items():
        expected = n * share
        ratio[x] = 0.0 if abs(own[x] - expected) < importance.ERRORS * math.sqrt(expected + 1) else math.log((own[x] + importance.PRIOR) / (expected + importance.PRIOR))
    weight = {i: sum(ratio[x] for x in b) for i, b in enumerate(bags)}
    return weight, {i: w + noise[i] for i, w in weight.items()}


def test_features_by_brute_force():
    """Texts share as many buckets as they share words, word pairs, shapes and shape pairs."""

    def bag(t: str) -> set:
        low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        raw = WORD.findall(t)
        w = [x.translate(low) for x in raw]
        kind = lambda c: "a" if c.islower() and c.isascii() or not c.isascii() else "A" if c.isupper() else "0" if c.isdigit() else c
        s = ["".join(k for i, k in enumerate(map(kind, x)) if i == 0 or k != kind(x[i - 1])) for x in raw]
        return {(0, x) for x in w} | {(1, *p) for p in zip(w, w[1:])} | {(2, x) for x in s} | {(3, *p, a == b) for p, a, b in zip(zip(s, s[1:]), w, w[1:])}

    r = random.Random(8)
    texts = [" ".join(r.choice(["one", "Two", "x1", "!!", "éa", "a.b", "A1b2", "one"]) for _ in range(r.randrange(0, 25))) for _ in range(60)]
    own = [set(importance.features(pa.array([t]), 1 << 40)[1].tolist()) for t in texts]
    bags = [bag(t) for t in texts]
    for i in range(60):
        assert len(own[i]) == len(bags[i])
        for j in range(i):
            assert len(own[i] & own[j]) == len(bags[i] & bags[j])


def test_resampling_by_brute_force(spark):
    r = random.Random(9)
    texts = [sentence(r, r.randrange(1, 80), 200) + (" awful nasty" if i % 4 == 0 else " fine") for i in range(240)]
    good = {i for i in range(0, 240, 3) if i % 4}
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 240, 3)], "doc_id long, quality int, toxic int")
    docs = table(spark, texts)
    noise = {x["doc_id"]: x["g"] for x in docs.select("doc_id", importance.gumbel().alias("g")).collect()}
    weight, key = brute_resample(texts, good, noise, importance.BUCKETS)
    got = {x["doc_id"]: x for x in importance.resample(docs, labels).collect()}
    assert all(math.isclose(got[i]["log_weight"], weight[i], abs_tol=1e-3) and math.isclose(got[i]["gumbel_key"], key[i], abs_tol=1e-3) for i in weight)
    of_good = sorted(math.floor(got[i]["log_weight"] * 10) / 10 for i in good)
    cut = of_good[int(importance.LOSS * len(good))]
    k = sum(x["log_weight"] >= cut for x in got.values())
    best = sorted(got, key=lambda i: -got[i]["gumbel_key"])[:k]
    assert {i for i, x in got.items() if x["kept"]} == set(best)


def test_weights_of_very_long_texts_keep_their_order(spark):
    keyed = spark.createDataFrame([(1, 5e9), (2, 4e9), (3, -7e9), (4, 1.0)], "doc_id long, key double")
    rows = keyed.select("doc_id", importance.sortable(F.col("key"), 7e9).alias("k")).orderBy("k").collect()
    assert [r["doc_id"] for r in rows] == [3, 4, 2, 1]


def test_languages_in_groups(spark, monkeypatch):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the quick brown fox and the dog", "en"), ("le chien et la maison de la ville", "fr"), ("der hund und das haus", "de")] * 6)]
    docs = spark.createDataFrame([*rows, (100, "das haus der stadt", None), (101, None, None), (102, "12", None)], "doc_id long, text string, lang string")
    every = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in langid.predict(docs).collect()}
    monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", 1)
    assert {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in langid.predict(docs).collect()} == every
    assert every[100][0] == "de" and every[101] == every[102] == ("und", 0)


def test_pipeline_with_columns_of_any_name(spark, tmp_path):
    r = random.Random(10)
    names = ["my col", "a.b", "__keep", "__rid", "__leak", "row", "spans", "`x`", "pieces"]
    rows = [(i, sentence(r, 60, 5000) + (" mail ann@mail.org" if i == 3 else ""), "en" if i % 2 else None, "s", 1, *[f"{n}{i}" for n in names]) for i in range(40)]
    rows += [(50, rows[0][1], "en", "s", 1, *names), (None, None, None, None, None, *[None] * len(names))]
    ticks = lambda n: "`" + n.replace("`", "``") + "`"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{ticks(n)} string" for n in names))
    spark.createDataFrame([(1, rows[7][1])], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept) == set(range(40)) - {7} and kept[3]["text"].endswith("mail [EMAIL]") and kept[5]["a.b"] == "a.b5" and kept[5]["`x`"] == "`x`5"
    assert corpus_pipeline.packed(spark, docs, f"file://{tmp_path}").count() >= 39
