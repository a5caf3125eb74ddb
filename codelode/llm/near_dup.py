"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's set is its distinct word shingles. Equal sets (by a 128-bit hash) are one node of the graph from the start, so copies
cost one row each. A node's signature has 16 bits of each of 64 minima; the distance of two signatures is the number of positions that differ. For a
threshold of T positions the signature is cut into M chunks with M * (R + 1) > T: two signatures within T differ in at most R
positions in some chunk (pigeonhole). With R = 1 every chunk is indexed once for each position that may be in error, by what the
other positions hold; two signatures within T meet under at least one of these 64 keys, always. limits() derives T and M from
the similarity: a position differs with a chance of 0.15 at a similarity of 0.85, so more than T of 64 differ in at most LOST
of such pairs (T = 25, M = 13: 6 in 10^7; at 0.8 T = 29, M = 15: 12 in 10^7), and in far fewer above.

Links are then confirmed on full sets. To keep the work down without losing a link:
- nodes that share a key are first compared with the least node of that key (a star, one pair a row);
- then keys whose nodes are still in different components are searched for further pairs across components. Groups are dealt in
  tiles of TILE x TILE nodes, so no key is gathered in one task, and the nodes of a key's largest component meet only those outside
  it. A pair is reported under the first key that its nodes share,
  and of the pairs between two components a batch reports KEEP; if any was left out, the search runs again with 16 times as
  many, until none is left out;
- a pair needs a signature distance within T, and parity sketches that allow it: each element of the symmetric difference flips
  one of 2048 bits, so the sketches' distance never exceeds the size of the difference.
Components come from rounds of large-star and small-star, each written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm._common import slabs, written
from codelode.llm._tokens import mix, windows, words
from codelode.operators.layout import spread

SHINGLE, SIMILARITY = 5, 0.85
POSITIONS, MISSED, LOST = 64, 1e-5, 2e-6
PARITY = 2048
TILE, KEEP = 1024, 16
_A = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SHORT, _S1, _S2 = 0x5851F42D4C957F2D, np.uint64(0x2545F4914F6CDD1D), np.uint64(0x6C62272E07BB0142)


@lru_cache
def limits(similarity: float, missed: float = MISSED) -> tuple[int, int]:
    """The threshold T that pairs of that similarity exceed with a chance of at most missed, and the number of chunks for it."""
    chance = lambda k: math.comb(POSITIONS, k) * (1 - similarity) ** k * similarity ** (POSITIONS - k)
    within = next(t for t in range(POSITIONS + 1) if sum(map(chance, range(t + 1, POSITIONS + 1))) <= missed)
    return within, within // 2 + 1


WITHIN, CHUNKS = limits(SIMILARITY)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z as a-z; a text of fewer words has its whole sequence as one."""
    w = words(texts)
    h = w.hashes(lower=True)
    _, sh = windows(h, w.doc, size)
    cut = np.concatenate([[0], np.cumsum(np.maximum(w.count - size + 1, 0))])
    first, out = w.first, []
    for i in range(len(w.count)):
        own = np.sort(sh[cut[i] : cut[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif not len(own) and w.count[i]:
            own = np.array([int(w.count[i]) * _SHORT % (1 << 64)], np.uint64)
            for x in h[first[i] : first[i + 1]]:
                own = mix(own ^ x)
        out.append(own)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of POSITIONS values for each set, none of them empty."""
    out = np.zeros((len(sets), POSITIONS), np.uint16)
    if sets:
        every = np.concatenate(sets)
        start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        for k in range(POSITIONS):
            out[:, k] = mix(np.minimum.reduceat(every * _A[k], start)) & np.uint64(0xFFFF)
    return out


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """Bits (packed) that say which values of h mod PARITY a set has an odd number of."""
    if not sets:
        return np.zeros((0, PARITY // 8), np.uint8)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = row * PARITY + (np.concatenate(sets) >> np.uint64(20)).astype(np.int64) % PARITY
    return np.packbits((np.bincount(at, minlength=len(sets) * PARITY) & 1).astype(np.uint8).reshape(-1, PARITY), axis=1)


def chunk_keys(sig: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """The keys of each signature, one for each position left out of its chunk; the low six bits say which."""
    out = np.empty((len(sig), POSITIONS), np.uint64)
    wide = sig.astype(np.uint64) + np.uint64(1)
    for chunk in np.array_split(np.arange(POSITIONS), chunks):
        for j in chunk:
            h = np.full(len(sig), j + 1, np.uint64)
            for x in chunk:
                if x != j:
                    h = mix(h ^ wide[:, x])
            out[:, j] = h & ~np.uint64(POSITIONS - 1) | np.uint64(j)
    return out


def first_shared(s1: np.ndarray, s2: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """The first position under whose key two signatures meet, for each pair of rows; POSITIONS if they never do."""
    differ = s1 != s2
    chunk = np.repeat(np.arange(chunks), [len(c) for c in np.array_split(np.arange(POSITIONS), chunks)])
    count = np.stack([differ[:, chunk == c].sum(1) for c in range(chunks)], axis=1)
    meet = count[:, chunk] == differ
    return np.where(meet.any(1), meet.argmax(1), POSITIONS)


def _rows(sig: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sig), np.uint16).reshape(-1, POSITIONS)


def _near(n1, n2, s1, s2, o1, o2, similarity: float) -> np.ndarray:
    """Which pairs can be linked, by sizes, signatures and parity sketches."""
    both = n1 + n2
    fine = np.minimum(n1, n2) >= similarity * np.maximum(n1, n2) - 1e-9
    at = np.flatnonzero(fine)
    at = at[(s1[at] != s2[at]).sum(1) <= limits(similarity, LOST)[0]]
    flips = np.bitwise_count(o1[at] ^ o2[at]).sum(1)
    return at[flips <= (1 - similarity) / (1 + similarity) * both[at] + 1e-6]


def names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each set, in two halves."""
    size = np.array([len(s) for s in sets], np.uint64)
    return tuple(mix(np.array([mix(s ^ k).sum(dtype=np.uint64) for s in sets], np.uint64) ^ size * _S2).view(np.int64) for k in (_S1, _S2))


def row_id(doc_id: Column, text: Column) -> list[Column]:
    """What tells rows apart: a 128-bit hash of id and text, in two halves."""
    return [F.xxhash64(doc_id, text).alias("rid"), F.xxhash64(F.lit(7), text, doc_id).alias("rid2")]


def sketch(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, rid, rid2, n (set size), high and low (hash of the set, null if empty), sig, odd."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text"):
            sets = shingle_sets(slab.column("text"), shingle)
            full = [s for s in sets if len(s)]
            own = [iter(x) for x in (*(h.tolist() for h in names(full)), map(bytes, signatures(full)), map(bytes, parity(full)))]
            cols = [pa.array([next(x) if len(s) else None for s in sets], t) for x, t in zip(own, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.record_batch([*(slab.column(c) for c in ("doc_id", "rid", "rid2")), pa.array([len(s) for s in sets], pa.int64()), *cols], names=["doc_id", "rid", "rid2", "n", "high", "low", "sig", "odd"])

    rows = docs.select("doc_id", *row_id(F.col("doc_id"), F.col("text")), "text")
    return spread(rows).mapInArrow(f, "doc_id long, rid long, rid2 long, n long, high long, low long, sig binary, odd binary")


def _keys(nodes: DataFrame, similarity: float) -> DataFrame:
    _, chunks = limits(similarity, LOST)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                k = chunk_keys(_rows(part.column("sig").to_pylist()), chunks)
                node = np.repeat(part.column("node").to_numpy(), POSITIONS)
                yield pa.record_batch([pa.array(k.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(f, "key long, node long")


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node and its set, for nodes (node, rid, high, low)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text"):
            sets = shingle_sets(slab.column("text"), shingle)
            high, low = names(sets)
            same = (high == slab.column("high").to_numpy()) & (low == slab.column("low").to_numpy())  # not a text with the same rid
            yield pa.record_batch([slab.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "members"]).filter(pa.array(same))

    texts = docs.select(row_id(F.col("doc_id"), F.col("text"))[0], "text").join(nodes.select("node", "rid", "high", "low"), "rid").select("node", "high", "low", "text")
    return texts.mapInArrow(f, "node long, members binary").groupBy("node").agg(F.min("members").alias("members"))


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (u, v) whose full sets are similar enough; similarity is compared in whole hundredths."""
    percent = round(100 * similarity)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                if 100 * same >= percent * (len(both) - same):
                    keep.append(i)
            yield pa.record_batch([batch.column("u"), batch.column("v")], names=["u", "v"]).take(pa.array(keep, pa.int64()))

    full = pairs.join(sets.select(F.col("node").alias("u"), F.col("members").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("members").alias("b")), "v")
    return full.select("u", "v", "a", "b").mapInArrow(f, "u long, v long")


def _stars(shared: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs of a key's least node and each other node, as far as sketches allow a link."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4000):
                b = batch.slice(at, 4000)
                n1, n2 = (b.column(c).to_numpy().astype(np.int64) for c in ("n1", "n2"))
                s1, s2 = (_rows(b.column(c).to_pylist()) for c in ("s1", "s2"))
                o1, o2 = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, PARITY // 8) for c in ("o1", "o2"))
                keep = _near(n1, n2, s1, s2, o1, o2, similarity)
                yield pa.record_batch([b.column("u"), b.column("v")], names=["u", "v"]).take(pa.array(keep))

    pairs = shared.where("node != center").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct()
    own = lambda x, i: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{i}"), F.col("sig").alias(f"s{i}"), F.col("odd").alias(f"o{i}"))
    return pairs.join(own("u", 1), "u").join(own("v", 2), "v").mapInArrow(f, "u long, v long")


def _across(shared: DataFrame, nodes: DataFrame, comps: DataFrame, similarity: float, keep: int) -> DataFrame:
    """Pairs of nodes under one key in different components, as far as sketches allow a link: u, v, and more (pairs were left out)."""
    own = shared.select("key", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # a key's largest component and the rest are dealt apart: pairs within the largest need no look, however large it is
    parts = own.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("comp", F.struct("n", "comp")).alias("major"))
    mixed = parts.where("comps > 1").select("key", "major", F.ceil((F.col("size") - F.col("most")) / TILE).cast("int").alias("rest"), F.ceil(F.col("most") / TILE).cast("int").alias("large"))
    rows = own.join(mixed, "key").join(nodes.select("node", "n", "sig", "odd"), "node")
    is_major, salt = F.col("comp") == F.col("major"), F.xxhash64("node", F.lit(1))
    place = F.when(is_major, F.col("rest") + F.pmod(salt, F.col("large"))).otherwise(F.pmod(salt, F.col("rest"))).cast("int")
    meets = F.when(is_major, F.col("rest") - 1).otherwise(F.col("rest") + F.col("large") - 1)
    tiles = rows.withColumn("tile", place).select("*", F.explode(F.sequence(F.lit(0), meets)).alias("other")).withColumns({"x": F.least("tile", "other"), "y": F.greatest("tile", "other")})
    dealt = tiles.select("key", "x", "y", "tile", "node", "comp", "n", "sig", "odd").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "tile")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(group: pa.Table) -> pa.RecordBatch:
            out: dict[tuple, set] = {}
            dropped: set[tuple] = set()
            g = group.combine_chunks()
            key, x, y, tile, node, comp, n = (g.column(c).to_numpy() for c in ("key", "x", "y", "tile", "node", "comp", "n"))
            sig, odd = _rows(g.column("sig").to_pylist()), np.frombuffer(b"".join(g.column("odd").to_pylist()), np.uint8).reshape(-1, PARITY // 8)
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]), [True]])
            edge = np.flatnonzero(new)
            i_all, j_all, todo = [], [], 0

            def test():
                nonlocal i_all, j_all, todo
                if not i_all:
                    return
                i, j = np.concatenate(i_all), np.concatenate(j_all)
                i_all, j_all, todo = [], [], 0
                at = _near(n[i], n[j], sig[i], sig[j], odd[i], odd[j], similarity)
                at = at[first_shared(sig[i[at]], sig[j[at]], limits(similarity, LOST)[1]) == key[i[at]] & (POSITIONS - 1)]  # each pair under one key
                for a, b in zip(i[at].tolist(), j[at].tolist()):
                    own = (min(comp[a], comp[b]), max(comp[a], comp[b]))
                    pair = (min(node[a], node[b]), max(node[a], node[b]))
                    have = out.setdefault(own, set())
                    if len(have) < keep:
                        have.add(pair)
                    elif pair not in have:
                        dropped.add(own)

            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                cross = x[a] != y[a]
                for i in range(a, b - 1):  # each node with those after it, in another component (and in the other tile)
                    j = np.arange(i + 1, b)
                    j = j[(comp[i + 1 : b] != comp[i]) & (tile[i + 1 : b] != tile[i] if cross else True)]
                    if len(j):
                        i_all.append(np.full(len(j), i))
                        j_all.append(j)
                        todo += len(j)
                    if todo > 20000:
                        test()
            test()
            rows = [(u, v, own in dropped) for own, pairs in out.items() for u, v in pairs]
            cols = zip(*rows) if rows else ((), (), ())
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_()))], names=["u", "v", "more"])

        for batch in batches:
            if not len(batch):
                continue
            last = [batch.column(c)[-1].as_py() for c in ("key", "x", "y")]
            same = np.logical_and.reduce([batch.column(c).to_numpy() == v for c, v in zip(("key", "x", "y"), last)])
            first = len(batch) if not same.any() else int(np.argmax(same))  # rows are sorted: the last group is at the end
            if first:
                yield done(pa.Table.from_batches([*held, batch.slice(0, first)]))
                held = []
            elif held and [held[-1].column(c)[-1].as_py() for c in ("key", "x", "y")] != last:
                yield done(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(first))
        if held:
            yield done(pa.Table.from_batches(held))

    return dealt.mapInArrow(f, "u long, v long, more boolean").groupBy("u", "v").agg(F.max("more").alias("more"))


def components(links: DataFrame) -> DataFrame:
    """node and comp (the least node reachable) for every node of links (u, v), by large-star and small-star rounds."""
    edges = written(links.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a != b").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # larger neighbours to the least one
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = written(small.where("a != b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
        state = now


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _graph(base: DataFrame, similarity: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows of sketch(base), and every node with comp, its component, its set's high and low, and its least document's doc_id, rid, rid2."""
    rows = written(sketch(base, shingle))
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "rid2", "n", "sig", "odd")).alias("x")
    found = rows.where("n > 0").groupBy("high", "low").agg(pick)
    nodes = written(found.select(F.monotonically_increasing_id().alias("node"), "high", "low", "x.doc_id", "x.rid", "x.rid2", "x.n", "x.sig", "x.odd"))
    keys = _keys(nodes, similarity)
    twice = keys.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center != last").select("key", "center")
    shared = written(keys.join(twice, "key"))
    meet = written(nodes.join(shared.select("node").distinct(), "node", "left_semi"))  # nodes alone under all their keys go no further
    sets = written(_sets(base, meet, shingle))
    links = written(_linked(_stars(shared, meet, similarity), sets, similarity))
    comps, keep = components(links), KEEP
    while True:
        found = written(_across(shared, meet, comps, similarity, keep))
        more = written(_linked(found.select("u", "v"), sets, similarity))
        left_out = not found.where("more").isEmpty()
        if not more.isEmpty():
            links = links.unionByName(more)
            comps = components(links)
        if not left_out:
            break
        keep *= 16
    return rows, nodes.select("node", "high", "low", "doc_id", "rid", "rid2").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the document's component) and kept (doc_id = component_id).

    Defined cases: a null or empty text has an empty set and is a component of its own; rows that repeat a doc_id with other
    texts are documents of their own, with the same id; a null doc_id is not taken for a component's least, and is kept only if
    its component has no id at all; an empty table gives an empty result; extra columns are ignored.
    """
    rows, nodes = _graph(_base(docs, id_col, text_col), similarity, shingle)
    least = nodes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    known = nodes.join(least, "comp").select("high", "low", "component_id", F.lit(True).alias("full"))
    out = rows.select("doc_id", "n", "high", "low").join(known, ["high", "low"], "left").withColumn("component_id", F.when(F.col("full"), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """docs with one document of each component, the one with the least doc_id; documents without words all stay, row by row.

    Rows that repeat both doc_id and text count as one document, unless they have no words. Other columns may have any names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    full = text.rlike(r"[^\x20\x09-\x0D]")
    every = docs.select(F.struct("*").alias("row"), full.alias("full"), *row_id(F.col("doc_id").cast("long"), text))
    _, nodes = _graph(_base(docs, "doc_id", "text"), similarity, shingle)
    first = nodes.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "rid2")).alias("x")).select("x.rid", "x.rid2")
    one = every.where("full").join(first, ["rid", "rid2"], "left_semi").dropDuplicates(["rid", "rid2"]).select("row")
    stay = one.unionByName(every.where("NOT full").select("row"))
    return stay.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
