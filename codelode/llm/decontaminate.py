"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words, in lower case, over all documents, give TF-IDF weights.
2. A randomised SVD of TF-IDF passages: with X the passages and G a random matrix, tasks sum Z = X'X G over their passages, and
   the single-pass (Nystroem) decomposition Z (G'Z)^-1 Z' = U S^2 U' gives the latent axes U. It is fitted on all passages of
   all documents, FIT_BYTES of text or more a task.
3. Every document is cut into passages of 2, 4 and 8 blocks of 8 words, and of twice as many for as long as items are longer, each
   starting a block after the one before (an eighth of a passage for the longer ones). Passages are searched for in the latent
   space: an item's candidates are the passages of the size next to its own whose cosine with it is COSINE or more, times the
   root of the share of the passage that the item can fill. The index of a benchmark has cells of some CELL items (spherical
   k-means); a passage looks into the cells next to it, as many as twice the root of their number and PROBES at least.
4. Candidates are checked on their words, over a window that holds the whole item and a margin on both sides of the passage: a
   share ANSWERS of the item's answer words (given ones, or its rarest words; all of them in items of under SHORT words) must be
   in it, and the longest common subsequence must cover a share LCS of the item, which insertions, deletions and exchanged words
   leave (paraphrases).

Texts are searched in pieces with an overlap of the widest window, so that memory does not grow with a text's length times the
number of items; the result is that of whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm._common import parts, slabs, text_bytes, written
from codelode.llm._tokens import Words, buffer, distinct, words
from codelode.operators.layout import spread

BUCKETS, RANK, BLOCK, SIZES = 1 << 15, 128, 8, (2, 4, 8)
FIT_BYTES, FIT_TASKS = 64 << 20, 12
COSINE, LCS, ANSWERS, N_ANSWERS, SHORT = 0.25, 0.6, 0.25, 8, 8
NOISE = 1e-3  # of the largest singular value: axes below it are rounding errors of corpora with fewer passages than axes
CELL, PROBES, AT_ONCE = 512, 4, 1024
ITEM_BYTES = 16 << 20  # of a benchmark's texts that are searched for in one pass over the documents
MARGIN = 0.25  # of an item's length, for words put in
_ROWS = 256  # buckets a row of summed matrices
_SLAB = 1 << 19
_STRIP = 512
PIECE = 4096  # blocks of a slab that are searched at a time
_TURNS = 16


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by the bit-parallel recurrence."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := where.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def word_hashes(docs: DataFrame) -> DataFrame:
    """docs (text, and doc_id if there) with the words' hashes as bytes in place of the text, which must be in lower case."""
    keep = [c for c in ("doc_id",) if c in docs.columns]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text"):
            w = words(slab.column("text"))
            raw = w.hashes().tobytes()
            at = np.concatenate([[0], np.cumsum(w.count * 8)]).astype(np.int64)
            own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(slab), [None, pa.py_buffer(at), pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.record_batch([*(slab.column(c) for c in keep), own], names=[*keep, "hashes"])

    return docs.select(*keep, "text").mapInArrow(f, ("doc_id long, " if keep else "") + "hashes binary")


@dataclass
class Hashed:
    """The words of a slab by their hashes: the text each is of, and how many each text has."""

    hash: np.ndarray
    doc: np.ndarray
    count: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.count)])


def unpack(column: pa.Array) -> Hashed:
    data, off = buffer(column)
    count = np.diff(off) // 8
    return Hashed(np.frombuffer(data.tobytes(), np.uint64), np.repeat(np.arange(len(count)), count), count)


def blocks_of(w: Words | Hashed, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each block, the text each block is of, and each text's first block with the number of blocks at the end."""
    n = -(-w.count // size)
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    return w.first[doc] + (np.arange(first[-1]) - first[doc]) * size, doc, first


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each hash; BUCKETS is a power of two."""
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def summed(rows: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """rows[slot[0]] + rows[slot[1]] + ..., in strips that stay in a cache."""
    out = np.empty((slot.shape[1], rows.shape[1]), rows.dtype)
    more = np.empty((_STRIP, rows.shape[1]), rows.dtype)
    for at in range(0, len(out), _STRIP):
        own = out[at : at + _STRIP]
        np.take(rows, slot[0, at : at + _STRIP], axis=0, out=own, mode="clip")
        for x in slot[1:, at : at + _STRIP]:
            own += np.take(rows, x, axis=0, out=more[: len(own)], mode="clip")
    return out


def sizes_for(longest: int) -> list[int]:
    """Passage sizes in blocks: SIZES, doubled until they cover an item of that many words."""
    sizes = list(SIZES)
    while sizes[-1] * BLOCK < longest:
        sizes.append(2 * sizes[-1])
    return sizes


def step_of(size: int) -> int:
    """Blocks from the start of a passage to that of the next."""
    return max(1, size // SIZES[-1])


def side_of(n_words: int, size: int) -> int:
    """Blocks beside a passage, at both ends, in which an item that starts less than a step after it lies with its margin."""
    return max(1, -(-int(n_words * (1 + MARGIN)) // BLOCK) + 1 - size + step_of(size))


def cells(v: np.ndarray, each: int = CELL, rounds: int = 6) -> tuple[np.ndarray, list[np.ndarray]]:
    """Centres of cells of unit vectors (spherical k-means) and the members of each cell; every vector is in one."""
    k = -(-len(v) // each)
    centers = v[np.arange(k) * len(v) // k]
    for _ in range(rounds if k > 1 else 1):
        own = np.concatenate([np.argmax(v[i : i + AT_ONCE] @ centers.T, axis=1) for i in range(0, len(v), AT_ONCE)])
        total = np.zeros_like(centers)
        np.add.at(total, own, v)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centers = np.where(norm > 0, total / np.maximum(norm, 1e-30), centers)
    return centers, [np.flatnonzero(own == c) for c in range(k)]


@dataclass
class Piece:
    """Blocks of a slab that are searched together: passages start in [low, high), the blocks around belong to windows of theirs."""

    hash: np.ndarray
    first: np.ndarray  # word of each block
    doc: np.ndarray  # text of each block, as numbered in the slab
    doc_block: np.ndarray  # first block of each text, counted from the piece's first
    block_of_word: np.ndarray
    low: int
    high: int
    sums: np.ndarray  # latent vectors of one block, later of as many as the passages in turn have


def pieces(w: Hashed, latent: np.ndarray, before: int, after: int) -> Iterator[Piece]:
    """A slab in pieces of PIECE blocks (or twice what is beside, if more), each with so many blocks before and after it."""
    first, doc, doc_block = blocks_of(w)
    n, length = len(first), max(PIECE, 2 * (before + after))
    edge = np.append(first, len(w.hash))
    for low in range(0, n, length):
        high = min(low + length, n)
        a, b = max(low - before, 0), min(high + after, n)
        h, own = w.hash[edge[a] : edge[b]], first[a:b] - edge[a]
        block_of_word = np.repeat(np.arange(b - a), np.diff(edge[a : b + 1]))
        slot = np.full((BLOCK, b - a), BUCKETS)  # a row of zeros fills up short blocks
        slot[np.arange(len(h)) - own[block_of_word], block_of_word] = bucket_of(h)
        yield Piece(h, own, doc[a:b], doc_block - a, block_of_word, low - a, high - a, summed(latent, slot))


@dataclass
class Items:
    """The items of one passage size (in blocks), ready to be searched for."""

    size: int
    name: list[int]
    vector: np.ndarray  # in the latent space, of length 1
    least: np.ndarray  # the cosine that a candidate needs
    words: list[list[int]]
    side: np.ndarray
    answer: list[set[int]]
    need: np.ndarray  # answer words that a window needs
    centers: np.ndarray
    members: list[np.ndarray]

    def close(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """Items of one cell, and [(rows of x, which of them are close enough to which of the items)]; x has rows of length 1."""
        probes = max(PROBES, 2 * math.isqrt(len(self.members)))
        every = probes >= len(self.members)
        near = None if every else np.concatenate([np.argpartition(-(x[i : i + AT_ONCE] @ self.centers.T), probes - 1, axis=1)[:, :probes] for i in range(0, len(x), AT_ONCE)])
        for c, members in enumerate(self.members):
            own = np.arange(len(x)) if every else np.flatnonzero((near == c).any(1))
            for i in range(0, len(members) if len(own) else 0, 2 * CELL):
                j = members[i : i + 2 * CELL]
                v, least = self.vector[j].T, self.least[j]
                yield j, [(rows, x[rows] @ v >= least) for rows in (own[k : k + AT_ONCE] for k in range(0, len(own), AT_ONCE))]

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of x, item) whose cosine is large enough."""
        found = [(rows[p], j[q]) for j, parts in self.close(x) for rows, mask in parts for p, q in [np.nonzero(mask)]]
        return tuple(np.concatenate(y) for y in zip(*found)) if found else (np.zeros(0, np.int64),) * 2

    def answers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All answer words in order, the item of each, and a table by the low bits of a hash of whether it can be one."""
        word = np.array([x for a in self.answer for x in a], np.uint64)
        item = np.repeat(np.arange(len(self.answer)), [len(a) for a in self.answer])
        order = np.argsort(word, kind="stable")
        rare = np.zeros(1 << 16, bool)
        rare[(word & np.uint64(0xFFFF)).astype(np.int64)] = True
        return word[order], item[order], rare


def prepare(items: pa.Table, latent: np.ndarray, idf: np.ndarray) -> list[Items]:
    """Items (item_id, text, answer) by passage size; those without words are left out."""
    w = words(items.column("text").combine_chunks())
    h = w.hashes()
    bucket = bucket_of(h)
    sizes = sizes_for(int(w.count.max(initial=1)))
    found: dict[int, list] = {}
    for i in np.flatnonzero(w.count).tolist():
        at = slice(w.first[i], w.first[i + 1])
        own, n = h[at], int(w.count[i])
        given = items.column("answer")[i].as_py()
        answer = set((words(pa.array([given])).hashes() if given else own[np.argsort(-idf[bucket[at]], kind="stable")][:N_ANSWERS]).tolist())
        v = latent[bucket[at]].sum(0)
        size = min(sizes, key=lambda k: abs(k * BLOCK - n))
        need = len(answer) if n < SHORT else math.ceil(ANSWERS * len(answer))
        found.setdefault(size, []).append((items.column("item_id")[i].as_py(), v / max(float(np.linalg.norm(v)), 1e-30), COSINE * math.sqrt(min(1.0, n / (size * BLOCK))), own.tolist(), side_of(n, size), answer, need))
    out = []
    for size, rows in sorted(found.items()):
        name, vector, least, seq, side, answer, need = zip(*rows)
        vector = np.stack(vector).astype(np.float32)
        out.append(Items(size, list(name), vector, np.array(least, np.float32), list(seq), np.array(side), list(answer), np.array(need), *cells(vector)))
    return out


def search(items: Items, ready: tuple, piece: Piece, share: float, done: set[tuple[int, int]]) -> Iterator[tuple[int, int, float, float]]:
    """(text of the slab, item_id, lcs, cosine) of every passage that starts in the piece and in which an item is found."""
    h, sums, first, doc, block_of_word = piece.hash, piece.sums, piece.first, piece.doc, piece.block_of_word
    n = len(first)
    start = np.arange(piece.low, piece.high)
    start = start[(start - piece.doc_block[doc[start]]) % step_of(items.size) == 0]
    low, high = np.maximum(piece.doc_block[doc[start]], 0), np.minimum(piece.doc_block[doc[start] + 1], n)
    end = np.minimum(start + items.size, high)
    x = sums[start]
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-30)
    # answer words of the items by block, from the few words that are any item's
    word, item, rare = ready
    at = np.flatnonzero(rare[(h & np.uint64(0xFFFF)).astype(np.int64)])
    x0 = np.searchsorted(word, h[at], "left")
    at = at[hit := word[np.minimum(x0, len(word) - 1)] == h[at]]
    x0 = x0[hit]
    many = np.searchsorted(word, h[at], "right") - x0
    which = item[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(x0, many)]
    order = np.argsort(which, kind="stable")
    which, block = which[order], np.repeat(block_of_word[at], many)[order]
    place = which * n + block  # in order: the hits of an item, by block
    for members, parts in items.close(x):
        for rows, mask in parts:
            p, q = np.nonzero(mask)
            if len(p):
                p, q = rows[p], members[q]
                a, b = np.maximum(start[p] - items.side[q], low[p]), np.minimum(end[p] + items.side[q], high[p])
                fine = np.searchsorted(place, q * n + b) - np.searchsorted(place, q * n + a) >= items.need[q]
                p, q, a, b = p[fine], q[fine], a[fine], b[fine]
                for p, j, a, b in zip(p.tolist(), q.tolist(), a.tolist(), b.tolist()):
                    pair = (int(doc[start[p]]), j)
                    if pair not in done:
                        near, seq = h[first[a] : first[b] if b < n else len(h)].tolist(), items.words[j]
                        there = set(near)
                        if len(items.answer[j] & there) < items.need[j] or sum(map(there.__contains__, seq)) < share * len(seq) or (part := lcs(seq, near) / len(seq)) < share:
                            continue
                        if part == 1:
                            done.add(pair)
                    else:
                        part = 1.0
                    yield pair[0], items.name[j], part, float(x[p] @ items.vector[j])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents (as of word_hashes) each bucket's words are in, and their number."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for slab in slabs(batches, "hashes"):
            w = unpack(slab.column("hashes"))
            own = distinct(w.doc * BUCKETS + bucket_of(w.hash))
            total += np.bincount(own % BUCKETS, minlength=BUCKETS)
            n += len(slab)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array([-1, *at], pa.int64()), pa.array([n, *total[at]], pa.int64())], names=["bucket", "n"])

    sums = docs.select("hashes").mapInArrow(f, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = sums.column("bucket").to_numpy(), sums.column("n").to_numpy()
    out = np.zeros(BUCKETS, np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket == -1].sum())


def axes(docs: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (bucket x rank) and singular values of the TF-IDF passages of docs."""

    def noise() -> np.ndarray:
        return np.random.default_rng(seed).standard_normal((BUCKETS, rank)).astype(np.float32)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, z = np.concatenate([noise() * idf[:, None], np.zeros((1, rank), np.float32)]), np.zeros((BUCKETS, rank), np.float32)
        for slab in slabs(batches, "hashes", _SLAB):
            w = unpack(slab.column("hashes"))
            if not len(w.hash):
                continue
            b = bucket_of(w.hash)
            first, _, _ = blocks_of(w, BLOCK * SIZES[-1])
            passage = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(b))))
            slot = np.full((BLOCK * SIZES[-1], len(first)), BUCKETS)  # a row of zeros fills up short passages
            slot[np.arange(len(b)) - first[passage], passage] = b
            y = summed(g, slot)  # of each passage: x G
            at = passage[np.argsort(b.astype(np.uint16), kind="stable")]  # the passages of each bucket
            n = np.bincount(b, minlength=BUCKETS)
            start = np.cumsum(n) - n
            own = np.argsort(-n, kind="stable")[: np.count_nonzero(n)]
            n, start = n[own], start[own]
            total = y[at[start]]
            for k in range(1, _TURNS):  # the k-th passage of all buckets that have so many
                m = int(np.searchsorted(-n, -k))
                total[:m] += np.take(y, at[start[:m] + k], axis=0)
            for i in range(int(np.searchsorted(-n, -_TURNS))):
                total[i] += y[at[start[i] + _TURNS : start[i] + n[i]]].sum(0)
            z[own] += total * idf[own, None]
        for at in range(0, BUCKETS, _ROWS):
            if z[at : at + _ROWS].any():
                yield pa.record_batch([pa.array([at], pa.int32()), pa.array([z[at : at + _ROWS].tobytes()], pa.binary())], names=["at", "z"])

    def add(key, group):
        total = np.sum([np.frombuffer(x, np.float32).astype(np.float64) for x in group.column("z").to_pylist()], axis=0)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["at", "z"])

    z, rows = np.zeros((BUCKETS, rank)), (docs if "hashes" in docs.columns else word_hashes(docs)).select("hashes")
    for r in rows.mapInArrow(f, "at int, z binary").groupBy("at").applyInArrow(add, "at int, z binary").toArrow().to_pylist():
        z[r["at"] : r["at"] + _ROWS] = np.frombuffer(r["z"]).reshape(-1, rank)
    core = noise().astype(np.float64).T @ z
    shift = 1e-9 * max(np.trace(core), 1e-30)
    lower = np.linalg.cholesky((core + core.T) / 2 + shift * np.eye(rank))
    u, s, _ = np.linalg.svd(np.linalg.solve(lower, z.T).T, full_matrices=False)
    return u, s


def find_leaks(docs: DataFrame, benchmark: DataFrame, answer_col: str | None = None, share: float = LCS) -> DataFrame:
    """doc_id, item_id, cosine and lcs (share of the item's words, the best of the document's passages) of every leak found.

    The benchmark is a stated query set and is searched for in parts of some ITEM_BYTES, of which one at a time reaches the driver
    and is broadcast. Defined cases: null texts and items without words match nothing; items that repeat are reported each; rows
    that repeat a doc_id are searched each and reported once; an empty table gives an empty result; extra columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    base = spread(base)
    schema = "doc_id long, item_id long, cosine double, lcs double"
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text"), (F.lower(F.col(answer_col).cast("string")) if answer_col else F.lit(None).cast("string")).alias("answer")).where("text is not null")
    size, asked_size = text_bytes(docs.select(F.col("text").cast("string").alias("text")), "text"), text_bytes(asked, "text")
    if not asked_size or not size:
        return docs.sparkSession.createDataFrame([], schema)
    base = written(word_hashes(base))  # words are found once, and three passes read their hashes
    df, n_docs = document_frequencies(base)
    idf = (np.log((n_docs + 1) / (df + 1)) + 0.1).astype(np.float32)
    u, sv = axes(base.coalesce(parts(size, FIT_BYTES, FIT_TASKS)), idf)  # each task sends a matrix of 16 MB
    scale = np.where(sv > NOISE * sv.max(), 1 / np.maximum(sv, 1e-30), 0)
    latent = (u * idf[:, None] * scale).astype(np.float32)
    n_parts, out = parts(asked_size, ITEM_BYTES), None
    for part in range(n_parts):
        items = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == part).orderBy("item_id", "text").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast((latent, prepare(items, latent, idf)))
        found = base.mapInArrow(_finder(shared, share), schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"))


def _finder(shared, share: float):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latent, every = shared.value
        latent = np.concatenate([latent, np.zeros((1, latent.shape[1]), np.float32)])
        ready = [items.answers() for items in every]
        before = max((int(items.side.max()) for items in every), default=0)
        after = max((items.size + int(items.side.max()) for items in every), default=0)
        for slab in slabs(batches, "hashes", _SLAB):
            w = unpack(slab.column("hashes"))
            if not len(w.hash):
                continue
            best: dict[tuple[int, int], tuple[float, float]] = {}
            done: list[set] = [set() for _ in every]
            for piece in pieces(w, latent, before, after):
                size, sums, doc = 1, piece.sums, piece.doc
                for items, own, found in zip(every, ready, done):
                    while size < items.size:  # the sums of size blocks from each, up to the end of the text
                        more = sums[size:] * (doc[size:] == doc[:-size])[:, None]
                        sums[: len(more)] += more
                        size *= 2
                    for row, name, part, cosine in search(items, own, piece, share, found):
                        best[row, name] = max(best.get((row, name), (part, cosine)), (part, cosine))
            ids = slab.column("doc_id")
            yield pa.record_batch([ids.take(pa.array([d for d, _ in best], pa.int64())), pa.array([i for _, i in best], pa.int64()), pa.array([c for _, c in best.values()], pa.float64()), pa.array([s for s, _ in best.values()], pa.float64())], names=["doc_id", "item_id", "cosine", "lcs"])

    return f


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents in which a leak was found; their other columns may have any names."""
    leaks = find_leaks(docs, benchmark).select(F.struct("doc_id").alias("leak")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("own"))
    stay = rows.join(leaks, F.col("own.doc_id").eqNullSafe(F.col("leak.doc_id")), "left_anti")
    return stay.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
