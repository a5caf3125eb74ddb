"""Exact removal of repeated passages: Rabin-Karp hashes of every fixed-length window of words, counted over the whole corpus.

Documents are dealt to blocks of some megabytes by a hash of id and text. A block hashes all its windows, keeps each value once
(with a bit that says it came more than once), and sends the sorted values to buckets by value range, as packed bytes: a window
costs a few bytes of shuffle, and however often a window occurs, a block sends it once. A bucket counts: it finds the values that
two blocks hold or one block marked, and answers each block with one bit a value.

Windows so found are confirmed on their words: each block sends with each such value a BLAKE2 digest of the window's words (joined
by a space) to buckets in the same way, and a window is repeated only if both are. So a collision of Rabin-Karp hashes costs time,
never a word. The block merges the repeated windows into maximal intervals and removes them. Text is shuffled once, hashes once. Rows equal
in id and text are one row with their number, counted before the shuffle, so many copies are no hot block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm._common import parts, slabs, text_bytes, written
from codelode.llm._tokens import Words, windows, words

WINDOW = 35
BLOCK_BYTES, BUCKET_BYTES, LEAST_BLOCKS = 6 << 20, 12 << 20, 24
AT_ONCE = 1 << 12


def _marks(slab: pa.RecordBatch, w: Words, at: np.ndarray) -> np.ndarray:
    """Which windows are of a text that stands for several equal rows: they are repeated for certain."""
    return (slab.column("copies").to_numpy() > 1)[w.doc[at]]


def _block_hashes(group: pa.Table, size: int, bits: int = 64) -> tuple[list, np.ndarray]:
    """[(slab, its words, first word of each of its windows)], and the hashes of all windows of a block."""
    held, out = [], []
    for slab in slabs(iter(group.combine_chunks().to_batches()), "text"):
        w = words(slab.column("text"))
        at, h = windows(w.hashes(), w.doc, size)
        held.append((slab, w, at))
        out.append(h >> np.uint64(64 - bits) << np.uint64(64 - bits))
    return held, np.concatenate(out) if out else np.zeros(0, np.uint64)


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """floor(value * buckets / 2^64), for fewer than 2^32 buckets: buckets are ranges of values."""
    n, low = np.uint64(buckets), np.uint64(32)
    return (((values >> low) * n + ((values & np.uint64(0xFFFFFFFF)) * n >> low)) >> low).astype(np.int64)


def _cuts(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted values pass from one bucket to the next, and their ends; empty buckets are left out."""
    b = bucket_of(values, buckets)
    return np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(values)]]).astype(np.int64) if len(values) else np.zeros(1, np.int64)


def packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences with like bytes together, which the shuffle's compression shortens."""
    d = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    b = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T)
    return np.cumsum(b.reshape(-1).view(np.uint64), dtype=np.uint64)


def digests(w: Words, at: np.ndarray, size: int) -> np.ndarray:
    """The digest of the words of each window; at is its first word."""
    if not len(at):
        return np.zeros(0, np.uint64)
    length = w.end - w.start + 1
    place = np.concatenate([[0], np.cumsum(length)])
    text = b" ".join(w.data.tobytes().split())  # words keep their order, texts meet at white space or at an edge
    if len(text) != place[-1] - 1:  # words of two texts that meet without white space
        text = b" ".join(w.data[a:b].tobytes() for a, b in zip(w.start.tolist(), w.end.tolist()))
    hashed = hashlib.blake2b
    raw = b"".join([hashed(text[a:b], digest_size=8).digest() for a, b in zip(place[at].tolist(), (place[at + size] - 1).tolist())])
    return np.frombuffer(raw, np.uint64)


_SENT = "level int, block int, bucket int, hashes binary, many binary"
_SAID = "level int, block int, bucket int, n int, bits binary, again binary"


def _rows(level: int, block: int, first: np.ndarray, second: np.ndarray | None, many: np.ndarray, buckets: int) -> pa.Table:
    """Messages to the buckets, of values (and digests) in order."""
    cut = _cuts(first, buckets)
    rows = [(b, packed(first[x:y]) + (second[x:y].tobytes() if second is not None else b""), np.packbits(many[x:y]).tobytes()) for b, x, y in zip(bucket_of(first[cut[:-1]], buckets).tolist(), cut[:-1].tolist(), cut[1:].tolist())]
    ids, vals, marks = zip(*rows) if rows else ((), (), ())
    own = [pa.array([x] * len(rows), pa.int32()) for x in (level, block)]
    return pa.table([*own, pa.array(ids, pa.int32()), pa.array(vals, pa.binary()), pa.array(marks, pa.binary())], names=["level", "block", "bucket", "hashes", "many"])


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def counted(key, group):
    """One bucket's answers: for each value sent, whether two blocks hold it or one marked it, and whether it is that before again."""
    level = key[0].as_py()
    raw = group.column("hashes").to_pylist()
    first = [unpacked(x[: len(x) >> (level - 1)]) for x in raw]
    size = [len(v) for v in first]
    many = np.concatenate([_bits(x, n) for x, n in zip(group.column("many").to_pylist(), size)])
    v1 = np.concatenate(first)
    v2 = np.concatenate([np.frombuffer(x[len(x) >> 1 :], np.uint64) for x in raw]) if level == 2 else np.zeros(len(v1), np.uint64)
    order = np.lexsort((v2, v1)) if level == 2 else np.argsort(v1, kind="stable")
    start = np.concatenate([[True], (v1[order][1:] != v1[order][:-1]) | (v2[order][1:] != v2[order][:-1])])
    at = np.flatnonzero(start)
    twice = np.logical_or.reduceat(many[order], at) | (np.diff(np.append(at, len(v1))) > 1)
    answer = np.empty(len(v1), bool)
    answer[order] = twice[np.cumsum(start) - 1]
    bits = [np.packbits(x).tobytes() for x in np.split(answer, np.cumsum(size)[:-1])]
    again = [np.packbits(np.diff(v, prepend=v[:1] + np.uint64(1)) == 0).tobytes() if level == 2 else b"" for v in first]
    own = [group.column(c).combine_chunks() for c in ("level", "block", "bucket")]
    return pa.table([*own, pa.array(size, pa.int32()), pa.array(bits, pa.binary()), pa.array(again, pa.binary())], names=["level", "block", "bucket", "n", "bits", "again"])


def _answers(said: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The answers of one level in the order in which the block's values were sent, and where a value is that before again."""
    rows = sorted((b, n, x, y) for lv, b, n, x, y in zip(*(said.column(c).to_pylist() for c in ("level", "bucket", "n", "bits", "again"))) if lv == level)
    none = [np.zeros(0, bool)]
    return np.concatenate([_bits(x, n) for _, n, x, _ in rows] or none), np.concatenate([_bits(y, n) if y else np.zeros(n, bool) for _, n, _, y in rows] or none)


def _dedup(blocks: DataFrame, size: int, buckets: int, digest: bool, hash_bits: int) -> DataFrame:
    """blocks (doc_id, text, copies, block) to doc_id, n_words, n_removed, kept words or their digest, and copies."""

    def hashed(key, group):
        held, h = _block_hashes(group, size, hash_bits)
        values, n = np.unique(h, return_counts=True)
        many = n > 1
        mark = np.concatenate([_marks(*x) for x in held] or [np.zeros(0, bool)])
        many[np.searchsorted(values, h[mark])] = True
        return _rows(1, key[0].as_py(), values, None, many, buckets)

    def found(texts, said):
        """The block's slabs, and of each its windows that the first count found, with the index of their values among those found."""
        held, h = _block_hashes(texts, size, hash_bits)
        values, back = np.unique(h, return_inverse=True)
        flag = _answers(said, 1)[0]
        index, used, out = np.cumsum(flag) - 1, 0, []
        for slab, w, at in held:
            own = back[used : used + len(at)]
            used += len(at)
            out.append((slab, w, at[flag[own]], index[own[flag[own]]]))
        return values[flag], out

    def told_apart(held, which=None):
        """Distinct (value, digest) of windows found (of the values marked in which) in order, how many each, and that of each window."""
        value = np.concatenate([v if which is None else v[which[v]] for *_, v in held] or [np.zeros(0, np.int64)])
        digest = np.concatenate([digests(w, at if which is None else at[which[v]], size) for _, w, at, v in held] or [np.zeros(0, np.uint64)])
        order = np.lexsort((digest, value))
        v, d = value[order], digest[order]
        start = np.concatenate([[True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])]) if len(v) else np.zeros(0, bool)
        back = np.empty(len(v), np.int64)
        back[order] = np.cumsum(start) - 1
        return v[start], d[start], np.diff(np.append(np.flatnonzero(start), len(v))), back

    def proved(key, left, right):
        values, held = found(left, right)
        v, d, n, back = told_apart(held)
        many = n > 1
        many[back[np.concatenate([_marks(*x[:3]) for x in held] or [np.zeros(0, bool)])]] = True
        return _rows(2, key[0].as_py(), values[v], d, many, buckets)

    def removed(key, left, right):
        values, held = found(left, right)
        bit, again = _answers(right, 2)
        entry = np.flatnonzero(~again)  # the first of each value; few have another, which only words tell apart
        several = np.diff(np.append(entry, len(bit))) > 1
        hits = [bit[entry[v]] for *_, v in held]
        if several.any():
            v, _, _, back = told_apart(held, several)
            own = bit[np.flatnonzero(several[np.cumsum(~again) - 1])][back]
            used = 0
            for hit, (*_, v) in zip(hits, held):
                hit[several[v]] = own[used : used + several[v].sum()]
                used += several[v].sum()
        ids, n_words, n_removed, kept, copies = [], [], [], [], []
        for (slab, w, at, _), repeated in zip(held, hits):
            hit = at[repeated]
            cover = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + size, -1)
            gone = np.cumsum(cover[:-1]) > 0
            first, data = w.first, w.data.tobytes()
            dropped = np.concatenate([[0], np.cumsum(gone)])
            dropped = (dropped[first[1:]] - dropped[first[:-1]]).tolist()
            for i, k in enumerate(dropped):
                a, b = first[i], first[i + 1]
                own = data[w.offsets[i] : w.offsets[i + 1]].split()
                if k:
                    own = [x for x, g in zip(own, gone[a:b].tolist()) if not g]
                kept.append(hashlib.sha256(b" ".join(own)).hexdigest() if digest else b" ".join(own).decode())
                n_removed.append(k)
            ids += slab.column("doc_id").to_pylist()
            n_words += w.count.tolist()
            copies += slab.column("copies").to_pylist()
        return pa.table([*(pa.array(x, pa.int64()) for x in (ids, n_words, n_removed)), pa.array(kept, pa.string()), pa.array(copies, pa.int64())], names=["doc_id", "n_words", "n_removed", "kept", "copies"])

    by_block = blocks.groupBy("block")
    said = by_block.applyInArrow(hashed, _SENT).groupBy("level", "bucket").applyInArrow(counted, _SAID)
    proof = by_block.cogroup(said.groupBy("block")).applyInArrow(proved, _SENT)
    agreed = proof.groupBy("level", "bucket").applyInArrow(counted, _SAID)
    return by_block.cogroup(said.unionByName(agreed).groupBy("block")).applyInArrow(removed, "doc_id long, n_words long, n_removed long, kept string, copies long")


def once(base: DataFrame) -> DataFrame:
    """doc_id, text and copies: one row for all rows that are equal in both, which Spark counts before they are shuffled.

    Only rows that share a 64-bit hash with another are grouped, by id and text themselves. The table of those hashes is written, so
    that Spark knows its size when it chooses how to join.
    """
    rows = base.withColumn("same", F.xxhash64("doc_id", "text"))
    twice = written(rows.groupBy("same").count().where("count > 1").select("same", F.lit(True).alias("again")))
    split = rows.join(twice, "same", "left")
    alone = split.where("again is null").select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
    return alone.unionByName(split.where("again").groupBy("doc_id", "text").agg(F.count("*").alias("copies")))


def repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as its copies say, in steps of AT_ONCE so that no long array is built."""
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / AT_ONCE))).alias("step")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(AT_ONCE).cast("long"), F.col("copies") - F.col("step") * AT_ONCE))).alias("each")
    return rows.select("*", step).select("*", each).drop("copies", "step", "each")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest: bool = False, hash_bits: int = 64) -> DataFrame:
    """Remove every word that a repeated window of `window` words covers, all its occurrences included.

    Returns doc_id, n_words, n_removed and kept_text (kept words joined by one space), or with digest=True kept_sha256 in place
    of kept_text. With fewer hash_bits more windows have to be told apart by their words; the result is the same. Defined cases: null
    text has no words; texts shorter than a window lose nothing; windows of one text that repeat each other count; rows that repeat
    a doc_id (null ones too) are separate documents; rows equal in id and text are worked on once and returned each; an empty table
    gives an empty result; extra columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = text_bytes(base, "text")
    blocks = parts(size, BLOCK_BYTES, LEAST_BLOCKS)
    dealt = once(base).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    return repeated(_dedup(dealt, window, parts(size, BUCKET_BYTES, LEAST_BLOCKS), digest, hash_bits)).withColumnRenamed("kept", "kept_sha256" if digest else "kept_text")
