"""The prefix trie of conversations: which first turns they share, and how many words a shared prefix saves.

Only digests of turns and counts of words are shuffled, never texts. Equal conversations become one sequence with a count first, so
a conversation that many have is one path. Sequences are dealt to buckets by the digest of their first turn; a bucket's sub-tries are
dictionaries of pointers, built and summed up in one task. A sub-trie too large for that is not built: its sequences are dealt again
by the next turn (behind the turns that all of them share), again and again, and the nodes above are sums over their children.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm._common import parts, written

#: Turns of the sequences that one sub-trie may have; ids of one row of text to hash.
LIMIT, CHUNK = 20_000, 1 << 14
EVERY, HEADS = 20, 4
#: Of turns with equal numbers and roles, so much of the text decides their order before its digest.
_TIE_CHARS = 32
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _key(path: Column, depth: Column | int) -> Column:
    """The digest of a path's first turns."""
    return _digest(F.array_join(F.transform(F.slice(path, 1, F.lit(depth) if isinstance(depth, int) else depth), F.hex), ""))


_ROOT = bytes.fromhex(hashlib.sha256(b"").hexdigest()[:32])


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id, path (a digest of role and text a turn) and words (theirs), in the order of turns; see trie for defined cases."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").isNotNull().alias("numbered"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"), F.substring(text, 1, _TIE_CHARS).alias("start"),
        _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )
    whole = rows.where(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.select("conv_id", F.col("turns.digest").alias("path"), F.col("turns.words").alias("words"))


def with_shared_heads(convs: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % every, then c's own after its first h; h = crc32(c) % heads."""
    base = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, heads - 1).alias("head"), F.slice("words", 1, heads - 1).alias("head_words"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    both = convs.join(base, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    join = lambda head, own: F.concat(F.coalesce(F.slice(head, 1, h), F.slice(own, 1, 0)), F.slice(own, h + 1, F.size(own)))
    return both.select("conv_id", join("head", "path").alias("path"), join("head_words", "words").alias("words"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a sequence that lie in a task, joined by commas, some thousands a row."""
    seqs, ids = [], []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seqs, pa.binary()), pa.array([x[0] for x in ids], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([",".join(map(str, x)) for x in ids], pa.string())], names=["seq", "conv_id", "n", "ids"])

    for batch in batches:
        for seq, conv in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()):
            if seqs and seqs[-1] == seq and len(ids[-1]) < CHUNK:
                ids[-1].append(conv)
            else:
                if len(seqs) >= CHUNK:
                    yield rows()
                    seqs, ids = [], []
                seqs.append(seq)
                ids.append([conv])
    if seqs:
        yield rows()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a sequence from its chunks in order: the smallest id, how many, and the SHA-256 of all joined by commas."""
    out, last, state = [], None, None

    def rows() -> pa.RecordBatch:
        seq, conv, n, ends = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(seq, pa.binary()), pa.array(conv, pa.int64()), pa.array(n, pa.int64()), pa.array(ends, pa.string())], names=["seq", "conv_id", "n", "ends"])

    for batch in batches:
        for seq, conv, n, ids in zip(*(batch.column(c).to_pylist() for c in ("seq", "conv_id", "n", "ids"))):
            if seq == last:
                out[-1][2] += n
                state.update(b",")
            else:
                if out:
                    out[-1][3] = state.hexdigest()
                if len(out) >= CHUNK:
                    yield rows()
                    out = []
                out.append([seq, conv, n, None])
                last, state = seq, hashlib.sha256()
            state.update(ids.encode())
    if out:
        out[-1][3] = state.hexdigest()
        yield rows()


def _sequences(convs: DataFrame) -> DataFrame:
    """Distinct paths: seq (their digest), path, words, size, and of the conversations that have it the smallest id, number and hash of ids.

    Ids are sorted by range, so that those of one sequence may lie in many tasks; each gives rows of text, which are hashed in order.
    """
    whole = written(convs.select(_key(F.col("path"), F.size("path")).alias("seq"), "conv_id", "path", "words"))
    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = whole.select("seq", "conv_id").repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(_chunks, "seq binary, conv_id long, n long, ids string")
    ends = chunks.repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(_hashes, "seq binary, conv_id long, n long, ends string")
    return written(ends.join(whole.drop("seq"), "conv_id").withColumn("size", F.size("path")))


def _subtries(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's sub-tries; `up` is the key of the node above for their top nodes only."""
    tops: dict[bytes, int] = {}
    children: list[dict[bytes, int]] = []
    parent, depth, words, conv, n, ends, up = [], [], [], [], [], [], []

    def node(above: int, at: int, count: int, over: bytes | None) -> int:
        children.append({})
        for column, value in ((parent, above), (depth, at), (words, count), (conv, None), (n, 0), (ends, None), (up, over)):
            column.append(value)
        return len(depth) - 1

    for top, over, lo, path, counts, first, many, digest in rows[["top", "up", "lo", "path", "words", "conv_id", "n", "ends"]].itertuples(index=False):
        at = tops.get(top)
        if at is None:
            at = tops[top] = node(-1, lo, int(counts[0]), over)
        for i in range(1, len(path)):
            below = children[at].get(path[i])
            if below is None:
                below = children[at][path[i]] = node(at, lo + i, int(counts[i]), None)
            at = below
        conv[at], n[at], ends[at] = first, many, digest
    size = len(depth)
    leaves, saved = [0] * size, [0] * size
    for at in range(size - 1, -1, -1):  # nodes come after those above them, so this is a postorder
        leaves[at] = leaves[at] or 1
        saved[at] += (n[at] - 1) * words[at]
        if (above := parent[at]) >= 0:
            n[above] += n[at]
            leaves[above] += leaves[at]
            saved[above] += saved[at]
            conv[above] = conv[at] if conv[above] is None else min(conv[above], conv[at])
    return pd.DataFrame({
        "conv_id": conv, "depth": depth, "parent_conv_id": pd.array([conv[p] if p >= 0 else None for p in parent], "Int64"), "n_convs": n, "n_children": list(map(len, children)), "n_leaves": leaves, "saved_tokens": saved, "ends": ends, "up": up,
    })


def _deal(seqs: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Sequences with the sub-trie to build them in (top, up and lo, the depth of its top node), and by round the chains of nodes above.

    A chain (key, up, lo, hi, words) are the nodes from depth lo to hi that all members of an oversized sub-trie share.
    """
    path = F.col("path")
    pending = seqs.where("size > 0").withColumns({"lo": F.lit(1), "up": F.lit(_ROOT), "top": _key(path, 1)})
    dealt, chains = [], []
    while True:
        groups = pending.groupBy("top").agg(F.sum(F.col("size") - F.col("lo") + 1).alias("turns"), F.count("*").alias("seqs"))
        big = written(groups.where((F.col("turns") > limit) & (F.col("seqs") > 1)).select("top"))
        if big.isEmpty():
            dealt.append(pending)
            break
        dealt.append(pending.join(big, "top", "left_anti"))
        inside = pending.join(big, "top")
        ends = inside.groupBy("top", "lo", "up").agg(F.min(F.struct("path", "words")).alias("a"), F.max("path").alias("b"))
        # first and last in order share what all share
        same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size("a.path"), F.size("b"))), lambda i: F.slice("a.path", 1, i) == F.slice("b", 1, i)))
        chain = written(ends.withColumn("hi", same).select("top", "lo", "up", "hi", _key(F.col("a.path"), F.col("hi")).alias("key"), F.slice("a.words", F.col("lo"), F.col("hi") - F.col("lo") + 1).alias("words")))
        chains.append(chain)
        deeper = inside.drop("lo", "up").join(chain.select("top", (F.col("hi") + 1).alias("lo"), F.col("key").alias("up")), "top").where(F.col("size") >= F.col("lo"))
        pending = written(deeper.withColumn("top", _key(path, F.col("lo"))))
    return reduce(DataFrame.unionByName, [d.select("top", "up", "lo", "conv_id", "n", "ends", F.slice("path", F.col("lo"), F.size("path")).alias("path"), F.slice("words", F.col("lo"), F.size("words")).alias("words")) for d in dealt]), chains


def _summed(tops: DataFrame) -> DataFrame:
    return tops.groupBy("up").agg(F.sum("n_convs").alias("n"), F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"), F.min("conv_id").alias("conv"))


def trie(convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row a node of the trie over convs (conv_id, path, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a sequence of first turns that some conversation has, and is named by its smallest member and depth. Defined cases: a null
    role or text is empty; turns with equal numbers are ordered by role, then by text (its first 32 characters, then its digest), those
    without number come first; rows that repeat are turns of their own; rows without conv_id are in no conversation; a conversation
    without turns is a member of the root only; no conversation gives no node, not even a root. A conversation's turns must fit a task at
    some 40 bytes each. limit bounds the turns that a sub-trie built in one task may have, and changes no result.
    """
    seqs = _sequences(convs)
    rows, chains = _deal(seqs, limit)
    buckets = max(parts(seqs.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"], limit), int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nodes = written(rows.withColumn("bucket", F.pmod(F.xxhash64("top"), F.lit(buckets))).groupBy("bucket").applyInPandas(_subtries, f"{_NODE}, up binary"))
    names = [f.split()[0] for f in _NODE.split(", ")]
    own = seqs.select(F.col("seq").alias("key"), F.col("n").alias("own_n"), F.col("conv_id").alias("own_conv"), "ends")
    done, above = [nodes.where(F.col("up").isNull()).select(*names)], []
    tops = nodes.where(F.col("up").isNotNull()).drop("parent_conv_id")
    for chain in reversed(chains):
        end = chain.join(_summed(tops).withColumnRenamed("up", "key"), "key").join(own, "key", "left")
        end = end.withColumns({"n": F.col("n") + F.coalesce("own_n", F.lit(0)), "conv": F.least("conv", "own_conv")})
        every = written(end.withColumn("depth", F.explode(F.sequence("lo", "hi"))).select(
            F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > F.col("lo"), F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(F.col("depth") == F.col("hi"), F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
            (F.col("saved") + (F.col("n") - 1) * F.aggregate(F.slice("words", F.col("depth") - F.col("lo") + 1, F.size("words")), F.lit(0).cast("long"), lambda s, w: s + w)).alias("saved_tokens"),
            F.when(F.col("depth") == F.col("hi"), F.col("ends")).alias("ends"), F.when(F.col("depth") == F.col("lo"), F.col("up")).alias("up"), "key",
        ))
        done.append(every.where(F.col("up").isNull()).select(*names))
        above.append(every.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id")).distinct())
        tops = tops.unionByName(every.where(F.col("up").isNotNull()).drop("parent_conv_id", "key"))
    at_root = tops.where(F.col("up") == F.lit(_ROOT))
    total, turnless = (df.first() for df in (_summed(at_root), own.where(F.col("key") == F.lit(_ROOT))))
    if total or turnless:
        conv = min(([total["conv"]] if total else []) + ([turnless["own_conv"]] if turnless else []))
        n = (total["n"] if total else 0) + (turnless["own_n"] if turnless else 0)
        root = [conv, 0, None, n, *((total["n_children"], total["n_leaves"], total["saved"]) if total else (0, 1, 0)), turnless["ends"] if turnless else None]
        done += [seqs.sparkSession.createDataFrame([tuple(root)], _NODE), at_root.withColumn("parent_conv_id", F.lit(conv).cast("long")).select(*names)]
    if above:
        done.append(tops.where(F.col("up") != F.lit(_ROOT)).join(reduce(DataFrame.unionByName, above), "up").select(*names))
    none = hashlib.sha256(b"").hexdigest()
    return reduce(DataFrame.unionByName, done).withColumn("ends", F.coalesce("ends", F.lit(none))).withColumnRenamed("ends", "ends_sha256")


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt with shared heads."""
    return trie(with_shared_heads(conversations_of(rows)))
