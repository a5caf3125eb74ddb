"""Packing of tokenised documents into fixed-length sequences by bounded-space online best fit.

Each partition keeps `open_windows` windows. A piece goes into the open window that it leaves the least room in (best fit). When
none takes it whole, the fullest window is topped up with the piece's head and emitted, a new window opens, and the rest of the
piece is placed again. What stays open at the end of a partition is merged with other partitions' leftovers, `fan_in` partitions
a task, level by level. The last window of all is cut into lengths that are powers of two, which need no padding.

Ids are those of the tokenizers library for the vocabulary file. They are computed by tiktoken from that same file's vocabulary,
which gives the same ids four times as fast (tests compare the two); a vocabulary of another kind, and a text with white space of
LONG_SPACE characters on end, on which tiktoken's backtracking runs out of stack, goes through tokenizers itself.
With added_tokens, as the queries have it, the literal text of an added token (<|endoftext|>) is that one id, as
encode(text, add_special_tokens=False) has it; without, it is encoded like any other text (encode_special_tokens).

Defined cases: a null text counts as empty and has only the end id; a null doc_id is kept as null; rows that repeat a doc_id
are packed row by row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm._common import slabs, written
from codelode.operators.layout import spread

LENGTH, OPEN, FAN_IN = 1024, 16, 64
LONG_SPACE = 10_000
_LONG_SPACE = re.compile(rf"(?<!\s)\s{{{LONG_SPACE},}}+")
#: Sequence ids: partition-phase ids count up from partition * 2^SHIFT; merged ones have MERGED added.
SHIFT, MERGED = 32, 1 << 61

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_LEFT = "part long, ids binary"


@lru_cache(maxsize=2)
def encoder(path: str, added_tokens: bool = False):
    """A function from texts to lists of ids under the vocabulary at path (a tokenizers JSON file)."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = not added_tokens

    def plainly(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]

    spec = json.load(open(path, encoding="utf-8"))
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    added = spec.get("added_tokens", [])
    names = [x["content"] for x in added]
    plain = not any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip")) and not any(a != b and a in b for a in names for b in names)
    if (plain or not added_tokens) and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and model["type"] == "BPE" and not spec.get("normalizer"):
        import public_tokenizers
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves
        other = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte[c] for c in k): v for k, v in model["vocab"].items() if k not in names}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={x["content"]: x["id"] for x in added} if added_tokens else {})
        fast = partial(own.encode, allowed_special="all") if added_tokens else own.encode_ordinary
        return lambda texts: [plainly([t])[0] if len(t) >= LONG_SPACE and _LONG_SPACE.search(t) else fast(t) for t in texts]
    return plainly


class Packer:
    """The open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int, space: int, next_id: int):
        self.length, self.space, self.next_id = length, space, next_id
        self.open: list[list] = []  # [used, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def place(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            if len(ids) >= self.length:
                self.emit([(doc, start, ids[: self.length], total)])
                start, ids = start + self.length, ids[self.length :]
                continue
            fits = [w for w in self.open if w[0] + len(ids) <= self.length]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.space:
                self.open.append(best := [0, []])
            else:  # top up the fullest and emit it
                best = max(self.open, key=lambda w: w[0])
                n = self.length - best[0]
                self.emit([*best[1], (doc, start, ids[:n], total)])
                self.open.remove(best)
                start, ids = start + n, ids[n:]
                continue
            best[0] += len(ids)
            best[1].append((doc, start, ids, total))
            if best[0] == self.length:
                self.emit(best[1])
                self.open.remove(best)
            return

    def close(self) -> None:
        """Emit what is left: windows are filled from one another, the last is cut into powers of two."""
        rest = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open = []
        todo = sum(len(p[2]) for p in rest)
        while todo:
            want = self.length if todo >= self.length else 1 << (todo.bit_length() - 1)
            todo, have, pieces = todo - want, 0, []
            while have < want:
                doc, start, ids, total = rest.pop(0)
                n = min(len(ids), want - have)
                pieces.append((doc, start, ids[:n], total))
                have += n
                if n < len(ids):
                    rest.insert(0, (doc, start + n, ids[n:], total))
            self.emit(pieces)


def _columns(rows: list[tuple], left: list[tuple]) -> pa.RecordBatch:
    """Emitted pieces have a null part; leftover ones have ids and no sequence."""
    cols = [*zip(*rows)] if rows else [[]] * 7
    lcols = [*zip(*left)] if left else [[]] * 6
    n, m = len(rows), len(left)
    pick = lambda i, j: pa.array([*cols[i], *(lcols[j] if j is not None else [None] * m)], pa.int64())
    return pa.record_batch(
        [pick(0, 0), pick(1, 1), pick(2, 2), pick(3, None), pick(4, 3), pick(5, None), pick(6, None), pa.array([*[None] * n, *lcols[4]], pa.int64()), pa.array([*[None] * n, *lcols[5]], pa.binary())],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"],
    )


def _leftovers(packer: Packer, part: int) -> list[tuple]:
    return [(doc, start, len(ids), total, part, ids.tobytes()) for _, pieces in packer.open for doc, start, ids, total in pieces]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, open_windows: int = OPEN, end_id: int = 0, fan_in: int = FAN_IN, added_tokens: bool = False) -> DataFrame:
    """Pieces of every document in sequences of at most length ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, encode = Packer(length, open_windows, part << SHIFT), encoder(tokenizer, added_tokens)
        for slab in slabs(batches, "text"):
            texts = ["" if t is None else t for t in slab.column("text").to_pylist()]
            for doc, ids in zip(slab.column("doc_id").to_pylist(), encode(texts)):
                ids.append(end_id)
                packer.place(doc, 0, np.array(ids, "<u4"), len(ids))
            yield _columns(packer.rows, [])
            packer.rows = []
        yield _columns([], _leftovers(packer, part))

    def merge(last: bool, level: int):
        def f(key, group):
            part = key[0].as_py()
            packer = Packer(length, open_windows, MERGED + (level << 56) + (part << SHIFT))
            g = group.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
            for doc, start, ids, total in zip(*(g.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
                packer.place(doc, start, np.frombuffer(ids, "<u4"), total)
            if last:
                packer.close()
            return pa.Table.from_batches([_columns(packer.rows, _leftovers(packer, part))])

        return f

    schema = f"{_PIECE}, {_LEFT}"
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = spread(base)
    out = written(base.mapInArrow(first, schema))
    done, level = out.where("part is null"), 0
    left = out.where("part is not null")
    todo = 1 + (left.agg(F.max("part").alias("m")).first()["m"] or 0)
    while True:  # each level has fan_in times fewer groups, the last has one
        last, todo, level = todo <= fan_in, -(-todo // fan_in), level + 1
        merged = left.groupBy(F.floor(F.col("part") / fan_in).cast("long").alias("at")).applyInArrow(merge(last, level), schema)
        if last:
            done = done.unionByName(merged)
            break
        merged = written(merged)
        done, left = done.unionByName(merged.where("part is null")), merged.where("part is not null")
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
