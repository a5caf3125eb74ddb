"""Language identification by prediction by partial matching (PPM, escape method C with exclusion) over bytes.

Per language, a context tree of up to `ORDER` bytes has the counts of the byte that follows. A byte is coded in the longest
context known; if it was not seen there, an escape goes to the next shorter one, where bytes of the longer context are excluded,
down to a uniform code over the bytes never seen. Statistics are frozen after training, so a byte's exact code length is a fixed
function of its context; a language's lengths are laid out once as a table (state x byte), where a state is the longest context that
it knows: some tens of megabytes. A text's code length under a language is then a sum of table entries; the shortest one wins.
LANGUAGES_AT_ONCE languages are in memory at a time; where more were learned, texts are scored in that many passes.

Training reads whole texts of a sample bounded by `docs_per_language` labelled documents a language (expected number, chosen by
a hash of the id); the counts, not the texts, reach the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from codelode.llm._common import slabs, written
from codelode.llm._tokens import buffer
from codelode.operators.layout import spread

ORDER = 3
DOCS_PER_LANGUAGE = 2000
LANGUAGES_AT_ONCE = 16
UND = "und"


def grams(data: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """Codes (first byte highest) of the n-grams that lie in one text."""
    if len(data) < n:
        return np.zeros(0, np.uint32)
    code = np.zeros(len(data) - n + 1, np.uint32)
    for i in range(n):
        code = (code << np.uint32(8)) | data[i : len(data) - n + 1 + i]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return code[doc[: len(code)] == doc[n - 1 :]]


class Language:
    """One language's code lengths in bits by state and byte, from its n-gram counts by n, (codes, counts) each."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray]], order: int):
        none = np.zeros(0, np.uint32), np.zeros(0)
        seen = np.unique(counts.get(1, none)[0]).astype(np.int64)
        self.order, self.size = order, (a := len(seen) + 1)  # the last symbol stands for every byte that the language has not
        self.symbol = np.full(256, a - 1, np.int64)
        self.symbol[seen] = np.arange(a - 1)
        tables, contexts = [], []
        value = escape = None
        for o in range(order + 1):
            codes, cnt = counts.get(o + 1, none)
            code, keys = codes.astype(np.int64), np.zeros(len(codes), np.int64)
            for i in range(o + 1):
                keys = keys * a + self.symbol[(code >> (8 * (o - i))) & 255]
            ctx = np.unique(keys // a) if o else np.zeros(1, np.int64)
            c = np.zeros((len(ctx), a))
            c[np.searchsorted(ctx, keys // a), keys % a] = cnt
            has = c > 0
            if o == 0:
                after = np.full((1, a), 1 / max(1, 256 - int(has.sum())))
            else:  # the shorter context without the bytes seen here
                i = np.searchsorted(contexts[-1], ctx % (a ** (o - 1)))
                rest = np.where(has, 0, shorter[i])
                q = (rest > 0).sum(1, keepdims=True)
                d = np.maximum(rest.sum(1, keepdims=True) + q, 1)
                after = np.where(rest > 0, rest / d, np.where(q > 0, q / d, 1.0) * escape[i])
            q = has.sum(1, keepdims=True)
            value = np.where(has, c / np.maximum(c.sum(1, keepdims=True) + q, 1), q / np.maximum(c.sum(1, keepdims=True) + q, 1) * after) if o or len(keys) else after
            tables.append(-np.log2(np.maximum(value, 1e-300)).astype(np.float32))
            contexts.append(ctx)
            escape, shorter = after, c
        self.bits = np.concatenate(tables).reshape(-1)
        base = np.cumsum([0, *map(len, contexts)])
        self.state = np.zeros(1, np.int32)  # of order bytes before, the longest known context
        for o in range(1, order + 1):
            self.state = np.tile(self.state, a)
            self.state[contexts[o]] = base[o] + np.arange(len(contexts[o]))

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each text."""
        n, out = len(data), np.zeros(len(off) - 1)
        if not n:
            return out
        a, sym = self.size, self.symbol[data]
        before = np.zeros(n, np.int64)
        for i in range(self.order, 0, -1):
            x = np.full(n, a - 1, np.int64)
            x[i:] = sym[:-i]
            for k in range(i):  # nothing is before a text
                at = off[:-1] + k
                x[at[at < off[1:]]] = a - 1
            before *= a
            before += x
        at = self.state[before].astype(np.int64) * a + sym
        full = off[:-1] < off[1:]
        out[full] = np.add.reduceat(self.bits[at], off[:-1][full], dtype=np.float64)
        return out


class Model:
    """Code lengths under every language of n-gram counts {(language, n): (codes, counts)}."""

    def __init__(self, counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.langs = sorted({lang for lang, _ in counts})
        self.parts = [Language({n: v for (own, n), v in counts.items() if own == lang}, order) for lang in self.langs]

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        return np.stack([part.lengths(data, off) for part in self.parts], axis=1) if self.parts else np.zeros((len(off) - 1, 1))


_models: dict[str, Model] = {}


def train(docs: DataFrame, order: int = ORDER, docs_per_language: int = DOCS_PER_LANGUAGE) -> dict:
    """n-gram counts of labelled docs (doc_id, text, lang), of a sample of about docs_per_language documents a language."""
    labelled = docs.where("lang is not null and text is not null")
    share = {r["lang"]: min(1.0, docs_per_language / r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    limit = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 30)))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) < limit[F.col("lang")])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text"):
            lang = slab.column("lang")
            for own in pc.unique(lang).to_pylist():
                data, off = buffer(slab.column("text").filter(pc.equal(lang, own)))
                for n in range(1, order + 2):
                    code, cnt = np.unique(grams(data, off, n), return_counts=True)
                    yield pa.record_batch([pa.array([own] * len(code), pa.string()), pa.array([n] * len(code), pa.int32()), pa.array(code.astype(np.int64)), pa.array(cnt)], names=["lang", "n", "code", "cnt"])

    sums = sample.select("text", "lang").mapInArrow(f, "lang string, n int, code long, cnt long").groupBy("lang", "n", "code").agg(F.sum("cnt").alias("cnt")).orderBy("lang", "n", "code").toArrow()
    out = {}
    key = list(zip(sums.column("lang").to_pylist(), sums.column("n").to_pylist()))
    code, cnt = sums.column("code").to_numpy().astype(np.uint32), sums.column("cnt").to_numpy()
    edges = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
    for x, y in zip(edges, edges[1:]):
        if x < y:
            out[key[x]] = code[x:y], cnt[x:y]
    return out


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 4


def _has_letter(texts: pa.Array, data: np.ndarray, off: np.ndarray) -> list[bool]:
    letter = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122), out=letter[1:])
    plain = (letter[off[1:]] > letter[off[:-1]]).tolist()
    return [p or any(map(str.isalpha, texts[i].as_py() or "")) for i, p in enumerate(plain)]


def _score(rows: DataFrame, counts: dict, order: int, last: bool) -> DataFrame:
    """rows (row, text, and lang, cost, odds of the languages before) after the languages of counts; the last has no text."""
    name = uuid.uuid4().hex
    shared = rows.sparkSession.sparkContext.broadcast((name, counts))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, counts = shared.value
        if name not in _models:
            _models.clear()
            _models[name] = Model(counts, order)
        model = _models[name]
        for slab in slabs(batches, "text", 1 << 19):
            texts = slab.column("text")
            data, off = buffer(texts)
            lang, odds = slab.column("lang").to_pylist(), slab.column("odds").to_numpy()
            old, best = slab.column("cost").to_numpy(), np.zeros(len(slab), np.int64)
            low = old
            if model.langs:
                cost = model.lengths(data, off)
                best = cost.argmin(axis=1)
                low = np.minimum(old, cost.min(axis=1))
                odds = odds * np.exp2(-np.minimum(old - low, 1000)) + np.exp2(-np.minimum(cost - low[:, None], 1000)).sum(axis=1)
            lang = [model.langs[b] if new else was for b, new, was in zip(best.tolist(), (low < old).tolist(), lang)]
            cols = [slab.column("row"), texts, pa.array(lang, pa.string()), pa.array(low), pa.array(odds)]
            if last:
                some = [x is not None and y for x, y in zip(lang, _has_letter(texts, data, off))]
                cols = [slab.column("row"), pa.array([x if y else UND for x, y in zip(lang, some)], pa.string()), pa.array(np.where(some, 1 / np.maximum(odds, 1e-300), 0.0))]
            yield pa.record_batch(cols, names=["row", "lang_pred", "score"] if last else ["row", "text", "lang", "cost", "odds"])

    fields = [("lang_pred", StringType()), ("score", DoubleType())] if last else [("text", StringType()), ("lang", StringType()), ("cost", DoubleType()), ("odds", DoubleType())]
    return rows.mapInArrow(f, StructType([StructField("row", rows.schema["row"].dataType), *(StructField(*x) for x in fields)]))


def identify(docs: DataFrame, counts: dict, order: int = ORDER, keep: list[str] | None = None) -> DataFrame:
    """docs (with text) to the columns keep, lang_pred and score, the winner's posterior under equal priors.

    lang_pred is `und` with score 0 for a null text, a text without a letter, or where no language was learned. Ties go to the
    language first in order. Columns may have any names; rows that repeat are predicted each.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != "text"]
    own = F.struct(*[docs["`" + c.replace("`", "``") + "`"] for c in keep]).alias("row")
    rows = docs.select(own, F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(float("inf")).alias("cost"), F.lit(0.0).alias("odds"))
    langs = sorted({lang for lang, _ in counts})
    groups = [langs[i : i + LANGUAGES_AT_ONCE] for i in range(0, len(langs), LANGUAGES_AT_ONCE)] or [[]]
    for i, group in enumerate(groups):
        rows = _score(rows, {k: v for k, v in counts.items() if k[0] in group}, order, i + 1 == len(groups))
        if i + 1 < len(groups):
            rows = written(rows)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in keep], "lang_pred", "score")


def predict(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from labelled documents whose remainder is not 2, applied to all.

    Defined cases: a null doc_id is not held out and not learned from; a row without lang is predicted but not learned from; an
    empty table gives an empty result; extra columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = train(base.where(remainder() != 2), docs_per_language=docs_per_language)
    ready = spread(base).select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "text")
    return identify(ready, counts, keep=["doc_id", "held_out"])
