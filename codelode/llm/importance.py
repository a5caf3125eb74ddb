"""Quality selection by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

The target is a sample of about TARGET_DOCS labelled good documents (quality 1, not toxic), chosen by a hash of the id; raw is
every document, and every document is weighed. Both are generative bags of hashed
n-grams: words and word pairs, and the same over word shapes (runs of lower case, capitals, digits and each other sign; pairs
also tell whether the two words are the same), each counted once a document. A document's log weight is the sum over its n-grams
of log((target + A) / (expected + A)), where expected is the raw count times the target's share of documents. Buckets whose
target count is within Z standard errors of that have ratio 1: they would only add noise.

k documents are drawn without replacement in proportion to their weights by adding Gumbel noise (a hash of the id) to the log
weight and taking the k largest sums. k is a parameter; by default it is the number of documents whose log weight reaches the
highest tenth that at most a share LOSS of the labelled good documents lies below. The k-th largest sum is found exactly by radix
selection, 16 bits a pass, so nothing is sorted or gathered; sums of any size keep their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm._common import slabs, written
from codelode.llm._tokens import distinct, mix, run_hashes, windows, words
from codelode.operators.layout import spread

BUCKETS, PRIOR, ERRORS, SEED = 1 << 18, 1.0, 3.0, 11
LOSS, TARGET_DOCS = 0.01, 20_000
_CLASS = np.arange(256, dtype=np.uint8) | 128
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1
_SHAPES = 1  # seed of the hashes of shapes
_SALT = [np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shapes(w) -> np.ndarray:
    """A hash of each word's shape; letters outside ASCII count as lower case."""
    kind = _CLASS[w.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[w.start] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    return run_hashes(kind[keep], upto[w.start], upto[w.end], _SHAPES)


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) of a slab, as two arrays in order."""
    w = words(texts)
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, s = w.hashes(lower=True), shapes(w)
    at, h2 = windows(h, w.doc, 2)
    _, s2 = windows(s, w.doc, 2)
    same = (h[at] == h[at + 1]).astype(np.uint64)
    code = [mix(x ^ _SALT[i]) for i, x in enumerate((h, h2, s, s2 + same))]
    doc = np.concatenate([w.doc, w.doc[at], w.doc, w.doc[at]])
    both = distinct(doc * buckets + (np.concatenate(code) % np.uint64(buckets)).astype(np.int64))
    return both // buckets, both % buckets


def ratios(docs: DataFrame, target: np.ndarray, buckets: int = BUCKETS, prior: float = PRIOR, errors: float = ERRORS) -> np.ndarray:
    """Log ratio of each bucket, from docs (doc_id, text) and the ids of target documents. Raw counts are over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(target))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good, n = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), [0, 0]
        for slab in slabs(batches, "text"):
            doc, b = features(slab.column("text"), buckets)
            ids = slab.column("doc_id")
            is_good = np.isin(ids.fill_null(0).to_numpy(), shared.value) & ids.is_valid().to_numpy(zero_copy_only=False)
            raw += np.bincount(b, minlength=buckets)
            good += np.bincount(b[is_good[doc]], minlength=buckets)
            n = [n[0] + len(slab), n[1] + int(is_good.sum())]
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array([-1, *at], pa.int64()), pa.array([n[0], *raw[at]], pa.int64()), pa.array([n[1], *good[at]], pa.int64())], names=["bucket", "raw", "good"])

    sums = docs.select("doc_id", "text").mapInArrow(f, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    bucket, raw, good = (sums.column(c).to_numpy() for c in ("bucket", "raw", "good"))
    out = np.zeros(buckets, np.float32)
    if len(bucket) and (total := raw[bucket == -1].sum()):
        share = good[bucket == -1].sum() / total
        b = bucket >= 0
        expected = raw[b] * share
        ratio = np.log((good[b] + prior) / (expected + prior))
        out[bucket[b]] = np.where(np.abs(good[b] - expected) < errors * np.sqrt(expected + 1), 0, ratio)
    return out


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_features and log_weight."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for slab in slabs(batches, "text"):
            doc, b = features(slab.column("text"), len(r))
            n = np.bincount(doc, minlength=len(slab)).astype(np.int64)
            w = np.bincount(doc, r[b].astype(np.float64), minlength=len(slab))
            yield pa.record_batch([slab.column("doc_id"), pa.array(n), pa.array(w)], names=["doc_id", "n_features", "log_weight"])

    return docs.select("doc_id", "text").mapInArrow(f, "doc_id long, n_features long, log_weight double")


def gumbel(seed: int = SEED) -> Column:
    """Standard Gumbel noise, a function of doc_id."""
    unit = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(unit))


def cut(weighed: DataFrame, loss: float = LOSS) -> float:
    """The highest log weight, in steps of a tenth, that at most a share `loss` of the labelled good documents lies below."""
    step = F.floor(F.col("log_weight") * 10).cast("long")
    rows = sorted((r["s"], r["n"]) for r in weighed.where("good").groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect())
    spare = loss * sum(n for _, n in rows)
    for s, n in rows:
        if (spare := spare - n) < 0:
            return s / 10
    return -math.inf


def kth_largest(df: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest value of a long column; None if k < 1 or there are fewer. Four passes of at most 65,536 counts each."""
    if k < 1:
        return None
    shifted = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    high = 0
    for level in range(3, -1, -1):
        own = df if level == 3 else df.where(F.shiftrightunsigned(shifted, 16 * (level + 1)) == high)
        digit = F.shiftrightunsigned(shifted, 16 * level).bitwiseAND(0xFFFF)
        for d, n in sorted(((r["d"], r["n"]) for r in own.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True):
            if n >= k:
                break
            k -= n
        else:
            return None
        high = high << 16 | d
    return (high ^ (1 << 63)) - (1 << 64) if high ^ (1 << 63) >= 1 << 63 else high ^ (1 << 63)


def sortable(x: Column, top: float) -> Column:
    """A double as a long of the same order, for doubles of at most top: fixed point, in steps finer than those of doubles near top."""
    return F.round(x * F.lit(2.0**62 / max(top, 1.0))).cast("long")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, log_weight, gumbel_key and kept (among the k largest keys) of every document.

    Defined cases: null or empty texts have log weight 0; documents with several labels are good if all say so, null labels say
    nothing; without labelled good documents all weights are 0; rows that tie with the k-th are all kept; an empty table gives
    an empty result; extra columns are ignored. Labels have a row a document at most, and are joined, not broadcast by hand.
    """
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("good")).where("good is not null and doc_id is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = spread(base)
    good_ids = marks.where("good").select("doc_id")
    share = min(1.0, TARGET_DOCS / max(1, good_ids.count()))
    target = good_ids.where(F.pmod(F.xxhash64("doc_id", F.lit("target")), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1)).toArrow()
    weighed = written(weigh(base, ratios(base, target.column("doc_id").to_numpy().astype(np.int64))))
    if k is None:
        k = weighed.where(F.col("log_weight") >= cut(weighed.join(marks, "doc_id"))).count()
    keyed = weighed.withColumn("gumbel_key", F.col("log_weight") + gumbel(seed))
    top = keyed.agg(F.max(F.abs("gumbel_key")).alias("m")).first()["m"] or 1.0
    place = sortable(F.col("gumbel_key"), top)
    at = kth_largest(keyed.select(place.alias("key")), "key", k)
    kept = F.lit(k > 0) if at is None else place >= at
    return keyed.select("doc_id", "n_features", "log_weight", "gumbel_key", kept.alias("kept"))
