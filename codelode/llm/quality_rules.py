"""Quality rules whose thresholds adapt to each language and source.

Features of whole texts are counted in numpy. Their distribution per (language, source) goes into quantile sketches: a
log-linear histogram keeps values below 64 as they are and the six highest bits of larger ones, so a quantile is within 1/32 of
its value. A sketch is a set of (bucket, count) rows; sketches merge by adding counts, which is how they are built in one
distributed aggregation, and how those of a language and of the whole corpus come from those of the sources. Unlike sampling
sketches the outcome does not depend on the order of merging.

A document fails the method if a ratio lies outside its group's fences, quartiles -/+ FENCE times the spread between them (a
floor keeps groups without spread from failing everybody). Groups of under LEAST documents use their language's fences, and
languages of under LEAST the corpus's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm._common import slabs, written
from codelode.llm._tokens import SPACE, windows, words
from codelode.operators.layout import spread

LEAST, FENCE = 50, 3
#: Metrics as whole numbers: numerator, denominator, scale, floor of the spread, and whether low values fail too.
METRICS = {
    "word_length": ("word_chars", "n_words", 100, 60, True),
    "symbols": ("n_symbols", "n_words", 1000, 60, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 200, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 120, False),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def count_slab(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a slab."""
    w = words(texts)
    data, off, n = w.data, w.offsets, len(texts)

    def per_text(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[off[1:]] - c[off[:-1]]

    at, h = windows(w.hashes(), w.doc, 3)
    doc = w.doc[at]
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(w.start), bool)
    for i in range(3):
        cover[at[twice] + i] = True
    lines, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = data.tobytes()
    for i in range(n):
        own = [x for x in raw[off[i] : off[i + 1]].split(b"\n") if x and not x.isspace()]
        lines[i], dup[i] = len(own), len(own) - len(set(own))
    return {"n_words": w.count, "word_chars": per_text(~SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": per_text(_SYMBOL[data]), "n_lines": lines, "n_dup_lines": dup, "n_repeat_words": np.bincount(w.doc[cover], minlength=n).astype(np.int64)}


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text"):
            c = count_slab(slab.column("text"))
            yield pa.record_batch([slab.column("doc_id"), slab.column("lang"), slab.column("source"), *[pa.array(c[k]) for k in COUNTS]], names=["doc_id", "lang", "source", *COUNTS])

    return spread(base).mapInArrow(f, "doc_id long, lang string, source string, " + ", ".join(f"{k} long" for k in COUNTS))


def bucket(v: Column) -> Column:
    """The least value of a value's bucket: v below 64, else its six highest bits."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    step = F.pow(F.lit(2.0), shift)
    return (F.floor(v / step) * step).cast("long")


def metric(name: str) -> Column:
    top, bottom, scale, _, _ = METRICS[name]
    return F.floor(F.lit(scale) * F.col(top) / F.greatest(F.col(bottom), F.lit(1))).cast("long")


def sketches(feats: DataFrame) -> DataFrame:
    """Mergeable sketches: lang, source, metric, bucket, n. Documents that fail the base rules are not part of them."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(metric(k)).alias("bucket")) for k in METRICS])
    return feats.where(~F.col("base_failed")).select("lang", "source", F.explode(pairs).alias("x")).groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of keys and metric: n and the buckets at which a quarter and three quarters of the counts are reached."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys, "metric")
    run = merged.withColumns({"upto": F.sum("n").over(own.orderBy("bucket")), "total": F.sum("n").over(own)})
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    return run.groupBy(*keys, "metric").agg(F.max("total").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def fences(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """A row per group of keys of at least LEAST documents (any number without keys): low and high fence of every metric."""
    q = quartiles(sketch, keys)
    cols = []
    for k, (_, _, _, floor, both) in METRICS.items():
        pick = lambda c, k=k: F.max(F.when(F.col("metric") == k, F.col(c)))
        spread = F.greatest(pick("q3") - pick("q1"), F.lit(floor))
        cols += [(pick("q3") + FENCE * spread).alias(f"{tag}_{k}_high"), (pick("q1") - FENCE * spread if both else F.lit(-1).cast("long")).alias(f"{tag}_{k}_low")]
    out = q.groupBy(*keys).agg(F.max("n").alias("n"), *cols)
    return (out.where(F.col("n") >= LEAST) if keys else out).drop("n")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept.

    Defined cases: null text has no words (and fails the base rules); null lang or source is a group like any other; rows that
    repeat a doc_id are judged each; an empty table gives an empty result; extra columns are ignored. Group tables have a row a
    (language, source), so they are joined, and broadcast only where Spark knows them to be small.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    feats = written(features(docs).withColumn("base_failed", failed))
    sketch = written(sketches(feats))
    out = feats
    for tag, keys in (("own", ["lang", "source"]), ("lang", ["lang"])):
        f = fences(sketch, keys, tag).withColumnsRenamed({k: f"{tag}__{k}" for k in keys})
        on = [F.col(k).eqNullSafe(F.col(f"{tag}__{k}")) for k in keys]
        out = out.join(f, on, "left").drop(*[f"{tag}__{k}" for k in keys])
    whole = fences(sketch, [], "all").first()
    bound = lambda k, side: F.coalesce(F.col(f"own_{k}_{side}"), F.col(f"lang_{k}_{side}"), F.lit(whole[f"all_{k}_{side}"] if whole else None).cast("long"))
    fine = F.lit(True)
    for k in METRICS:
        fine = fine & (metric(k) <= bound(k, "high")) & (metric(k) >= bound(k, "low"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(fine, F.lit(True))).alias("kept"))
