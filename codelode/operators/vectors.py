"""Embeddings: a deterministic embedder, dimension checks, cosine top-k, an approximate index and copy-forward."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def top_k(vectors: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The k vectors most similar to one query, with score (6 places); payload filters first. Spark keeps k rows a task."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("score", F.round(cosine(F.col(vector), q), 6)).orderBy(F.desc_nulls_last("score"), key).limit(k)


#: Vectors and queries compared at a time in a task: some 30 MB, whatever the Arrow batches hold.
ROWS, ASKED = 1024, 512


def merged(have: tuple | None, score: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, pa.Array]:
    """The best k scores a query (a row) and their ids, of those had so far and new ones; ties go to the lower id."""
    if score.shape[1] > k:  # with all that are as near as the last
        least = np.partition(score, -k, axis=1)[:, -k, None]
        wanted = score >= (least if have is None else np.maximum(least, have[0].min(1, keepdims=True) if have[0].shape[1] == k else -2))
        used = np.flatnonzero(wanted.any(0))
        score, ids = score[:, used], ids.take(pa.array(used))
    place = np.broadcast_to(np.arange(len(ids)), score.shape)
    if have is not None:
        score, place = np.concatenate([have[0], score], 1), np.concatenate([np.arange(have[0].size).reshape(have[0].shape), place + have[0].size], 1)
        ids = pa.concat_arrays([have[1], ids])
    own = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
    best = np.lexsort((own[place], -score), axis=1)[:, :k]
    return np.take_along_axis(score, best, 1), ids.take(pa.array(np.take_along_axis(place, best, 1).ravel()))


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", block: int = 2000) -> DataFrame:
    """query_id, key, score and rank: the k vectors most similar to each of a stated set of queries (query_id, vector).

    Exact: every vector is compared with every query by matrix products. Queries go to the driver in blocks of at most `block`,
    whose size bounds what is broadcast; a task compares ROWS vectors with ASKED queries at a time and keeps k a query, so it gives k
    rows a query however many vectors it reads; these are then merged. Ties go to the lower key. Vectors of another length than the
    queries, or of length zero, are no candidates.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col("query_id").cast("long"), F.col(vector)).where(F.col(vector).isNotNull())
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(F.col(vector).isNotNull())
    kind = dict(rows.dtypes)["id"]

    def search(part: list) -> DataFrame:
        ids = np.array([r["query_id"] for r in part], np.int64)
        q = np.array([r[vector] for r in part], np.float64)
        shared = spark.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            cuts = range(0, len(ids), ASKED)
            best: list[tuple | None] = [None] * len(cuts)
            for whole in batches:
                for at in range(0, len(whole), ROWS):
                    batch = whole.slice(at, ROWS)
                    fit = batch.filter(pc.equal(pc.list_value_length(batch.column("v")), q.shape[1]))
                    if not len(fit):
                        continue
                    x = fit.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1]).astype(np.float64)
                    norm = np.linalg.norm(x, axis=1)
                    for i, cut in enumerate(cuts):
                        score = np.where(norm > 0, np.round(q[cut : cut + ASKED] @ x.T / np.maximum(norm, 1e-300), 6), -2)
                        best[i] = merged(best[i], score, fit.column("id"), k)
            for cut, have in zip(cuts, best):
                if have is not None:
                    score, found = have
                    ok = score.ravel() > -2
                    yield pa.record_batch([pa.array(np.repeat(ids[cut : cut + ASKED], score.shape[1])[ok]), found.filter(pa.array(ok)), pa.array(score.ravel()[ok])], names=["query_id", "id", "score"])

        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return rows.mapInArrow(f, f"query_id long, id {kind}, score double").withColumn("rank", place).where(F.col("rank") <= k)

    out, part = None, []
    for r in asked.toLocalIterator():
        part.append(r)
        if len(part) == block:
            out, part = search(part) if out is None else out.unionByName(search(part)), []
    if part or out is None:
        last = search(part) if part else spark.createDataFrame([], f"query_id long, id {kind}, score double, rank int")
        out = last if out is None else out.unionByName(last)
    return out.withColumnRenamed("id", key)


def wrong_dims(vectors: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """Vectors that do not have dims entries."""
    return vectors.where(F.coalesce(F.size(vector), F.lit(-1)) != dims)


def planes(n: int, dims: int, seed: int = 3) -> list[list[float]]:
    """Normals of random hyperplanes."""
    import random

    r = random.Random(seed)
    return [[r.gauss(0, 1) for _ in range(dims)] for _ in range(n)]


def bucket_of(vector: Column, normals: list[list[float]]) -> Column:
    """The side of each hyperplane that a vector is on, as bits."""
    out = F.lit(0)
    for i, n in enumerate(normals):
        out = out + F.when(dot(vector, F.array(*[F.lit(x) for x in n])) > 0, 1 << i).otherwise(0)
    return out


def embed(texts: DataFrame, text: str, dims: int = 64, batch: int = 50) -> DataFrame:
    """texts with `embedding`: counts of words hashed into dims signed buckets, of length 1 (of length 0 without words).

    Stands in for a model behind a service, which is called batch by batch: the same text always has the same vector, and texts
    that share words are close. A null text has no words.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.slice(at, batch)
                out = np.zeros((len(part), dims))
                for i, t in enumerate(part.column(text).to_pylist()):
                    codes = np.array([zlib.crc32(w.encode()) for w in re.findall(r"\w+", (t or "").lower())], np.int64)
                    if len(codes):
                        v = np.bincount(codes % dims, np.where(codes >> 31, 1.0, -1.0), dims)
                        out[i] = v / (np.linalg.norm(v) or 1.0)
                vectors = pa.ListArray.from_arrays(np.arange(0, dims * len(part) + 1, dims, dtype=np.int32), pa.array(out.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], names=[*part.schema.names, "embedding"])

    fields = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes)
    return texts.mapInArrow(f, f"{fields}, embedding array<float>")


def copy_forward(vectors: DataFrame, ids: DataFrame, **payload: Column) -> DataFrame:
    """vectors under the new ids of ids (old_id, new_id), with payload columns replaced; others are left behind."""
    out = vectors.join(ids, vectors["vec_id"] == ids["old_id"]).drop("vec_id", "old_id").withColumnRenamed("new_id", "vec_id")
    return out.withColumns(payload).select(*vectors.columns)
