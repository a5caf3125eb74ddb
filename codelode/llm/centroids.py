"""Lloyd's k-means on integer vectors: exact sums, so the result does not depend on how rows are partitioned.

Vectors become integers once and are written. A round broadcasts the centroids, compares each Arrow batch with one centroid after
the other in numpy, and gives a task's sums by cluster, which a groupBy merges: k rows of sums reach the driver. Whatever
share of the vectors is the same or falls to one cluster, a task's share of them is one list of sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm._common import written

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: 64 squared differences of integers up to this fit a long.
LARGEST = 189_812_531


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the vectors of dims finite components as floor(scale * x); others are left out (see kmeans)."""
    x = F.transform(F.col(vector_col), lambda e: F.floor(e.cast("double") * scale))
    finite = F.forall(F.col(vector_col), lambda e: F.coalesce(F.abs(e.cast("double") * scale) < LARGEST, F.lit(False)))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when((F.size(vector_col) == dims) & finite, x).cast("array<int>").alias("v"))
    return kept.where(F.col("v").isNotNull())


def seeds(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of "seed:vec_id", in that order; of rows with one id the smaller vector is first, and no id is last."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.orderBy(F.asc_nulls_last(rank), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroid with the smallest squared distance from each row of x, the lower number on ties, and that distance."""
    d = np.empty((len(centroids), len(x)), np.int64)
    for i, c in enumerate(centroids):
        diff = x - c
        d[i] = np.einsum("ij,ij->i", diff, diff)
    best = d.argmin(0)
    return best, d[best, np.arange(len(x))]


def _rows(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["v"].to_numpy()).astype(np.int64)


def _totals(points: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """Of each cluster that has vectors: how many, the sum of their distances, and those of their components."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        sums = [np.zeros(at.shape[1] + 3, np.int64) for _ in at]  # vectors, distances shifted by 32 bits, their rest, components
        for batch in batches:
            if len(batch):
                x = _rows(batch)
                best, d = nearest(x, at)
                for c in np.unique(best):
                    own = best == c
                    sums[c] += np.concatenate([[own.sum(), (d[own] >> 32).sum(), (d[own] & 0xFFFFFFFF).sum()], x[own].sum(0)])
        yield pd.DataFrame({"cluster": np.arange(len(at), dtype=np.int32), "sums": sums})

    rows = points.select("v").mapInPandas(f, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("place", "x"))
    out = np.zeros((len(centroids), centroids.shape[1] + 3), object)
    for r in rows.groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        out[r["cluster"], r["place"]] = int(r["x"])
    return {c: [r[0], (r[1] << 32) + r[2], *r[3:]] for c, r in enumerate(out.tolist()) if r[0]}


def _moved(centroids: np.ndarray, totals: dict[int, list[int]]) -> np.ndarray:
    """Centroids at the floors of their vectors' means; those without vectors stay."""
    out = centroids.copy()
    for c, (n, _, *sums) in totals.items():
        out[c] = [s // n for s in sums]
    return out


def kmeans(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector after some rounds of Lloyd.

    Defined cases: a vector is left out if it is null, has not dims components, or has one that is null, not finite or as large as
    LARGEST / scale (185,363) in amount, beyond which squared distances would not fit a long. Of equally near centroids the lowest
    number wins; a centroid without vectors stays where it is; with fewer than k vectors each is a centroid. Rows with the same id
    are vectors of their own; those without id are clustered too, but come last as first centroids. An inertia beyond a long is the
    largest long. An empty table gives an empty result; extra columns are ignored.
    """
    points = written(whole_vectors(vectors, id_col, vector_col, dims, scale))
    centroids = seeds(points, k, seed)
    if not len(centroids):
        none = points.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
        return none.where(F.lit(False))
    for _ in range(rounds):
        centroids = _moved(centroids, _totals(points, centroids))
    spread = {c: distances for c, (_, distances, *_) in _totals(points, centroids).items()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    longest = (1 << 63) - 1
    by_cluster: Callable[[list, str], Column] = lambda values, kind: F.element_at(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster") + 1)
    each = [min(spread.get(c, 0), longest) for c in range(len(centroids))]
    return _assigned(points, centroids).select("vec_id", "cluster", "distance", by_cluster(each, "long").alias("cluster_inertia"), F.lit(min(sum(spread.values()), longest)).cast("long").alias("inertia"), by_cluster(digest, "string").alias("centroid_sha256"))


def _assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                best, d = nearest(_rows(batch), shared.value)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": best.astype(np.int32), "distance": d})

    named = points.select(F.col("vec_id").cast("string").alias("vec_id"), "v")  # pandas makes longs among which there is a null floats
    return named.mapInPandas(f, "vec_id string, cluster int, distance long").withColumn("vec_id", F.col("vec_id").cast("long"))
