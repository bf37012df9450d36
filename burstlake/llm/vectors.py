"""What the two vector operators share: valid vectors, bounded training samples, k-means and blocks of cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flagged(df: DataFrame) -> DataFrame:
    """df with embedding as doubles and ok: it is not null or zero, has only finite components, and as many as most do."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    df = df.withColumn("embedding", e).withColumn("ok", F.coalesce(fine, F.lit(False)))
    sizes = df.where("ok").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return df.withColumn("ok", F.col("ok") & (F.size("embedding") == (sizes[0]["n"] if sizes else 0)))


def valid_vectors(df: DataFrame) -> DataFrame:
    """The rows of which flagged() says ok."""
    return flagged(df).where("ok").drop("ok")


def sample(vectors: DataFrame, most: int, by: str) -> np.ndarray:
    """At most `most` vectors, those whose hash of column `by` is in the share that gives about so many."""
    share = min(1.0, 0.97 * most / max(1, vectors.count()))
    h = F.xxhash64(by)
    rows = vectors.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))).select(h.alias("h"), "embedding").limit(most).toPandas().sort_values("h")["embedding"]
    return np.array(rows.tolist(), dtype=np.float64).reshape(len(rows), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def kmeans(x: np.ndarray, k: int, turns: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's iterations from a seeded choice of distinct points; at most k centres."""
    points = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = points[rng.permutation(len(points))[: max(1, min(k, len(points)))]].copy()
    for _ in range(turns):
        of = nearest(x, c)
        n = np.bincount(of, minlength=len(c))
        total = np.zeros_like(c)
        for j in range(x.shape[1]):
            total[:, j] = np.bincount(of, weights=x[:, j], minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))

