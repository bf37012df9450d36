"""Nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by its own codebook, so a pair of centroids is a cell. A query visits cells in the order
of summed half distances, produced from a heap (the multi-sequence walk), until they hold the wanted share of the rows, and
every row of these cells is ranked by exact distance. The share is the least one that reaches the wanted recall for held-out
rows of the bounded training sample, measured there against brute force.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, cut
from .vectors import kmeans, matrix, nearest, sample, valid_vectors


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells (i * width + j) by left[i] + right[j], smallest first, until they hold `wanted` rows; empty cells are left out."""
    width = len(right)
    li, ri = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    a, b = left[li], right[ri]
    heap, out, held = [(a[0] + b[0], 0, 0)], [], 0
    counts = counts.tolist() if isinstance(counts, np.ndarray) else counts
    li, ri, a, b = li.tolist(), ri.tolist(), a.tolist(), b.tolist()
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = li[i] * width + ri[j]
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
        if j + 1 < width:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(li):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def _halves(x: np.ndarray, books) -> tuple[np.ndarray, np.ndarray]:
    h = books[0].shape[1]
    return x[:, :h], x[:, h:]


def _cells(x: np.ndarray, books) -> np.ndarray:
    a, b = _halves(x, books)
    return nearest(a, books[0]) * len(books[1]) + nearest(b, books[1])


def _half_distances(x: np.ndarray, books):
    return [((part[:, None, :] - book) ** 2).sum(2) for part, book in zip(_halves(x, books), books)]


def share_for(x: np.ndarray, books, k: int, recall: float, queries: int = 200) -> float:
    """The least share of the sample's rows to visit for the wanted mean recall of its own first rows."""
    n = len(x)
    if n <= 20 * k:
        return 1.0
    q = x[:queries]
    d = (q**2).sum(1)[:, None] - 2 * q @ x.T + (x**2).sum(1)
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    best = np.argpartition(d, k, axis=1)[:, :k]
    cells = _cells(x, books)
    counts = np.bincount(cells, minlength=len(books[0]) * len(books[1]))
    left, right = _half_distances(q, books)
    need = []  # share at which each true neighbour's cell is reached
    for i in range(len(q)):
        order = walk(left[i], right[i], counts, n)
        reach = np.zeros(len(counts))
        reach[order] = np.cumsum(counts[order])
        need.append(reach[cells[best[i]]] / n)
    return float(min(1.0, np.quantile(np.concatenate(need), recall) * 1.05 + k / n))


def _placed(books):
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.append_column("cell", pa.array(_cells(matrix(b.column("embedding")), books)))

    return run


def _routed(books, counts: np.ndarray, blocks: np.ndarray, starts: np.ndarray, shards: int, wanted: int):
    """Queries -> one row per shard that they visit, with the cells wanted there."""
    blocks, starts = blocks.tolist(), starts.tolist()
    counts = counts.tolist()

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                left, right = _half_distances(matrix(part.column("embedding")), books)
                row, shard, cells = [], [], []
                for i in range(part.num_rows):
                    there: dict[int, list[int]] = {}
                    for c in walk(left[i], right[i], counts, wanted):
                        for k in range(blocks[c]):
                            there.setdefault((starts[c] + k) % shards, []).append(c)
                    for h, cs in there.items():
                        row.append(i)
                        shard.append(h)
                        cells.append(cs)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(row), part.column("embedding").take(row), pa.array(shard, pa.int64()), pa.array(cells, pa.list_(pa.int32()))], ["query_id", "q", "shard", "cells"])

    return run


def _ranked(k: int):
    def run(rows, asked):
        q_, v_, s_ = [], [], []
        if rows.num_rows and asked.num_rows:
            ids, cell, x = rows.column("vec_id").to_numpy(), rows.column("cell").to_numpy(), matrix(rows.column("embedding"))
            order = np.argsort(cell, kind="stable")
            ids, cell, x = ids[order], cell[order], x[order]
            qid, q = asked.column("query_id").to_numpy(), matrix(asked.column("q"))
            for i, cells in enumerate(asked.column("cells").to_pylist()):
                cells = np.array(cells)
                lo, hi = np.searchsorted(cell, cells), np.searchsorted(cell, cells, "right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
                at = at[ids[at] != qid[i]]
                if len(at):
                    d = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
                    if len(d) > k:
                        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                        at, d = at[near], d[near]
                    top = np.lexsort((ids[at], d))[:k]
                    q_.append(np.full(len(top), qid[i]))
                    v_.append(ids[at][top])
                    s_.append(d[top])
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table({"query_id": cat(q_, np.int64), "vec_id": cat(v_, np.int64), "score": cat(s_, np.float64)})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.97, train: int = 20_000, rows_per_shard: int = 4096, queries_per_turn: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors found for each query, by Euclidean distance.

    A query's own vec_id is no candidate. Vectors that are null, zero or hold null or non-finite components take no part,
    on either side. The codebooks and the share of rows to visit come from at most `train` rows of the index; every row is
    indexed; up to 20 * k sampled rows every cell is visited. Of identical vectors only the k + 1 smallest ids can be among k nearest, so the index keeps those: an exact reduction.
    Ties go to the smaller vec_id; repeated rows are candidates of their own; a null vec_id takes no part; empty tables
    give no rows."""
    good = valid_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null"))
    n = good.count()
    spark = vectors.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    placed = good.withColumn("turn", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("turn") <= k + 1).drop("turn")
    placed = cut(placed.select("vec_id", "embedding"), "distinct")
    x = sample(placed, train, "vec_id")
    half, size = x.shape[1] // 2, int(np.clip(round((n / 8) ** 0.5), 1, 256))
    books = [kmeans(x[:, :half], size), kmeans(x[:, half:], size)] if half else [np.zeros((1, 0)), kmeans(x, size)]
    share = share_for(x, books, k, recall)

    dim = x.shape[1]
    index = cut(placed.mapInArrow(_placed(books), "vec_id long, embedding array<double>, cell long"), "index")
    found = index.groupBy("cell").count().toPandas()  # at most size * size rows
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    counts[found["cell"]] = found["count"]
    blocks = -(-counts // rows_per_shard)
    shards = int(max(16, -(-int(counts.sum()) // rows_per_shard)))
    starts = (np.cumsum(counts) // rows_per_shard) % shards  # neighbours in cell number share shards, crowded cells have several
    wanted = int(np.ceil(share * counts.sum())) + k + 1

    frame = spark.createDataFrame([(int(c), int(blocks[c]), int(starts[c])) for c in np.flatnonzero(blocks)], "cell long, blocks long, first long")
    spread = index.join(F.broadcast(frame), "cell").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vec_id", "embedding"), F.col("blocks"))) % shards)
    asked = valid_vectors(queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")).where(F.size("embedding") == dim)
    asked = asked.select("vec_id", "embedding").mapInArrow(_routed(books, counts, blocks, starts, shards, wanted), "query_id long, q array<double>, shard long, cells array<int>")
    # queries meet a shard in blocks, so that a task's share of them has a bound as well
    turns = -(-queries.count() // queries_per_turn)
    spread = spread.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max(turns - 1, 0)))))
    asked = asked.withColumn("turn", F.pmod(F.xxhash64("query_id", "q"), F.lit(max(turns, 1))).cast("int"))
    best = spread.groupBy("shard", "turn").cogroup(apart(asked).groupBy("shard", "turn")).applyInArrow(_ranked(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
