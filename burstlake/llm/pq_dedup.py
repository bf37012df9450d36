"""Near-duplicate vectors by product quantisation over coarse inverted lists, with no link lost.

Vectors are put on the unit sphere, where cosine >= t means a distance of at most r = sqrt(2 - 2t). A coarse codebook deals
them to lists; a list is probed unless the half-space bound shows that none of its vectors can lie within r: a vector x of
list j is no nearer to centre i than to j, so |q-cj|^2 - |q-ci|^2 <= 2 r |ci-cj| for every i; and the distance of q from the
centre must lie within r of those that the list's vectors of q's label have. In a list, the residuals'
subspace codes give a distance by table look-up; it is off by at most the code's own error, which is stored, so pairs beyond
r plus that error are dropped. All others are verified by cosine in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, cut
from .components import components
from .vectors import flagged, kmeans, matrix, nearest, sample

SLACK = 1e-7  #: for rounding in the bounds; the cosine itself has none


def _scaled(column: str):
    """A vector over a power of two next to its largest component: exact, and squares of tiny and huge components stay finite."""
    most = F.array_max(F.transform(column, lambda v: F.abs(v)))
    by = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(most)), F.lit(-1074)))
    return F.transform(column, lambda v: v / by)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _coded(coarse: np.ndarray, books: list[np.ndarray]):
    """Each class with its list, its residual's codes and the error of these codes."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(matrix(b.column("embedding")))
            of = nearest(u, coarse)
            rest, codes, back = u - coarse[of], [], []
            for part, book in zip(np.array_split(rest, len(books), axis=1), books):
                c = nearest(part, book)
                codes.append(c.astype(np.uint8))
                back.append(book[c])
            error = np.sqrt(((rest - np.concatenate(back, axis=1)) ** 2).sum(1))
            codes = np.stack(codes, axis=1)
            yield b.append_column("list", pa.array(of.astype(np.int64))).append_column("off", pa.array(np.sqrt((rest * rest).sum(1)))).append_column("codes", pa.array([r.tobytes() for r in codes], pa.binary())).append_column("error", pa.array(error))

    return run


def _probes(coarse: np.ndarray, r: float):
    """Each class -> one row with the lists that may hold a partner."""
    gap = np.sqrt(np.maximum(((coarse[:, None, :] - coarse) ** 2).sum(2), 0))

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                u = _unit(matrix(part.column("embedding")))
                d = ((u[:, None, :] - coarse) ** 2).sum(2) if len(coarse) <= 64 else (u * u).sum(1)[:, None] - 2 * u @ coarse.T + (coarse * coarse).sum(1)
                open_ = np.ones(d.shape, bool)
                for i in range(len(coarse)):
                    open_ &= d - d[:, i : i + 1] <= 2 * r * gap[i] + SLACK
                row, of = np.nonzero(open_)
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(row)) for c in ("node", "label", "embedding", "n")] + [pa.array(of.astype(np.int64)), pa.array(np.sqrt(np.maximum(d[row, of], 0)))], ["node", "label", "embedding", "n", "list", "off"])

    return run


def _forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a boolean matrix of links: the smallest left row that each left row and each right column reaches."""
    n = len(hit)
    left = np.where(hit.any(1), np.arange(n), n)
    while True:
        right = np.where(hit, left[:, None], n).min(0)
        new = np.minimum(left, np.where(hit, right[None, :], n).min(1))
        if (new == left).all():
            return left, right
        left = new


def _linked(coarse: np.ndarray, books: list[np.ndarray], cosine: float, r: float, tile: int = 1024):
    def run(rows, asked):
        out = {"node": [], "links": [], "other": []}
        if rows.num_rows and asked.num_rows:
            lists = rows.column("list").to_numpy()
            centre = coarse[lists[0]]
            node, n, error, x = rows.column("node").to_numpy(), rows.column("n").to_numpy(), rows.column("error").to_numpy(), matrix(rows.column("embedding"))
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
            size = np.sqrt((x * x).sum(1))
            q_node, q = asked.column("node").to_numpy(), matrix(asked.column("embedding"))
            for s in range(0, len(q), tile):
                some, ids = q[s : s + tile], q_node[s : s + tile]
                q_size = np.sqrt((some * some).sum(1))
                rest = some / q_size[:, None] - centre
                far = np.zeros((len(some), len(x)))
                for k, (part, book) in enumerate(zip(np.array_split(rest, len(books), axis=1), books)):
                    far += ((part[:, None, :] - book) ** 2).sum(2)[:, codes[:, k]]  # a table of distances, looked up by code
                a, b = np.nonzero(np.sqrt(far) - error <= r + SLACK)
                other = ids[a] != node[b]
                a, b = a[other], b[other]
                keep = np.zeros(len(a), bool)
                for t in range(0, len(a), 1 << 16):
                    i, j = a[t : t + (1 << 16)], b[t : t + (1 << 16)]
                    keep[t : t + (1 << 16)] = (some[i] * x[j]).sum(1) / (q_size[i] * size[j]) >= cosine
                a, b = a[keep], b[keep]
                if len(a):
                    hit = np.zeros((len(some), len(x)), bool)
                    hit[a, b] = True
                    left, right = _forest(hit)
                    links = np.bincount(a, weights=n[b], minlength=len(some)).astype(np.int64)
                    l, m = np.flatnonzero(left < len(some)), np.flatnonzero(right < len(some))
                    out["node"] += [ids[l], node[m]]
                    out["links"] += [links[l], np.zeros(len(m), np.int64)]
                    out["other"] += [ids[left[l]], ids[right[m]]]
        return pa.table({k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in out.items()})

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.93, train: int = 20_000, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors(vec_id, embedding, label, ...).

    Rows of one label link where the cosine of their vectors is at least `cosine`. Identical vectors of a label are one
    class and are compared once; n_links counts all rows linked directly, component_id is the smallest vec_id reachable.
    Vectors that are null, zero, hold null or non-finite components or have another length than most, and rows without a
    label, link with nothing; tiny and huge finite vectors link like any others. A null
    vec_id names a component only where no member has an id; repeated rows are rows of their own; the codebooks are fitted
    on at most `train` vectors, everything else covers all; an empty table gives no rows."""
    known = flagged(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label"))
    known = known.withColumn("node", F.when(F.col("ok") & F.col("label").isNotNull(), F.xxhash64("label", "embedding")))
    known = cut(known, "vectors")
    rows, rest = known.where("node is not null"), known.where("node is null")
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = cut(rows.groupBy("node", "label", "embedding").agg(F.count("*").alias("n")).withColumn("embedding", _scaled("embedding")), "classes")
    if not classes.take(1):
        return rest
    total = classes.count()
    u = _unit(sample(classes, train, "node"))
    r = float(np.sqrt(2 - 2 * cosine))
    coarse = kmeans(u, int(np.clip(round(total**0.5 / 8), 1, 512)))
    parts = min(8, u.shape[1])
    books = [kmeans(p, 32) for p in np.array_split(u - coarse[nearest(u, coarse)], parts, axis=1)]

    kind = dict(classes.dtypes)["label"]
    listed = cut(classes.mapInArrow(_coded(coarse, books), f"node long, label {kind}, embedding array<double>, n long, list long, off double, codes binary, error double"), "lists")
    crowds = cut(listed.groupBy("label", "list").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"), F.min("off").alias("near"), F.max("off").alias("far")), "blocks")
    split = listed.drop("off").join(crowds.drop("near", "far"), ["label", "list"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    asked = classes.mapInArrow(_probes(coarse, r), f"node long, label {kind}, embedding array<double>, n long, list long, off double").join(crowds, ["label", "list"])
    asked = asked.where(F.col("off").between(F.col("near") - (r + SLACK), F.col("far") + (r + SLACK))).drop("off", "near", "far")
    asked = asked.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("turn", F.pmod(F.xxhash64("node", F.lit(1)), "blocks"))
    split = split.withColumn("turn", F.explode(F.expr("sequence(0L, blocks - 1)")))
    key = ["label", "list", "block", "turn"]
    found = cut(split.groupBy(*key).cogroup(apart(asked).groupBy(*key)).applyInArrow(_linked(coarse, books, cosine, r), "node long, links long, other long"), "links")
    comps = cut(components(found.select(F.col("node").alias("a"), F.col("other").alias("b"))), "components")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    about = cut(classes.select("node", "n").join(counts, "node", "left").join(comps, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "about")
    named = cut(rows.select("vec_id", "node").join(about, "node"), "named")
    names = cut(named.groupBy("component").agg(F.min("vec_id").alias("component_id")), "names")
    linked = named.join(names, "component").select("vec_id", "n_links", "component_id")
    linked = linked.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
    return linked.unionByName(rest)
