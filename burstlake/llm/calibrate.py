"""Labelled rows and logistic calibration, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, y: one row per labelled id; labels other than 0 and 1 and null ids are left out, of several the larger counts."""
    y = F.col(column).cast("int")
    return labels.where(F.col("doc_id").isNotNull() & y.isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(y).alias("y"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, turns: int = 60) -> dict:
    """Newton's method on standardised columns with a small ridge; without both classes, the smoothed rate alone."""
    rate = (y.sum() + 1) / (len(y) + 2)
    n = x.shape[1] if x.ndim == 2 else 0
    if len(y) == 0 or y.min() == y.max():
        return {"mean": [0.0] * n, "scale": [1.0] * n, "weights": [0.0] * n, "bias": float(np.log(rate / (1 - rate)))}
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, penalty = np.zeros(n + 1), ridge * np.r_[np.ones(n), 0]
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        size = np.abs(step).max()
        w += step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return {"mean": mean.tolist(), "scale": scale.tolist(), "weights": w[:-1].tolist(), "bias": float(w[-1])}


def logistic(model: dict, columns: list[str]):
    """The calibrated score as a Column."""
    total = F.lit(model["bias"])
    for c, m, s, w in zip(columns, model["mean"], model["scale"], model["weights"]):
        total = total + F.lit(w) * (F.col(c) - F.lit(m)) / F.lit(s)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), total))))


def labelled_sample(scored: DataFrame, labels: DataFrame, columns: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and labels of at most `most` labelled rows: those whose id's hash is in the share that gives about so many."""
    share = min(1.0, 0.97 * most / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = scored.join(chosen, "doc_id").select(F.xxhash64("doc_id").alias("h"), *columns, "y").limit(most).toPandas().sort_values(["h", *columns])
    return got[columns].to_numpy(np.float64), got["y"].to_numpy(np.float64)
