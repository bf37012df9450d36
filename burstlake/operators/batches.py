"""Grouped work on many groups at a time: rows are dealt and sorted by key, and a task gets whole groups in portions of bounded
memory, so that what a group costs is its samples and not a call of its own."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PORTION = 1 << 24  #: bytes of Arrow rows that are worked on at once, unless a single group has more
CANVAS = 1 << 22  #: samples of the squares that the groups of a portion are laid out in


def numbered(t: pa.Table, keys) -> np.ndarray:
    """Number of each row's group, from 0, of a table sorted by its keys."""
    new = np.zeros(t.num_rows, bool)
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def portions(t: pa.Table, keys):
    """Whole groups of a sorted table, as (table, number of each row's group)."""
    group = numbered(t, keys)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    rows = max(1, int(PORTION * t.num_rows / max(1, t.nbytes)))
    start = 0
    while start < t.num_rows:
        ends = first[(first > start) & (first <= start + rows)]
        later = first[first > start]
        end = t.num_rows if start + rows >= t.num_rows else int(ends[-1]) if len(ends) else int(later[0]) if len(later) else t.num_rows
        yield t.slice(start, end - start), group[start:end] - group[start]
        start = end


def sorted_groups(df: DataFrame, keys, run: Callable, schema: str) -> DataFrame:
    """run(table, group) -> table, for rows that lie sorted by their keys in partitions that split none of the groups."""

    def all_of(batches):
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            group = numbered(held, keys)
            end = int(np.searchsorted(group, group[-1])) if held.num_rows else 0  # the last group may go on
            for t, g in portions(held.slice(0, end).combine_chunks(), keys) if end else ():
                yield from run(t, g).to_batches()
            held = held.slice(end)
        if held is not None and held.num_rows:
            for t, g in portions(held.combine_chunks(), keys):
                yield from run(t, g).to_batches()

    return df.mapInArrow(all_of, schema)


def dealt(df: DataFrame, keys) -> DataFrame:
    """Rows dealt to all tasks by key, however few bytes they have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_groups(df: DataFrame, keys, run: Callable, schema: str) -> DataFrame:
    """run(table, group) -> table, for the groups of df by keys. They are dealt to all tasks by key: what a group costs is its
    arithmetic, so its few bytes should not join it with others."""
    return sorted_groups(dealt(df, keys).sortWithinPartitions(*keys), keys, run, schema)


def one_by_one(run: Callable, keys, schema: pa.Schema) -> Callable:
    """run(key, table) -> table of one group, for all groups of a portion; key as Arrow scalars, tables with `schema`."""

    def each(t: pa.Table, group: np.ndarray) -> pa.Table:
        first = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)].tolist()
        parts = [run(tuple(t.column(k)[a] for k in keys), t.slice(a, b - a)) for a, b in zip(first, first[1:])]
        return pa.concat_tables([schema.empty_table(), *(p.cast(schema) for p in parts if p.num_rows)]).combine_chunks()

    return each


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists and where each row's begin (with the end of the last); null rows have none."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0) if a.num_chunks else pa.array([], a.type)
    return a.values.to_numpy(zero_copy_only=False), a.offsets.to_numpy()


def lists_of(values: np.ndarray, sizes: np.ndarray, type_=None) -> pa.Array:
    """A column of lists from all their values and the length of each."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values, type_ or pa.float64()))


def canvases(t: pa.Table, group: np.ndarray, n: int):
    """(samples, y0, x0, frame height, frame width) of the first plane of n groups of tiles, each on a square as large as the
    largest; what was not sent is not a number."""
    y0, x0, th, tw, fh, fw = (t.column(c).to_numpy().astype(np.int64) for c in ("y0", "x0", "th", "tw", "fh", "fw"))
    far = np.iinfo(np.int64).max
    top, left, bottom, right, h, w = np.full(n, far), np.full(n, far), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.minimum.at(top, group, y0)
    np.minimum.at(left, group, x0)
    np.maximum.at(bottom, group, y0 + th)
    np.maximum.at(right, group, x0 + tw)
    h[group], w[group] = fh, fw
    none = bottom == 0
    top[none], left[none] = 0, 0
    out = np.full((n, int((bottom - top).max(initial=0)), int((right - left).max(initial=0))), np.nan)
    values, offsets = lists(t.column("data"))
    for a, b in {*zip(th.tolist(), tw.tolist())}:
        k = np.flatnonzero((th == a) & (tw == b))
        src = values[offsets[k][:, None] + np.arange(a * b)].reshape(-1, a, b)
        out[group[k][:, None, None], (y0[k] - top[group[k]])[:, None, None] + np.arange(a)[:, None], (x0[k] - left[group[k]])[:, None, None] + np.arange(b)] = src
    return out, top, left, h, w


def alike(group: np.ndarray, columns):
    """Rows (m x n) of m groups of n rows each that are the same in all columns of whole numbers, sorted by these."""
    order = np.lexsort((*reversed(columns), group))
    ints, sorted_ = np.stack(columns, 1)[order], group[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    count = np.diff(np.r_[first, len(group)])
    for n in np.unique(count):
        at = first[count == n][:, None] + np.arange(n)
        _, kind = np.unique(ints[at].reshape(len(at), -1), axis=0, return_inverse=True)
        by = np.argsort(kind.ravel(), kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(kind.ravel()[by])) + 1):
            yield order[at[part]]
