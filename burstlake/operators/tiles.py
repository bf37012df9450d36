"""Block matching and refinement in tile form: the same results as operators.match with one shuffle of frames and halos.

Frames are kept as storage tiles, one row for each square of samples. A block of match tiles asks for the storage tiles that
its displaced rectangles touch, so what it gets follows the displacement and no fixed halo bounds it; a task holds one
block with these. Where refinement leads a tile out of what was fetched, the tile comes back with the turns it has left and
is fetched anew: results stay exact, and each pass makes at least one turn."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import photometry as P
from . import halo
from .batches import CANVAS, by_groups, canvases, lists, lists_of, sorted_groups
from .gather import upscale_flow
from .match import tiles_of
from .stencil import BASE

FAR = 1 << 40  #: samples
CELLS = 1 << 22  #: samples under all offsets that are compared at once
SLACK = 4  #: samples around the search window that refinement may use before a tile is fetched anew
KEY = (*BASE, "by", "bx")


PIECE = "burst_id long, frame_idx int, sy int, sx int, y0 int, x0 int, th int, tw int, at array<int>, data array<double>"
STORED = "burst_id long, frame_idx int, sy int, sx int, y0 int, x0 int, th int, tw int, data array<double>, fh int, fw int"


def _boxes(group: np.ndarray, n: int, y0, x0, y1, x1):
    """y0, x0, height and width of what each of n groups covers."""
    far = np.iinfo(np.int64).max
    top, left, bottom, right = np.full(n, far), np.full(n, far), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for f, into, v in ((np.minimum, top, y0), (np.minimum, left, x0), (np.maximum, bottom, y1), (np.maximum, right, x1)):
        f.at(into, group, v)
    return top, left, bottom - top, right - left


def _pieces(side: int):
    """The samples of a batch by tile: in `data` row by row where they fill a rectangle, else with their place in `at`."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            burst, frame, y, x = (b.column(c).to_numpy().astype(np.int64) for c in (*BASE, "y", "x"))
            v = b.column("v").to_numpy(zero_copy_only=False).astype(np.float64)
            order = np.lexsort((x, y, x // side, y // side, frame, burst))
            burst, frame, y, x, v = burst[order], frame[order], y[order], x[order], v[order]
            cols = (burst, frame, y // side, x // side)
            new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])]
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            n = np.diff(np.r_[first, len(v)])
            y0, x0, h, w = _boxes(group, len(first), y, x, y + 1, x + 1)
            place = (y - y0[group]) * w[group] + x - x0[group]
            scattered = np.zeros(len(first), bool)
            scattered[group[place != np.arange(len(v)) - first[group]]] = True
            scattered |= n != h * w
            at = lists_of(place[scattered[group]].astype(np.int32), np.where(scattered, n, 0), pa.int32())
            small = [pa.array(c.astype(np.int32)) for c in (frame[first], cols[2][first], cols[3][first], y0, x0, h, w)]
            yield pa.RecordBatch.from_arrays([pa.array(burst[first]), *small, at, lists_of(v, n)], names=[f.split()[0] for f in PIECE.split(", ")])

    return run


def _whole_tiles(t: pa.Table, group: np.ndarray) -> pa.Table:
    """One row for each tile from its pieces."""
    n = int(group[-1]) + 1
    y0, x0, th, tw = (t.column(c).to_numpy().astype(np.int64) for c in ("y0", "x0", "th", "tw"))
    top, left, h, w = _boxes(group, n, y0, x0, y0 + th, x0 + tw)
    begin = np.r_[0, np.cumsum(h * w)]
    values, offsets = lists(t.column("data"))
    at, at_offsets = lists(t.column("at"))
    size, placed = np.diff(offsets), np.diff(at_offsets) > 0
    row = np.repeat(np.arange(t.num_rows), size)
    local = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(size)][:-1], size)
    local[placed[row]] = at[at_offsets[0] : at_offsets[-1]]
    y, x = local // tw[row] + (y0 - top[group])[row], local % tw[row] + (x0 - left[group])[row]
    out = np.full(begin[-1], np.nan)
    out[begin[group][row] + y * w[group][row] + x] = values[offsets[0] : offsets[-1]]
    first = np.searchsorted(group, np.arange(n))
    of = lambda c: t.column(c).combine_chunks().take(pa.array(first))
    box = [pa.array(c.astype(np.int32)) for c in (top, left, h, w)]
    return pa.Table.from_arrays([*[of(c) for c in (*BASE, "sy", "sx")], *box, lists_of(out, h * w), of("fh"), of("fw")], names=[f.split()[0] for f in STORED.split(", ")])


def stored(px: DataFrame, side: int) -> DataFrame:
    """burst_id, frame_idx, sy, sx, y0, x0, th, tw, data and the frame's size fh, fw: samples as squares of `side`.

    What a task has of a tile is packed before it is sent, so the one shuffle takes a few bytes for each sample; tiles are
    put together and sizes found where the pieces of a frame meet, as a window that Spark may spill."""
    plain = px.select(F.col("burst_id").cast("long").alias("burst_id"), F.col("frame_idx").cast("int").alias("frame_idx"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    frame = Window.partitionBy(*BASE).orderBy("sy", "sx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pieces = plain.mapInArrow(_pieces(side), PIECE).withColumns({"fh": F.max(F.col("y0") + F.col("th")).over(frame), "fw": F.max(F.col("x0") + F.col("tw")).over(frame)})
    return sorted_groups(pieces.sortWithinPartitions(*BASE, "sy", "sx"), (*BASE, "sy", "sx"), _whole_tiles, STORED)


def _touched(low: Column, high: Column, size: Column, side: int) -> Column:
    """Numbers of the storage tiles from one coordinate to another, both held inside the frame."""
    at = lambda v: F.floor(F.least(F.greatest(v, F.lit(0)), size - 1) / side).cast("int")
    return F.explode(F.sequence(at(low), at(high)))


def _read(canvas, g: np.ndarray, y: np.ndarray, x: np.ndarray, clamp: bool) -> np.ndarray:
    """Samples at rows y[k] and columns x[k] of canvas g[k] for every tile k; beyond the frame the nearest one or 0, not a number
    where they were not fetched."""
    data, y0, x0, h, w = (canvas[0], *(c[g][:, None] for c in canvas[1:]))
    inside = ((y >= 0) & (y < h))[:, :, None] & ((x >= 0) & (x < w))[:, None, :]
    y, x = np.clip(y, 0, h - 1) - y0, np.clip(x, 0, w - 1) - x0
    fetched = ((y >= 0) & (y < data.shape[1]))[:, :, None] & ((x >= 0) & (x < data.shape[2]))[:, None, :]
    v = data[g[:, None, None], np.clip(y, 0, data.shape[1] - 1)[:, :, None], np.clip(x, 0, data.shape[2] - 1)[:, None, :]]
    v = np.where(fetched, v, np.nan)
    return v if clamp else np.where(inside, v, 0.0)


def _whole(v: np.ndarray) -> np.ndarray:
    """Displacements as whole numbers; so far off that nothing is met they are all the same."""
    return np.clip(np.nan_to_num(v), -FAR, FAR).astype(np.int64)[:, None]


def _costs(r: np.ndarray, moving, g: np.ndarray, y: np.ndarray, x: np.ndarray, dy: np.ndarray, dx: np.ndarray, radius: int, metric: str):
    """(cost of each tile and offset, found): found only where no sample is missing. metric: L1, L2 or the products' sum."""
    wide = lambda at: at[:, 1:2] + np.arange(-radius, at.shape[1] - 2 + radius)
    window = _read(moving, g, wide(y) + _whole(np.rint(dy)), wide(x) + _whole(np.rint(dx)), metric != "L1")
    m = np.lib.stride_tricks.sliding_window_view(window, r.shape[1:], axis=(1, 2))
    own = r[:, None, None]
    if metric == "L1":
        cost = np.abs(own - m).sum((3, 4))
    else:
        cost = np.einsum("kijyx,kyx->kij", m, r)
        cost = cost if metric == "products" else (m * m).sum((3, 4)) - 2 * cost
    return cost, ~np.isnan(window).any((1, 2))


def _matched(r: np.ndarray, moving, g: np.ndarray, y: np.ndarray, x: np.ndarray, dy: np.ndarray, dx: np.ndarray, radius: int, metric: str):
    """(dy, dx, cost, found) of the best offset of each tile, the first in raster order among equals; found only where no
    sample is missing. y and x are the tiles' rows and columns with one more at both ends."""
    reach = np.arange(-radius, radius + 1)
    fy, fx = np.rint(dy), np.rint(dx)
    cost, found = _costs(r, moving, g, y, x, dy, dx, radius, metric)
    flat = cost.reshape(len(r), -1)
    best = flat.argmin(1)
    base = (fy, fx) if metric == "L1" else (dy, dx)
    return base[0] + reach[best // len(reach)], base[1] + reach[best % len(reach)], flat[np.arange(len(r)), best], found


def _refined(r, gy, gx, moving, g, y, x, dy, dx, clamp: bool, turns: np.ndarray):
    """(dy, dx, turns left) after steps of inverse-compositional refinement of each tile, as far as the samples reach."""
    h00, h01, h11 = ((a * b).sum((1, 2)) for a, b in ((gx, gx), (gx, gy), (gy, gy)))
    det = h00 * h11 - h01 * h01
    good = np.abs(det) >= 1e-10
    dy, dx, turns = dy.copy(), dx.copy(), np.where(good, turns, 0)
    at = np.flatnonzero(turns > 0)
    while len(at):
        ty, tx = np.trunc(dy[at]), np.trunc(dx[at])
        fy, fx = (dy[at] - ty)[:, None, None], (dx[at] - tx)[:, None, None]
        m = _read(moving, g[at], y[at, 1:] + _whole(ty), x[at, 1:] + _whole(tx), clamp)
        held = ~np.isnan(m).any((1, 2))
        at, m, fy, fx = at[held], m[held], fy[held], fx[held]
        t = (1 - fy) * ((1 - fx) * m[:, :-1, :-1] + fx * m[:, :-1, 1:]) + fy * ((1 - fx) * m[:, 1:, :-1] + fx * m[:, 1:, 1:]) - r[at]
        b0, b1 = -(gx[at] * t).sum((1, 2)), -(gy[at] * t).sum((1, 2))
        dx[at] += (h11[at] * b0 - h01[at] * b1) / det[at]
        dy[at] += (h00[at] * b1 - h01[at] * b0) / det[at]
        turns[at] -= 1
        at = at[turns[at] > 0]
    return dy, dx, turns


def _portions(tiles, ref, g: np.ndarray, tile: int, radius: int):
    """(tiles, their rows, their columns, the reference around them) of one size, in portions of bounded memory; tiles at the
    ends of a frame may be smaller, and what lies beyond the reference is passed over."""
    top, left = tiles["ty"] * tile, tiles["tx"] * tile
    size = np.stack([np.minimum(top + tile, ref[3][g]) - top, np.minimum(left + tile, ref[4][g]) - left], axis=1)
    portion = max(1, CELLS // ((2 * radius + 1) ** 2 * tile * tile))
    for h, w in np.unique(size[(size > 0).all(1)], axis=0):
        same = np.flatnonzero((size == (h, w)).all(1))
        for s in range(0, len(same), portion):
            at = same[s : s + portion]
            y, x = top[at, None] + np.arange(-1, h + 1), left[at, None] + np.arange(-1, w + 1)
            yield at, y, x, _read(ref, g[at], y, x, False)


def _laid_out(t: pa.Table, group: np.ndarray):
    """(tiles, their groups, reference, moving) of whole groups, cut in two as long as their squares would be too large."""
    kind = t.column("kind").to_numpy()
    n = int(group[-1]) + 1
    cells = 0
    for k in (0, 1):
        some = np.flatnonzero(kind == k)
        y0, x0, th, tw = (t.column(c).to_numpy(zero_copy_only=False)[some].astype(np.int64) for c in ("y0", "x0", "th", "tw"))
        _, _, h, w = _boxes(group[some], n, y0, x0, y0 + th, x0 + tw)
        here = np.zeros(n, bool)
        here[group[some]] = True
        cells += n * int(np.where(here, h, 0).max(initial=0)) * int(np.where(here, w, 0).max(initial=0))
    if cells > CANVAS and n > 1:
        half = int(np.searchsorted(group, n // 2))
        yield from _laid_out(t.slice(0, half).combine_chunks(), group[:half])
        yield from _laid_out(t.slice(half).combine_chunks(), group[half:] - group[half])
        return
    part = lambda k: t.filter(pa.array(kind == k)).combine_chunks()
    yield part(2), group[kind == 2], *(canvases(part(k), group[kind == k], n) for k in (0, 1))


SHAPE = "burst_id long, frame_idx int, by int, bx int, ty int, tx int, dx double, dy double, cost double, todo int, matched boolean"
SHAPED = tuple(f.split()[0] for f in SHAPE.split(", "))


def _solved(tile: int, radius: int, metric: str):
    def run(t: pa.Table, group: np.ndarray) -> pa.Table:
        return pa.concat_tables([solve(*laid) for laid in _laid_out(t, group)])

    def solve(tiles, g, ref, moving):
        col = {n: tiles[n].to_numpy(zero_copy_only=False).copy() for n in ("ty", "tx", "dx", "dy", "cost", "todo", "matched")}
        there = np.zeros(len(g), bool)
        for at, y, x, around in _portions(col, ref, g, tile, radius):
            there[at] = moving[3][g[at]] > 0
            r, gx, gy = around[:, 1:-1, 1:-1], around[:, 1:-1, 2:] - around[:, 1:-1, :-2], around[:, 2:, 1:-1] - around[:, :-2, 1:-1]
            new = np.flatnonzero(~col["matched"][at])
            if len(new):
                *found, ok = _matched(r[new], moving, g[at[new]], y[new], x[new], col["dy"][at[new]], col["dx"][at[new]], radius, metric)
                for n, v in zip(("dy", "dx", "cost"), found):
                    col[n][at[new[ok]]] = v[ok]
                col["matched"][at[new[ok]]] = True
            some = np.flatnonzero(col["matched"][at] & (col["todo"][at] > 0))
            if len(some):
                dy, dx, left_ = _refined(r[some], gy[some], gx[some], moving, g[at[some]], y[some], x[some], col["dy"][at[some]], col["dx"][at[some]], tile == 8, col["todo"][at[some]])
                col["dy"][at[some]], col["dx"][at[some]], col["todo"][at[some]] = dy, dx, left_
        col["todo"][~there] = 0  # nothing to refine by
        tiles = tiles.select(SHAPED)
        for n in ("dx", "dy", "cost", "todo", "matched"):
            k = tiles.schema.get_field_index(n)
            tiles = tiles.set_column(k, tiles.schema.field(k), pa.array(col[n], tiles.schema.field(k).type))
        return tiles.filter(pa.array(there | col["matched"]))

    return run


CORR = "burst_id long, frame_idx int, ty int, tx int, oy int, ox int, corr double"


def _correlated(tile: int, radius: int):
    def run(t: pa.Table, group: np.ndarray) -> pa.Table:
        out = []
        for tiles, g, ref, moving in _laid_out(t, group):
            col = {n: tiles[n].to_numpy() for n in (*BASE, "ty", "tx", "dx", "dy")}
            for at, y, x, around in _portions(col, ref, g, tile, radius):
                at, y, x, around = (v[moving[3][g[at]] > 0] for v in (at, y, x, around))
                cost, _ = _costs(around[:, 1:-1, 1:-1], moving, g[at], y, x, col["dy"][at], col["dx"][at], radius, "products")
                k, i, j = (v.ravel() for v in np.indices(cost.shape))
                ints = [pa.array(v.astype(np.int32)) for v in (*(col[n][at][k] for n in ("frame_idx", "ty", "tx")), i - radius, j - radius)]
                out.append(pa.Table.from_arrays([pa.array(col["burst_id"][at][k]), *ints, pa.array(cost.ravel())], names=[f.split()[0] for f in CORR.split(", ")]))
        return pa.concat_tables(out) if out else pa.table({f.split()[0]: pa.array([], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f.split()[1]]) for f in CORR.split(", ")})

    return run


SQUARE = ("sy", "sx", "y0", "x0", "th", "tw", "fh", "fw", "data")


def _todo(flow: DataFrame, block: int, turns: int, matched: bool) -> DataFrame:
    at = lambda n, f: F.floor(F.col(f) / block).cast("int").alias(n)
    return flow.select(F.col("burst_id").cast("long"), F.col("frame_idx").cast("int"), at("by", "ty"), at("bx", "tx"), F.col("ty").cast("int"), F.col("tx").cast("int"), F.col("dx").cast("double"), F.col("dy").cast("double"), F.lit(0.0).alias("cost"), F.lit(turns).alias("todo"), F.lit(matched).alias("matched"))


def _with_sources(todo: DataFrame, ref: DataFrame, moving: DataFrame, tile: int, reach: int, side: int, block: int) -> DataFrame:
    """The tiles to do (kind 2) with the storage tiles of the reference (0) and of their frame (1) that their blocks touch."""
    sizes = lambda df, *by: df.groupBy(*by).agg(F.first("fh").alias("fh"), F.first("fw").alias("fw"))
    # what is to do is an exploded grid, whose size Spark takes for that of its source: the hint keeps it from being broadcast
    asked = todo.join(sizes(moving, *BASE).hint("merge"), [*BASE])
    for s, t, d, n in (("sy", "ty", "dy", "fh"), ("sx", "tx", "dx", "fw")):
        at = F.col(t) * tile + F.rint(d)
        asked = asked.withColumn(s, _touched(at - reach, at + (tile - 1 + reach), F.col(n), side))
    near = asked.select(*KEY, "sy", "sx").distinct().join(moving.select(*BASE, *SQUARE), [*BASE, "sy", "sx"]).withColumn("kind", F.lit(1))
    own = todo.select(*KEY).distinct().join(sizes(ref, "burst_id"), "burst_id")
    for s, b, n in (("sy", "by", "fh"), ("sx", "bx", "fw")):
        at = F.col(b) * (block * tile)
        own = own.withColumn(s, _touched(at - 1, at + block * tile, F.col(n), side))
    own = own.drop("fh", "fw").join(ref.select("burst_id", *SQUARE), ["burst_id", "sy", "sx"]).withColumn("kind", F.lit(0))
    sources = near.select(*KEY, "kind", *SQUARE).unionByName(own.select(*KEY, "kind", *SQUARE))
    return sources.unionByName(todo.withColumn("kind", F.lit(2)), allowMissingColumns=True)


def match_and_refine(ref: DataFrame, moving: DataFrame, flow: DataFrame, tile: int, radius: int | None, metric: str = "L1", turns: int = 0, side: int = 64, block: int = 8, materialise=lambda df, name: df) -> DataFrame:
    """burst_id, frame_idx, ty, tx, dx, dy, cost: flow after block matching and `turns` of refinement.

    ref and moving are storage tiles (of `side`) of frame 0 and of the others; flow starts it; without a radius it is only refined. A task holds block x block
    tiles. materialise(df, name) stores what a pass gives, so that the next one need not repeat it."""
    matched = radius is None
    radius = 0 if matched else radius
    todo = _todo(flow, block, turns, matched)
    reach, done, passes = radius + (2 + SLACK if turns else 0), None, 0
    while True:
        out = by_groups(_with_sources(todo, ref, moving, tile, reach, side, block), KEY, _solved(tile, radius, metric), SHAPE)
        out = materialise(out, f"tiles_{passes}") if turns else out
        ended = out.where("matched and todo = 0")
        done, todo, passes = ended if done is None else done.unionByName(ended), out.where("not matched or todo > 0"), passes + 1
        if passes > turns or not todo.take(1):
            return done.select(*BASE, "ty", "tx", "dx", "dy", "cost")


def block_match(ref: DataFrame, moving: DataFrame, flow: DataFrame, tile: int, radius: int, metric: str = "L1", side: int = 64, block: int = 8) -> DataFrame:
    """match.block_match of samples, in tile form: no row for an offset."""
    return match_and_refine(stored(ref, side), stored(moving, side), flow, tile, radius, metric, 0, side, block)


def correlation_map(ref: DataFrame, moving: DataFrame, flow: DataFrame, tile: int, radius: int, side: int = 64, block: int = 8) -> DataFrame:
    """match.correlation_map of samples, in tile form: the rows it gives are the first for single offsets."""
    rows = _with_sources(_todo(flow, block, 0, False), stored(ref, side), stored(moving, side), tile, radius, side, block)
    return by_groups(rows, KEY, _correlated(tile, radius), CORR)


def refine(ref: DataFrame, moving: DataFrame, flow: DataFrame, tile: int, turns: int = 3, side: int = 64, block: int = 8, materialise=lambda df, name: df) -> DataFrame:
    """match.refine of samples, in tile form; materialise as match_and_refine has it."""
    kept = [materialise(stored(px, side), n) for px, n in ((ref, "ref"), (moving, "moving"))]
    return match_and_refine(*kept, flow, tile, None, "L1", turns, side, block, materialise).drop("cost")


def level_step(c: P.Config, side: int = 64, block: int = 8, materialise=lambda df, name: df):
    """The step of match.align in tile form: (ref, moving, start, level) -> flow."""

    def step(ref: DataFrame, moving: DataFrame, start: DataFrame, level: int) -> DataFrame:
        name = lambda df, n: materialise(df, f"{n}_{level}")
        kept = [name(stored(px, side), n) for px, n in ((ref, "ref"), (moving, "moving"))]
        return match_and_refine(*kept, start, c.tile_sizes[level], c.radii[level], c.metrics[level], c.refine_turns, side, block, name).drop("cost")

    return step


def align(grey: DataFrame, c: P.Config, side: int = 64, block: int = 8, materialise=lambda df, name: df) -> DataFrame:
    """match.align of storage tiles (of `side`) of all frames: samples become tiles once and every level is made of the tiles of
    the one before, so no row stands for a sample. grey should be stored, as every level reads what it was made from."""
    tile, ref = c.tile_sizes[0], grey.where("frame_idx = 0")
    even = F.expr(f"fh % {tile} = 0 and fw % {tile} = 0")
    padded = materialise(halo.along_lines(ref.where(~even), halo.circular_lines(tile), side), "padded")
    px, levels = grey.where((F.col("frame_idx") > 0) | even).select(*halo.COLUMNS).unionByName(padded), []
    for i, f in enumerate(c.factors):
        px = px if f == 1 else materialise(halo.along_lines(px, halo.downsample_lines(f), side), f"level_{i}")
        levels.append((px.where("frame_idx = 0"), px.where("frame_idx > 0")))
    frames, flow = grey.where("frame_idx > 0").select(*BASE).distinct(), None
    for i in range(len(levels) - 1, -1, -1):
        (ref, moving), tile, named = levels[i], c.tile_sizes[i], lambda df, name: materialise(df, f"{name}_{i}")  # noqa: B023
        size = ref.groupBy("burst_id").agg(F.first("fh").alias("h"), F.first("fw").alias("w"))
        grid = tiles_of(frames.join(size, "burst_id"), tile)
        if flow is None:
            start = grid.withColumns({"dx": F.lit(0.0), "dy": F.lit(0.0)})
        else:
            start = upscale_flow(flow, grid, c.factors[i + 1], tile, c.tile_sizes[i + 1])
        flow = named(match_and_refine(ref, moving, start, tile, c.radii[i], c.metrics[i], c.refine_turns, side, block, named).drop("cost"), "flow")
    return flow
