"""Stencils in tile form: a chain of them needs one shuffle, in which tiles send their neighbours the borders these need.

Frames are storage tiles, a row for each square of `side` samples (tiles.stored); `data` holds one plane after the other. A
chain is a list of steps; from what each step needs around its output follows how far the borders reach, and a task holds a
portion of tiles with their borders at a time, of which those that lie alike are worked on as one array. A chain that halves
the frame twice turns tiles of 64 samples into tiles of 16."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import photometry as P
from .batches import alike, by_groups, lists, lists_of
from .stencil import BASE, half_of_frequencies

TILE = "burst_id long, frame_idx int, sy int, sx int, y0 int, x0 int, th int, tw int, fh int, fw int, data array<double>"
COLUMNS = ("burst_id", "frame_idx", "sy", "sx", "y0", "x0", "th", "tw", "fh", "fw", "data")
_TILE = pa.schema([*[(n, pa.int64() if n == "burst_id" else pa.int32()) for n in COLUMNS[:10]], ("data", pa.list_(pa.float64()))])


@dataclass
class View:
    """Planes (first axis) of the part of frames (fh x fw) that begins at row top and column left; the frames, if several, are
    the axis before rows and columns."""

    data: np.ndarray
    top: int
    left: int
    fh: int
    fw: int

    def read(self, y0: int, y1: int, x0: int, x1: int, beyond: float | None = None) -> np.ndarray:
        """Rows y0 to y1 and columns x0 to x1; beyond the frame the nearest sample, or the value `beyond`."""
        y, x = np.arange(y0, y1), np.arange(x0, x1)
        rows = slice(y0 - self.top, y1 - self.top) if y0 >= 0 and y1 <= self.fh else np.clip(y, 0, self.fh - 1) - self.top
        columns = slice(x0 - self.left, x1 - self.left) if x0 >= 0 and x1 <= self.fw else np.clip(x, 0, self.fw - 1) - self.left
        out = self.data[..., rows, :][..., columns]
        if beyond is not None:
            out[..., (y < 0) | (y >= self.fh), :] = beyond
            out[..., (x < 0) | (x >= self.fw)] = beyond
        return out


@dataclass
class Step:
    """run(view, y0, y1, x0, x1) gives rows y0 to y1 and columns x0 to x1 of the output; these need the input from
    need(y0, y1)[0] to need(y0, y1)[1]. size: height and width of the output frame; factor: input samples for each output one."""

    run: Callable
    need: Callable = lambda lo, hi: (lo, hi)
    size: Callable = lambda h, w: (h, w)
    factor: int = 1


def pointwise(f) -> Step:
    return Step(lambda v, *at: f(v.read(*at)))


def stabilised(c: P.Config) -> Step:
    """The variance-stabilising transform of photometry.stabilise."""
    return pointwise(lambda v: 2.0 / c.alpha * np.sqrt(np.maximum(0.0, v * c.alpha + (0.375 * c.alpha * c.alpha + c.beta))))


def _quads(v: View, y0: int, y1: int, x0: int, x1: int) -> list[np.ndarray]:
    """The four samples of each quad."""
    a = v.read(2 * y0, 2 * y1, 2 * x0, 2 * x1)
    return [a[..., i::2, j::2] for i in (0, 1) for j in (0, 1)]


def box_grey() -> Step:
    """Mean of each quad; odd last rows and columns go."""
    return Step(lambda v, *at: sum(_quads(v, *at)) / 4, lambda lo, hi: (2 * lo, 2 * hi), lambda h, w: (h // 2, w // 2), 2)


def guide(c: P.Config) -> Step:
    """Half-size planes of red, green and blue over the white balance; frames have even sizes. Not a mosaic: as it is."""
    if not c.bayer:
        return pointwise(lambda v: v)
    channel = [1 if x == 3 else x for x in c.cfa]

    def run(v, *at):
        q = [a[0] / c.white_balance[k] for a, k in zip(_quads(v, *at), channel)]
        return np.stack([sum(a for a, x in zip(q, channel) if x == k) / channel.count(k) for k in sorted(set(channel))])

    return Step(run, lambda lo, hi: (2 * lo, 2 * hi), lambda h, w: (h // 2, w // 2), 2)


def local_stats() -> Step:
    """Planes of means, then planes of variances, of 3 x 3 neighbourhoods with the ends repeated."""

    def run(v, y0, y1, x0, x1):
        a = v.read(y0 - 1, y1 + 1, x0 - 1, x1 + 1)
        three = lambda z: (lambda r: r[..., 1:-1, :] + r[..., :-2, :] + r[..., 2:, :])(z[..., 1:-1] + z[..., :-2] + z[..., 2:])
        m = three(a) / 9
        return np.concatenate([m, three(a * a) / 9 - m * m])

    return Step(run, lambda lo, hi: (lo - 1, hi + 1))


def local_min(reach: int = 2) -> Step:
    """Smallest value within `reach` rows and columns; not-a-number is passed over."""

    def run(v, y0, y1, x0, x1):
        a = v.read(y0 - reach, y1 + reach, x0 - reach, x1 + reach, np.inf)
        a = np.where(np.isnan(a), np.inf, a)
        n = 2 * reach + 1
        rows = np.minimum.reduce([a[..., k : a.shape[-1] - n + 1 + k] for k in range(n)])
        return np.minimum.reduce([rows[..., k : rows.shape[-2] - n + 1 + k, :] for k in range(n)])

    return Step(run, lambda lo, hi: (lo - reach, hi + reach))


def blur(sigma: float) -> Step:
    """Separable Gaussian with the ends repeated."""
    r = max(1, int(np.ceil(3 * sigma)))
    w = P.gaussian(r, sigma)

    def run(v, y0, y1, x0, x1):
        a = v.read(y0 - r, y1 + r, x0 - r, x1 + r)
        a = sum(c * a[..., k : a.shape[-1] - 2 * r + k] for k, c in enumerate(w))
        return sum(c * a[..., k : a.shape[-2] - 2 * r + k, :] for k, c in enumerate(w))

    return Step(run, lambda lo, hi: (lo - r, hi + r))


def downsample(factor: int) -> Step:
    """Gaussian of sigma factor / 2 where it fits wholly, every factor-th value; too small a frame, which is one tile, stays."""
    r = int(4 * factor / 2 + 0.5)
    w = P.gaussian(r, factor / 2)
    small = lambda h, n: h - 2 * r < factor or n - 2 * r < factor

    def run(v, y0, y1, x0, x1):
        if small(v.fh, v.fw):
            return v.read(y0, y1, x0, x1)
        a = v.read(factor * y0, factor * (y1 - 1) + 2 * r + 1, factor * x0, factor * (x1 - 1) + 2 * r + 1)
        a = sum(c * a[..., k : k + factor * (x1 - x0 - 1) + 1 : factor] for k, c in enumerate(w))
        return sum(c * a[..., k : k + factor * (y1 - y0 - 1) + 1 : factor, :] for k, c in enumerate(w))

    size = lambda h, n: (h, n) if small(h, n) else ((h - 2 * r) // factor, (n - 2 * r) // factor)
    return Step(run, lambda lo, hi: (factor * lo, factor * (hi - 1) + 2 * r + 1), size, factor)


def gradients() -> Step:
    """Planes gx and gy of 2 x 2 neighbourhoods, a quarter of the differences; one row and column fewer."""

    def run(v, y0, y1, x0, x1):
        a = v.read(y0, y1 + 1, x0, x1 + 1)[0]
        p, q, s, t = a[..., :-1, :-1], a[..., :-1, 1:], a[..., 1:, :-1], a[..., 1:, 1:]
        return np.stack([(q - p + t - s) * 0.25, (s - p + t - q) * 0.25])

    return Step(run, lambda lo, hi: (lo, hi + 1), lambda h, w: (h - 1, w - 1))


def central_differences() -> Step:
    """Planes gx and gy as next minus previous, nothing beyond the frame."""

    def run(v, y0, y1, x0, x1):
        a = v.read(y0 - 1, y1 + 1, x0 - 1, x1 + 1, 0.0)[0]
        return np.stack([a[..., 1:-1, 2:] - a[..., 1:-1, :-2], a[..., 2:, 1:-1] - a[..., :-2, 1:-1]])

    return Step(run, lambda lo, hi: (lo - 1, hi + 1))


def displaced(dy: float, dx: float, clamp: bool) -> Step:
    """What lies at (y + dy, x + dx), between four samples, as gather.bilinear has it: beyond the frame the nearest one or 0."""
    ty, tx = int(dy), int(dx)
    fy, fx = dy - ty, dx - tx

    def run(v, y0, y1, x0, x1):
        a = v.read(y0 + ty, y1 + ty + 1, x0 + tx, x1 + tx + 1, None if clamp else 0.0)
        h, w = y1 - y0, x1 - x0
        return sum((fx if j else 1 - fx) * (fy if i else 1 - fy) * a[..., i : i + h, j : j + w] for i in (0, 1) for j in (0, 1))

    # the same reach on both axes, as a step has one for both
    return Step(run, lambda lo, hi: (lo + min(0, ty, tx), hi + 1 + max(0, ty, tx)))


def structure_tensor() -> Step:
    """Planes xx, xy and yy summed over the up to four gradients around each pixel of the grey image."""

    def run(v, y0, y1, x0, x1):
        gx, gy = v.read(y0 - 1, y1, x0 - 1, x1, 0.0)
        return np.stack([z[..., :-1, :-1] + z[..., :-1, 1:] + z[..., 1:, :-1] + z[..., 1:, 1:] for z in (gx * gx, gx * gy, gy * gy)])

    return Step(run, lambda lo, hi: (lo - 1, hi), lambda h, w: (h + 1, w + 1))


def kernel_covariance(c: P.Config) -> Step:
    """Planes xx, xy and yy: covariance of the merging kernel from the structure tensor, as photometry.eigen and
    photometry.kernel_strengths have it."""

    def run(v, *at):
        xx, xy, yy = v.read(*at)
        with np.errstate(all="ignore"):
            s = np.sqrt(np.maximum((xx + yy) * (xx + yy) - 4 * (xx * yy - xy * xy), 0.0))
            p, q = (xx + yy + s) / 2, (xx + yy - s) / 2
            l1, l2 = np.where(np.abs(p) >= np.abs(q), p, q), np.where(np.abs(p) >= np.abs(q), q, p)
            a, b = xx + xy - l2, xy + yy - l2
            n = np.sqrt(a * a + b * b)
            axes, no_a, no_b = (xy == 0) & (xx == yy), a == 0, b == 0
            u, w = np.where(axes, 1.0, np.where(no_a, 0.0, np.where(no_b, 1.0, a / n))), np.where(axes, 0.0, np.where(no_a, 1.0, np.where(no_b, 0.0, b / n)))
            other_x = np.where(axes, 0.0, np.where(no_a, 1.0, np.where(no_b, 0.0, np.where(u < 0, w, -w))))
            other_y = np.where(axes, 1.0, np.where(no_a, 0.0, np.where(no_b, 1.0, np.abs(u))))
            if c.steerable:
                total = np.where(l1 + l2 == 0, 1e-12, l1 + l2)
                much = 1 + np.sqrt(np.maximum((l1 - l2) / total, 0.0))
                d = np.clip(1 - np.sqrt(np.maximum(l1, 0.0)) / c.D_tr + c.D_th, 0.0, 1.0)
                if c.hard_selection:
                    one, two = np.where(much > 1.95, 1 / c.k_shrink, 1.0), np.where(much > 1.95, c.k_stretch, 1.0)
                else:
                    one, two = 1 + much / 2 * (1 / c.k_shrink - 1), 1 + much / 2 * (c.k_stretch - 1)
                k1, k2 = ((1 - d) * one + d * c.k_denoise) * c.k_detail, ((1 - d) * two + d * c.k_denoise) * c.k_detail
            else:
                k1 = k2 = np.full_like(xx, c.k_detail)
            k1, k2 = k1 * k1, k2 * k2
            return np.stack([k1 * u * u + k2 * other_x * other_x, k1 * u * w + k2 * other_x * other_y, k1 * w * w + k2 * other_y * other_y])

    return Step(run)


def _geometry(t) -> tuple[dict, np.ndarray, np.ndarray]:
    """(whole-number columns by name, values, where each row's begin) of tiles."""
    values, offsets = lists(t.column("data"))
    col = {n: t.column(n).to_numpy().astype(np.int64) for n in COLUMNS[:10]}
    return col | {"size": np.diff(offsets)}, values, offsets


LIE = ("sy", "sx", "y0", "x0", "th", "tw", "fh", "fw", "size")


def _tiles_of(burst, frame, box, size, data: np.ndarray):
    """Rows of tiles that lie alike: sy, sx, y0, x0, th, tw, fh, fw as `box`; data (planes, tiles, rows, columns)."""
    m = len(burst)
    values = np.ascontiguousarray(np.moveaxis(data, 0, 1)).ravel()
    ints = [pa.array(np.full(m, v, np.int32)) for v in (*box, *size)]
    return [pa.array(burst), pa.array(frame.astype(np.int32)), *ints, lists_of(values, np.full(m, len(values) // m))]


def _taken(values, begin: np.ndarray, th: int, tw: int, size: int) -> np.ndarray:
    """Planes (planes, tiles, th, tw) of tiles whose values begin there."""
    return np.moveaxis(values[begin[:, None] + np.arange(size)].reshape(len(begin), -1, th, tw), 0, 1)


def _borders(side: int, before: int, after: int):
    """Each tile as it is and, for every other tile that reads it, the part that lies in that tile's border."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            col, values, offsets = _geometry(b)
            for rows in alike(np.arange(b.num_rows), [col[n] for n in LIE]):
                rows = rows[:, 0]
                _, _, y0, x0, th, tw, fh, fw, size = (int(col[n][rows[0]]) for n in LIE)
                a = _taken(values, offsets[rows], th, tw, size)
                for by in range(max(0, (y0 - after) // side), min((fh - 1) // side, (y0 + th - 1 + before) // side) + 1):
                    p, q = max(y0, by * side - before), min(y0 + th, (by + 1) * side + after)
                    for bx in range(max(0, (x0 - after) // side), min((fw - 1) // side, (x0 + tw - 1 + before) // side) + 1):
                        s, t = max(x0, bx * side - before), min(x0 + tw, (bx + 1) * side + after)
                        if p < q and s < t:
                            yield pa.RecordBatch.from_arrays(_tiles_of(col["burst_id"][rows], col["frame_idx"][rows], (by, bx, p, s, q - p, t - s), (fh, fw), a[..., p - y0 : q - y0, s - x0 : t - x0]), schema=b.schema)

    return run


def config_of_all(params: np.ndarray, c: P.Config) -> P.Config:
    """c with the parameters of several bursts (settings.parameters), as arrays that suit planes of all of them; the mosaic is
    the first one's."""
    n, each = len(P.PER_BURST), lambda v: v[:, None, None]
    own = {name: each(params[:, k]) for k, name in enumerate(P.PER_BURST)}
    return replace(c, **own, white_balance=tuple(each(params[:, n + k]) for k in range(3)), cfa=tuple(int(v) for v in params[0, n + 3 : n + 7]))


def _chained(steps_of: Callable[[P.Config | None], list[Step]], side: int, c: P.Config | None):
    def run(t, group):
        own, out = "params" in t.column_names, []
        col, values, offsets = _geometry(t)
        lie = [col[n] for n in LIE]
        if own:
            params, at = lists(t.column("params"))
            params = params[at[0] : at[-1]].reshape(t.num_rows, -1)
            lie += list(params[:, len(P.PER_BURST) + 3 :].astype(np.int64).T)  # one mosaic at a time
        for rows in alike(group, lie):
            first = rows[:, 0]
            data = solve(rows, {n: col[n][rows[0]] for n in LIE}, values, offsets, steps_of(config_of_all(params[first], c) if own else c))
            if data is not None:
                out.append(pa.Table.from_arrays(_tiles_of(col["burst_id"][first], col["frame_idx"][first], *data), schema=_TILE))
        return pa.concat_tables([_TILE.empty_table(), *out]).combine_chunks()

    def solve(rows, box, values, offsets, steps):
        by, bx, fh, fw = (int(box[n][0]) for n in ("sy", "sx", "fh", "fw"))
        top, left = int(box["y0"].min()), int(box["x0"].min())
        planes = int(box["size"][0] // (box["th"][0] * box["tw"][0]))
        data = np.full((planes, len(rows), int((box["y0"] + box["th"]).max()) - top, int((box["x0"] + box["tw"]).max()) - left), np.nan)
        for k in range(rows.shape[1]):  # what was not sent is not a number
            y, x, th, tw = int(box["y0"][k]) - top, int(box["x0"][k]) - left, int(box["th"][k]), int(box["tw"][k])
            data[..., y : y + th, x : x + tw] = _taken(values, offsets[rows[:, k]], th, tw, int(box["size"][k]))
        view, small = View(data, top, left, fh, fw), side // int(np.prod([s.factor for s in steps]))
        sizes = [(fh, fw)]
        for s in steps:
            sizes.append(s.size(*sizes[-1]))
        h, w = sizes[-1]
        last = [(sizes[0][i] - 1) // side for i in (0, 1)]  # the last tile takes what is left of the output
        at = [by * small, h if by == last[0] else min(h, (by + 1) * small), bx * small, w if bx == last[1] else min(w, (bx + 1) * small)]
        if at[0] >= at[1] or at[2] >= at[3]:
            return None
        wanted = [tuple(at)]
        for s, (n, m) in zip(reversed(steps), reversed(sizes[:-1])):
            y, x = s.need(*wanted[-1][:2]), s.need(*wanted[-1][2:])
            wanted.append((max(0, y[0]), min(n, y[1]), max(0, x[0]), min(m, x[1])))  # never empty, as no step passes over its own place
        for s, size, to in zip(steps, sizes[1:], reversed(wanted[:-1])):
            view = View(s.run(view, *to), to[0], to[2], *size)
        return (by, bx, at[0], at[2], at[1] - at[0], at[3] - at[2]), (h, w), view.data

    return run


def chain(tiles: DataFrame, steps: list[Step] | Callable[[P.Config], list[Step]], side: int, c: P.Config | None = None, params: DataFrame | None = None) -> DataFrame:
    """Tiles after all steps, of side / (product of the factors), with one shuffle of tiles and borders.

    `side` is that of tiles and a multiple of the product, and no smaller than a border. steps may be a function of c; with
    params(burst_id, params), of settings.parameters, each burst has the steps of its own parameters. These change what a step
    works out, not how far it reaches."""
    steps_of = steps if callable(steps) else lambda _: steps
    steps = steps_of(c)
    total = int(np.prod([s.factor for s in steps]))
    lo, hi = 0, side // total
    for s in reversed(steps):
        lo, hi = s.need(lo, hi)
    before, after = max(0, -lo), max(0, hi - side)
    if side % total or max(before, after) > side:
        raise ValueError(f"tiles of {side} do not suit a chain that divides by {total} and reaches {max(before, after)}")
    sent = tiles.select(*[F.col(n).cast(t) for n, t in zip(COLUMNS, (x.strip().split(" ")[1] for x in TILE.split(",")))])
    if before or after:
        sent = sent.mapInArrow(_borders(side, before, after), TILE)
    if params is not None:
        sent = sent.join(params, "burst_id")
    key = (*BASE, "sy", "sx")
    return by_groups(sent, key, _chained(steps_of, side, c), TILE)


@dataclass
class Lines:
    """A step along whole rows and then along whole columns. run(data, axis, fh, fw) gives the lines, which are the last axis of
    data (planes, tiles, lines, samples), of frames of fh x fw before both; size: height and width of the output frame."""

    run: Callable
    size: Callable = lambda h, w: (h, w)


def low_pass_lines() -> Lines:
    """stencil.low_pass_rows: between rows and columns samples are complex, their imaginary parts a plane of their own."""

    def run(a, axis, fh, fw):
        z = a[:1] + 1j * (a[1:] if len(a) > 1 else 0)
        z = half_of_frequencies(z) if z.shape[-1] > 1 else z
        return np.concatenate([z.real, z.imag]) if axis == "x" else z.real

    return Lines(run)


def circular_lines(tile: int) -> Lines:
    """stencil.pad_circular: frames continued from their start up to a multiple of the tile size."""
    return Lines(lambda a, axis, fh, fw: np.take(a, np.arange(a.shape[-1] + -a.shape[-1] % tile) % a.shape[-1], -1), lambda h, w: (h + -h % tile, w + -w % tile))


def downsample_lines(factor: int) -> Lines:
    """downsample() of frames of any size: no border bounds it, so tiles need not be larger than what the factor reaches."""
    step, r = downsample(factor), int(4 * factor / 2 + 0.5)
    w = P.gaussian(r, factor / 2)

    def run(a, axis, fh, fw):
        if step.size(fh, fw) == (fh, fw):  # too small
            return a
        n = (a.shape[-1] - 2 * r) // factor
        return sum(c * a[..., k : k + factor * (n - 1) + 1 : factor] for k, c in enumerate(w))

    return Lines(run, step.size)


def _lined(lines: Lines, axis: str, side: int):
    def run(t, group):
        col, values, offsets = _geometry(t)
        out = [_TILE.empty_table()]
        for rows in alike(group, [col[n] for n in LIE]):
            first, box = rows[:, 0], {n: col[n][rows[0]] for n in LIE}
            sy, sx, fh, fw = (int(box[n][0]) for n in ("sy", "sx", "fh", "fw"))
            top, left = int(box["y0"].min()), int(box["x0"].min())
            planes = int(box["size"][0] // (box["th"][0] * box["tw"][0]))
            data = np.full((planes, len(rows), int((box["y0"] + box["th"]).max()) - top, int((box["x0"] + box["tw"]).max()) - left), np.nan)
            for k in range(rows.shape[1]):  # what was not sent is not a number
                y, x, th, tw = int(box["y0"][k]) - top, int(box["x0"][k]) - left, int(box["th"][k]), int(box["tw"][k])
                data[..., y : y + th, x : x + tw] = _taken(values, offsets[rows[:, k]], th, tw, int(box["size"][k]))
            data = lines.run(data if axis == "x" else data.swapaxes(-1, -2), axis, fh, fw)
            for s in range(0, data.shape[-1], side):
                part = data[..., s : s + side]
                part, at = (part, (sy, s // side, top, s)) if axis == "x" else (part.swapaxes(-1, -2), (s // side, sx, s, left))
                out.append(pa.Table.from_arrays(_tiles_of(col["burst_id"][first], col["frame_idx"][first], (*at, *part.shape[-2:]), (fh, fw) if axis == "x" else lines.size(fh, fw), part), schema=_TILE))
        return pa.concat_tables(out).combine_chunks()

    return run


def along_lines(tiles: DataFrame, lines: Lines, side: int) -> DataFrame:
    """Tiles of `side` after a step along rows and columns: a task puts together the tiles of a strip of `side` lines, so what it
    holds grows with the length of a line and not with the frame."""
    out = tiles.select(*[F.col(n).cast(t) for n, t in zip(COLUMNS, (x.strip().split(" ")[1] for x in TILE.split(",")))])
    for axis, strip in (("x", "sy"), ("y", "sx")):
        out = by_groups(out, (*BASE, strip), _lined(lines, axis, side), TILE)
    return out


def samples(tiles: DataFrame, *names: str, keep: tuple = ()) -> DataFrame:
    """burst_id, frame_idx, y, x, a column for each plane, and the columns of the tile that are to be kept."""
    area = F.col("th") * F.col("tw")
    planes = [F.slice("data", area * k + 1, area).alias(n) for k, n in enumerate(names)]
    out = tiles.select(*BASE, *keep, "y0", "x0", "tw", F.posexplode(F.arrays_zip(*planes)).alias("pos", "s"))
    return out.select(*BASE, (F.col("y0") + F.floor(F.col("pos") / F.col("tw"))).cast("int").alias("y"), (F.col("x0") + F.col("pos") % F.col("tw")).cast("int").alias("x"), *[F.col(f"s.{n}").alias(n) for n in names], *keep)


def kernel_steps(c: P.Config) -> list[Step]:
    """From raw samples to the covariance of the merging kernel at each grey pixel."""
    return [stabilised(c), *([box_grey()] if c.bayer else []), gradients(), structure_tensor(), kernel_covariance(c)]


def guide_stats_steps(c: P.Config) -> list[Step]:
    """From raw samples to mean and variance of the guide."""
    return [guide(c), local_stats()]
