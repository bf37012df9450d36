"""Stencils over samples, as windows along rows and then along columns: each shuffles by row or column, never by frame.

Frames are dense grids. Keys are burst_id and frame_idx, and ch or level where the table has them."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import photometry as P

BASE = ("burst_id", "frame_idx")


def keys(px: DataFrame) -> list[str]:
    return [*BASE, *[c for c in ("ch", "level") if c in px.columns]]


def along(px: DataFrame, axis: str):
    """The window of a row (axis x) or a column (axis y)."""
    return Window.partitionBy(*keys(px), "y" if axis == "x" else "x").orderBy(axis)


def with_dims(px: DataFrame) -> DataFrame:
    """h and w of each sample's frame; the small table of sizes is broadcast where Spark finds it small enough."""
    dims = px.groupBy(*BASE).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return px.join(dims, [*BASE])


def box_grey(px: DataFrame, bayer: bool = True) -> DataFrame:
    """Mean of each 2 x 2 quad; odd last rows and columns go. Not a mosaic: as it is."""
    if not bayer:
        return px
    q = px.groupBy(*keys(px), F.floor(F.col("y") / 2).cast("int").alias("Y"), F.floor(F.col("x") / 2).cast("int").alias("X")).agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return q.where("n = 4").select(*keys(px), F.col("Y").alias("y"), F.col("X").alias("x"), "v")


def pad_circular(px: DataFrame, tile: int) -> DataFrame:
    """Frames continued from their start up to a multiple of the tile size."""
    d = with_dims(px)
    down = F.pmod(-F.col("h"), F.lit(tile))
    d = d.withColumn("y", F.explode(F.when(F.col("y") < down, F.array("y", F.col("y") + F.col("h"))).otherwise(F.array("y"))))
    right = F.pmod(-F.col("w"), F.lit(tile))
    d = d.withColumn("x", F.explode(F.when(F.col("x") < right, F.array("x", F.col("x") + F.col("w"))).otherwise(F.array("x"))))
    return d.select(*px.columns)


def _weighted(v: Column, w, weights: list[float], clamp_ends: bool) -> Column:
    r = len(weights) // 2
    total = F.lit(0.0)
    for k, c in zip(range(-r, r + 1), weights):
        end = F.first(v).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if k < 0 else F.last(v).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        tap = F.lag(v, -k).over(w) if k < 0 else F.lead(v, k).over(w) if k else v
        total = total + F.lit(c) * (F.coalesce(tap, end) if clamp_ends else tap)
    return total


def downsample(px: DataFrame, factor: int) -> DataFrame:
    """Gaussian of sigma factor / 2 where it fits wholly, every factor-th value of that; too small a frame stays as it is."""
    if factor == 1:
        return px
    sigma = factor / 2
    r = int(4 * sigma + 0.5)
    weights = P.gaussian(r, sigma)
    d = with_dims(px)
    small = (F.col("h") - 2 * r < factor) | (F.col("w") - 2 * r < factor)
    out = d.where(~small)
    for axis, size in (("x", "w"), ("y", "h")):
        n = F.floor((F.col(size) - 2 * r) / factor)
        at = F.col(axis) - r
        out = out.withColumn("v", _weighted(F.col("v"), along(out, axis), weights, False)).where((at >= 0) & (F.pmod(at, F.lit(factor)) == 0) & (at / factor < n))
        out = out.withColumn(axis, F.floor((F.col(axis) - r) / factor).cast("int"))
    return out.select(*px.columns).unionByName(d.where(small).select(*px.columns))


def pyramid(px: DataFrame, factors=(1, 2, 4, 4), materialise=lambda df, name: df) -> list[DataFrame]:
    """Levels from fine to coarse, each made from the one before; materialise(df, name) stores them, so that none is made twice."""
    levels = []
    for i, f in enumerate(factors):
        px = materialise(downsample(px, f), f"level_{i}")
        levels.append(px)
    return levels


def gradients(px: DataFrame) -> DataFrame:
    """gx, gy of each 2 x 2 neighbourhood, a quarter of the differences; one row and column fewer."""
    w = along(px, "x")
    rows = px.select(*px.columns, F.lead("v").over(w).alias("r")).where("r is not null")
    d = along(rows, "y")
    q = rows.select(*keys(px), "y", "x", "v", "r", F.lead("v").over(d).alias("b"), F.lead("r").over(d).alias("d")).where("b is not null")
    return q.select(*keys(px), "y", "x", ((F.col("r") - F.col("v") + F.col("d") - F.col("b")) * 0.25).alias("gx"), ((F.col("b") - F.col("v") + F.col("d") - F.col("r")) * 0.25).alias("gy"))


def central_differences(px: DataFrame) -> DataFrame:
    """gx, gy as next minus previous, nothing beyond the frame."""
    side = lambda f, axis: F.coalesce(f("v").over(along(px, axis)), F.lit(0.0))
    return px.select(*px.columns, (side(F.lead, "x") - side(F.lag, "x")).alias("gx"), (side(F.lead, "y") - side(F.lag, "y")).alias("gy"))


def blur(px: DataFrame, sigma: float) -> DataFrame:
    """Separable Gaussian with the ends repeated."""
    import math

    weights = P.gaussian(max(1, math.ceil(3 * sigma)), sigma)
    for axis in "xy":
        px = px.withColumn("v", _weighted(F.col("v"), along(px, axis), weights, True))
    return px


def guide(px: DataFrame, c: P.Config) -> DataFrame:
    """Half-size colour image: each quad's red and blue, and the mean of its greens, over the white balance."""
    if not c.bayer:
        return px.withColumn("ch", F.lit(0))
    ch = P.channel_of("y", "x", c.cfa)
    gain = F.element_at(F.array(*[F.lit(float(x)) for x in c.white_balance]), ch + 1)
    q = px.withColumn("ch", ch).withColumn("v", F.col("v") / gain)
    return q.groupBy(*BASE, "ch", F.floor(F.col("y") / 2).cast("int").alias("Y"), F.floor(F.col("x") / 2).cast("int").alias("X")).agg(F.avg("v").alias("v")).select(*BASE, "ch", F.col("Y").alias("y"), F.col("X").alias("x"), "v")


def local_stats(px: DataFrame) -> DataFrame:
    """mean and var (population) of each 3 x 3 neighbourhood, with the ends repeated."""
    px = px.withColumn("s", F.col("v")).withColumn("q", F.col("v") * F.col("v"))
    for axis in "xy":
        w = along(px, axis)
        three = lambda c: F.col(c) + F.coalesce(F.lag(c).over(w), F.col(c)) + F.coalesce(F.lead(c).over(w), F.col(c))  # noqa: E731,B023
        px = px.withColumns({"s": three("s"), "q": three("q")})
    m = F.col("s") / 9
    return px.select(*keys(px), "y", "x", m.alias("mean"), (F.col("q") / 9 - m * m).alias("var"))


def local_min(px: DataFrame, reach: int = 2) -> DataFrame:
    """Smallest value within `reach` rows and columns; not-a-number is passed over."""
    px = px.withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    for axis in "xy":
        px = px.withColumn("v", F.min("v").over(along(px, axis).rowsBetween(-reach, reach)))
    return px.withColumn("v", F.coalesce("v", F.lit(float("inf"))))


def structure_tensor(grad: DataFrame) -> DataFrame:
    """xx, xy, yy summed over the up to four gradients around each pixel of the grey image."""
    g = grad.select(*keys(grad), "y", "x", (F.col("gx") * F.col("gx")).alias("xx"), (F.col("gx") * F.col("gy")).alias("xy"), (F.col("gy") * F.col("gy")).alias("yy"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    g = g.withColumn("o", F.explode(near))
    return g.groupBy(*keys(grad), (F.col("y") + F.col("o.i")).alias("y"), (F.col("x") + F.col("o.j")).alias("x")).agg(*[F.sum(k).alias(k) for k in ("xx", "xy", "yy")])


def kernel_field(px: DataFrame, c: P.Config, tuned: DataFrame | None = None) -> DataFrame:
    """xx, xy, yy: covariance of the merging kernel at each grey pixel.

    tuned(burst_id, k_detail, k_denoise, D_th, D_tr): parameters of each burst in place of those of c."""
    grey = box_grey(px.withColumn("v", P.stabilise("v", c.alpha, c.beta)), c.bayer)
    t = structure_tensor(gradients(grey)).withColumn("e", P.eigen("xx", "xy", "yy"))
    if tuned is not None:
        names = ("k_detail", "k_denoise", "D_th", "D_tr")
        t, c = t.join(tuned.select("burst_id", *names), "burst_id"), replace(c, **{n: F.col(n) for n in names})
    t = t.withColumn("k", P.kernel_strengths("e.l1", "e.l2", c))
    p, q = F.col("k.k1") * F.col("k.k1"), F.col("k.k2") * F.col("k.k2")
    e = lambda n: F.col(f"e.{n}")
    return t.select(*BASE, "y", "x", (p * e("e1x") * e("e1x") + q * e("e2x") * e("e2x")).alias("xx"), (p * e("e1x") * e("e1y") + q * e("e2x") * e("e2y")).alias("xy"), (p * e("e1y") * e("e1y") + q * e("e2y") * e("e2y")).alias("yy"))


def flow_irregularity(flow: DataFrame, c: P.Config) -> DataFrame:
    """s of each tile: small where displacements differ among its neighbours."""
    f = flow
    for axis, other in (("tx", "ty"), ("ty", "tx")):
        w = Window.partitionBy(*BASE, other).orderBy(axis).rowsBetween(-1, 1)
        low, high = (("dx", "dx"), ("dy", "dy")) if axis == "tx" else (("dx0", "dx1"), ("dy0", "dy1"))
        f = f.withColumns({"a": F.min(low[0]).over(w), "b": F.max(low[1]).over(w), "c": F.min(high[0]).over(w), "d": F.max(high[1]).over(w)}).withColumns({"dx0": F.col("a"), "dx1": F.col("b"), "dy0": F.col("c"), "dy1": F.col("d")})
    p, q = F.col("dx1") - F.col("dx0"), F.col("dy1") - F.col("dy0")
    return f.select(*BASE, "ty", "tx", F.when(p * p + q * q > c.r_Mt * c.r_Mt, c.r_s1).otherwise(c.r_s2).alias("s"))


def pyramid_levels(px: DataFrame, factors=(1, 2, 4, 4)) -> DataFrame:
    """All levels of pyramid() as one table with level, 0 the finest."""
    return reduce(DataFrame.unionByName, [p.withColumn("level", F.lit(i)) for i, p in enumerate(pyramid(px, factors))])


def _by_lines(px: DataFrame, into, axes=("x", "y")) -> DataFrame:
    """into(complex lines, along the last axis) applied to each row (axis x) and then to each column of px(..., v, im). Lines are
    dealt to all tasks, which work on portions of them, those of one length at once. Lines of one sample stay as they are."""
    import numpy as np
    import pyarrow as pa

    from .batches import dealt, sorted_groups

    def run(t, group):
        z = t.column("v").to_numpy() + 1j * t.column("im").to_numpy()
        first = np.searchsorted(group, np.arange(group[-1] + 1))
        size = np.diff(np.r_[first, len(group)])
        for n in np.unique(size[size > 1]):
            at = first[size == n][:, None] + np.arange(n)
            z[at] = into(z[at])
        new = {"v": z.real.copy(), "im": z.imag.copy()}
        return pa.table({n: pa.array(new[n]) if n in new else t.column(n) for n in t.column_names})

    for axis in axes:
        line = (*BASE, "y" if axis == "x" else "x")
        px = sorted_groups(dealt(px, line).sortWithinPartitions(*line, axis), line, run, px.schema)
    return px


def _complex(px: DataFrame) -> DataFrame:
    im = F.col("im").cast("double") if "im" in px.columns else F.lit(0.0)
    return px.select(*BASE, "y", "x", F.col("v").cast("double").alias("v"), im.alias("im"))


def fourier(px: DataFrame, inverse: bool = False) -> DataFrame:
    """v, im: the transform of each frame in both axes, of any size; the inverse scales by the number of samples."""
    import numpy as np

    return _by_lines(_complex(px), np.fft.ifft if inverse else np.fft.fft)


def half_shift(px: DataFrame, back: bool = False) -> DataFrame:
    """Samples moved by half a frame around each axis, which puts the zero frequency in the middle; back undoes it."""
    d = with_dims(px)
    half = lambda n: F.ceil(F.col(n) / 2) if back else F.floor(F.col(n) / 2)
    return d.withColumns({a: F.pmod(F.col(a) + half(n), F.col(n)).cast("int") for a, n in (("y", "h"), ("x", "w"))}).select(*px.columns)


def half_of_frequencies(z):
    """Complex lines, along the last axis, by the centred half of their frequencies."""
    import numpy as np

    n = z.shape[-1]
    mask = np.zeros(n, bool)
    mask[n // 4 : n - n // 4] = True
    return np.fft.ifft(np.where(np.fft.ifftshift(mask), np.fft.fft(z), 0))


def low_pass_rows(grey: DataFrame) -> DataFrame:
    """Grey by the centred half of the frequencies, at full size. Not for one-pixel frames, which stay as they are."""
    return _by_lines(_complex(grey), half_of_frequencies).drop("im")
