"""Displacement of tiles: block matching, sub-pixel refinement, and both from coarse to fine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import photometry as P
from .gather import BASE, bilinear, read_at, taps, upscale_flow, with_dims
from .stencil import central_differences, pad_circular, pyramid


def tiles_of(frames: DataFrame, tile: int) -> DataFrame:
    """burst_id, frame_idx, ty, tx for frames(burst_id, frame_idx, h, w): at least one tile on each axis."""
    n = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) / tile).cast("int"))
    return frames.select(*BASE, F.explode(F.sequence(F.lit(0), n("h") - 1)).alias("ty"), "w").withColumn("tx", F.explode(F.sequence(F.lit(0), n("w") - 1))).drop("w")


def _members(ref: DataFrame, flow: DataFrame, tile: int) -> DataFrame:
    """Reference samples (burst_id, y, x, v) with each comparison frame's tile and displacement."""
    r = ref.select("burst_id", "y", "x", F.col("v").alias("r"), F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"))
    return r.join(flow.select(*BASE, "ty", "tx", "dx", "dy"), ["burst_id", "ty", "tx"])


def match_costs(ref: DataFrame, moving: DataFrame, flow: DataFrame, tile: int, radius: int, metric: str = "L1") -> DataFrame:
    """cost of each tile and offset (oy, ox) around its displacement.

    L1: sum of absolute differences, nothing beyond the frame. L2: sum of squares less twice the products, the ends repeated."""
    dims = moving.groupBy(*BASE).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    m = _members(ref, flow, tile).join(dims, [*BASE]).withColumn("o", F.explode(taps(-radius, radius)))
    y, x = F.col("y") + F.rint("dy") + F.col("o.i"), F.col("x") + F.rint("dx") + F.col("o.j")
    got = read_at(m, moving, y, x, "zero" if metric == "L1" else "clamp")
    cost = F.sum(F.abs(F.col("r") - F.col("m"))) if metric == "L1" else F.sum(F.col("m") * F.col("m")) - 2 * F.sum(F.col("r") * F.col("m"))
    return got.groupBy(*BASE, "ty", "tx", F.col("o.i").alias("oy"), F.col("o.j").alias("ox")).agg(cost.alias("cost"), F.first("dx").alias("dx"), F.first("dy").alias("dy"))


def correlation_map(ref: DataFrame, moving: DataFrame, flow: DataFrame, tile: int, radius: int) -> DataFrame:
    """corr of each tile and offset (oy, ox): the sum of products of the reference with the displaced frame, ends repeated."""
    dims = moving.groupBy(*BASE).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    m = _members(ref, flow, tile).join(dims, [*BASE]).withColumn("o", F.explode(taps(-radius, radius)))
    got = read_at(m, moving, F.col("y") + F.rint("dy") + F.col("o.i"), F.col("x") + F.rint("dx") + F.col("o.j"), "clamp")
    return got.groupBy(*BASE, "ty", "tx", F.col("o.i").alias("oy"), F.col("o.j").alias("ox")).agg(F.sum(F.col("r") * F.col("m")).alias("corr"))


def block_match(ref: DataFrame, moving: DataFrame, flow: DataFrame, tile: int, radius: int, metric: str = "L1") -> DataFrame:
    """burst_id, frame_idx, ty, tx, dx, dy, cost: the best offset of each tile, the first in raster order among equals.

    L1 adds it to the rounded displacement, L2 to the displacement as it is."""
    best = match_costs(ref, moving, flow, tile, radius, metric).groupBy(*BASE, "ty", "tx").agg(F.min(F.struct("cost", "oy", "ox")).alias("b"), F.first("dx").alias("dx"), F.first("dy").alias("dy"))
    base = (lambda c: F.rint(c)) if metric == "L1" else F.col
    return best.select(*BASE, "ty", "tx", (base("dx") + F.col("b.ox")).alias("dx"), (base("dy") + F.col("b.oy")).alias("dy"), F.col("b.cost").alias("cost"))


def hessians(ref: DataFrame, tile: int) -> DataFrame:
    """h00, h01, h11, det of each reference tile from central differences; ref(burst_id, frame_idx, y, x, v)."""
    g = central_differences(ref).withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
    t = g.groupBy("burst_id", "ty", "tx").agg(F.sum(F.col("gx") * F.col("gx")).alias("h00"), F.sum(F.col("gx") * F.col("gy")).alias("h01"), F.sum(F.col("gy") * F.col("gy")).alias("h11"))
    return t.withColumn("det", F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01"))


def refine(ref: DataFrame, moving: DataFrame, flow: DataFrame, tile: int, turns: int = 3) -> DataFrame:
    """Flow after `turns` steps of inverse-compositional refinement; tiles with a singular Hessian keep theirs."""
    h = hessians(ref, tile)
    g = central_differences(ref).select("burst_id", "y", "x", "gx", "gy")
    dims = with_dims(moving).select(*BASE, "h", "w").distinct()
    ref = ref.select("burst_id", "y", "x", "v")
    for _ in range(turns):
        m = _members(ref, flow, tile).join(g, ["burst_id", "y", "x"]).join(dims, [*BASE])
        m = bilinear(m, moving, F.col("dx"), F.col("dy"), tile == 8, [*BASE, "y", "x"])
        t = F.col("mov") - F.col("r")
        b = m.groupBy(*BASE, "ty", "tx").agg(F.sum(-F.col("gx") * t).alias("b0"), F.sum(-F.col("gy") * t).alias("b1"))
        met = flow.join(b, [*BASE, "ty", "tx"], "left").join(h, ["burst_id", "ty", "tx"], "left")
        good = F.abs("det") >= 1e-10
        flow = met.select(
            *BASE, "ty", "tx",
            F.when(good, F.col("dx") + F.try_divide(F.col("h11") * F.col("b0") - F.col("h01") * F.col("b1"), F.col("det"))).otherwise(F.col("dx")).alias("dx"),
            F.when(good, F.col("dy") + F.try_divide(F.col("h00") * F.col("b1") - F.col("h01") * F.col("b0"), F.col("det"))).otherwise(F.col("dy")).alias("dy"),
        )
    return flow


def align(grey: DataFrame, c: P.Config, materialise=lambda df, name: df, step=None) -> DataFrame:
    """Flow of every comparison frame (frame_idx > 0) against frame 0, from the coarsest level to the finest.

    grey: samples of all frames. Only the reference is padded to whole tiles. materialise(df, name) cuts the lineage
    between levels, for example by writing a stage table. step(ref, moving, start, level) -> flow does the work of a level:
    sample by sample unless given, in tile form by tiles.level_step."""
    ref = pyramid(pad_circular(grey.where("frame_idx = 0"), c.tile_sizes[0]), c.factors, materialise)
    moving = pyramid(grey.where("frame_idx > 0"), c.factors, materialise)
    frames = grey.where("frame_idx > 0").select(*BASE).distinct()
    flow = None
    for level in range(len(c.factors) - 1, -1, -1):
        tile = c.tile_sizes[level]
        size = ref[level].groupBy("burst_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
        grid = tiles_of(frames.join(size, "burst_id"), tile)
        if flow is None:
            start = grid.withColumns({"dx": F.lit(0.0), "dy": F.lit(0.0)})
        else:
            start = upscale_flow(flow, grid, c.factors[level + 1], tile, c.tile_sizes[level + 1])
        if step is None:
            found = block_match(ref[level], moving[level], start, tile, c.radii[level], c.metrics[level]).drop("cost")
            found = refine(ref[level], moving[level], found, tile, c.refine_turns)
        else:
            found = step(ref[level], moving[level], start, level)
        flow = materialise(found, f"flow_{level}")
    return flow
