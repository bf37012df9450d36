"""Matching in tile form from samples in any order, in work that grows with the samples and not with offsets."""

import pyarrow as pa
from pyspark.sql import functions as F

from burstlake.operators import batches, match, tiles
from burstlake.plans import registry
from burstlake.sources import rasters

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_tiles_from_samples_in_any_order(spark):
    px = rasters.events_px(spark, SF).where("y < 7 and x < 6")
    want = rows(px, "burst_id", "frame_idx", "y", "x", "v")
    for given in (px, px.repartition(5, F.rand(1))):
        t = tiles.stored(given, 4).select("burst_id", "frame_idx", "y0", "x0", "tw", "fh", "fw", F.posexplode("data").alias("p", "v"))
        assert t.where("fh != 7 or fw != 6").count() == 0
        assert rows(t.select("burst_id", "frame_idx", (F.col("y0") + F.floor(F.col("p") / F.col("tw"))).alias("y"), (F.col("x0") + F.col("p") % F.col("tw")).alias("x"), "v"), "burst_id", "frame_idx", "y", "x", "v") == want


def test_matching_equals_that_of_samples_and_has_no_row_for_an_offset(spark):
    px = rasters.scene_px(spark, SF).where("burst_id < 2 and y < 28")
    ref, moving, zero = px.where("frame_idx = 0"), px.where("frame_idx > 0"), registry._zero_flow(px, 8)
    key = ("burst_id", "frame_idx", "ty", "tx")
    for metric in ("L1", "L2"):
        got = tiles.block_match(ref, moving, zero, 8, 2, metric, 16, 2)
        assert rows(got, *key, "dx", "dy", "cost") == rows(match.block_match(ref, moving, zero, 8, 2, metric), *key, "dx", "dy", "cost")
    assert rows(tiles.correlation_map(ref, moving, zero, 8, 1, 16, 1), *key, "oy", "ox", "corr") == rows(match.correlation_map(ref, moving, zero, 8, 1), *key, "oy", "ox", "corr")
    for name in ("i1_block_match_l1", "f3_correlation", "i2_refine_step", "d15_flow_irregularity"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "__ay" not in plan, name


def test_a_group_over_many_batches_stays_whole():
    t = pa.table({"k": [0] * 5 + [1] * 2 + [2] * 9})
    old, batches.PORTION = batches.PORTION, t.nbytes // 4
    try:
        assert [sorted(set(p["k"].to_pylist())) for p, _ in batches.portions(t, ["k"])] == [[0], [1], [2]]
    finally:
        batches.PORTION = old


def test_colours_of_blocks_equal_those_of_single_channels(spark):
    from burstlake.operators import encode, merge, tile_merge

    raw = tiles.stored(rasters.unit(rasters.scene_px(spark, SF)).where("burst_id < 2 and frame_idx = 0 and y < 7"), 16)
    acc = tile_merge.merge(raw, None, None, None, 8, registry.ISO, 16)
    want = encode.rgb(merge.normalised(tile_merge.sums(acc), registry.ISO, balance=False))
    assert rows(tile_merge.colours(acc, registry.ISO, balance=False), "burst_id", "Y", "X", "r", "g", "b") == rows(want, "burst_id", "Y", "X", "r", "g", "b")
