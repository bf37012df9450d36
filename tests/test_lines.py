"""Steps along whole rows and columns in tile form, and what is made of them, with the rows of the forms sample by sample."""

import math

import pytest
from pyspark.sql import functions as F

from burstlake.functions import photometry as P
from burstlake.operators import encode, halo, match, merge, stencil, tiles
from burstlake.plans import registry, super_resolve
from tests.test_bursts import _bursts, _same, _store
from tests.test_portions import frames_of

KEY = ("burst_id", "frame_idx", "y", "x")


def test_lines_of_odd_frames(spark):
    px = frames_of(spark, (37, 45), (5, 6), (9, 100), (1, 7), (16, 16))
    # frames of less than half a tile are gone through more than once, up to a whole tile
    small = halo.samples(halo.along_lines(tiles.stored(px.where("burst_id = 3"), 8), halo.circular_lines(8), 8), "v").collect()
    row = {r.x: r.v for r in px.where("burst_id = 3").collect()}
    assert {(r.y, r.x): r.v for r in small} == {(y, x): row[x % 7] for y in range(8) for x in range(8)}
    px = px.where("burst_id != 3").unionByName(frames_of(spark, (1, 1), (7, 5)).withColumn("burst_id", F.col("burst_id") + 9).where("burst_id > 9"))
    for lines, want in ((halo.downsample_lines(2), stencil.downsample(px, 2)), (halo.downsample_lines(4), stencil.downsample(px, 4)), (halo.circular_lines(8), stencil.pad_circular(px, 8)), (halo.low_pass_lines(), stencil.low_pass_rows(px))):
        _same(halo.samples(halo.along_lines(tiles.stored(px, 8), lines, 8), "v"), want, KEY, "v", least=900)


def test_alignment_of_tiles_makes_no_row_for_a_sample(spark, monkeypatch):
    for module, name in ((match, "align"), (match, "pyramid"), (stencil, "downsample"), (stencil, "pad_circular")):
        monkeypatch.setattr(module, name, lambda *a: pytest.fail("a row for each sample"))
    assert registry.i3_tiles(spark, "/root/testdata/sf0.001").count() > 0


def test_alignment_of_tiles_equals_alignment_of_samples(spark, tmp_path):
    """Uneven frames of two sizes over three levels, tiles smaller than what a level reaches, and a burst that has its reference
    alone."""
    store, c = _store(tmp_path), P.Config(factors=(1, 2, 4), tile_sizes=(8, 8, 8), radii=(1, 2, 2), metrics=("L1", "L2", "L2"), refine_turns=2)
    wave = lambda x, y, d: math.sin((x + d) * 0.21) + math.cos((y - d) * 0.17) + 0.3 * math.sin((x + d) * (y - d) * 0.01)
    sizes = {(1, 0): (100, 84), (1, 1): (100, 84), (1, 2): (100, 84), (2, 0): (19, 30), (2, 1): (19, 30), (3, 0): (16, 16)}
    px = spark.createDataFrame([(b, f, y, x, wave(x, y, 1.3 * f)) for (b, f), (h, w) in sizes.items() for y in range(h) for x in range(w)], "burst_id long, frame_idx int, y int, x int, v double")
    px = store(px.coalesce(4), "px")
    got = tiles.align(store(tiles.stored(px, 16), "grey"), c, 16, 2, store)
    want = match.align(px, c, store, tiles.level_step(c, 16, 2, store))
    _same(got.select(*KEY[:2], "ty", "tx", "dx", "dy"), want, ("burst_id", "frame_idx", "ty", "tx"), "dx", "dy", least=2 * 13 * 11 + 12)
    assert got.where(F.col("burst_id") == 3).count() == 0


def test_whole_path_in_tiles_makes_no_row_for_a_sample_or_channel(spark, tmp_path, monkeypatch):
    """The flow that is not given comes from tiles, and colours from blocks, with the rows of the forms sample by sample."""
    store, c = _store(tmp_path), P.Config(factors=(1, 2), tile_sizes=(8, 8), radii=(1, 2), metrics=("L1", "L2"), refine_turns=1)
    px, lut = store(_bursts(spark), "px"), registry._lut(spark)
    flow = store(match.align(store(stencil.low_pass_rows(px), "grey"), c, store, tiles.level_step(c, 16, 2, store)), "flow")
    sums = super_resolve.merged(px, c, lut, flow, store, side=16)
    want = store(encode.encode_16(encode.rgb(merge.normalised(sums, c, balance=False)), c), "want")
    for module, name in ((match, "align"), (stencil, "low_pass_rows"), (encode, "rgb")):
        monkeypatch.setattr(module, name, lambda *a: pytest.fail("a row for each sample or channel"))
    got, _ = super_resolve.process_to_rows(px, c, lut, side_tiles=16, materialise=store)
    a, b = ({(r.burst_id, r.Y, r.X): (r.r16, r.g16, r.b16) for r in df.collect()} for df in (got, want))
    assert set(a) == set(b) and len(a) == 3 * 64 * 64
    assert all(abs(x - y) <= 1 for k in a for x, y in zip(a[k], b[k]))
