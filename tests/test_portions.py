"""Tiles, blocks and lines that lie alike are worked on as one array, with the rows of the forms sample by sample."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from burstlake.functions import photometry as P
from burstlake.operators import gather, halo, match, stencil, tile_merge, tiles
from burstlake.plans import registry
from tests.test_oracles import rows

KEY = ["burst_id", "frame_idx", "y", "x"]


def frames_of(spark, *sizes):
    """A frame of each size with samples that repeat nowhere."""
    all_ = [(i, 0, y, x, float((7919 * i + 104729 * y + 1299709 * x) % 10007)) for i, (h, w) in enumerate(sizes) for y in range(h) for x in range(w)]
    return spark.createDataFrame(all_, "burst_id long, frame_idx int, y int, x int, v double")


def same(got, want):
    assert rows(got.toPandas()) == rows(want.toPandas())


def test_a_step_runs_once_for_all_tiles_that_lie_alike():
    calls = []
    step = halo.Step(lambda v, *at: calls.append(v.data.shape) or v.read(*at))
    t = pa.Table.from_arrays([pa.array([*range(5)]), *[pa.array([n] * 5, pa.int32()) for n in (0, 0, 0, 0, 0, 2, 2, 2, 2)], pa.array([[float(k)] * 4 for k in range(5)])], schema=halo._TILE)
    out = halo._chained(lambda c: [step], 2, None)(t, np.arange(5))
    assert calls == [(1, 5, 2, 2)]
    assert sorted(zip(out["burst_id"].to_pylist(), out["data"].to_pylist())) == [(k, [float(k)] * 4) for k in range(5)]


def test_lines_of_one_length_are_transformed_together(spark, monkeypatch):
    px = frames_of(spark, (3, 5), (3, 5), (1, 4))
    got = stencil.fourier(px).where("burst_id = 1").orderBy("y", "x").collect()
    v = np.array([r["v"] for r in px.where("burst_id = 1").orderBy("y", "x").collect()]).reshape(3, 5)
    assert np.allclose([complex(r["v"], r["im"]) for r in got], np.fft.fft2(v).ravel())
    assert "FlatMapGroupsInArrow" not in stencil.fourier(px)._jdf.queryExecution().toString()


@pytest.mark.parametrize("dy,dx,clamp", [(-0.25, 0.375, False), (2.25, -1.625, True), (-1.5, 3.75, False)])
def test_displaced_reads(spark, dy, dx, clamp):
    px = frames_of(spark, (9, 6), (4, 4), (1, 7))
    asked = stencil.with_dims(px).withColumns({"dx": F.lit(dx), "dy": F.lit(dy)}).drop("v")
    want = gather.bilinear(asked, px, F.col("dx"), F.col("dy"), clamp, KEY).select(*KEY, "mov")
    got = halo.samples(halo.chain(tiles.stored(px, 4), [halo.displaced(dy, dx, clamp)], 4), "mov")
    six = lambda df: df.withColumn("mov", F.round("mov", 6))
    same(six(got), six(want))


def test_central_differences_and_guide(spark):
    px = frames_of(spark, (10, 6), (4, 4), (2, 8))
    got = halo.samples(halo.chain(tiles.stored(px, 4), [halo.central_differences()], 4), "gx", "gy")
    same(got, stencil.central_differences(px).drop("v"))
    got = tile_merge.channel_samples(halo.chain(tiles.stored(px, 4), [halo.guide(P.Config())], 4), 3, "v")
    same(got, stencil.guide(px, P.Config()))


def test_alignment_runs_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(match, "match_costs", lambda *a: pytest.fail("a row for each offset"))
    registry.i3_align(spark, "/root/testdata/sf0.001")
