"""Known answers and borders of the raster operators."""

import math

import pytest
from pyspark.sql import functions as F

from burstlake.functions import photometry as P
from burstlake.operators import crop, encode, gather, halo, match, merge, robust, settings, stencil, tile_merge, tiles
from burstlake.plans import registry, super_resolve
from burstlake.sources import rasters

SF = "/root/testdata/sf0.001"
PX = "burst_id long, frame_idx int, y int, x int, v double"


def frame(spark, values, burst=1, idx=0):
    return spark.createDataFrame([(burst, idx, y, x, float(v)) for y, row in enumerate(values) for x, v in enumerate(row)], PX)


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_rounding_and_clamps(spark):
    assert one(spark, F.rint(F.lit(2.5))) == 2 and one(spark, P.half_away(F.lit(2.5))) == 3 and one(spark, P.half_away(F.lit(-2.5))) == -3
    assert one(spark, P.toward_zero(F.lit(-1.7))) == -1
    assert math.isnan(one(spark, P.clamp(F.lit(float("nan"))))) and one(spark, P.clamp(F.lit(7.0))) == 1
    assert one(spark, P.smoothstep(1, 1, F.lit(1.0))) == 1 and one(spark, P.smoothstep(0, 1, F.lit(0.5))) == 0.5
    assert one(spark, P.normalise(F.lit(500.0), 0, 0)) == pytest.approx(500 / 65535)
    assert one(spark, P.between_points(F.lit(3.0), 2, 2, 5, 6)) == 5


def test_eigen_and_inverse(spark):
    e = one(spark, P.eigen(F.lit(2.0), F.lit(0.0), F.lit(2.0)))
    assert (e.e1x, e.e1y, e.e2x, e.e2y) == (1, 0, 0, 1)
    e = one(spark, P.eigen(F.lit(3.0), F.lit(1.0), F.lit(2.0)))
    assert e.l1 + e.l2 == pytest.approx(5) and e.e1x * e.e2x + e.e1y * e.e2y == pytest.approx(0)
    assert tuple(one(spark, P.inverse(F.lit(0.0), F.lit(0.0), F.lit(0.0)))) == (1, 0, 1)


def test_weights_sum_to_one():
    assert sum(P.gaussian(4, 1.0)) == pytest.approx(1) and P.overridden(P.Config(), {"r_t": 0.5, "unknown": 1}).r_t == 0.5


def test_constant_frames(spark):
    px = frame(spark, [[5] * 12] * 12)
    g = stencil.gradients(px).agg(F.max(F.abs("gx")), F.max(F.abs("gy")), F.count("*")).first()
    assert tuple(g) == (0, 0, 121)
    assert stencil.local_stats(px).agg(F.max(F.abs("var"))).first()[0] == pytest.approx(0)
    assert stencil.blur(px, 1.0).agg(F.min("v"), F.max("v")).first() == pytest.approx((5, 5))
    assert stencil.downsample(px, 2).agg(F.count("*"), F.avg("v")).first() == pytest.approx((4, 5))
    assert stencil.downsample(frame(spark, [[1] * 4] * 4), 2).count() == 16  # too small: as it is


def test_low_pass_keeps_constants(spark):
    px = frame(spark, [[3] * 8] * 6)
    assert stencil.low_pass_rows(px).agg(F.min("v"), F.max("v")).first() == pytest.approx((3, 3))


def test_minimum_passes_over_nan(spark):
    px = frame(spark, [[float("nan"), 2, 3], [4, 5, 6]])
    assert {r.v for r in stencil.local_min(px).collect()} == {2.0}
    assert stencil.local_min(frame(spark, [[float("nan")]])).first().v == float("inf")


def test_padding_and_crops(spark):
    px = frame(spark, [[y * 5 + x for x in range(5)] for y in range(5)])
    assert stencil.pad_circular(px, 4).count() == 64
    assert stencil.box_grey(px).count() == 4
    assert {(r.y, r.x) for r in crop.centre_crop(px, 2).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert crop.valid_bursts(px).count() == 0


def test_scene_shift_is_found(spark):
    flow = registry.i1_block_match_l1(spark, SF).where("tx between 1 and 2 and ty between 1 and 2")
    want = flow.withColumns({"sy": (F.col("burst_id") + F.col("frame_idx")) % 3 - 1, "sx": (3 * F.col("burst_id") + 2 * F.col("frame_idx")) % 3 - 1})
    assert want.where("cost != 0 or dx != -sx or dy != -sy").count() == 0 and want.count() == 120


def test_refinement_finds_a_fraction(spark):
    shape = lambda d: [[math.sin((x + d) * 0.3) + math.cos(y * 0.35) for x in range(32)] for y in range(32)]
    ref, moving = frame(spark, shape(0)), frame(spark, shape(0.4), idx=1)
    grid = match.tiles_of(spark.createDataFrame([(1, 1, 32, 32)], "burst_id long, frame_idx int, h int, w int"), 16).withColumns({"dx": F.lit(0.0), "dy": F.lit(0.0)})
    inner = match.refine(ref, moving, grid, 16, 3).collect()
    assert all(abs(r.dy) < 0.2 for r in inner) and any(abs(r.dx + 0.4) < 0.2 for r in inner)


def test_flow_upscaling_fills_with_zero(spark):
    f = spark.createDataFrame([(1, 1, 0, 0, 2.0, -1.0)], "burst_id long, frame_idx int, ty int, tx int, dx double, dy double")
    grid = spark.createDataFrame([(1, 1, y, x) for y in range(3) for x in range(2)], "burst_id long, frame_idx int, ty int, tx int")
    got = {(r.ty, r.tx): (r.dx, r.dy) for r in gather.upscale_flow(f, grid, 2, 8, 8).collect()}
    assert got[(1, 1)] == (4, -2) and got[(2, 0)] == (0, 0)


def test_identical_frames_are_trusted_and_merge_to_themselves(spark):
    px = frame(spark, [[0.5] * 16] * 16).unionByName(frame(spark, [[0.5] * 16] * 16, idx=1))
    c = P.Config(tile_sizes=(8, 8, 8, 8))
    grid = registry._zero_flow(px, 8)
    rob = robust.robustness(px, robust.reference_stats(px, c), grid, registry._lut(spark), 8, c)
    assert rob.agg(F.min("v")).first()[0] == 1
    cov = stencil.kernel_field(px, c)
    acc = merge.accumulate(merge.merge_comparison(px, grid, rob, cov, 8, c), merge.merge_reference(px, cov, robust.accumulated(rob), c))
    out = merge.normalised(acc, c).agg(F.min("v"), F.max("v"), F.count("*")).first()
    assert out[0] == pytest.approx(0.5) and out[1] == pytest.approx(0.5) and out[2] <= 32 * 32 * 3


def test_reference_border_is_infinite(spark):
    px = frame(spark, [[0.5] * 8] * 8)
    s = robust.reference_stats(px, P.Config())
    assert {r.mean for r in s.where("y = 0 or x = 0").collect()} == {float("inf")}


def test_noise_curves_are_measured(spark):
    """Still pairs whose cells differ by four steps in brightness 0.25 and by none in 0.75; levels between lie on a line of squares."""
    still = frame(spark, [[100] * 3 + [300] * 3] * 3).unionByName(frame(spark, [[104] * 3 + [300] * 3] * 3, idx=1))
    assert robust.noise_curves(still.where("v < 0"), 400).count() == 0
    lut = {r.bin: r for r in robust.noise_curves(still, 400).collect()}
    assert len(lut) == 1001 and lut[255].diff == lut[0].diff == pytest.approx(0.01) and lut[750].diff == lut[1000].diff == 0
    assert lut[502].diff == pytest.approx(0.01 * (1 - 247 / 495) ** 0.5) and all(r.sigma == 0 for r in lut.values())
    uneven = robust.noise_curves(frame(spark, [[0, 0, 0], [0, 90, 0], [0, 0, 0]]).unionByName(frame(spark, [[0, 0, 0], [0, 90, 0], [0, 0, 0]], idx=1)), 100).first()
    assert uneven.sigma == pytest.approx(0.1 * 8**0.5) and uneven.diff == 0


def test_replacing_covers_all_channels(spark):
    """A pixel of which the reference gives one channel loses the others as well; beside it they are added."""
    shape = "burst_id long, Y int, X int, ch int, num double, den double, src string"
    comp = spark.createDataFrame([(1, 0, 0, 0, 2.0, 1.0, "comp"), (1, 0, 0, 1, 3.0, 1.0, "comp"), (1, 0, 1, 0, 5.0, 1.0, "comp")], shape)
    ref = spark.createDataFrame([(1, 0, 0, 0, 7.0, 2.0, "ref"), (1, 0, 1, 0, 1.0, 1.0, "ref")], shape).withColumn("replaces", F.col("X") == 0)
    assert {(r.X, r.ch): (r.num, r.den) for r in merge.accumulate(comp, ref).collect()} == {(0, 0): (7, 2), (0, 1): (0, 0), (1, 0): (6, 2)}


def test_noise_bounds(spark):
    low, high = spark.range(1).select(*P.linear_noise(1.80710882e-4, 3.1937599182e-6)).first()
    assert low == pytest.approx(0.0169, abs=1e-3) and high == pytest.approx(0.961, abs=1e-3)


def test_the_twelve_tuning_keys(spark):
    # The keys that can be tuned.
    keys = """r_t r_s1 r_s2 r_Mt k_detail k_denoise k_stretch snr_auto_tune accumulated_robustness_denoiser_enabled
        acc_rob_rad_max acc_rob_max_multiplier acc_rob_max_frame_count""".split()
    assert sorted(P.TUNABLE) == sorted(keys)
    given = {k: 0.0 if k == "snr_auto_tune" else 1.0 for k in keys}
    s = spark.createDataFrame([(1, {**given, "alpha": 5.0, "k_shrink": 9.0}), (2, None), (3, {"snr_auto_tune": None, "r_t": 0.5})], "burst_id long, overrides map<string,double>")
    got = {r.burst_id: r.asDict() for r in settings.burst_config(s, P.Config()).collect()}
    usual = P.Config()
    assert all(got[1][n] == P.overridden(usual, given).__dict__[n] for n in P.TUNABLE.values()) and all(got[2][n] == getattr(usual, n) for n in P.TUNABLE.values())
    assert got[1]["alpha"] == usual.alpha and "k_shrink" not in got[1] and got[3]["snr_tuning"] is True and got[3]["r_t"] == 0.5
    means = spark.createDataFrame([(1, 0.5), (2, 0.5)], "burst_id long, mean double")
    config = settings.burst_config(s.where("burst_id < 3"), usual)
    own = {r.burst_id: r for r in settings.tuned(config, means, usual).collect()}
    assert own[1].k_denoise == 1 and own[1].tile == 16 and own[1].D_tr == usual.D_tr  # switched off: as overridden
    assert own[2].k_denoise == pytest.approx(3) and own[2].D_tr == pytest.approx(1)


def test_header_has_every_tag(spark):
    sizes = spark.createDataFrame([(1, 6, 4, "maker", "", 6), (2, 6, 4, None, "camera", 9)], "burst_id long, H int, W int, make string, model string, orientation int")
    rows = {(r.burst_id, r.tag): r.text if r.text is not None else r["values"] for r in encode.header_rows(sizes, P.Config()).collect()}
    assert [t for b, t in sorted(rows) if b == 1] == [254, 256, 257, 258, 259, 262, 271, 272, 273, 274, 277, 278, 279, 284, 339, 50706, 50707, 50708, 50714, 50717, 50719, 50720, 50721, 50778, 50829]
    assert (rows[1, 271], rows[1, 272], rows[2, 271], rows[2, 50708]) == ("maker", "merged", "burstlake", "camera")
    assert rows[1, 274] == [6] and (2, 274) not in rows and rows[1, 279] == [144] and rows[1, 50829] == [0, 0, 6, 4] and rows[1, 50720] == [4, 6] and rows[1, 50717] == [65535] * 3
    baked = {r.tag for r in encode.header_rows(sizes, P.Config(bake_srgb=True)).collect()}
    assert 50721 not in baked and 50778 not in baked


def test_transforms_of_any_size(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(5, 6))
    f = stencil.half_shift(stencil.fourier(frame(spark, v)))
    want = np.fft.fftshift(np.fft.fft2(v))
    assert all(r.v + 1j * r.im == pytest.approx(want[r.y, r.x]) for r in f.collect())
    back = stencil.fourier(stencil.half_shift(f, back=True), inverse=True).collect()
    assert len(back) == 30 and all(r.v == pytest.approx(v[r.y, r.x]) and abs(r.im) < 1e-9 for r in back)


def test_planes_round_trip(spark):
    px = frame(spark, [[1, 2, 3], [4, 5, 6]])
    planes = rasters.pack_planes(px)
    assert planes.first().data == [1, 2, 3, 4, 5, 6]
    assert sorted(map(tuple, rasters.unpack_planes(planes).collect())) == sorted(map(tuple, px.collect()))


def test_whole_path_aligns_and_tunes_each_burst(spark, monkeypatch):
    """A bright burst and a dim one: each gets its tile size and kernels; the flow comes from align, the noise from the curves."""
    wave = lambda level, d: [[level * (1 + 0.5 * math.sin((x + d) * 0.3) * math.cos(y * 0.35)) for x in range(16)] for y in range(16)]
    px = frame(spark, wave(0.5, 0)).unionByName(frame(spark, wave(0.5, 0.4), idx=1)).unionByName(frame(spark, wave(0.01, 0), burst=2)).unionByName(frame(spark, wave(0.01, 0.4), burst=2, idx=1))
    seen = []
    acc = "burst_id long, Y int, X int, ch int, num double, den double"
    monkeypatch.setattr(super_resolve, "merged", lambda px, c, lut, **how: seen.append((c.tile_sizes, how["tuned"].first(), how.get("flow"), lut)) or spark.createDataFrame([], acc))
    monkeypatch.setattr(registry, "_sc", lambda spark, sf: px)
    registry.i11_super_resolve(spark, SF)
    dim, bright = sorted(seen, key=lambda s: -s[0][0])
    assert dim[0] == (64, 64, 64, 32) and bright[0] == (16, 16, 16, 8) and dim[2] is bright[2] is None
    assert dim[1].k_denoise > bright[1].k_denoise == pytest.approx(3.0) and bright[3].where("bin = 500").first().diff != registry._lut(spark).where("bin = 500").first().diff
    a, b = (stencil.kernel_field(px.where("burst_id = 2 and frame_idx = 0"), P.Config(), t).agg(F.avg("xx")).first()[0] for t in (None, super_resolve.snr_table(px, P.Config())))
    assert a != b


def _bursts(spark):
    """Three bursts of three frames: a bright one, a dim one and one in between, moving by fractions."""
    wave = lambda level, d, e: [[level * (1 + 0.5 * math.sin((x + d) * 0.5) * math.cos((y + e) * 0.45)) for x in range(32)] for y in range(32)]
    parts = [frame(spark, wave(level, 0.7 * f, -0.4 * f), burst=b, idx=f) for b, level in ((1, 0.5), (2, 0.01), (3, 0.05)) for f in range(3)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.coalesce(4)


def test_whole_path_in_tile_form_gives_the_same_raster(spark, tmp_path):
    """Alignment, robustness, kernels by each burst's own tuning, denoiser and merge, both ways, down to the 16-bit rows."""
    store = _store(tmp_path)
    px, c = store(_bursts(spark), "px"), P.Config(denoise_accumulated=True, factors=(1, 2), tile_sizes=(8, 8), radii=(1, 2), metrics=("L1", "L2"), refine_turns=2)
    flow = store(match.align(px, c, store, tiles.level_step(c, 16, 2, store)), "flow")
    lut, own = registry._lut(spark), store(super_resolve.snr_table(px, c), "snr")
    plain = store(super_resolve.merged(px, c, lut, flow, store, own), "plain")
    tiled = store(super_resolve.merged(px, c, lut, flow, store, own, side=16), "tiled")
    _same(tiled, plain, ("burst_id", "Y", "X", "ch"), "num", "den", least=3 * 64 * 64 * 2)
    rows = [{(r.burst_id, r.Y, r.X): (r.r16, r.g16, r.b16) for r in encode.encode_16(encode.rgb(merge.normalised(a, c)), c).collect()} for a in (plain, tiled)]
    assert len(rows[0]) == 3 * 64 * 64 and all(abs(a - b) <= 1 for k in rows[0] for a, b in zip(rows[0][k], rows[1][k]))
    # a frame whose robustness is lost is as if it had never come
    lost = lambda df, name: store(df.where("not (burst_id = 2 and frame_idx = 1)") if name == "rob" else df, name)
    without = px.where("not (burst_id = 2 and frame_idx = 1)")
    want = super_resolve.merged(without, c, lut, flow.where("not (burst_id = 2 and frame_idx = 1)"), store, own, side=16)
    _same(super_resolve.merged(px, c, lut, flow, lost, own, side=16), want, ("burst_id", "Y", "X", "ch"), "num", "den", least=20000)


def test_settings_of_each_burst_in_tile_form(spark, tmp_path):
    """Two cameras in one plan give what each gives alone with its own parameters."""
    store = _store(tmp_path)
    px = store(_bursts(spark).where("burst_id < 3"), "px")
    flow = store(registry._zero_flow(px, 8).withColumn("dx", F.lit(0.4)), "flow")
    own = {1: P.Config(r_t=0.05, white_balance=(2.0, 1.0, 1.5), k_detail=0.5, denoise_accumulated=True, denoise_radius=1), 2: P.Config(alpha=1e-3, cfa=(1, 0, 2, 3), r_s2=3.0, k_stretch=2.0)}
    names = [*P.PER_BURST, "white_balance", "cfa"]
    config = spark.createDataFrame([(b, *[(float(v) if not isinstance(v, tuple) else [float(x) for x in v]) for v in (getattr(c, n) for n in names)]) for b, c in own.items()], ["burst_id", *names])
    lut, parts = registry._lut(spark), None
    for b, c in own.items():
        one = store(super_resolve.merged(px.where(F.col("burst_id") == b), c, lut, flow.where(F.col("burst_id") == b), store), "one")
        parts = one if parts is None else parts.unionByName(one)
    got = super_resolve.merged(px, P.Config(), lut, flow, store, store(config, "config"), side=16)
    _same(got, parts, ("burst_id", "Y", "X", "ch"), "num", "den", least=12000)


def test_tile_form_equals_pixel_form(spark):
    """A frame of several blocks, uneven at its ends, started far off, refined in several turns: flow and cost agree, and tiles
    that refinement leads away are fetched again."""
    wave = lambda dx, dy: [[math.sin((x + dx) * 0.21) + math.cos((y + dy) * 0.17) + 0.3 * math.sin((x + dx) * (y + dy) * 0.01) for x in range(44)] for y in range(36)]
    ref, moving = frame(spark, wave(0, 0)), frame(spark, wave(2.4, -1.3), idx=1)
    grid = match.tiles_of(spark.createDataFrame([(1, 1, 36, 44)], "burst_id long, frame_idx int, h int, w int"), 8)
    start = grid.withColumns({"dx": (F.col("tx") % 3).cast("double") * 3, "dy": -F.col("ty").cast("double")})
    for metric in ("L1", "L2"):
        found = match.block_match(ref, moving, start, 8, 2, metric)
        want = {(r.ty, r.tx): r for r in match.refine(ref, moving, found.drop("cost"), 8, 3).collect()}
        cost = {(r.ty, r.tx): r.cost for r in found.collect()}
        got = tiles.match_and_refine(tiles.stored(ref, 16), tiles.stored(moving, 16), start, 8, 2, metric, 3, side=16, block=2).collect()
        assert len(got) == len(want) == 20
        for r in got:
            w = want[r.ty, r.tx]
            assert (r.dx, r.dy, r.cost) == pytest.approx((w.dx, w.dy, cost[r.ty, r.tx]), abs=1e-5)


def _wavy(spark):
    """Three frames of uneven size in tiles, with edges, and a flow of fractions, some of it far beyond the frame."""
    wave = lambda d, e: [[0.5 + 0.2 * math.sin((x + d) * 0.41) + 0.2 * math.cos((y + e) * 0.37) + (0.1 if (x // 5 + y // 7) % 2 else 0) for x in range(44)] for y in range(36)]
    px = frame(spark, wave(0, 0)).unionByName(frame(spark, wave(0.6, -1.2), idx=1)).unionByName(frame(spark, wave(-2.5, 0.3), idx=2))
    grid = match.tiles_of(spark.createDataFrame([(1, f, 36, 44) for f in (1, 2)], "burst_id long, frame_idx int, h int, w int"), 8)
    far = F.when((F.col("tx") == 2) & (F.col("ty") == 1), 25.4).otherwise(0.0)
    flow = grid.withColumns({"dx": F.col("tx") * 0.37 - 1.1 * F.col("frame_idx") + far, "dy": F.col("ty") * -0.45 + 0.8 * F.col("frame_idx")})
    return px, flow


def _store(path):
    """Writes what it is given and reads it back, so that nothing is worked out twice."""
    count = iter(range(1000))
    return lambda df, name: registry.frames.write_stage(df, f"file://{path}/{name}-{next(count)}")


def _same(got, want, key, *values, least=1):
    a, b = ({tuple(r[k] for k in key): [r[v] for v in values] for r in df.collect()} for df in (got, want))
    assert set(a) == set(b) and len(a) >= least
    for k, v in a.items():
        for x, y in zip(v, b[k]):
            assert x == pytest.approx(y, rel=1e-6, abs=1e-6, nan_ok=True), k


@pytest.mark.parametrize("c", [P.Config(), P.Config(hard_selection=True, cfa=(1, 0, 2, 3)), P.Config(bayer=False)], ids=["steered", "hard", "mono"])
def test_merge_and_robustness_in_tile_form(spark, c, tmp_path):
    store, key = _store(tmp_path), ("burst_id", "frame_idx", "y", "x")
    px, flow = (store(df.coalesce(2), "given") for df in _wavy(spark))
    raw = store(tiles.stored(px, 16), "raw")
    cov, cov_tiles = store(stencil.kernel_field(px, c), "cov"), store(tile_merge.kernel_tiles(raw, c, 16), "cov")
    _same(halo.samples(cov_tiles, "xx", "xy", "yy"), cov, key, "xx", "xy", "yy", least=300)
    rob = store(robust.robustness(px, robust.reference_stats(px, c), flow, registry._lut(spark), 8, c), "rob")
    rob_tiles = store(tile_merge.robustness(raw, flow, registry._lut(spark), 8, c, 16, store), "rob")
    _same(halo.samples(rob_tiles, "v"), rob, key, "v", least=3000)
    acc, acc_tiles = store(robust.accumulated(rob), "acc"), store(tile_merge.accumulated(rob_tiles), "acc")
    _same(halo.samples(acc_tiles, "v"), acc, ("burst_id", "y", "x"), "v", least=1500)
    for denoise in (False, True):
        c.denoise_accumulated = denoise
        want = merge.accumulate(merge.merge_comparison(px, flow, rob, cov, 8, c), merge.merge_reference(px, cov, acc if denoise else None, c))
        got = tile_merge.sums(tile_merge.merge(raw, flow, rob_tiles, cov_tiles, 8, c, 16, acc_tiles if denoise else None))
        _same(got, want, ("burst_id", "Y", "X", "ch"), "num", "den", least=6000)


def test_chains_of_any_size_in_tile_form(spark):
    import numpy as np

    v = np.random.default_rng(4).normal(size=(37, 45))
    v[3, 4] = np.nan
    px, key = frame(spark, v), ("burst_id", "frame_idx", "y", "x")
    good = frame(spark, np.nan_to_num(v))
    _same(halo.samples(halo.chain(tiles.stored(px, 16), [halo.local_min()], 16), "v"), stencil.local_min(px), key, "v", least=1600)
    _same(halo.samples(halo.chain(tiles.stored(good, 16), [halo.blur(1.3)], 16), "v"), stencil.blur(good, 1.3), key, "v", least=1600)
    _same(halo.samples(halo.chain(tiles.stored(good, 32), [halo.downsample(2), halo.downsample(2)], 32), "v"), stencil.downsample(stencil.downsample(good, 2), 2), key, "v", least=1)
    _same(halo.samples(halo.chain(tiles.stored(good, 16), [halo.box_grey(), halo.gradients(), halo.structure_tensor()], 16), "xx", "xy", "yy"), stencil.structure_tensor(stencil.gradients(stencil.box_grey(good))), key, "xx", "xy", "yy", least=390)
    small = frame(spark, np.ones((5, 6)))
    _same(halo.samples(halo.chain(tiles.stored(small, 16), [halo.downsample(4)], 16), "v"), stencil.downsample(small, 4), key, "v", least=30)
    with pytest.raises(ValueError):
        halo.chain(tiles.stored(good, 4), [halo.downsample(4)], 4)


def test_stored_rows_are_checked_by_their_ledger(spark, tmp_path):
    import glob
    import os

    px = spark.range(5000).select((F.col("id") % 3).alias("burst_id"), F.floor(F.col("id") / 3 / 40).cast("int").alias("Y"), (F.floor(F.col("id") / 3) % 40).cast("int").alias("X"), (F.col("id") % 77).cast("int").alias("r16")).repartition(7)
    path = f"file://{tmp_path}/rows"
    back = encode.write_rows(px, path)
    assert [(r.burst_id, r.Y, r.X) for r in back.orderBy("place").collect()] == sorted((r.burst_id, r.Y, r.X) for r in px.collect())
    assert encode.read_rows(spark, path, px.schema).count() == 5000
    os.remove(glob.glob(f"{tmp_path}/rows/rows/*.parquet")[0])
    with pytest.raises(ValueError):
        encode.read_rows(spark, path, px.schema)
    none = encode.write_rows(px.where("false"), f"file://{tmp_path}/none")
    assert none.count() == 0
