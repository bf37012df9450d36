"""Scalar functions on samples as Column expressions: nothing leaves the JVM."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Config:
    """Parameters of a burst; the defaults are fixed values of the method."""

    scale: float = 2.0
    bayer: bool = True
    alpha: float = 1.80710882e-4
    beta: float = 3.1937599182e-6
    factors: tuple = (1, 2, 4, 4)
    tile_sizes: tuple = (16, 16, 16, 8)
    radii: tuple = (1, 4, 4, 4)
    metrics: tuple = ("L1", "L2", "L2", "L2")
    refine_turns: int = 3
    robust: bool = True
    r_t: float = 0.15
    r_s1: float = 0.25
    r_s2: float = 24.0
    r_Mt: float = 0.8
    denoise_accumulated: bool = False
    denoise_radius: int = 2
    denoise_power: float = 8.0
    denoise_frames: float = 2.0
    steerable: bool = True
    hard_selection: bool = False
    k_detail: float = 0.30
    k_denoise: float = 3.5
    D_th: float = 0.005
    D_tr: float = 0.014
    k_stretch: float = 6.0
    k_shrink: float = 2.0
    cfa: tuple = (0, 1, 1, 2)
    white_balance: tuple = (1.0, 1.0, 1.0)
    matrix: tuple = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    bake_srgb: bool = False
    snr_tuning: bool = True


# The tuning keys that override a default when they are given, and only these, with the parameter of each.
TUNABLE = {
    "r_t": "r_t",
    "r_s1": "r_s1",
    "r_s2": "r_s2",
    "r_Mt": "r_Mt",
    "k_detail": "k_detail",
    "k_denoise": "k_denoise",
    "k_stretch": "k_stretch",
    "snr_auto_tune": "snr_tuning",
    "accumulated_robustness_denoiser_enabled": "denoise_accumulated",
    "acc_rob_rad_max": "denoise_radius",
    "acc_rob_max_multiplier": "denoise_power",
    "acc_rob_max_frame_count": "denoise_frames",
}


def overridden(config: Config, given: dict) -> Config:
    """config with the known keys of given in place, each in the type of its default; others are ignored."""
    return replace(config, **{TUNABLE[k]: type(getattr(config, TUNABLE[k]))(v) for k, v in given.items() if k in TUNABLE and v is not None})


#: What may differ from burst to burst, in the order of a vector of parameters; white balance and mosaic follow these.
PER_BURST = ("alpha", "beta", "r_t", "r_s1", "r_s2", "r_Mt", "k_detail", "k_denoise", "k_stretch", "k_shrink", "D_th", "D_tr", "denoise_accumulated", "denoise_radius", "denoise_power", "denoise_frames")


def config_of(vector, config: Config) -> Config:
    """config with the parameters of a burst, from a vector of settings.parameters."""
    n = len(PER_BURST)
    own = {name: type(getattr(config, name))(v) for name, v in zip(PER_BURST, vector)}
    return replace(config, **own, white_balance=tuple(float(v) for v in vector[n : n + 3]), cfa=tuple(int(v) for v in vector[n + 3 : n + 7]))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clamp(v, low=0.0, high=1.0) -> Column:
    """NaN passes through, as it compares false with both ends."""
    v = _c(v)
    return F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))))


def normalise(raw, black, white) -> Column:
    """Black and white level to 0..1; a white level of nothing means 16 bits."""
    white = F.when(_c(white) <= 0, F.lit(65535.0)).otherwise(_c(white))
    return clamp((_c(raw) - _c(black)) / F.greatest(F.lit(1.0), white - _c(black)))


def smoothstep(low: float, high: float, x) -> Column:
    """0 to 1 with flat ends; equal or reversed edges make a step."""
    if high <= low:
        return F.when(_c(x) >= low, 1.0).otherwise(0.0)
    t = clamp((_c(x) - low) / (high - low))
    return t * t * (3 - 2 * t)


def stabilise(v, alpha: float, beta: float) -> Column:
    """Variance-stabilising transform of signal-dependent noise."""
    return F.lit(2.0 / alpha) * F.sqrt(F.greatest(F.lit(0.0), _c(v) * F.lit(alpha) + F.lit(0.375 * alpha * alpha + beta)))


def srgb(v) -> Column:
    """The standard transfer curve of linear light, clamped first."""
    v = clamp(v)
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def to_16_bits(v) -> Column:
    return F.floor(clamp(v) * 65535 + 0.5).cast("int")


def to_8_bits(v, half_even: bool = True) -> Column:
    v = clamp(v) * 255
    return (F.rint(v) if half_even else F.floor(v + 0.5)).cast("int")


def spline_weight(a) -> Column:
    """Dodgson's quadratic: 1 at the centre, nothing beyond 1.5."""
    a = F.abs(_c(a))
    return F.when(a <= 0.5, 1 - 2 * a * a).when(a <= 1.5, a * a - 2.5 * a + 1.5).otherwise(0.0)


def toward_zero(v) -> Column:
    v = _c(v)
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("double")


def half_away(v) -> Column:
    v = _c(v)
    return F.when(v >= 0, F.floor(v + 0.5)).otherwise(F.ceil(v - 0.5)).cast("double")


def between_points(x, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Linear between two points, constant outside; y0 where they coincide."""
    if x1 <= x0:
        return F.lit(float(y0))
    return clamp((_c(x) - x0) / (x1 - x0)) * (y1 - y0) + y0


def eigen(xx, xy, yy) -> Column:
    """Struct l1, l2, e1x, e1y, e2x, e2y of a symmetric matrix; l1 has the larger modulus; isotropic: the axes."""
    xx, xy, yy = _c(xx), _c(xy), _c(yy)
    s = F.sqrt(F.greatest((xx + yy) * (xx + yy) - 4 * (xx * yy - xy * xy), F.lit(0.0)))
    p, q = (xx + yy + s) / 2, (xx + yy - s) / 2
    l1, l2 = F.when(F.abs(p) >= F.abs(q), p).otherwise(q), F.when(F.abs(p) >= F.abs(q), q).otherwise(p)
    a, b = xx + xy - l2, xy + yy - l2
    n = F.sqrt(a * a + b * b)
    same = (xy == 0) & (xx == yy)
    u, v = F.try_divide(a, n), F.try_divide(b, n)
    pick = lambda iso, no_a, no_b, usual: F.when(same, F.lit(float(iso))).when(a == 0, F.lit(float(no_a))).when(b == 0, F.lit(float(no_b))).otherwise(usual)
    return F.struct(
        l1.alias("l1"), l2.alias("l2"),
        pick(1, 0, 1, u).alias("e1x"), pick(0, 1, 0, v).alias("e1y"),
        pick(0, 1, 0, F.when(u < 0, v).otherwise(-v)).alias("e2x"), pick(1, 0, 1, F.abs(u)).alias("e2y"),
    )


def inverse(xx, xy, yy, least: float = 1e-10) -> Column:
    """Struct ixx, ixy, iyy; the identity where the determinant is not above `least`."""
    xx, xy, yy = _c(xx), _c(xy), _c(yy)
    det = xx * yy - xy * xy
    good = F.abs(det) > least
    over = lambda v, other: F.when(good, F.try_divide(v, det)).otherwise(F.lit(float(other)))
    return F.struct(over(yy, 1).alias("ixx"), over(-xy, 0).alias("ixy"), over(xx, 1).alias("iyy"))


def channel_of(y, x, cfa=(0, 1, 1, 2)) -> Column:
    """Colour of a sample by its parity; the fourth colour counts as green."""
    table = F.array(*[F.lit(int(1 if c == 3 else c)) for c in cfa])
    return F.element_at(table, (F.pmod(_c(y), F.lit(2)) * 2 + F.pmod(_c(x), F.lit(2)) + 1).cast("int"))


def orientation_code(flip) -> Column:
    return F.when(_c(flip) == 3, 3).when(_c(flip) == 5, 8).when(_c(flip) == 6, 6).otherwise(1)


def kernel_strengths(l1, l2, c: Config) -> Column:
    """Struct k1, k2: kernel widths across and along an edge by anisotropy and detail."""
    if not c.steerable:
        return F.struct(F.lit(c.k_detail).alias("k1"), F.lit(c.k_detail).alias("k2"))
    l1, l2 = _c(l1), _c(l2)
    total = F.when(l1 + l2 == 0, F.lit(1e-12)).otherwise(l1 + l2)
    a = 1 + F.sqrt(F.greatest((l1 - l2) / total, F.lit(0.0)))
    d = clamp(1 - F.sqrt(F.greatest(l1, F.lit(0.0))) / c.D_tr + c.D_th)
    if c.hard_selection:
        one, two = F.when(a > 1.95, F.lit(1 / c.k_shrink)).otherwise(1.0), F.when(a > 1.95, F.lit(c.k_stretch)).otherwise(1.0)
    else:
        one, two = 1 + a / 2 * (1 / c.k_shrink - 1), 1 + a / 2 * (c.k_stretch - 1)
    return F.struct((((1 - d) * one + d * c.k_denoise) * c.k_detail).alias("k1"), (((1 - d) * two + d * c.k_denoise) * c.k_detail).alias("k2"))


def linear_noise(alpha, beta, t: float = 3.0) -> tuple[Column, Column]:
    """Brightness between which clipping, t deviations away, leaves the noise linear."""
    a, b, q = _c(alpha), _c(beta), t * t
    low = q / 2 * (a + F.sqrt(q * a * a + 4 * b))
    inner = F.greatest((2 + q * a) * (2 + q * a) - 4 * (1 + q * b), F.lit(0.0))
    return low, (2 + q * a - F.sqrt(inner)) / 2


def gaussian(radius: int, sigma: float) -> list[float]:
    import math

    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def ratio(num, den, least: float = 0.0) -> Column:
    """num / den where den is above `least`, else 0."""
    return F.when(_c(den) > least, F.try_divide(_c(num), _c(den))).otherwise(0.0)


def noise_terms(d, var, sigma_t, d_t) -> Column:
    """Struct d2, s2: the difference shrunk by the expected one, and the larger of measured and expected variance."""
    p = _c(d) * _c(d)
    shrink = F.try_divide(p, p + _c(d_t) * _c(d_t))
    return F.struct((p * shrink * shrink).alias("d2"), F.greatest(_c(var), _c(sigma_t) * _c(sigma_t)).alias("s2"))


def snr(mean, alpha: float, beta: float) -> Column:
    sigma = F.sqrt(_c(mean) * alpha + beta)
    return F.when(sigma <= 1e-8, F.lit(15.0)).otherwise(clamp(F.try_divide(_c(mean), sigma), 6, 30))


def tuned_by_snr(s) -> list[Column]:
    """Kernel parameters and tile size that follow the signal-to-noise ratio."""
    s = _c(s)
    line = lambda y0, y1: between_points(s, 6, 30, y0, y1)
    tile = F.when(s <= 14, 64).when(s <= 22, 32).otherwise(16)
    return [line(0.30, 0.29).alias("k_detail"), line(5.0, 3.0).alias("k_denoise"), line(0.81, 0.71).alias("D_th"), line(1.24, 1.0).alias("D_tr"), tile.alias("tile"), F.greatest(F.lit(4), F.floor(tile / 2).cast("int")).alias("coarse_tile")]


def denoise_choice(accumulated, frames: float, many, few=1) -> Column:
    return F.when(_c(accumulated) <= frames, F.lit(many)).otherwise(F.lit(few))


def six(x) -> Column:
    """Six decimals by plain arithmetic, the same in any engine; not-a-number and infinity become null."""
    x = _c(x)
    return F.when(F.isnan(x) | (F.abs(x) > 1e12), None).otherwise(F.floor(x * 1e6 + 0.5) / 1e6)
