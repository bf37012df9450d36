"""Settings of each burst as a table: camera metadata, tuning overrides and noise, joined to samples by burst.

Bursts of different cameras go through one plan: what differs between them is a column, not a literal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import photometry as P


def gains(multipliers) -> Column:
    """White balance of red, green and blue from a camera's multipliers: over the green one where that is above 0."""
    m = F.col(multipliers) if isinstance(multipliers, str) else multipliers
    green = F.element_at(m, 2)
    return F.transform(F.slice(m, 1, 3), lambda v: F.when(green > 0, F.try_divide(v, green)).otherwise(F.lit(1.0)))


def crop_factor(lens, given=1) -> Column:
    """2 for the doubled wide lens, else what is given, at least 1."""
    lens, given = (F.col(x) if isinstance(x, str) else F.lit(x) if not isinstance(x, Column) else x for x in (lens, given))
    return F.greatest(F.lit(1), F.when(lens == F.lit("wide2x"), 2).otherwise(given)).cast("int")


def reference_settings(meta: DataFrame) -> DataFrame:
    """make, model, white_balance, cfa, orientation, matrix, crop of each burst, from its reference frame alone.

    meta(burst_id, frame_idx, make, model, multipliers, colours, flip, matrix, lens): a row for each frame. The fourth
    colour of the mosaic is green."""
    ref = meta.where("frame_idx = 0")
    return ref.select(
        "burst_id", "make", "model", gains("multipliers").alias("white_balance"), F.transform("colours", lambda c: F.when(c == 3, 1).otherwise(c)).alias("cfa"),
        P.orientation_code("flip").alias("orientation"), "matrix", crop_factor("lens").alias("crop"),
    )


def burst_config(settings: DataFrame, c: P.Config) -> DataFrame:
    """settings with a column for each parameter that can be tuned: what its map `overrides` gives under the tuning key, else the
    default of c. Switches are given as numbers, 0 for off.

    Unknown keys and null values do not count. Without a column `overrides` all are defaults. alpha and beta are the noise of
    the burst's camera where settings has them, else that of c; noise_low and noise_high are the brightness between which
    clipping leaves such noise linear."""
    given = "overrides" in settings.columns

    def value(key: str, name: str) -> Column:
        default = getattr(c, name)
        usual = F.lit(default if isinstance(default, bool) else float(default))
        if not given:
            return usual
        own = F.try_element_at("overrides", F.lit(key)).cast("double")
        return F.coalesce(own != 0 if isinstance(default, bool) else own, usual)

    noise = {n: F.lit(float(getattr(c, n))) for n in ("alpha", "beta") if n not in settings.columns}
    out = settings.withColumns({n: value(k, n) for k, n in P.TUNABLE.items()} | noise)
    low, high = P.linear_noise("alpha", "beta")
    return out.withColumns({"noise_low": low, "noise_high": high}).drop("overrides")


def tuned(config: DataFrame, means: DataFrame, c: P.Config) -> DataFrame:
    """config(burst_id, ..., of burst_config) after the tuning by signal-to-noise ratio, where it is switched on for the burst.

    means(burst_id, mean): the brightness of the reference. Tuning comes after the overrides, so it replaces an override of
    k_detail or k_denoise; it gives D_th, D_tr, tile and coarse_tile as well, which else are those of c."""
    at = config.join(means.select("burst_id", "mean"), "burst_id").withColumn("snr", P.snr("mean", F.col("alpha"), F.col("beta")))
    by_snr = at.withColumn("t", F.struct(*P.tuned_by_snr("snr")))
    usual = {"k_detail": F.col("k_detail"), "k_denoise": F.col("k_denoise"), "D_th": F.lit(c.D_th), "D_tr": F.lit(c.D_tr), "tile": F.lit(c.tile_sizes[0]), "coarse_tile": F.lit(c.tile_sizes[-1])}
    return by_snr.withColumns({n: F.when(F.col("snr_tuning"), F.col(f"t.{n}")).otherwise(v) for n, v in usual.items()}).drop("t")


def parameters(settings: DataFrame, c: P.Config) -> DataFrame:
    """burst_id, params: all that may differ from burst to burst as one vector, from the columns that settings has, else from c."""
    known = set(settings.columns)
    one = [F.col(n).cast("double") if n in known else F.lit(float(getattr(c, n))) for n in P.PER_BURST]
    many = [F.col(n).cast("array<double>") if n in known else F.array(*[F.lit(float(v)) for v in getattr(c, n)]) for n in ("white_balance", "cfa")]
    return settings.select("burst_id", F.concat(F.array(*one), *many).alias("params"))


def with_settings(px: DataFrame, settings: DataFrame, *names: str) -> DataFrame:
    """px with the named settings of its burst; samples of bursts without settings go. Spark broadcasts the table of bursts
    where it is small enough, else it shuffles by burst."""
    return px.join(settings.select("burst_id", *names), "burst_id")


def balanced(px: DataFrame, settings: DataFrame) -> DataFrame:
    """Samples (with ch) times the gain of their channel in their burst."""
    return with_settings(px, settings, "white_balance").withColumn("v", F.col("v") * F.element_at("white_balance", F.col("ch") + 1)).drop("white_balance")


def coloured(rgb: DataFrame, settings: DataFrame) -> DataFrame:
    """r, g, b balanced and through the matrix of their burst (nine numbers, row by row)."""
    return mixed(with_settings(rgb, settings, "white_balance", "matrix"))


def mixed(met: DataFrame) -> DataFrame:
    """r, g, b of rows that have the white_balance and the matrix of their burst."""
    v = [F.col(n) * F.element_at("white_balance", i + 1) for i, n in enumerate("rgb")]
    rgb = {n: sum((F.element_at("matrix", 3 * i + k + 1) * v[k] for k in range(3)), F.lit(0.0)) for i, n in enumerate("rgb")}
    return met.withColumns(rgb).drop("white_balance", "matrix")


def colour_samples(px: DataFrame, settings: DataFrame) -> DataFrame:
    """Samples with ch, their colour by the mosaic of their burst."""
    at = (F.pmod("y", F.lit(2)) * 2 + F.pmod("x", F.lit(2)) + 1).cast("int")
    return with_settings(px, settings, "cfa").withColumn("ch", F.element_at("cfa", at)).drop("cfa")


def complete_analysis(frames: DataFrame, *parts: DataFrame) -> DataFrame:
    """The frames(burst_id, frame_idx) of which every part has rows; the others are left out of the merge, and a burst
    without any comparison frame left is left out whole."""
    kept = frames.where("frame_idx > 0")
    for part in parts:
        kept = kept.join(part.select("burst_id", "frame_idx").distinct(), ["burst_id", "frame_idx"], "left_semi")
    ref = frames.where("frame_idx = 0").join(kept.select("burst_id").distinct(), "burst_id", "left_semi")
    return ref.unionByName(kept)
