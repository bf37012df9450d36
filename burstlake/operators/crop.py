"""Filters that choose frames and parts of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stencil import BASE, with_dims


def even(v) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return v.bitwiseAND(F.lit(-2))


def centre_crop(px: DataFrame, factor: int) -> DataFrame:
    """The middle 1 / factor of each axis, even in size and origin, counted from 0 again."""
    if factor <= 1:
        return px
    d = with_dims(px).withColumns({"ch_": even(F.floor(F.col("h") / factor).cast("int")), "cw_": even(F.floor(F.col("w") / factor).cast("int"))})
    d = d.withColumns({"y0": even(F.floor((F.col("h") - F.col("ch_")) / 2).cast("int")), "x0": even(F.floor((F.col("w") - F.col("cw_")) / 2).cast("int"))})
    d = d.where("y >= y0 and y < y0 + ch_ and x >= x0 and x < x0 + cw_")
    return d.withColumns({"y": F.col("y") - F.col("y0"), "x": F.col("x") - F.col("x0")}).select(*px.columns)


def crop_to_reference(px: DataFrame) -> DataFrame:
    """Every frame to the even size of frame 0, from the top left."""
    ref = px.where("frame_idx = 0").groupBy("burst_id").agg(even(F.max("y") + 1).alias("h"), even(F.max("x") + 1).alias("w"))
    return px.join(ref, "burst_id").where("y < h and x < w").select(*px.columns)


def not_empty(meta: DataFrame) -> DataFrame:
    return meta.where("h > 0 and w > 0")


def valid_bursts(px: DataFrame, least: int = 2) -> DataFrame:
    """Samples of bursts with a reference and at least `least` frames."""
    n = px.select(*BASE).distinct().groupBy("burst_id").agg(F.count("*").alias("n"), F.min("frame_idx").alias("first")).where((F.col("n") >= least) & (F.col("first") == 0))
    return px.join(n.select("burst_id"), "burst_id", "left_semi")


def first_frames(px: DataFrame, wanted) -> DataFrame:
    """The first frames, their number held between 2 and 8."""
    return px.where(F.col("frame_idx") < F.least(F.greatest(F.lit(wanted), F.lit(2)), F.lit(8)))
