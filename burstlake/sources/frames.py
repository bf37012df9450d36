"""Frame tables: manifest, metadata, stage tables and their retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.crop import crop_to_reference


def manifest(frames: DataFrame) -> DataFrame:
    """burst_id, frame_idx, capture_ts, path: frames in order of arrival, the first is the reference."""
    order = Window.partitionBy("burst_id").orderBy("capture_ts", "path")
    return frames.select("burst_id", (F.row_number().over(order) - 1).cast("int").alias("frame_idx"), "capture_ts", "path")


def scan(spark: SparkSession, path: str, burst_id: int | None = None, frame_idx: int | None = None) -> DataFrame:
    """Stored samples of all, of one burst or of one frame; the filters reach the scan."""
    px = spark.read.parquet(path)
    px = px if burst_id is None else px.where(F.col("burst_id") == burst_id)
    return px if frame_idx is None else px.where(F.col("frame_idx") == frame_idx)


def burst_scan(listed: DataFrame, samples: DataFrame) -> DataFrame:
    """burst_id, frame_idx, y, x, v of the listed(burst_id, frame_idx, path) frames that have samples(path, y, x, v).

    Frames that could not be read have none and are passed over: the others move up, so the first readable one is the
    reference, and all are cropped to its even size."""
    readable = samples.select("path").distinct()
    order = Window.partitionBy("burst_id").orderBy("frame_idx")
    kept = listed.join(readable, "path", "left_semi").withColumn("frame_idx", (F.row_number().over(order) - 1).cast("int"))
    return crop_to_reference(kept.select("burst_id", "frame_idx", "path").join(samples, "path").select("burst_id", "frame_idx", "y", "x", "v"))


def reference_metadata(px: DataFrame) -> DataFrame:
    """h, w, black and white of frame 0 for every frame of its burst."""
    meta = px.where("frame_idx = 0").groupBy("burst_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.min("v").alias("black"), F.max("v").alias("white"))
    return px.select("burst_id", "frame_idx").distinct().join(meta, "burst_id")


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Materialise a stage table once under a new path and read it back, empty or not, with its own schema. Stages that are
    written burst by burst, replaced, purged or rebuilt are kept by sources.stages.StageStore."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession, path: str, into: str, now: str, hours: int = 24) -> DataFrame:
    """Rewrite the stage table at path without stale bursts, and read it back; readers move to `into`, the old one can go."""
    return write_stage(retained(spark.read.parquet(path), now, hours), into)


def retained(stages: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Stage rows of bursts that are not stale: created_at within the last hours."""
    return stages.where(F.col("created_at") >= F.to_timestamp(F.lit(now)) - F.expr(f"interval {int(hours)} hours"))
