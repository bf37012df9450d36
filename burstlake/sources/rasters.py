"""Raster views over the star-schema tables: bursts of frames as one row per sample (burst_id, frame_idx, y, x, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _dealt(table: DataFrame, key: str, value, frames: int, side: int) -> DataFrame:
    """Rows dealt to bursts of `frames` square frames by a dense key; only complete bursts stay."""
    area, id_ = side * side, F.col(key)
    px = table.select(
        F.floor(id_ / (area * frames)).cast("long").alias("burst_id"), F.floor(id_ / area % frames).cast("int").alias("frame_idx"),
        F.floor(id_ % area / side).cast("int").alias("y"), (id_ % side).cast("int").alias("x"), F.floor(value * 65535 + 0.5).cast("double").alias("v"),
    )
    full = px.groupBy("burst_id").count().where(F.col("count") == area * frames).select("burst_id")
    return px.join(full, "burst_id", "left_semi")


def events_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 frames of 8 x 8 from events."""
    return _dealt(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", F.least(F.col("value") / 600, F.lit(1.0)), 8, 8)


def orders_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 frames of 32 x 32 from orders."""
    return _dealt(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", F.col("o_totalprice").cast("double") / 500000, 4, 32)


def orders_strip_px(spark: SparkSession, sf_dir: str, side: int = 96, starts: tuple = (0, 5, 16)) -> DataFrame:
    """Square frames of one strip of order prices for each burst, frame i beginning starts[i] rows down; complete bursts only."""
    rows, key = side + max(starts), F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key, F.floor(F.col("o_totalprice").cast("double") / 500000 * 65535 + 0.5).cast("double").alias("v"))
    o = o.select(F.floor(key / (rows * side)).cast("long").alias("burst_id"), F.floor(key % (rows * side) / side).cast("int").alias("r"), (key % side).cast("int").alias("x"), "v")
    full = o.groupBy("burst_id").count().where(F.col("count") == rows * side).select("burst_id")
    px = o.join(full, "burst_id", "left_semi").select("*", F.posexplode(F.array(*map(F.lit, starts))).alias("frame_idx", "start"))
    return px.select("burst_id", "frame_idx", (F.col("r") - F.col("start")).alias("y"), "x", "v").where(F.col("y").between(0, side - 1))


def embeddings_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8 x 8 frame for each vector: the stored plane unpacked to samples."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return unpack_planes(e.select(F.col("label").cast("long").alias("burst_id"), F.col("vec_id").alias("frame_idx"), F.lit(8).alias("w"), F.col("embedding").alias("data")))


def unpack_planes(planes: DataFrame) -> DataFrame:
    """(burst_id, frame_idx, w, data) -> samples, row by row."""
    px = planes.select("burst_id", "frame_idx", "w", F.posexplode("data").alias("pos", "v"))
    return px.select("burst_id", "frame_idx", F.floor(F.col("pos") / F.col("w")).cast("int").alias("y"), (F.col("pos") % F.col("w")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def pack_planes(px: DataFrame, tile: int | None = None) -> DataFrame:
    """Samples -> one row for each frame, or for each tile of it: its place, size and data in row order."""
    cell = F.lit(0) if tile is None else None
    ty = cell if tile is None else F.floor(F.col("y") / tile).cast("int")
    tx = cell if tile is None else F.floor(F.col("x") / tile).cast("int")
    packed = px.withColumn("ty", ty).withColumn("tx", tx).groupBy("burst_id", "frame_idx", "ty", "tx").agg(
        F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"),
        F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("s"),
    )
    return packed.withColumn("data", F.transform("s", lambda s: s["v"])).drop("s")


def scene_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 frames of 32 x 32 of a smooth scene with edges for each supplier, frames after the first shifted by whole pixels."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("burst_id"))
    # a few bytes of keys become thousands of samples each, so they are dealt to all tasks first
    s = s.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "burst_id")
    moved = F.col("frame_idx") > 0
    s = s.select("burst_id", F.explode(F.array(*map(F.lit, range(4)))).alias("frame_idx"))
    s = s.withColumn("sy", F.when(moved, (F.col("burst_id") + F.col("frame_idx")) % 3 - 1).otherwise(0).cast("int"))
    s = s.withColumn("sx", F.when(moved, (3 * F.col("burst_id") + 2 * F.col("frame_idx")) % 3 - 1).otherwise(0).cast("int"))
    # samples differ by the shift alone, so each shift's are worked out once and sent to all tasks: 25 frames
    shift, at = F.floor(F.col("id") / 1024), F.col("id") % 1024
    grid = spark.range(25 * 1024).select((F.floor(shift / 5) - 3).cast("int").alias("sy"), (shift % 5 - 3).cast("int").alias("sx"), F.floor(at / 32).cast("int").alias("y"), (at % 32).cast("int").alias("x"))
    Y, X = F.col("y") + F.col("sy"), F.col("x") + F.col("sx")
    edge = F.when(F.floor(F.abs(X) * 0.25) % 2 == 0, 0.15).otherwise(-0.15)
    u = F.lit(0.5) + F.sin((Y + X) * 0.20) * 0.4 * F.cos((X - Y) * 0.13) + edge
    grid = grid.withColumn("v", F.floor(F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) * 65535 + 0.5).cast("double"))
    return s.join(F.broadcast(grid), ["sy", "sx"]).select("burst_id", "frame_idx", "y", "x", "v")


def unit(px: DataFrame) -> DataFrame:
    """Samples of 16 bits as 0..1."""
    return px.withColumn("v", F.col("v") / 65535)
