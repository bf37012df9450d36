"""From accumulated sums to stored samples, previews and header rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import photometry as P


def rgb(values: DataFrame, mono: bool = False) -> DataFrame:
    """burst_id, Y, X, r, g, b from one row for each channel; a channel without samples is 0, mono fills all three."""
    at = lambda n: F.coalesce(F.max(F.when(F.col("ch") == (0 if mono else n), F.col("v"))), F.lit(0.0))
    return values.groupBy("burst_id", "Y", "X").agg(at(0).alias("r"), at(1).alias("g"), at(2).alias("b"))


def colour(px: DataFrame, c: P.Config, balance: bool = True, matrix: bool = True) -> DataFrame:
    """r, g, b balanced and through the camera matrix."""
    v = [F.col(n) * F.lit(float(w) if balance else 1.0) for n, w in zip("rgb", c.white_balance)]
    m = c.matrix if matrix else (1, 0, 0, 0, 1, 0, 0, 0, 1)
    return px.withColumns({n: sum((v[k] * F.lit(float(m[3 * i + k])) for k in range(3)), F.lit(0.0)) for i, n in enumerate("rgb")})


def encode_16(px: DataFrame, c: P.Config) -> DataFrame:
    """burst_id, Y, X, r16, g16, b16: baked to the display curve where asked, else linear."""
    if c.bake_srgb:
        px = colour(px, c).withColumns({n: P.srgb(n) for n in "rgb"})
    return px.select("burst_id", "Y", "X", *[P.to_16_bits(n).alias(f"{n}16") for n in "rgb"])


def preview(px: DataFrame, side: int, c: P.Config) -> DataFrame:
    """burst_id, py, px, r8, g8, b8: at most `side` a side, always on the display curve; of the pixels that meet in a cell
    the last in raster order counts."""
    size = px.groupBy("burst_id").agg((F.max("Y") + 1).alias("H"), (F.max("X") + 1).alias("W"))
    shown = colour(px, c).withColumns({n: P.srgb(n) for n in "rgb"}).join(size, "burst_id")
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest("H", "W"))
    cell = lambda a, n: F.least(F.floor(F.col(a) * scale), F.greatest(F.floor(F.col(n) * scale), F.lit(1)) - 1).cast("int")
    shown = shown.withColumns({"py": cell("Y", "H"), "px": cell("X", "W")})
    last = shown.groupBy("burst_id", "py", "px").agg(F.max_by(F.struct("r", "g", "b"), F.struct("Y", "X")).alias("s"))
    return last.select("burst_id", "py", "px", *[P.to_8_bits(f"s.{n}", half_even=False).alias(f"{n}8") for n in "rgb"])


def header_rows(sizes: DataFrame, c: P.Config, make: str = "burstlake", model: str = "merged") -> DataFrame:
    """burst_id, tag, name, text, values: header rows for sizes(burst_id, H, W), sorted by tag.

    make, model and orientation come from columns of these names where sizes has them; an empty or null name becomes the
    given one, an orientation outside 1 to 8 has no row. Linear output has an identity matrix and its illuminant. text is null
    for numbers and values are null for text; offsets in a file are not rows of a table, so tag 273 has 0."""
    known = set(sizes.columns)
    name = lambda n, other: F.coalesce(F.when(F.col(n) != "", F.col(n)), F.lit(other)) if n in known else F.lit(other)
    none, no_text = F.lit(None).cast("array<double>"), F.lit(None).cast("string")
    row = lambda tag, label, *v: F.struct(F.lit(tag).alias("tag"), F.lit(label).alias("name"), no_text.alias("text"), F.array(*[(F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("double") for x in v]).alias("values"))
    text = lambda tag, label, v: F.struct(F.lit(tag).alias("tag"), F.lit(label).alias("name"), v.alias("text"), none.alias("values"))
    # Tag numbers of the image file format and what this kind of file has in them.
    rows = [
        row(254, "subfile", 0),
        row(256, "width", "W"),
        row(257, "height", "H"),
        row(258, "bits", 16, 16, 16),
        row(259, "compression", 1),
        row(262, "photometric", 2 if c.bake_srgb else 34892),
        text(271, "make", name("make", make)),
        text(272, "model", name("model", model)),
        row(273, "strip_offset", 0),
        row(277, "samples", 3),
        row(278, "rows_per_strip", "H"),
        row(279, "strip_bytes", F.col("W").cast("long") * F.col("H") * 6),
        row(284, "planar", 1),
        row(339, "sample_format", 1, 1, 1),
        row(50706, "version", 1, 4, 0, 0),
        row(50707, "backward_version", 1, 3, 0, 0),
        text(50708, "unique_model", name("model", model)),
        row(50714, "black", 0, 0, 0),
        row(50717, "white", 65535, 65535, 65535),
        row(50719, "crop_origin", 0, 0),
        row(50720, "crop_size", "W", "H"),
        row(50829, "active_area", 0, 0, "H", "W"),
    ]
    if "orientation" in known:
        rows.append(F.when(F.col("orientation").between(1, 8), row(274, "orientation", "orientation")))
    if not c.bake_srgb:
        rows += [row(50721, "matrix", 1, 0, 0, 0, 1, 0, 0, 0, 1), row(50778, "illuminant", 21)]
    return sizes.select("burst_id", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("burst_id", "r.tag", "r.name", "r.text", "r.values").orderBy("burst_id", "tag")


def export_linear(rgb_: DataFrame, path: str) -> DataFrame:
    """r, g, b in 0..1 stored as 16-bit rows without balance or curve, and read back."""
    return write_rows(rgb_.select("burst_id", "Y", "X", *[P.to_16_bits(n).alias(f"{n}16") for n in "rgb"]), path).drop("place")


def write_preview(px8: DataFrame, path: str) -> DataFrame:
    """Store previews by burst in raster order and read them back."""
    px8.repartition("burst_id").sortWithinPartitions("burst_id", "py", "px").write.mode("overwrite").parquet(path)
    return px8.sparkSession.read.parquet(path)


LEDGER = "file string, first struct<burst_id:bigint,Y:int,X:int>, last struct<burst_id:bigint,Y:int,X:int>, rows bigint, digest bigint"


def _files(stored: DataFrame) -> DataFrame:
    """What the ledger says of each file: its first and last place in raster order, its rows and a digest of them."""
    place = F.struct(F.col("burst_id").cast("long").alias("burst_id"), F.col("Y").cast("int").alias("Y"), F.col("X").cast("int").alias("X"))
    return stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*stored.columns)).alias("digest"))


def write_rows(px16: DataFrame, path: str) -> DataFrame:
    """Store rows in output order, with a ledger of the files beside them, and give them as read_rows does."""
    ordered = px16.repartitionByRange("burst_id", "Y").sortWithinPartitions("burst_id", "Y", "X")
    ordered.write.mode("overwrite").parquet(f"{path}/rows")
    back = px16.sparkSession.read.schema(px16.schema).parquet(f"{path}/rows")
    _files(back).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger")
    return read_rows(px16.sparkSession, path, px16.schema)


def read_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stored rows with `place`, (first place of the file, row of the file), by which they are in output order.

    Raises where a file is missing, changed or not known to the ledger, or where files overlap."""
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    ledger = spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    now = _files(stored).withColumnsRenamed({n: f"now_{n}" for n in ("first", "last", "rows", "digest")})
    met = ledger.join(now, "file", "full")
    wrong = met.where(~F.coalesce((F.col("rows") == F.col("now_rows")) & (F.col("digest") == F.col("now_digest")) & (F.col("first") == F.col("now_first")) & (F.col("last") == F.col("now_last")), F.lit(False)))
    bad = [r["file"] for r in wrong.select("file").take(5)]
    if bad:
        raise ValueError(f"stored rows differ from their ledger: {bad}")
    before = Window.partitionBy(F.lit(0)).orderBy("first")  # a row for each file
    if ledger.withColumn("ends", F.lag("last").over(before)).where(F.col("ends") >= F.col("first")).take(1):
        raise ValueError("files of stored rows overlap")
    placed = stored.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return placed.join(ledger.select("file", "first"), "file").withColumn("place", F.struct("first", "row")).drop("file", "first", "row")


def completeness(rows: DataFrame) -> DataFrame:
    """burst_id, rows, expected, complete: whether all rows of each burst are there."""
    return rows.groupBy("burst_id").agg(F.countDistinct("Y").alias("rows"), (F.max("Y") + 1).alias("expected")).withColumn("complete", F.col("rows") == F.col("expected"))
