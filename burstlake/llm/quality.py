"""Quality by compression: two zstandard dictionaries, one of good and one of bad labelled text, compress every text, and the
difference of the two sizes for each byte becomes a calibrated score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .calibrate import fit_logistic, known_labels, labelled_sample, logistic
from .common import crc_mod, cut

SIZE = 64 << 10  #: bytes of a dictionary
TEXT_BYTES = 16 << 20  #: of a class's texts, so many bytes at most go into its dictionary
LEVEL = 3


def build_dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on the texts; of too few or too uniform texts, their last bytes as they are."""
    try:
        return zstandard.train_dictionary(SIZE, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[-SIZE:]


def _sized(good: bytes, bad: bytes):
    def run(batches):
        press = []
        for data in (good, bad):
            kept = zstandard.ZstdCompressionDict(data)
            kept.precompute_compress(level=LEVEL)
            press.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_dict_id=False))
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                data = (t or "").encode("utf-8", "surrogatepass")
                rows.append((len(data), *(len(p.compress(data)) for p in press)))
            n, g, w = np.array(rows, np.float64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(x) for x in ((w - g) / (n + 1), np.minimum(g, w) / (n + 1), np.log1p(n), (w - g) / np.maximum(np.maximum(g, w), 1))], ["doc_id", "difference", "ratio", "log_bytes", "relative"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, dictionary_rows: int = 3000, fit_rows: int = 50_000) -> DataFrame:
    """doc_id, held_out, score, predicted, difference, ratio: one row per row of docs(doc_id, text, ...).

    Learns from the labelled rows whose crc32(doc_id) mod `folds` is not `held`. A hash parts these in two halves: each
    dictionary is built from at most `dictionary_rows` whole texts and TEXT_BYTES bytes of its class in one half (null texts and
    those longer than TEXT_BYTES are passed over), the
    calibration takes at most `fit_rows` rows of the other; where that lacks a class, the score is constant. Every text is compressed whole. Null texts are empty and get a score like any other; a null doc_id counts as
    the empty text in the remainder; repeated rows are scored each; columns other than doc_id and text are never read; an
    empty table gives no rows, and labels of one class alone a constant score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = cut(known_labels(labels, "quality").where(crc_mod(F.col("doc_id"), folds) != held), "labels")
    known = known.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)))
    # the ids are chosen by their number and their texts' sizes before these are read, so what is joined is bounded
    chosen = [known.where((F.col("y") == y) & (F.col("half") == 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(dictionary_rows) for y in (1, 0)]
    chosen = F.broadcast(cut(chosen[0].unionByName(chosen[1]).select("doc_id", "y"), "chosen"))
    sizes = docs.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.max(F.octet_length("text")).alias("bytes"))
    sizes = sizes.where(F.col("bytes") <= TEXT_BYTES)  # a text that can't fit alone, or none at all, takes no other's place
    upto = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = F.broadcast(cut(sizes.withColumn("upto", F.sum("bytes").over(upto)).where(F.col("upto") <= TEXT_BYTES).select("doc_id", "y"), "chosen"))
    texts = docs.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text")).select("y", "text").toPandas().sort_values(["y", "text"])
    good, bad = ([t.encode("utf-8", "surrogatepass") for t in texts["text"][texts["y"] == y]] for y in (1, 0))
    sized = docs.mapInArrow(_sized(build_dictionary(good), build_dictionary(bad)), "doc_id long, difference double, ratio double, log_bytes double, relative double")
    sized = cut(sized, "sized")
    columns = ["difference", "ratio", "log_bytes", "relative"]
    model = fit_logistic(*labelled_sample(sized, known.where("half = 1").select("doc_id", "y"), columns, fit_rows))
    out = sized.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), logistic(model, columns).alias("score"), "difference", "ratio")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference", "ratio")
