"""Toxic passages as maximum-scoring segments of token log-odds.

Each token has a log-odds weight of toxic against clean text, smoothed by a Dirichlet prior in proportion to the whole
labelled corpus; a word is also seen through its prefixes, and its most certain view counts. One linear scan (Ruzzo and
Tompa) finds all disjoint segments of maximal score in a text. Scores of the best segments of clean texts follow an
extreme-value distribution in the length of the text; by its fit a segment's score becomes comparable between texts, and
what all segments of a text have in significant score is calibrated to a probability.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibrate import fit_logistic, known_labels, labelled_sample, logistic
from .common import as_long, crc_mod, cut, fresh, text_or_empty, words_of
from .minhash import shingle_set

PREFIXES = (4, 5, 6)
MARKS = b".,;:!?\"'()[]{}<>*#|"
DRIFT = 0.3  #: taken from every token, so that a text without toxic words has a falling score
CERTAIN = 3.0  #: a weight of fewer standard errors does not count
RAREST = 1 << 19  #: a feature makes up at least one in so many toxic tokens, so there are no more than this of each view


def views(word: bytes) -> list[int]:
    """Hashes of a word without marks around it and of its prefixes, each kind apart from the others."""
    bare = word.strip(MARKS)
    if not bare:
        return []
    out = [xxhash.xxh3_64_intdigest(bare, seed=1)]
    if len(bare) > 4:
        chars = bare.decode("utf-8", "replace")
        out += [xxhash.xxh3_64_intdigest(chars[:n].encode(), seed=n) for n in PREFIXES if len(chars) > n]
    return out


def _keyed(batches):
    """(text, y) with copies, the smallest hash of the text's word 3-shingles: near copies share it, other texts do not."""
    for b in batches:
        sets = (shingle_set(t, 3) for t in b.column(0).to_pylist())
        yield b.append_column("copies", pa.array([int(x[0]) - (1 << 63) if len(x) else None for x in sets], pa.int64()))


def _counted(batches):
    """(text, y, share) -> (feature, toxic, clean) summed over what the task has seen so far, in bounded portions."""
    seen: tuple[dict, dict] = ({}, {})

    def flush():
        total: dict[int, list[float]] = {}
        for y, counter in enumerate(seen):
            for word, n in counter.items():
                for v in views(word):
                    total.setdefault(v, [0.0, 0.0])[y] += n
            counter.clear()
        f = np.fromiter(total, np.uint64, len(total))
        n = np.array(list(total.values()), np.float64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(as_long(f)), pa.array(n[:, 1].copy()), pa.array(n[:, 0].copy())], ["feature", "toxic", "clean"])

    for b in batches:
        for t, y, share in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            held = seen[y]
            for word, n in Counter(words_of(t)).items():
                held[word] = held.get(word, 0.0) + n * share
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield flush()
    yield flush()


def training_shares(docs: DataFrame, known: DataFrame) -> DataFrame:
    """text, y, share: labelled documents, those with the same least shingle sharing one vote.

    A text with hundreds of near copies would otherwise make all its words look like marks of its label."""
    texts = cut(docs.join(known, "doc_id").select("text", "y").mapInArrow(_keyed, "text string, y int, copies long"), "labelled")
    sizes = cut(texts.groupBy("copies").agg(F.count("*").alias("n")).where("n > 1"), "copies")
    return texts.join(sizes, "copies", "left").select("text", "y", (1 / F.coalesce("n", F.lit(1))).alias("share"))


def fit_weights(texts: DataFrame, prior: float = 500.0, floor: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the features in texts(text, y, share) that are surely toxic.

    A weight of DRIFT or less can start no passage and a feature of fewer than one in RAREST toxic tokens is left out; since
    a word has one feature of each view, at most RAREST of each view remain, at any size of the corpus. Log-odds with an informative Dirichlet prior: a feature has `floor` counts and its share of all counts times `prior`."""
    counts = texts.mapInArrow(_counted, "feature long, toxic double, clean double").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    counts = cut(counts, "counts")
    total = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not total["t"] or not total["c"]:
        return np.empty(0, np.uint64), np.empty(0)
    n, m = float(total["t"]), float(total["c"])
    a = (F.col("t") + F.col("c")) * F.lit(prior / (n + m)) + floor
    delta = F.log((F.col("t") + a) / (n + prior)) - F.log((F.col("c") + a) / (m + prior))
    error = F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
    sure = F.when(delta > CERTAIN * error, F.round(delta - error, 6))
    # n adds the views of each token, so a share of the tokens is at most len(PREFIXES) + 1 times as large as one of n
    rows = counts.where(F.col("t") * RAREST >= n / (len(PREFIXES) + 1)).select("feature", sure.alias("w")).where(F.col("w") > DRIFT).toPandas()
    return rows["feature"].to_numpy(np.int64).view(np.uint64), rows["w"].to_numpy(np.float64)


class Weights(dict):
    """word -> its weight less DRIFT; forgets everything once it holds `most` words."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, most: int = 300_000):
        super().__init__()
        self.weights, self.most = dict(zip(features.tolist(), weights.tolist())), most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        value = max((self.weights.get(v, 0.0) for v in views(word)), default=0.0) - DRIFT
        if len(word) <= 40:
            self[word] = value
        return value


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments [start, end) of a score sequence, each with a positive sum, in linear time.

    They are disjoint; of segments with equal sums the shorter is taken, of two runs side by side that add up to no more than
    one of them both stay apart. No positive score gives none."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    # each held candidate: start, end, the running sum before it and after it, the last one held with a smaller sum before
    held: list[list] = []
    for i in up.tolist():
        start, end, low, high = i, i + 1, float(total[i]), float(total[i + 1])
        at = len(held) - 1
        while True:
            while at >= 0 and held[at][2] >= low:
                at = held[at][4]
            if at < 0 or held[at][3] >= high:
                held.append([start, end, low, high, at])
                break
            start, low = held[at][0], held[at][2]
            before = held[at][4]
            del held[at:]
            at = before
    return [(s, e, h - l) for s, e, l, h, _ in held]


def _scanned(features: np.ndarray, weights: np.ndarray):
    def run(batches):
        look = Weights(features, weights)
        for b in batches:
            words, best, sums = [], [], []
            for t in b.column(1).to_pylist():
                w = words_of(t)
                s = np.fromiter(map(look.__getitem__, w), np.float64, len(w))
                found = [x for _, _, x in segments(s)]
                words.append(len(w))
                best.append(max(found, default=0.0))
                sums.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(words, pa.int64()), pa.array(best, pa.float64()), pa.array(sums, pa.list_(pa.float64()))], ["doc_id", "fp", "n_words", "best", "sums"])

    return run


def extreme_values(n_words: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """(lambda, log K) by moments: a clean text of n words has its best score above s with chance 1 - exp(-K n e^(-lambda s))."""
    if len(best) < 10 or best.std() < 1e-6:
        return 1.0, 0.0
    rate = float(np.clip(np.pi / (6**0.5 * best.std()), 0.05, 5.0))
    return rate, float(rate * best.mean() - 0.5772156649 - np.log(np.maximum(n_words, 1)).mean())


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, fit_rows: int = 50_000) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, n_segments, best: one row per row of docs(doc_id, text, ...).

    Learns from the labelled rows whose crc32(doc_id) mod `folds` is not `held`: weights from all of them, the extreme-value
    fit and the calibration from at most `fit_rows`. Null, empty and unlabelled texts get a score like any other; a null
    doc_id counts as the empty text in the remainder; repeated rows are scored each; columns other than doc_id and text are
    never read; an empty table gives no rows, and labels of one class alone a constant score."""
    return _scores(docs, labels, folds, held, fit_rows).drop("fp")


def _scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, fit_rows: int = 50_000) -> DataFrame:
    """score_toxicity() with fp, the hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(text_or_empty()).alias("fp"))
    known = cut(known_labels(labels, "toxic").where(crc_mod(F.col("doc_id"), folds) != held), "labels")
    weights = fit_weights(training_shares(docs, known))
    scanned = cut(docs.mapInArrow(_scanned(*weights), "doc_id long, fp long, n_words long, best double, sums array<double>"), "scanned")

    n_best, y = labelled_sample(scanned, known, ["n_words", "best"], fit_rows)
    clean = n_best[y == 0]
    rate, log_k = extreme_values(clean[:, 0], clean[:, 1])
    # a segment counts with its normalised score; K n is the number of places where it could have come up by chance
    chance = F.lit(log_k) + F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    normal = F.transform("sums", lambda s: F.greatest(s * F.lit(rate) - chance, F.lit(0.0)))
    marked = scanned.withColumn("excess", F.aggregate(normal, F.lit(0.0), lambda a, x: a + x))
    marked = marked.withColumn("total", F.log1p(F.aggregate("sums", F.lit(0.0), lambda a, x: a + x))).withColumn("peak", F.log1p("best")).withColumn("log_words", F.log1p(F.col("n_words").cast("double"))).withColumn("excess", F.log1p("excess"))
    columns = ["peak", "total", "excess", "log_words"]
    model = fit_logistic(*labelled_sample(marked, known, columns, fit_rows))
    out = marked.select("doc_id", "fp", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), logistic(model, columns).alias("score"), "n_words", F.size("sums").alias("n_segments"), "best")
    return out.select("doc_id", "fp", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "n_segments", "best")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text is scored as toxic, whatever their doc_id; columns stay as they are.

    docs is read more than once and should be a written table."""
    fp = fresh(docs.columns, "fp")
    bad = cut(_scores(docs, labels).where("predicted = 1").select(F.col("fp").alias(fp)).distinct(), "toxic")
    return docs.withColumn(fp, F.xxhash64(text_or_empty())).join(bad, fp, "left_anti").select(*docs.columns)
