"""Removal of long repeated substrings by prefix-free parsing, exact over the whole corpus.

A text is a string of units: its UTF-8 bytes, or its words, each by four bytes of its hash. Words serve for passages that are
counted in words, whatever blanks stand between them and however long the words are.

Triggers of a rolling hash cut every text into phrases. A trigger is a position whose 16-byte rolling hash is smallest in
some stretch of `reach` positions, so phrases depend on content alone, have bounded length, and equal windows of `length`
bytes have their first trigger at the same place. Each phrase owns the windows whose first trigger is its own. Three steps
decide which of these windows occur again:

1. the dictionary: bytes that all windows of a phrase share ("core"). A core that occurs once settles its phrase: nothing
   of it repeats. This takes most of an ordinary corpus out of the work after one narrow shuffle.
2. the parse: the phrase with all that its windows cover ("full"). One that occurs twice or more is settled: all repeat.
3. what remains lies at the ends of repeated passages. For the phrases of one core, the suffixes of the phrases to the left
   of the trigger (dictionary) and the continuations to the right (parse) are each sorted into suffix order with their
   common prefixes; the two orders combine into corpus order, in which equal windows are neighbours. Cores with so many
   different surroundings that one task should not hold them are counted window by window instead, with partial sums.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, cut, fresh, hash_words, mix, text_or_empty, words_of

GRAM = 16
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
WORD = 4  #: bytes of a word in the string of a text's words
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def in_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def in_words(text: str) -> bytes:
    """WORD bytes for each word, lower-cased A-Z."""
    return hash_words(words_of(text)).astype("<u4").tobytes()


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of each GRAM-byte string by doubling."""
    h, width = _TABLE[data], 1
    while width < GRAM:
        h = h[:-width] * np.uint64(pow(_BASE, width, 2**64)) + h[width:]
        width *= 2
    return mix(h)


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by minima from the left and right of blocks."""
    n = len(x)
    pad = -n % width
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(y, axis=1).reshape(-1)
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def phrases(data: bytes, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each phrase: its trigger, and the first and last window start that it owns. Shorter data than `length`: none."""
    starts = len(data) - length + 1
    if starts <= 0:
        return (np.empty(0, np.int64),) * 3
    out, step = [], 1 << 20
    for at in range(0, starts, step):
        n = min(step, starts - at)
        h = _rolling(np.frombuffer(data, np.uint8, count=n + reach + GRAM - 2, offset=at))
        place = np.arange(len(h), dtype=np.uint64)
        least = _slide_min((h & np.uint64(0xFFFFFFFFFFC00000)) | place, reach)
        out.append((least & np.uint64(0x3FFFFF)).astype(np.int64) + at)
    anchor = np.concatenate(out)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return anchor[first], first, np.concatenate([first[1:] - 1, [starts - 1]])


def _places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigger, first and last window start of phrases from the long that holds them."""
    a = at >> 16
    lo = a - (at >> 8 & 255)
    return a, lo, lo + (at & 255)


def _parse(length: int, reach: int, encode):
    core = length - reach + 1

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part, rows = b.slice(i, 64), []
                cores, fulls = [], []
                for k, t in enumerate(part.column(2).to_pylist()):
                    data = encode(t)
                    a, lo, hi = phrases(data, length, reach)
                    if len(a):
                        view = memoryview(data)
                        rows.append((np.full(len(a), k), a << 16 | (a - lo) << 8 | hi - lo))
                        cores += [xxhash.xxh3_64_intdigest(view[x : x + core]) for x in a.tolist()]
                        fulls += [xxhash.xxh3_64_intdigest(view[x : y + length], z - x << 8 | y - x) for x, y, z in zip(lo.tolist(), hi.tolist(), a.tolist())]
                if rows:
                    k, at = map(np.concatenate, zip(*rows))
                    k = pa.array(k)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(k), part.column(1).take(k), pa.array(at), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (cores, fulls))], ["id", "fp", "at", "core", "full"])

    return run


def _surroundings(length: int, encode):
    """(id, fp, text, asked: array of (core, at, n)) -> each phrase with its left part and its continuation."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                data = encode(b.column(2)[i].as_py())
                asked = b.column(3)[i].values
                core, at, n = (asked.field(k) for k in ("core", "at", "n"))
                spans = list(zip(*(x.tolist() for x in _places(at.to_numpy()))))
                for s in range(0, len(spans), 2000):
                    some = spans[s : s + 2000]
                    m = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(b.column(0)[i], m), pa.repeat(b.column(1)[i], m), core.slice(s, m), at.slice(s, m), n.slice(s, m), pa.array([data[x:z] for z, x, y in some], pa.binary()), pa.array([data[z : y + length] for z, x, y in some], pa.binary())],
                        ["id", "fp", "core", "at", "n", "left", "right"],
                    )

    return run


def _padded(rows: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int16)
    for i, r in enumerate(rows):
        out[i, : len(r)] = np.frombuffer(r, np.uint8).astype(np.int16) + 1
    return out


def corpus_order(core: np.ndarray, near: np.ndarray, far: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> np.ndarray:
    """For phrases (rows) and distances x from window start to trigger: whether another row of the same core has the same window.

    near, far: the smallest and largest distance that the row owns. Returns a boolean matrix, rows by distances from 0.
    The continuations are put in suffix order once, with the common prefix of neighbours; the left parts are put in the
    order of their suffixes byte by byte. Two windows are equal where the left suffixes of x bytes are in the same class and
    nothing between them in the order of continuations shares fewer than length - x bytes."""
    n, reach = len(core), int(far.max(initial=0)) + 1
    again = np.zeros((n, reach), bool)
    tails = _padded(right, length)
    order = np.lexsort((np.ascontiguousarray(tails.astype(">i2")).view(f"V{2 * length}").reshape(-1).argsort(kind="stable").argsort(kind="stable"), core))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    sorted_tails, same = tails[order], core[order][1:] == core[order][:-1]
    differ = (sorted_tails[1:] != sorted_tails[:-1]) | (sorted_tails[1:] == 0)
    common = np.where(differ.any(1), differ.argmax(1), length)
    common = np.concatenate([[-1], np.where(same, common, -1)])
    heads = _padded([x[::-1] for x in left], reach)
    suffix = np.unique(core, return_inverse=True)[1].astype(np.int64)
    for x in range(reach):
        if x:
            suffix = np.unique(suffix * 512 + heads[:, x - 1], return_inverse=True)[1]
        follow = np.cumsum(common < length - x)[rank]
        has = np.flatnonzero((near <= x) & (x <= far))
        if len(has) > 1:
            _, which, count = np.unique(suffix[has] * (n + 1) + follow[has], return_inverse=True, return_counts=True)
            again[has, x] = count[which] > 1
    return again


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true values."""
    f = np.pad(flags, ((0, 0), (1, 1))).astype(np.int8)
    d = np.diff(f, axis=1)
    (r, s), (_, e) = np.nonzero(d == 1), np.nonzero(d == -1)
    return r, s, e - 1


def _borders(length: int, most: int = 20_000):
    """Rows sorted by core, all rows of a core in one partition; works on whole cores, about `most` rows at a time."""

    def solve(t: pa.Table):
        core = t.column("core").to_numpy()
        a, lo, hi = _places(t.column("at").to_numpy())
        again = corpus_order(core, a - hi, a - lo, t.column("left").to_pylist(), t.column("right").to_pylist(), length)
        again &= (t.column("n").to_numpy() == 1)[:, None]
        r, x0, x1 = _runs(again)
        r_ = pa.array(r)
        return pa.RecordBatch.from_arrays([t.column("id").combine_chunks().take(r_), t.column("fp").combine_chunks().take(r_), pa.array((a[r] - x1).astype(np.int32)), pa.array((a[r] - x0 + length).astype(np.int32))], ["id", "fp", "start", "end"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= most:
                t = pa.Table.from_batches(held)
                core = t.column("core").to_numpy()
                whole = int(np.flatnonzero(core != core[-1])[-1]) + 1 if (core != core[-1]).any() else 0
                if whole:
                    yield solve(t.slice(0, whole))
                    held = t.slice(whole).to_batches()
                    rows = t.num_rows - whole
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run


def _windows(length: int):
    """Phrases of crowded cores -> one row per window: its hash, its place and whether its phrase stands for several."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                k, start, digest = [], [], []
                places = (x.tolist() for x in _places(part.column("at").to_numpy()))
                for i, (_, lo, hi, left, right) in enumerate(zip(*places, *(part.column(c).to_pylist() for c in ("left", "right")))):
                    data = memoryview(left + right)
                    for w in range(hi - lo + 1):
                        digest.append(xxhash.xxh3_128_digest(data[w : w + length]))
                    k += [i] * (hi - lo + 1)
                    start += range(lo, hi + 1)
                k = pa.array(k)
                yield pa.RecordBatch.from_arrays([part.column("id").take(k), part.column("fp").take(k), pa.array(start, pa.int32()), part.column("n").take(k), pa.array(digest, pa.binary())], ["id", "fp", "start", "n", "window"])

    return run


def repeated_spans(docs: DataFrame, length: int = 400, crowd: int = 4096, encode=in_bytes) -> DataFrame:
    """(id, fp, spans): spans [start, end) of the encoded text covered by `length` of its bytes that start anywhere else as well.

    docs has id, fp (hash of the text) and text; rows equal in id and fp are the same text twice, and so repeats. A phrase is
    named by two hashes of 64 bits, of its core and of all that it covers; both must agree."""
    reach = min(length // 2, 224)
    parsed = cut(docs.select("id", "fp", "text").mapInArrow(_parse(length, reach, encode), "id long, fp long, at long, core long, full long"), "parse")
    # what is joined below is written first: both sides of a join are then plain exchanges, and a crowded core can be split
    common = cut(parsed.groupBy("core").agg(F.count("*").alias("cores")).where("cores > 1").select("core"), "common")
    twice = cut(parsed.join(common, "core"), "dictionary")
    classes = cut(twice.groupBy("core", "full").agg(F.count("*").alias("n"), F.min(F.struct("id", "fp", "at")).alias("first")), "classes")
    settled = twice.join(classes.where("n > 1").select("core", "full"), ["core", "full"])
    lo = F.expr("shiftright(at, 16) - (shiftright(at, 8) & 255)")
    settled = settled.select("id", "fp", lo.cast("int").alias("start"), (lo + F.expr("at & 255") + length).cast("int").alias("end"))

    open_ = cut(classes.groupBy("core").agg(F.min("n").alias("least"), F.count("*").alias("m")).where("least = 1 and m > 1").select("core", "m"), "open")
    asked = cut(classes.select("core", "n", "first.*").join(open_, "core"), "borders")
    lists = asked.groupBy("id", "fp").agg(F.collect_list(F.struct("core", "at", "n")).alias("asked"))
    around = docs.select("id", "fp", "text").join(lists, ["id", "fp"]).mapInArrow(_surroundings(length, encode), "id long, fp long, core long, at long, n long, left binary, right binary")
    around = cut(around.join(open_, "core"), "around")
    usual = around.where(F.col("m") <= crowd).repartition("core").sortWithinPartitions("core")
    border = usual.mapInArrow(_borders(length), "id long, fp long, start int, end int")

    windows = around.where(F.col("m") > crowd).mapInArrow(_windows(length), "id long, fp long, start int, n long, window binary")
    windows = cut(windows, "windows")
    seen = cut(windows.groupBy("window").agg(F.sum("n").alias("times")).where("times > 1").select("window"), "seen")
    crowded = windows.where("n = 1").join(seen, "window").select("id", "fp", "start", (F.col("start") + length).alias("end"))

    spans = settled.unionByName(border).unionByName(crowded)
    return spans.groupBy("id", "fp").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Sorted, disjoint spans that do not touch."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _pairs(cell) -> list[tuple[int, int]]:
    if not cell.is_valid:
        return []
    return merged(zip(cell.values.field("start").to_pylist(), cell.values.field("end").to_pylist()))


def _whole_words(spans, words: int) -> list[tuple[int, int]]:
    """Runs [first, last) of at least `words` whole words in spans of a string of words."""
    runs = ((-(-s // WORD), e // WORD) for s, e in spans)
    return [(s, e) for s, e in runs if e - s >= words]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text_or_empty()).alias("fp"), text_or_empty().alias("text"))


def _digests(words: int | None):
    def run(batches):
        for b in batches:
            rows = []
            for t, cell in zip(b.column(1).to_pylist(), b.column(2)):
                data, spans, at, kept = in_bytes(t), _pairs(cell), 0, hashlib.sha256()
                for s, e in spans:
                    kept.update(data[at:s])
                    at = e
                kept.update(data[at:])
                rows.append((len(data), sum(e - s for s, e in spans), len(spans), kept.hexdigest()))
            n, r, s, h = zip(*rows) if rows else ((), (), (), ())
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            if words:
                counts = [sum(e - s for s, e in _whole_words(_pairs(cell), words)) for cell in b.column(3)]
                out = out.append_column("n_passage_words", pa.array(counts, pa.int64()))
            yield out

    return run


def repeat_digests(docs: DataFrame, length: int = 400, words: int | None = None, crowd: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs(doc_id, text, ...).

    Each byte covered by a `length`-byte string that starts anywhere else in the corpus, same text included, counts as
    removed. Where `words` is given, a second parse adds n_passage_words: the words covered by runs of so many words that
    start anywhere else, which finds passages that are shorter than `length` bytes or differ in their blanks; nothing is
    removed for it. Null texts are empty; texts shorter than `length` lose nothing; rows that repeat a doc_id and its text
    are two texts that repeat each other; null ids stay null; other columns are ignored; an empty table gives no rows."""
    keyed = _keyed(docs)
    found = repeated_spans(keyed, length, crowd)
    if words:
        passages = repeated_spans(keyed, WORD * words, crowd, in_words)
        found = found.join(passages.withColumnRenamed("spans", "passages"), ["id", "fp"], "full")
    met = keyed.join(found, ["id", "fp"], "left").select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "text", *found.columns[2:])
    return met.mapInArrow(_digests(words), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", n_passage_words long" if words else ""))


def _characters(data: bytes, spans) -> list[tuple[int, int]]:
    """Byte spans shrunk to whole characters."""
    out = []
    for s, e in spans:
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        out.append((s, e))
    return out


def _places_of_words(data: bytes, runs) -> list[tuple[int, int]]:
    """Byte spans of runs of words, from the first byte of the first to the last of the last."""
    at = [m.span() for m in _WORDS.finditer(data)]
    return [(at[s][0], at[e - 1][1]) for s, e in runs]


def _cleared(words: int | None, text: str, spans: str):
    def run(batches):
        for b in batches:
            kept = []
            for t, cell in zip(b.column(text).to_pylist(), b.column(spans)):
                found = _pairs(cell)
                if words and found:
                    found = _whole_words(found, words)
                if not found or t is None:
                    kept.append(t)
                    continue
                data, at, out = in_bytes(t), 0, []
                for s, e in _places_of_words(data, found) if words else _characters(data, found):
                    out.append(data[at:s])
                    at = max(at, e)
                out.append(data[at:])
                kept.append(b"".join(out).decode("utf-8", "surrogatepass"))
            yield b.set_column(b.schema.get_field_index(text), text, pa.array(kept, pa.string())).drop_columns([spans])

    return run


def remove_repeats(docs: DataFrame, length: int = 400, words: int | None = None, crowd: int = 4096) -> DataFrame:
    """docs with every repeat taken out of text; n_chars follows where that column exists.

    A repeat is a string of `length` bytes (whole characters of it go), or where `words` is given a run of so many words
    (blanks around it stay), that starts anywhere else as well, same text included; all places of it are cleared. Rows and
    other columns stay as they are, null texts stay null. A text of nothing but repeats becomes empty. Rows that repeat a
    doc_id and its text repeat each other."""
    columns = docs.columns
    id_, fp, spans_ = (fresh(columns, x) for x in ("id", "fp", "spans"))
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), fp: F.xxhash64(text_or_empty())})
    spans = repeated_spans(_keyed(docs), WORD * words, crowd, in_words) if words else repeated_spans(_keyed(docs), length, crowd)
    met = keyed.join(spans.withColumnsRenamed({"id": id_, "fp": fp, "spans": spans_}), [id_, fp], "left").select(*columns, spans_)
    out = met.mapInArrow(_cleared(words, "text", spans_), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
