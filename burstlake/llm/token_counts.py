"""Token counts of texts of any length, by overlap resynchronisation.

A text of more than `chunk` characters becomes chunks that overlap, spread over all tasks and encoded with offsets. Where
the library splits text into the units that it merges apart from each other, what follows a boundary depends on the text
after it alone. So if a chunk and the next one both have a unit boundary at the same place, they have the same boundaries
and tokens from there on, and the counts can be spliced there. Two margins make that a proof: in the earlier chunk the place
is at least `margin` before its end, as a unit is decided by at most two characters beyond it and by special strings that
begin there; in the later one at least `margin` after its start, as a special string may lie across that. Texts with an
overlap that has no common boundary are put together again and cut with wider overlaps and chunks, until all fit or a chunk
holds the whole text.

Shorter texts are split into units here and only units not seen before go to the merge model; whatever could be split
another way (characters beyond Latin, special strings) goes through the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_OTHER = regex.compile(r"[^\t\n\r\x20-\x7e\xa0-\u024f]")
_loaded: dict[str, UnitCounts] = {}


class UnitCounts(dict):
    """A unit of text -> number of its tokens; forgets everything once it holds `most` units."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            about = json.load(f)
        self.special = [t["content"] for t in about["added_tokens"]]
        self.margin = 2 + max(map(len, self.special), default=0)
        known = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        split = about["pre_tokenizer"] or {}
        self.plain = about["normalizer"] is None and {k: split.get(k) for k in known} == known
        self.units = regex.compile(public_tokenizers.PATTERN)
        # the characters by which a byte-level vocabulary shows bytes: printable ones stand for themselves
        printable = [x for x in range(256) if chr(x).isprintable() and chr(x) != " "]
        rest = (x for x in range(256) if x not in printable)
        self.shown = {x: x for x in printable} | {x: 256 + n for n, x in enumerate(rest)}

    def __missing__(self, unit: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = len(self.tokenizer.model.tokenize(unit.encode().decode("latin-1").translate(self.shown)))
        if len(unit) <= 40:
            self[unit] = n
        return n

    def count(self, text: str) -> int:
        if self.plain and _OTHER.search(text) is None and not any(s in text for s in self.special):
            return sum(map(self.__getitem__, self.units.findall(text)))
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Places where a unit begins, the tokens before each, and the tokens of the whole text."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        if not len(e):
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        unit = np.array([-1 if w is None else w for w in e.word_ids])
        first = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1))
        offsets = e.offsets  # a new list each time it is read
        return np.array([offsets[k][0] for k in first.tolist()], np.int64), first, len(e)


def unit_counts(path: str) -> UnitCounts:
    if path not in _loaded:
        _loaded[path] = UnitCounts(path)
    return _loaded[path]


def _chunks(text: str, chunk: int, overlap: int):
    """(number, start, text) of chunks that begin every `chunk` characters and reach `overlap` into the next."""
    starts = range(0, max(1, len(text) - overlap), chunk)
    for k, at in enumerate(starts):
        yield k, at, text[at : len(text) if k == len(starts) - 1 else at + chunk + overlap]


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("text_no", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("piece", pa.string())])


def _counted_or_cut(tokenizer: str, chunk: int, overlap: int):
    def run(batches):
        units = unit_counts(tokenizer)
        for b in batches:
            rows = []
            for no, id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py()
                size = len(text.encode("utf-8", "surrogatepass"))
                if len(text) <= chunk + overlap:
                    rows.append((id_, size, units.count(text), no, None, None, None))
                    continue
                for part, at, piece in _chunks(text, chunk, overlap):
                    rows.append((id_, size, None, no, part, at, piece))
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), _CUT.types)], schema=_CUT)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), _CUT.types)], schema=_CUT)

    return run


def _cut_again(chunk: int, overlap: int):
    def run(batches):
        for b in batches:
            for no, text in zip(b.column(0).to_pylist(), b.column(1)):
                for part, at, piece in _chunks(text.as_py(), chunk, overlap):
                    yield pa.RecordBatch.from_pydict({"text_no": pa.array([no], pa.int64()), "part": pa.array([part], pa.int32()), "start": pa.array([at], pa.int64()), "piece": pa.array([piece])})

    return run


_SEAM = "text_no long, seam int, tokens long, at array<long>, before array<long>, after array<long>"


def _encoded(tokenizer: str, chunk: int, overlap: int):
    """Two rows for each chunk: for the seam with the chunk before it, its tokens and the unit boundaries near its start with
    the tokens before each; for the seam with the next one, the boundaries near its end with the tokens after each."""

    def run(batches):
        units = unit_counts(tokenizer)
        for b in batches:
            out = []
            for no, part, start, piece in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                piece = piece.as_py()
                at, before, n = units.boundaries(piece)
                head = (at >= units.margin) & (at <= overlap - units.margin) & (part > 0)
                tail = (at >= chunk + units.margin) & (at <= len(piece) - units.margin) & (len(piece) == chunk + overlap)
                out.append((no, part, n, at[head] + start, before[head], None))
                out.append((no, part + 1, 0, at[tail] + start, None, n - before[tail]))
            if out:
                longs = pa.list_(pa.int64())
                cols = [pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), longs, longs, longs))]
                yield pa.RecordBatch.from_arrays(cols, ["text_no", "seam", "tokens", "at", "before", "after"])

    return run


def _spliced(pieces: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """text_no, n_tokens of texts in pieces(text_no, part, start, piece); null where an overlap has no common boundary."""
    spread = pieces.select("text_no", "part", "start", "piece").repartition("text_no", "part")
    seams = spread.mapInArrow(_encoded(tokenizer, chunk, overlap), _SEAM)
    old, new = F.col("after").isNotNull(), F.col("before").isNotNull()
    both = seams.groupBy("text_no", "seam").agg(F.sum("tokens").alias("tokens"), F.count_if(new).alias("has_new"), *[F.first(F.when(w, F.struct("at", v)), True).alias(n) for w, v, n in ((old, "after", "old"), (new, "before", "new"))])
    place = F.array_min(F.array_intersect("old.at", "new.at"))
    of = lambda side, v: F.element_at(F.col(f"{side}.{v}"), F.array_position(F.col(f"{side}.at"), F.col("place")).cast("int"))
    both = both.withColumn("place", place)
    # the first chunk has no seam before it, and behind the last one there is no chunk to join
    twice = F.when((F.col("seam") == 0) | (F.col("has_new") == 0), 0).when(F.col("place").isNotNull(), of("old", "after") + of("new", "before"))
    both = both.select("text_no", (F.col("tokens") - twice).alias("own"))
    return both.groupBy("text_no").agg(F.when(F.count("own") == F.count("*"), F.sum("own")).alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk: int = 16_384, overlap: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: UTF-8 bytes and tokens of every whole text, and whether these exceed `limit`.

    A null or empty text has 0 of both; a null doc_id stays null; repeated rows have a row each; other columns are ignored;
    an empty table gives no rows. No tokens are added; special strings inside texts count as the library reads them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("text_no"), F.col("doc_id").cast("long"), text.alias("text"))
    shape = "doc_id long, n_bytes long, n_tokens long, text_no long, part int, start long, piece string"
    made = cut(rows.mapInArrow(_counted_or_cut(tokenizer, chunk, overlap), shape), "chunks")
    out = made.where("part is null").select("doc_id", "n_bytes", "n_tokens")
    texts = made.where("part = 0").select("text_no", "doc_id", "n_bytes")
    pieces, known = made.where("part is not null"), None
    while True:
        counted = cut(_spliced(pieces, tokenizer, chunk, overlap), "spliced")
        good = counted.where("n_tokens is not null")
        known = good if known is None else known.unionByName(good)
        open_ = counted.where("n_tokens is null").select("text_no")
        if not open_.take(1):
            break
        own = F.when(F.col("start") == 0, F.col("piece")).otherwise(F.substr("piece", F.lit(overlap + 1)))
        whole = pieces.join(open_, "text_no", "left_semi").groupBy("text_no").agg(F.array_sort(F.collect_list(F.struct("part", own.alias("own")))).alias("parts"))
        whole = whole.select("text_no", F.array_join(F.transform("parts", lambda p: p["own"]), "").alias("text"))
        chunk, overlap = 4 * chunk, 8 * overlap
        pieces = cut(whole.mapInArrow(_cut_again(chunk, overlap), "text_no long, part int, start long, piece string"), "wider")
    long_ = texts.join(known, "text_no").select("doc_id", "n_bytes", "n_tokens")
    return out.unionByName(long_).withColumn("over_limit", F.col("n_tokens") > limit)
