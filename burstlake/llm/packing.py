"""Best-fit packing of token sequences, certified by dual feasible functions.

Pieces are dealt to small groups, and each group packs its own by best-fit decreasing. The largest of several dual feasible
bounds tells how few sequences the group could need at best; a group that needs more has a gap. Groups with gaps give the
documents of their unfilled sequences to an exchange, certified groups those of their emptiest sequence alone; what was
given is dealt anew and packed again, for as long as that saves sequences. The last exchanges are small and meet in one
group, so the roundings of many groups are made good as well.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


# How the vocabulary's file splits lower-cased text into units that are merged apart from each other.
UNITS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class TokenIds(dict):
    """A run of characters without blanks -> its token ids, 4 bytes each; forgets everything once it holds `most` runs.

    Runs in plain form are split into the vocabulary's units, so "Word," and "word" share their work, and a unit goes to
    the merge model itself; any other run goes through the whole tokenizer."""

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        # the characters by which a byte-level vocabulary shows bytes: printable ones stand for themselves
        plain = [x for x in range(256) if chr(x).isprintable() and chr(x) != " "]
        rest = (x for x in range(256) if x not in plain)
        self.shown = {x: x for x in plain} | {x: 256 + n for n, x in enumerate(rest)}

    def __missing__(self, run: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if run.isprintable() and "<|" not in run and "\u03a3" not in run and unicodedata.is_normalized("NFC", run):
            units = UNITS.findall(run.lower())
            if units == [run]:
                shown = run if run.isascii() else run.encode().decode("latin-1").translate(self.shown)
                ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            else:
                ids = b"".join([self[u] for u in units])
        else:
            ids = array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()
        if len(run) <= 40:
            self[run] = ids
        return ids


_loaded: dict[str, TokenIds] = {}


def token_ids(path: str, text: str | None) -> np.ndarray:
    """Ids of a text as unsigned 32-bit numbers. The vocabulary drops white space, so runs between blanks are independent."""
    cache = _loaded.get(path)
    if cache is None:
        cache = _loaded[path] = TokenIds(path)
    runs = (text or "").replace("\n", " ").split(" ")
    return np.frombuffer(b"".join(map(cache.__getitem__, runs)), dtype="=u4")


def _pieces(path: str, most: int, end: int, with_ids: bool):
    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part, rows = b.slice(s, 512), []
                for k, t in enumerate(part.column(1).to_pylist()):
                    ids = np.append(token_ids(path, t), np.uint32(end)).astype("<u4")
                    for i, at in enumerate(range(0, len(ids), most)):
                        one = ids[at : at + most]
                        rows.append((k, i, at, len(one), zlib.crc32(one.tobytes()), one if with_ids else None))
                k, i, at, n, crc, ids = zip(*rows)
                out = [part.column(0).take(pa.array(k)), pa.array(i, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (, ids): the ids of each text and then `end`, cut every `most` ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer, most, end, with_ids), schema)


def best_fit_decreasing(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length and the fill of each bin; open bins are found by free space through a bit set."""
    where, offset, fills = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(most + 1)]
    some = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        fits = some >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            at = free[space].pop()
            if not free[space]:
                some ^= 1 << space
        else:
            space, at = most, len(fills)
            fills.append(0)
        where[k], offset[k] = at, most - space
        fills[at] += n
        if space > n:
            free[space - n].append(at)
            some |= 1 << (space - n)
    return where, offset, np.array(fills, np.int64)


def lower_bound(lengths: np.ndarray, most: int) -> int:
    """Fewest bins of size `most` by dual feasible functions: the sum, thresholds that drop small and round up large lengths,
    and rounding to k + 1 equal shares."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=most + 1).astype(np.int64)
    x = np.arange(most + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // most)
    mass, number = np.cumsum(count * x), np.cumsum(count)
    for t in range(1, most // 2 + 1):  # over most - t: a bin each; t to most - t: as they are; under t: nothing
        large, middle = int(number[-1] - number[most - t]), int(mass[most - t] - mass[t - 1])
        best = max(best, large - (-middle // most))
    for k in range(1, 33):
        share = (k + 1) * x
        value = np.where(share % most == 0, k * x, (share // most) * most)  # in units of 1 / (k * most)
        best = max(best, -(-int((count * value).sum()) // (k * most)))
    return best


def _packed(most: int, turn: int):
    def run(key, t):
        length = t.column("length").to_numpy()
        where, offset, fills = best_fit_decreasing(length, most)
        certified = len(fills) == lower_bound(length, most)
        given = np.arange(len(fills)) == fills.argmin() if certified else np.ones(len(fills), bool)
        given &= fills < most
        new = {"sequence_id": where + (turn << 56) + (key[0].as_py() << 24), "offset": offset, "given": given[where], "opens": offset == 0}
        t = t.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        for name, values in new.items():
            t = t.append_column(name, pa.array(values))
        return t

    return run


def pack(pieces: DataFrame, most: int = 2048, group: int = 4096, turns: int = 12) -> DataFrame:
    """pieces(doc_id, piece, start, length, ids_crc32) with sequence_id and offset: each sequence is gapless from 0.

    Lengths are between 1 and `most`. Rows that repeat are packed as rows of their own, in as many groups as any others; no
    rows give no sequences. pieces is a written table: each turn reads it again. After `turns` exchanges what is still open
    stays as it is packed, even where no bound certifies it."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, given boolean, opens boolean"
    open_, done, before = pieces, None, None
    for turn in range(turns):
        n = open_.count()
        if not n:
            break
        groups = -(-n // group)
        grp = F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups))
        made = cut(open_.select(*columns).withColumn("grp", grp).groupBy("grp").applyInArrow(_packed(most, turn), shape), "packed")
        now = made.agg(F.count_if("opens").alias("all"), F.count_if(F.col("opens") & F.col("given")).alias("given")).first()
        if before is not None and now["all"] >= before:
            break  # the exchange saved nothing: what was packed before stays
        kept = made.where("not given")
        done = kept if done is None else done.unionByName(kept)
        open_, before = made.where("given"), now["given"]
        if groups == 1:
            break
    if done is None:
        return pieces.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).where("false")
    return done.unionByName(open_).select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, most: int = 2048, end: int = 0, group: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: texts as tokens in as few sequences as possible.

    A null text is empty and a document still has its `end` token; longer documents are cut every `most` tokens; a null
    doc_id stays null; rows that repeat are packed each; other columns are ignored; an empty table gives no rows."""
    return pack(cut(token_pieces(docs, tokenizer, most, end), "pieces"), most, group)


def sequences(docs: DataFrame, tokenizer: str, most: int = 2048, end: int = 0) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, without ids of documents; null texts are empty.

    Rows are told apart by doc_id and text together, so null and repeated ids are packed like all others."""
    docs = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    pieces = cut(token_pieces(docs, tokenizer, most, end, with_ids=True), "pieces")
    placed = pack(pieces, most).join(pieces.select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"]), ["doc_id", "piece", "ids_crc32"])
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
