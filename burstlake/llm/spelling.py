"""Spelling variants: words of a corpus that are one edit apart, found by scanning sorted lists of the vocabulary.

A list is sorted, so a word shares with the word before it a prefix of known length (the adjacent LCP) and the rows of the
edit matrix of that prefix are used again. Rows are banded: only the three cells around the diagonal can stay within one
edit. As soon as no cell of a row is within one edit, all words that share the prefix so far are skipped.

Lists are made so that each pair meets in exactly one of them. Of two words with at most one edit between them, the shorter
of length c, either the first or the last half of what is not yet fixed agrees; lists hold words of lengths c and c + 1 with
the same fixed start and end. A list with more than `most` words is halved again, until one free character is left, where
the alphabet bounds it: no list grows with the vocabulary, however common a start or an ending is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIST = ("c", "start_at", "end_at", "below", "head", "tail")
_FAR = 2**31 - 1


def vocabulary(docs: DataFrame, least_length: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """word, n: runs of letters A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased, of at least `least_length` code points
    and `least` occurrences. A run loses a character where the crc32 of its id and itself is a multiple of `every`."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    ascii_ = F.octet_length("run") == F.char_length("run")
    runs = runs.withColumn("run", F.when(ascii_, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.left("run", at), F.substr("run", at + 2))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _row_steps() -> list[int]:
    """The next banded row for each row and for which of the three characters of the word agree.

    A row (x, y, z) holds the edits from a prefix of d characters to the first d - 1, d and d + 1 characters of the word,
    2 for more than one; it is numbered 9x + 3y + z. -1: no cell is within one edit."""
    out = []
    for row in range(27):
        x, y, z = row // 9, row // 3 % 3, row % 3
        for same in range(8):
            a, b, c = (0 if same & bit else 1 for bit in (4, 2, 1))
            left = min(x + a, y + 1)
            middle = min(y + b, z + 1, left + 1)
            right = min(z + c, middle + 1)
            new = [min(v, 2) for v in (left, middle, right)]
            out.append(9 * new[0] + 3 * new[1] + new[2] if min(new) < 2 else -1)
    return out


_STEP = _row_steps()
_FIRST = 2 * 9 + 0 * 3 + 1  # before any character: only the empty prefix and one inserted character are within one edit


def adjacent_lcp(words: list[str]) -> tuple[list[int], list[int]]:
    """Length of the prefix that each word shares with the one before it, and the next place where that is shorter."""
    lcp = [0] * len(words)
    for i in range(1, len(words)):
        a, b = words[i - 1], words[i]
        n = min(len(a), len(b))
        k = 0
        while k < n and a[k] == b[k]:
            k += 1
        lcp[i] = k
    after, open_ = [len(words)] * len(words), []
    for i, k in enumerate(lcp):
        while open_ and lcp[open_[-1]] > k:
            after[open_.pop()] = i
        open_.append(i)
    return lcp, after


def near_in_list(words: list[str], c: int, below: int):
    """(i, j) for words of a sorted list that are one edit apart, i of length c and j of length c or c + 1; a pair of equal
    lengths comes both ways. Pairs that share `below` or more characters from the start are those of another list."""
    lcp, after = adjacent_lcp(words)
    step, end = _STEP, len(words)
    for i, word in enumerate(words):
        if len(word) != c:
            continue
        padded = f"\0{word}\0\0"
        rows, depth, k = [_FIRST], 0, 0  # rows[d]: after d characters of words[k]; depth of them hold
        while k < end:
            other = words[k]
            del rows[depth + 1 :]
            row = rows[depth]
            for ch in other[depth:]:
                row = step[row << 3 | (padded[depth] == ch) << 2 | (padded[depth + 1] == ch) << 1 | (padded[depth + 2] == ch)]
                if row < 0:
                    break
                depth += 1
                rows.append(row)
            if row < 0:  # no word that shares these depth + 1 characters is near
                k += 1
                while k < end and lcp[k] > depth:
                    k = after[k]
            else:
                if (row // 3 % 3 if len(other) == c else row // 9 if len(other) == c + 1 else 2) == 1:
                    shared = 0
                    while shared < c and other[shared] == word[shared]:
                        shared += 1
                    if shared < below:
                        yield i, k
                k += 1
            if k < end:
                depth = min(depth, lcp[k])


def _best(words: list[str], n: list[int], c: int, below: int) -> list[tuple]:
    """(word, number of near words, n and word of the most frequent one, the first in order among equals) of a list."""
    count, best = [0] * len(words), [-1] * len(words)

    def met(i, j):
        count[i] += 1
        b = best[i]
        if b < 0 or n[j] > n[b] or (n[j] == n[b] and j < b):
            best[i] = j

    for i, j in near_in_list(words, c, below):
        met(i, j)
        if len(words[j]) > c:
            met(j, i)
    return [(words[i], count[i], n[b], words[b]) for i, b in enumerate(best) if b >= 0]


def _scanned(batches):
    """Lists come one after the other, each sorted by word."""
    key, words, n, out = None, [], [], []

    def rows():
        made = [list(x) for x in zip(*out)] or [[], [], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "near_n", "near"])

    for b in batches:
        cols = [b.column(i) for i in range(6)]
        ids = np.zeros(b.num_rows, bool)
        for col in cols:  # where a new list begins
            v = col.to_numpy(zero_copy_only=False)
            ids[1:] |= v[1:] != v[:-1]
        word, count = b.column(6).to_pylist(), b.column(7).to_pylist()
        edges = [0, *np.flatnonzero(ids).tolist(), b.num_rows] if b.num_rows else []
        for at, to in zip(edges, edges[1:]):
            new = tuple(col[at].as_py() for col in cols)
            if new != key:
                if len(words) > 1:
                    out += _best(words, n, key[0], key[3])
                key, words, n = new, [], []
            words += word[at:to]
            n += count[at:to]
        if len(out) > 10_000:
            yield rows()
    if len(words) > 1:
        out += _best(words, n, key[0], key[3])
    yield rows()


def _halved(lists: DataFrame) -> DataFrame:
    """Each word in the lists of its next start and of its next end; pairs that have the start in common stay with that."""
    free = F.col("c") - F.col("start_at") - F.col("end_at")
    k = F.floor(free / 2).cast("int")  # at most one edit in `free` characters leaves so many at one of the ends
    start, end = F.col("start_at") + k, F.col("end_at") + k
    by = [
        F.struct("c", start.alias("start_at"), "end_at", "below", F.left("word", start).alias("head"), "tail"),
        F.struct("c", "start_at", end.alias("end_at"), F.least("below", start).alias("below"), "head", F.right("word", end).alias("tail")),
    ]
    return lists.select(F.explode(F.array(*by)).alias("l"), "word", "n").select("l.*", "word", "n")


def near_words(vocab: DataFrame, most: int = 2000) -> DataFrame:
    """word, n_near, near_n, near: how many words of vocab(word, n) are one edit apart, and the most frequent of them.

    vocab is a written table. Words without any are left out."""
    size = F.char_length("word")
    shortest = vocab.agg(F.min(size)).first()[0]
    if shortest is None:
        return vocab.select("word", F.lit(0).cast("long").alias("n_near"), F.col("n").alias("near_n"), F.col("word").alias("near"))
    lists = vocab.select(F.explode(F.array(size, size - 1)).alias("c"), F.lit(0).alias("start_at"), F.lit(0).alias("end_at"), F.lit(_FAR).alias("below"), F.lit("").alias("head"), F.lit("").alias("tail"), "word", "n")
    lists, done = _halved(lists.where(F.col("c") >= shortest)), None
    while True:
        crowded = lists.where("c - start_at - end_at > 1").groupBy(*LIST).agg(F.count("*").alias("size")).where(F.col("size") > most).drop("size")
        crowded = cut(crowded, "crowded")
        if not crowded.take(1):
            break
        calm = lists.join(crowded, list(LIST), "left_anti")
        done = calm if done is None else done.unionByName(calm)
        lists = cut(_halved(lists.join(crowded, list(LIST), "left_semi")), "halved")
    lists = lists if done is None else done.unionByName(lists)
    found = lists.repartition(*LIST).sortWithinPartitions(*LIST, "word").mapInArrow(_scanned, "word string, n_near long, near_n long, near string")
    best = F.min_by(F.struct("near_n", "near"), F.struct(-F.col("near_n"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.near_n", "b.near")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for forms(word, form): the last form of each chain, by doubling. Counts grow tenfold along a chain, so there
    are at most 18 steps and five turns."""
    roots = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while roots.where("moved").take(1):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = roots.join(further, "root", "left")
        roots = cut(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return roots.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = 7, least: int = 2, every: int = 31, times: int = 10, most: int = 2000) -> DataFrame:
    """word, form, root, n, n_near, form_n: words with the spelling that they are probably variants of.

    A word's form is the most frequent word that one inserted, deleted or replaced code point away, ties to the first in
    code-point order, if it occurs at least `times` as often; else null, as is form_n then. root follows forms to the last.

    Null texts have no words, a null doc_id is written as the empty text, repeated rows count each, other columns are ignored,
    an empty table gives no rows; lists of more than `most` words are halved."""
    vocab = cut(vocabulary(docs, least_length, least, every), "vocabulary")
    words = vocab.join(near_words(vocab, most), "word", "left")
    known = F.col("near_n") >= times * F.col("n")
    words = cut(words.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(known, F.col("near")).alias("form"), F.when(known, F.col("near_n")).alias("form_n")), "words")
    out = words.join(_roots(words.where("form is not null").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
