"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents with equal shingle sets form one class, and only one member of a class is compared. Classes that share a band
of their MinHash signatures are candidates; their signatures are compared batch by batch and a pair is dropped as soon as
the posterior chance of reaching the threshold falls below the miss probability; every survivor is verified on full sets.
A bucket is first compared with its smallest class alone. Classes of buckets whose members then lie in several components
form families; in a family, blocks of classes are compared across components and only links that connect are returned, so
no link between two components is left out and the rows made stay in proportion to the classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, apart, as_long, cut, fresh, hash_words, mix, text_or_empty, words_of
from .components import components

BANDS, ROWS = 24, 5
BATCH = 24
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_CHUNK = 1 << 15


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word k-shingles; the whole sequence where there are fewer words; none without words."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words)
    width = min(k, len(h))
    n = len(h) - width + 1
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15 * (width + (1 << 20 if len(h) < k else 0)) & (2**64 - 1)))
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values of 32 bits."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), _CHUNK):
        x, y = low[at : at + _CHUNK], high[at : at + _CHUNK]
        t = np.empty_like(x)
        for i in range(BANDS * ROWS):
            np.multiply(x, _MUL[i], out=t)
            t += _ADD[i]
            t ^= y
            v = t.min()
            if v < out[i]:
                out[i] = v
    return out


def _survival(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(compared, fewest equal) after each batch: below it, P(similarity >= threshold | equal, uniform prior) < miss."""
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        # 1 - I_t(m+1, n-m+1) is the binomial tail P(X <= m) for n + 1 draws at t
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _plausible(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which of the paired signatures stay plausible through all batches."""
    live, equal, at = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in steps:
        equal[live] += (a[live, at:n] == b[live, at:n]).sum(1, dtype=np.int32)
        live, at = live[equal[live] >= least], n
        if not len(live):
            break
    return live


def _signed(k: int):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            node, sizes, sigs = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64), []
            for i, t in enumerate(texts):
                s = shingle_set(t, k)
                sizes[i] = len(s)
                node[i] = np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([ids, b.column(2), pa.array(node), pa.array(sizes), pa.array(sigs, pa.binary())], ["doc_id", "fp", "node", "n_shingles", "sig"])

    return run


def _banded(batches):
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
        h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), sig.shape[:2])
        for i in range(ROWS):
            h = mix(h * np.uint64(0x100000001B3) + sig[:, :, i].astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(as_long(h.reshape(-1))), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["bucket", "node"])


def _bayes(steps):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(b.num_rows, -1) for i in (2, 3))
                yield b.select([0, 1]).take(pa.array(_plausible(x, y, steps)))

    return run


def _sets(k: int):
    def run(batches):
        for b in batches:
            nodes, out, sets = b.column(0).to_numpy(), [], []
            for node, t in zip(nodes, b.column(1).to_pylist()):
                s = shingle_set(t, k)
                if np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64) == node:
                    out.append(node)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])

    return run


def _exact(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = np.intersect1d(x, y, assume_unique=True).size
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append(i)
            yield b.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def _rows(t: pa.Table):
    sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("set")]
    return t.column("node").to_numpy(), t.column("component").to_numpy(), np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(t.num_rows, -1), sets


def _across(steps, percent: int):
    """Links between two blocks of one family, tried only between members that lie in different components so far.

    Each pair of a family meets in one pair of blocks. It is tried where it shares a band and stays plausible; a member
    that links to a component is not tried with the rest of it, so the links returned are a spanning forest."""

    def run(left, right):
        a, b = [], []
        if left.num_rows and right.num_rows:
            (na, ca, sa, xa), (nb, cb, sb, xb) = _rows(left), _rows(right)
            size = np.array([len(x) for x in xb])
            _, label = np.unique(np.concatenate([ca, cb]), return_inverse=True)
            la, lb = label[: len(na)], label[len(na) :]
            bands = sb.reshape(len(nb), BANDS, ROWS)
            for i in range(len(na)):
                n = len(xa[i])
                j = np.flatnonzero((lb != la[i]) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n)))
                if len(j):
                    j = j[(bands[j] == sa[i].reshape(BANDS, ROWS)).all(2).any(1)]
                if len(j):
                    j = j[_plausible(np.broadcast_to(sa[i], (len(j), sa.shape[1])), sb[j], steps)]
                while len(j):
                    some, j = j[:64], j[64:]
                    flat = np.concatenate([xb[k] for k in some])
                    at = np.searchsorted(xa[i], flat)
                    hit = xa[i][np.minimum(at, n - 1)] == flat
                    both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[some])[:-1]]), dtype=np.int64)
                    linked = some[100 * both >= percent * (n + size[some] - both)]
                    for k in linked.tolist():
                        if la[i] != lb[k]:
                            a.append(na[i])
                            b.append(nb[k])
                            old, new = lb[k], la[i]
                            la[la == old] = new
                            lb[lb == old] = new
                    j = j[lb[j] != la[i]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-9, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs(doc_id, text, ...).

    Two documents link when their k-word shingle sets have 100 * |A & B| >= percent * |A | B|. component_id is the smallest
    doc_id reachable by links. Texts that are null or without words have an empty set and link with nothing; a null doc_id
    counts in its component but never names it unless no member has an id; rows that repeat a doc_id are compared as rows
    of their own. Other columns are ignored, an empty table gives no rows."""
    return _grouped(docs, k, percent, miss, block)[0]


def _grouped(docs: DataFrame, k: int, percent: int, miss: float = 1e-9, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """The rows of near_duplicates, and (doc_id, fp, component) of each row: fp is the hash of its text, component is null
    where it links with nothing for lack of words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(text_or_empty()).alias("fp"))
    signed = cut(docs.mapInArrow(_signed(k), "doc_id long, fp long, node long, n_shingles long, sig binary"), "signed")
    steps = _survival(percent / 100, miss)

    reps = cut(signed.where("sig is not null").groupBy("node").agg(F.min(F.struct("doc_id", "fp")).alias("at"), F.first("sig").alias("sig")), "reps")
    banded = cut(reps.select("node", "sig").mapInArrow(_banded, "bucket long, node long"), "banded")
    shared = cut(banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("bucket", "pivot"), "buckets")
    members = cut(banded.join(shared, "bucket"), "members")
    star = members.where("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()

    def with_sets(wanted: DataFrame) -> DataFrame:
        """(node, ...) with the full shingle set of each node, from the text of one of its documents."""
        wanted = wanted.join(reps.select("node", F.coalesce("at.doc_id", F.lit(NULL_ID)).alias("id"), "at.fp"), "node")
        return docs.withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID))).join(wanted, ["id", "fp"]).select("node", "text").mapInArrow(_sets(k), "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))

    sigs = reps.select("node", "sig")
    both = star.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
    pairs = cut(both.select("a", "b", "x", "y").mapInArrow(_bayes(steps), "a long, b long"), "plausible")
    sets = cut(with_sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    links = cut(both.select("a", "b", "x", "y").mapInArrow(_exact(percent), "a long, b long"), "links")
    found = cut(components(links), "components")

    placed = cut(members.join(found, "node", "left").select("bucket", "pivot", "node", F.coalesce("component", "node").alias("component")), "placed")
    mixed = cut(placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket"), "mixed")
    open_ = cut(placed.join(mixed, "bucket").select("pivot", "node", "component").distinct(), "open")
    if open_.take(1):
        # families: classes that mixed buckets connect; every pair that could still link lies in one family
        family = cut(components(open_.select(F.col("pivot").alias("a"), F.col("node").alias("b"))).withColumnRenamed("component", "family"), "families")
        sizes = cut(family.groupBy("family").agg(F.ceil(F.count("*") / F.lit(block)).alias("parts")), "sizes")
        members = family.join(sizes, "family").join(open_.select("node", "component").distinct(), "node").join(sigs, "node")
        members = cut(members.join(cut(with_sets(family.select("node")), "sets"), "node").withColumn("part", F.pmod(F.xxhash64("node"), "parts")), "members")
        dealt = members.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)"))).select("family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "component", "sig", "set")
        left, right = dealt.where("part = i"), apart(dealt.where("part = j"))
        more = left.groupBy("family", "i", "j").cogroup(right.groupBy("family", "i", "j")).applyInArrow(_across(steps, percent), "a long, b long")
        found = cut(components(links.unionByName(cut(more, "more"))), "components")

    named = signed.select("doc_id", "fp", "node", "n_shingles", "sig").join(found, "node", "left")
    alone = F.col("sig").isNull()
    named = cut(named.select("doc_id", "fp", "n_shingles", F.when(~alone, F.coalesce("component", "node")).alias("component")), "named")
    names = cut(named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "names")
    out = named.join(names, "component", "left").select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull()))
    return out, named.select("doc_id", "fp", "component")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group that near_duplicates() links: the one with the smallest doc_id.

    Of several texts under that doc_id the one with the smallest hash stays; of rows equal in both any one. Where no member
    has an id, one of the rows without stays. Texts that link with nothing all stay, empty ones too; columns stay as they
    are. docs is read more than once and should be a written table."""
    _, rows = _grouped(docs, k, percent)
    rows = rows.where("component is not null").groupBy("component", "doc_id", "fp").agg(F.count("*").alias("times"))
    known = cut(rows, "rows")
    first = cut(known.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), F.col("doc_id").isNull(), "fp")).alias("first")), "first")
    met = known.join(first, "component").withColumn("stays", F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), F.col("doc_id").isNull(), "fp") == F.col("first"))
    # one doc_id and text may stand in rows of one component alone
    id_, fp, stays, times = (fresh(docs.columns, x) for x in ("id", "fp", "stays", "times"))
    met = cut(met.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(id_), F.col("fp").alias(fp), F.col("stays").alias(stays), F.col("times").alias(times)), "decisions")
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), fp: F.xxhash64(text_or_empty())})
    rest = keyed.join(met.where(~F.col(stays)).select(id_, fp), [id_, fp], "left_anti")
    again = met.where(F.col(stays) & (F.col(times) > 1)).select(id_, fp)
    if again.take(1):
        again = cut(again, "again")
        one = rest.join(again, [id_, fp], "left_semi").dropDuplicates([id_, fp])
        rest = rest.join(again, [id_, fp], "left_anti").unionByName(one)
    return rest.select(*docs.columns)
