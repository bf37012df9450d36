"""Language-model scores: a unigram base and a hashed maximum-entropy model with a class-factored softmax.

Classes are nested: a Huffman tree with FAN branches puts frequent words into small classes near the root, so that
P(w | history) = P(class | history) P(class within it | class, history) ... P(w | its last class, history).
Every factor is a softmax over the branches of a class. Its sums are the logarithms of the branches' shares in the training
tokens plus the weight rows that the history's features select by hash together with the class: the word one back, the last
two words together, and the words two and three back with those between them skipped. Words that make up less than one in
HEADS of the training tokens share leaves by hash; inside such a leaf a word has its share of the leaf's tokens. Before all
this, one slot for words never seen takes the share of the training tokens that were seen once. The whole is normalised over
the vocabulary and that slot.

Documents stand in blocks of bounded size, written once. Rows of weights grow with the root of the corpus and blocks with the
rows, so what is sent between blocks stays in proportion to the tokens. In each of a few rounds the blocks of its part start
from the same weights, make gradient steps over their own documents, and the changes of a row are averaged over the blocks by
how often each used it. All training documents are counted and trained on once. Counts of words outside the tree's own leaves
are joined to the blocks that hold them; what reaches the driver are at most HEADS words and sums of the shared leaves.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashedWords, apart, as_long, crc_mod, cut, mix, text_or_empty, words_of

FAN = 16  #: branches of a class
HEADS = 1 << 16  #: a word of at least one in so many training tokens has a leaf of its own, so there are no more than these
SHARED = 1 << 12  #: leaves of all other words
LEAST_ROWS = 1 << 15  #: rows of hashed weights
PAGE = 512  #: rows of weights that travel together
CHUNK = 8192  #: tokens of one numpy batch
SLICE = 1 << 17  #: tokens whose features are held at once, in whole documents
STEPS, LEAST_BATCH = 64, 16  #: a block makes about so many gradient steps at least, unless its batches get smaller than this
FEATURES = 4
SMOOTH = 0.1
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))

_words = HashedWords()


def token_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text and of the end."""
    words = words_of(text)
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


@dataclass
class Tree:
    """The nested classes. Symbols are the leaves: first the words of their own, in the order of their hashes, then the shared
    ones. path, branch: class and branch taken at each depth; shares: logarithms of the branches' shares in each class."""

    words: np.ndarray
    counts: np.ndarray
    path: np.ndarray
    branch: np.ndarray
    depth: np.ndarray
    shares: np.ndarray
    keys: np.ndarray  #: a hash of each class
    mass: np.ndarray  #: training tokens of each shared leaf

    def __setstate__(self, state: dict) -> None:
        """Arrays that have travelled carry copies of their types, for which numpy takes slow paths; a view has the type itself."""
        self.__dict__.update({k: v.view(np.dtype(v.dtype.str).type) for k, v in state.items()})

    def symbols(self, h: np.ndarray) -> np.ndarray:
        shared = len(self.words) + (h >> np.uint64(20) & np.uint64(SHARED - 1)).astype(np.int64)
        if not len(self.words):
            return shared
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, shared)


def shared_leaf(k):
    """The shared leaf of a word's hash (a Column)."""
    return F.shiftrightunsigned(k, 20).bitwiseAND(F.lit(SHARED - 1))


def grow_tree(words: np.ndarray, counts: np.ndarray, mass: np.ndarray) -> Tree:
    """words, counts: those with leaves of their own; mass: tokens of each shared leaf. A leaf without tokens gets nothing."""
    order = np.argsort(words)
    words, counts = words[order], counts[order].astype(np.float64)
    weight = np.concatenate([counts, mass])
    n, at = len(weight), 0
    heap = [(w, i) for i, w in enumerate(weight.tolist())]
    heap += [(0.0, -1 - i) for i in range(-(n - 1) % (FAN - 1))]
    heapq.heapify(heap)
    inner, shares = {}, []
    while len(heap) > 1:
        some = [heapq.heappop(heap) for _ in range(FAN)]
        total = sum(w for w, _ in some)
        shares.append([math.log(w / total) if i >= 0 and w > 0 else -1e9 for w, i in some])
        for b, (_, i) in enumerate(some):
            inner[i] = (at, b)
        heapq.heappush(heap, (total, n + at))
        at += 1
    up = np.full((n + at, 2), -1, np.int64)
    for i, v in inner.items():
        if i >= 0:
            up[i] = v
    steps, now = [], np.arange(n)
    while (now >= 0).any():
        met = np.where(now[:, None] >= 0, up[now], -1)
        steps.append(met)
        now = np.where(met[:, 0] >= 0, n + met[:, 0], -1)
    steps = np.stack(steps[:-1], axis=1) if len(steps) > 1 else np.zeros((n, 0, 2), np.int64)
    depth = (steps[:, :, 0] >= 0).sum(1)
    path, branch = np.zeros((n, depth.max(initial=0)), np.int32), np.zeros((n, depth.max(initial=0)), np.int8)
    for d in range(path.shape[1]):  # from the root down
        has = np.flatnonzero(depth > d)
        path[has, d], branch[has, d] = steps[has, depth[has] - 1 - d].T
    return Tree(words, counts, path, branch, depth.astype(np.int8), np.array(shares, np.float32).reshape(-1, FAN), mix(np.arange(1, at + 1, dtype=np.uint64)), mass)


def history(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Feature hashes (features by tokens) of a run of documents; starts: the distance of each token from its first one."""
    back = []
    for k in (1, 2, 3):
        b = np.zeros_like(h)
        b[k:] = h[:-k]
        b[starts < k] = 0
        back.append(b)
    seed = [np.uint64(0x9E3779B97F4A7C15 * k & (2**64 - 1)) for k in range(1, FEATURES + 1)]
    return np.stack([mix(x) for x in (back[0] + seed[0], mix(back[0] + seed[1]) + back[1], back[1] + seed[2], back[2] + seed[3])])


def _row_numbers(features: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """The weight row of each feature (features by tokens) in the class of each token, whose key is given."""
    return ((features ^ keys) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)


def _powers(w: np.ndarray, rows: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Exponentials of the branches' sums, held below e^60."""
    part = np.empty_like(shares)
    for r in rows:
        shares += np.take(w, r, axis=0, out=part, mode="clip")
    np.minimum(shares, 60, out=shares)
    return np.exp(shares, out=shares)


def _steps(tree: Tree, bits: int, symbols: np.ndarray, features: np.ndarray):
    """At each depth: the tokens that get so far, their class, branch and weight rows."""
    depth = tree.depth[symbols]
    for d in range(tree.path.shape[1]):
        has = np.flatnonzero(depth > d)
        if not len(has):
            break
        y = symbols[has]
        node = tree.path[y, d]
        yield has, node, tree.branch[y, d], _row_numbers(features[:, has], tree.keys[node], bits)


def log_shares(tree: Tree, w: np.ndarray, bits: int, symbols: np.ndarray, features: np.ndarray) -> np.ndarray:
    """log10 P(leaf | history) of each token's leaf."""
    out, ones = np.zeros(len(symbols)), np.ones(FAN, np.float32)
    for has, node, branch, rows in _steps(tree, bits, symbols, features):
        z = _powers(w, rows, tree.shares[node])
        out[has] += np.log10(np.maximum(z[np.arange(len(has)), branch], 1e-30) / (z @ ones))
    return out


def descend(tree: Tree, w: np.ndarray, used: np.ndarray, square: np.ndarray, bits: int, symbols: np.ndarray, features: np.ndarray, rate: float) -> None:
    """A gradient step on w for a batch of tokens, at each depth of the tree. A row's step shrinks with the squares of its
    gradients so far, in square; used counts the tokens of each row."""
    # pairs of branches as one complex number: the same sums with half the indices
    flat, column, ones = w.reshape(-1).view(np.complex64), np.arange(FAN // 2), np.ones(FAN, np.float32)
    for has, node, branch, rows in _steps(tree, bits, symbols, features):
        g = _powers(w, rows, tree.shares[node])
        g /= (g @ ones)[:, None]
        g[np.arange(len(has)), branch] -= 1
        size = np.einsum("ij,ij->i", g, g) / FAN
        n = np.bincount(rows.reshape(-1), minlength=len(used)).astype(np.float32)
        for r in rows:
            np.add.at(square, r, size)
        for r in rows:
            np.add.at(flat, ((r * (FAN // 2))[:, None] + column).reshape(-1), (g * (np.float32(-rate) / np.sqrt(square[r] * n[r]))[:, None]).reshape(-1).view(np.complex64))
        used += n


def _piece(ids: list, size: list, places: np.ndarray) -> bytes:
    """Documents as one compressed value: ids, sizes, and the place of each token among the block's distinct words."""
    rows, tokens, sink = pa.record_batch([pa.array(ids, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "size"]), pa.record_batch([pa.array(places.astype(np.uint32))], ["place"]), pa.BufferOutputStream()
    for part in (rows, tokens):
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(part)
    return sink.getvalue().to_pybytes()


def _opened(piece: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, each token's place among the block's distinct words and distance from its document's start, and the sizes."""
    source = pa.BufferReader(piece)
    rows, tokens = (pa.ipc.open_stream(source).read_all() for _ in range(2))
    size = rows["size"].to_numpy()
    first = np.repeat(np.cumsum(size) - size, size)
    return rows["doc_id"].combine_chunks(), tokens["place"].to_numpy().astype(np.int64), np.arange(len(first)) - first, size


def _distinct(h: np.ndarray):
    """np.unique with places and counts; only distinct values are sorted."""
    coded = pa.array(h).dictionary_encode()
    words = coded.dictionary.to_numpy()
    order = np.argsort(words)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    places = rank[coded.indices.to_numpy()]
    return words[order], places, np.bincount(places)


PAGES = "page long, used binary, w binary"
BLOCK = "block long, part int, docs binary, words binary, times binary"


def _blocked(rounds: int, most: int):
    """(doc_id, held, text) -> a row for each block: its documents, its distinct words and how often it has each.

    Training documents are dealt to the rounds in turn; the rest is part `rounds`. A block ends at `most` tokens."""
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("docs", pa.binary()), ("words", pa.binary()), ("times", pa.binary())])

    def run(batches):
        held = {p: ([], []) for p in range(rounds + 1)}
        size, task, made, turn = dict.fromkeys(held, 0), TaskContext.get().partitionId() << 32, 0, 0

        def flush(part):
            nonlocal made
            ids, docs = held[part]
            k, places, n = _distinct(np.concatenate(docs))
            yield pa.RecordBatch.from_pydict({"block": [task + made], "part": [part], "docs": [_piece(ids, [len(d) for d in docs], places)], "words": [k.tobytes()], "times": [n.astype(np.uint32).tobytes()]}, schema)
            made, held[part], size[part] = made + 1, ([], []), 0

        for b in batches:
            for id_, apart_, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                part = rounds if apart_ else turn % rounds
                turn += not apart_
                tokens = token_hashes(text)
                held[part][0].append(id_)
                held[part][1].append(tokens)
                size[part] += len(tokens)
                if size[part] >= most:
                    yield from flush(part)
        for part in held:
            if held[part][0]:
                yield from flush(part)

    return run


def _listed(own: np.ndarray):
    """(block, words, times) -> a row for each word of each block that is not one of `own`, which are in order."""

    def run(batches):
        for b in batches:
            for block, words, times in zip(*(b.column(i).to_pylist() for i in range(3))):
                k, n = np.frombuffer(words, np.uint64), np.frombuffer(times, np.uint32)
                if len(own):
                    rest = own[np.minimum(np.searchsorted(own, k), len(own) - 1)] != k
                    k, n = k[rest], n[rest]
                for s in range(0, len(k), 1 << 16):
                    some = k[s : s + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(as_long(some)), pa.array(n[s : s + (1 << 16)].astype(np.int64))], ["block", "k", "n"])

    return run


def _slices(size: np.ndarray, most: int):
    """Runs [first, last) of documents and of their tokens, of at most `most` tokens unless a document alone has more."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        low = int(ends[at - 1]) if at else 0
        last = max(at + 1, int(np.searchsorted(ends, low + most, "right")))
        yield at, last, low, int(ends[last - 1])
        at = last


def _pages(w: np.ndarray, used: np.ndarray) -> pa.Table:
    """Weights as pages of half floats, with the use of each row."""
    at = range(0, len(w), PAGE)
    return pa.table({"page": pa.array(np.arange(len(at))), "used": pa.array([used[i : i + PAGE].tobytes() for i in at], pa.binary()), "w": pa.array([w[i : i + PAGE].astype(np.float16).tobytes() for i in at], pa.binary())})


def _weights(pages, values, bits: int) -> np.ndarray:
    w = np.zeros((1 << bits, FAN), np.float32)
    for p, v in zip(pages.to_pylist(), values.to_pylist()):
        if v is not None:
            w[p * PAGE : (p + 1) * PAGE] = np.frombuffer(v, np.float16).reshape(-1, FAN)
    return w


def _trained(tree: Tree, bits: int, rate: float):
    def run(docs, given):
        w = _weights(given["page"], given["w"], bits)
        before, used, square = w.copy(), np.zeros(len(w), np.float32), np.full(len(w), 1e-6, np.float32)
        for piece, words in zip(docs["docs"].to_pylist(), docs["words"].to_pylist()):
            _, places, starts, size = _opened(piece)
            words = np.frombuffer(words, np.uint64)
            symbols, batch = tree.symbols(words), min(CHUNK, max(LEAST_BATCH, len(places) // STEPS))
            for _, _, low, high in _slices(size, SLICE):
                of = places[low:high]
                y, features = symbols[of], history(words[of], starts[low:high])
                for s in range(0, len(of), batch):
                    descend(tree, w, used, square, bits, y[s : s + batch], features[:, s : s + batch], rate)
        return _pages(w - before, used)

    return run


def _averaged(t: pa.Table) -> pa.Table:
    """Changes of one page -> their mean by use, with the sum of their uses."""
    used = np.stack([np.frombuffer(x, np.float32) for x in t["used"].to_pylist()])
    w = np.stack([np.frombuffer(x, np.float16).reshape(-1, FAN) for x in t["w"].to_pylist()]).astype(np.float32)
    total = used.sum(0)
    mean = np.einsum("bp,bpf->pf", used, w) / np.maximum(total, 1)[:, None]
    return pa.table({"page": t["page"].slice(0, 1), "used": pa.array([total.tobytes()], pa.binary()), "w": pa.array([mean.astype(np.float16).tobytes()], pa.binary())})


def _added(t: pa.Table) -> pa.Table:
    """Weights plus the mean change of a page; weights stand as rows of no use at all."""
    old = [x for x, u in zip(t["w"].to_pylist(), t["used"].to_pylist()) if u is None]
    new = t.filter(pa.compute.is_valid(t["used"]))
    w = np.frombuffer(old[0], np.float16).astype(np.float32) if old else 0
    if new.num_rows:
        w = w + np.frombuffer(_averaged(new)["w"][0].as_py(), np.float16).astype(np.float32)
    return pa.table({"page": t["page"].slice(0, 1), "used": pa.array([None], pa.binary()), "w": pa.array([np.asarray(w).astype(np.float16).tobytes()], pa.binary())})


def _for_each(blocks: DataFrame, weights: DataFrame, bits: int) -> DataFrame:
    """block, page, w: the pages of the weights for each of the blocks."""
    asked = blocks.select("block").withColumn("page", F.explode(F.sequence(F.lit(0), F.lit((1 << bits) // PAGE - 1)).cast("array<bigint>")))
    return asked.join(weights.select("page", "w"), "page").select("block", "page", "w")


def train(blocks: DataFrame, tree: Tree, bits: int, rounds: int = 3, rate: float = 0.1) -> DataFrame:
    """page, used, w: all weights after one pass over blocks(block, part, docs, words) with 0 <= part < rounds, a part in each round."""
    weights = blocks.sparkSession.createDataFrame([], PAGES)
    for turn in range(rounds):
        mine = blocks.where(F.col("part") == turn).select("block", "docs", "words")
        change = mine.groupBy("block").cogroup(apart(_for_each(mine, weights, bits)).groupBy("block")).applyInArrow(_trained(tree, bits, rate), PAGES)
        # first within one of 16 shares of the blocks, so that no group grows with their number alone
        change = change.withColumn("share", F.pmod(F.xxhash64("used"), F.lit(16))).groupBy("page", "share").applyInArrow(lambda t: _averaged(t), PAGES)
        weights = cut(weights.unionByName(change).groupBy("page").applyInArrow(lambda t: _added(t), PAGES), "weights")
    return weights


def _scored(tree: Tree, bits: int, n: float, v: int, unseen: float, held: int):
    """unseen: the share of words never seen; n, v: training tokens and distinct words; held: the part that was kept out."""
    base_of = lambda c: np.log10((c + SMOOTH) / (n + SMOOTH * (v + 1)))

    def run(docs, given):
        is_page = pa.compute.is_valid(docs["page"])
        pages, docs = docs.filter(is_page), docs.filter(pa.compute.invert(is_page))
        w = _weights(pages["page"], pages["w"], bits)
        k, n_of = given["k"].to_numpy().view(np.uint64), given["n"].to_numpy().astype(np.float64)
        order = np.argsort(k)
        k, n_of, out = k[order], n_of[order], []
        own = len(tree.words)
        for part, piece, words in zip(*(docs[c].to_pylist() for c in ("part", "docs", "words"))):
            ids, places, starts, size = _opened(piece)
            words = np.frombuffer(words, np.uint64)
            symbols = tree.symbols(words)
            count = np.append(tree.counts, np.zeros(SHARED))[symbols]
            rest = np.flatnonzero(symbols >= own)
            if len(rest) and len(k):
                at = np.minimum(np.searchsorted(k, words[rest]), len(k) - 1)
                count[rest] = np.where(k[at] == words[rest], n_of[at], 0)
            inside = np.zeros(len(words))
            inside[rest] = np.log10(np.maximum(count[rest], 1) / np.maximum(tree.mass[symbols[rest] - own], 1))
            base = base_of(count)
            for at, last, low, high in _slices(size, SLICE):
                of = places[low:high]
                y, features = symbols[of], history(words[of], starts[low:high])
                model = np.concatenate([log_shares(tree, w, bits, y[s : s + CHUNK], features[:, s : s + CHUNK]) for s in range(0, len(of), CHUNK)])
                model = np.where(count[of] > 0, model + inside[of] + math.log10(max(1 - unseen, 1e-30)), math.log10(unseen))
                first = np.cumsum(size[at:last]) - size[at:last]
                sums = [np.add.reduceat(x, first) for x in ((count[of] > 0).astype(np.int64), base[of], model)]
                out.append(pa.table([ids.slice(at, last - at), pa.array(np.full(last - at, part == held)), pa.array(size[at:last]), *map(pa.array, sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out)

    return run


def row_bits(size: int) -> int:
    """log2 of the number of weight rows: four times the root of the number of tokens, six bytes each."""
    return (max(math.ceil(4 * math.sqrt(size / 6)), LEAST_ROWS) - 1).bit_length()


def score_texts(docs: DataFrame, folds: int = 10, held: int = 0, rounds: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs(doc_id, text, ...).

    Learns from the documents whose crc32(doc_id) mod `folds` is not `held`. Null texts are empty and consist of the end
    token alone; a null doc_id counts as the empty text in the remainder; repeated rows are scored each; other columns are
    ignored; an empty table gives no rows, and without a training document every token is an unseen one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    bits = row_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    made = cut(docs.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held).alias("held"), "text").mapInArrow(_blocked(rounds, 32 << bits), BLOCK), "blocks")
    blocks = made.select("block", "part", "docs", "words")
    listed = lambda own, which: made.where(which).select("block", "words", "times").mapInArrow(_listed(own), "block long, k long, n long")
    counts = cut(listed(np.empty(0, np.uint64), F.col("part") < rounds).groupBy("k").agg(F.sum("n").alias("n")), "counts")
    n, v, once = (x or 0 for x in counts.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1)).first())
    own = counts.where(F.col("n") * HEADS >= n)
    heads = own.toPandas()  # at most HEADS rows: each has that share of the tokens
    rest = counts.join(F.broadcast(own.select("k")), "k", "left_anti")
    mass = np.zeros(SHARED)
    for r in rest.groupBy(shared_leaf("k").alias("leaf")).agg(F.sum("n").alias("n")).collect():  # a row for each shared leaf
        mass[r["leaf"]] = r["n"]
    tree = grow_tree(heads["k"].to_numpy(np.int64).view(np.uint64), heads["n"].to_numpy(), mass)
    weights = train(blocks, tree, bits, rounds)

    words = listed(tree.words, F.lit(True)).select("block", "k").join(rest, "k").select("block", "k", "n")
    whole = blocks.unionByName(_for_each(blocks, weights, bits), allowMissingColumns=True)
    out = whole.groupBy("block").cogroup(apart(words).groupBy("block")).applyInArrow(_scored(tree, bits, float(n), v, (once + 1) / (n + 1), rounds), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
