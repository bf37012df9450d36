"""Text operators against brute force, with nulls, empties, copies and foreign columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from burstlake.llm import lm, minhash, mixing, packing, quality, suffix, toxicity
from burstlake.llm.calibrate import fit_logistic
from burstlake.llm.queries import WORD_BPE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, id string, spans int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i is None else f"s{i % 3}", len(t or ""), 7, "x", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(120)
    out = [(i, text(r.randint(1, 300))) for i in range(40)]
    out += [(40 + i, text(40) + " " + passage + " " + text(30)) for i in range(6)]
    base = text(150).split()
    for i in range(8):
        words = list(base)
        for _ in range(i % 4):
            words[r.randrange(len(words))] = word()
        out.append((60 + i, " ".join(words)))
    out += [(80, None), (81, ""), (82, "   \n"), (83, "one"), (84, "one two"), (85, "One  TWO"), (86, "aa " * 900), (87, "x" * 1500), (88, passage), (None, passage), (90, out[0][1]), (91, "y" * 399), (92, "y" * 399)]
    return out


def test_suffix_against_brute_force(spark, rows):
    length, data = 400, [(t or "").encode() for _, t in rows]
    count = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    runs = Counter(tuple(w[k : k + 50]) for w in (b.lower().split() for b in data) for k in range(len(w) - 49))
    want = []
    for (i, _), b in zip(rows, data):
        words = b.lower().split()
        shared = {j for k in range(len(words) - 49) if runs[tuple(words[k : k + 50])] > 1 for j in range(k, k + 50)}
        cover = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                cover[k : k + length] = True
        kept = bytes(x for x, c in zip(b, cover) if not c)
        want.append((i, len(b), int(cover.sum()), int((np.diff(cover.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), len(shared)))
    for crowd in (4096, 1):  # by suffix order, and window by window
        got = suffix.repeat_digests(docs_of(spark, rows), words=50, crowd=crowd).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, suffix.repeat_digests(docs_of(spark, rows)).collect()), key=str) == sorted((w[:-1] for w in want), key=str)
    assert any(w[2] for w in want) and any(w[5] for w in want)


def test_passages_of_55_words_go_and_clean_texts_stay(spark):
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choice("abcde") for _ in range(r.randint(2, 6))) for _ in range(n))
    passage = text(55)
    own = [text(120) for _ in range(6)]
    planted = {1: f"{own[0]} {passage} {own[1]}", 2: f"{passage}\n{own[2]}", 3: f"{own[3]} {passage.upper()}"}
    clean = {4: own[4], 5: f"{own[5]} {' '.join(passage.split()[:49])}", 6: "", 7: None}
    d = docs_of(spark, [*planted.items(), *clean.items()]).withColumns({"id": F.lit(1), "_id": F.lit(2), "fp": F.lit("x"), "Spans": F.lit(0)})
    out = suffix.remove_repeats(d, words=50)
    assert out.columns == d.columns
    got = {r.doc_id: r for r in out.collect()}
    assert all(passage not in got[i].text.lower() for i in planted)
    assert [got[i].text.split() for i in (1, 2, 3)] == [own[0].split() + own[1].split(), own[2].split(), own[3].split()]
    assert {i: got[i].text for i in clean} == clean and {(r.id, r._id, r.fp, r.Spans) for r in got.values()} == {(1, 2, "x", 0)}


def test_suffix_stage_keeps_columns_and_characters(spark, rows):
    d = docs_of(spark, rows)
    out = suffix.remove_repeats(d)
    assert out.columns == d.columns and out.count() == len(rows)
    assert all(r.text is None or r.n_chars == len(r.text) for r in out.collect())


def near(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    of = list(range(len(rows)))

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                of[top(a)] = top(b)
    name = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            name[top(a)] = min(i, name.get(top(a), i))
    return [(i, len(sets[a]), name.get(top(a)), (i == name.get(top(a)))) for a, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_minhash_against_brute_force(spark, rows, k, percent):
    got = minhash.near_duplicates(docs_of(spark, rows), k, percent).collect()
    assert sorted(map(tuple, got), key=str) == sorted(near(rows, k, percent), key=str)


def test_minhash_families_are_compared_across_blocks(spark):
    """A chain of near copies that no single pivot links: blocks of two must find all of it."""
    r = random.Random(5)
    words = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        for _ in range(3):
            words[r.randrange(200)] = f"n{r.randrange(10**6)}"
    got = minhash.near_duplicates(docs_of(spark, rows), 3, 85, block=2).collect()
    assert sorted(map(tuple, got)) == sorted(near(rows, 3, 85))


def test_pieces_are_the_tokenizers_ids(spark, rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(WORD_BPE)
    odd = ["<|endoftext|> x", "A\tb c", "İSTANBUL", "ΣΑΣ. Σ", "école É 'S it's we'RE", "日本語、です。", "क़क़", "don't!'s 'tis ...###", "a\x1cb", "ﬁ ßẞ ǅ"]
    for t in odd + [t for _, t in rows]:
        assert packing.token_ids(WORD_BPE, t).tolist() == tk.encode(t or "", add_special_tokens=False).ids
    got = packing.pack_documents(docs_of(spark, rows), WORD_BPE, most=128, group=16).toPandas()
    assert len(got[got.doc_id == 80]) == 1 and got[got.doc_id == 80].length.tolist() == [1]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 128
    ids = np.array(tk.encode(rows[3][1], add_special_tokens=False).ids + [0], "<u4")
    mine = got[got.doc_id == 3].sort_values("piece")
    assert mine.ids_crc32.tolist() == [zlib.crc32(ids[k : k + 128].tobytes()) for k in range(0, len(ids), 128)]


def test_bounds_certify_packings():
    r = np.random.default_rng(1)
    for high in (2048, 900, 300):
        n = r.integers(1, high + 1, 400)
        where, offset, fills = packing.best_fit_decreasing(n, 2048)
        assert packing.lower_bound(n, 2048) <= len(fills) <= 1.25 * packing.lower_bound(n, 2048) and fills.max() <= 2048
        assert np.bincount(where, weights=n).tolist() == fills.tolist()
    assert packing.lower_bound(np.array([1025] * 7), 2048) == 7


def test_sequences_hold_every_id(spark, rows):
    d = docs_of(spark, rows[:20])
    total = sum(len(packing.token_ids(WORD_BPE, t)) + 1 for _, t in rows[:20])
    assert packing.sequences(d, WORD_BPE, 64).agg(F.sum(F.size("ids"))).first()[0] == total


def test_mixing_means_and_order(spark):
    rows = [(i, "abcd" * (1 + i % 3)) for i in range(3000)] + [(None, None)]
    d = docs_of(spark, rows)
    out = mixing.mix_sources(d, {"s0": 3.0, "s1": 1.0}).toPandas()
    size = out.text.str.len().groupby(out.source).sum()
    assert set(size.index) == {"s0", "s1"} and 2.6 < size["s0"] / size["s1"] < 3.4
    assert out.shuffle_key.is_monotonic_increasing and (out["copy"] <= out.n_copies).all()
    again = mixing.mix_sources(d, {"s0": 3.0, "s1": 1.0}).toPandas()
    assert out.equals(again)
    many = mixing.mix_sources(d.where("source = 's0'"), {"s0": 1.0}, epochs=600).groupBy().count().first()[0]
    assert abs(many / (1000 * 600) - 1) < 0.01


def test_segments_are_maximal():
    s = np.array([1, -3, 2, -1, 3, -9, 1.0])
    assert toxicity.segments(s) == [(0, 1, 1.0), (2, 5, 4.0), (6, 7, 1.0)] and toxicity.segments(np.array([-1.0])) == []


def labelled(spark, column, n=400):
    r = random.Random(8)
    good = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        y = int(i % 3 == 0)
        words = [r.choice(good) for _ in range(80)]
        if y:
            for k in range(0, 80, 8):
                words[k] = r.choice(["vile", "nasty", "foul"]) if column == "toxic" else "$$$###$$$"
        rows.append((i, " ".join(words)))
        labels.append((i, y if column == "toxic" else 1 - y))
    rows += [(1000, None), (1001, ""), (None, "vile")]
    return docs_of(spark, rows), spark.createDataFrame(labels + [(None, 1), (5000, None)], f"doc_id long, {column} int"), dict(labels)


@pytest.mark.parametrize("column,score", [("toxic", toxicity.score_toxicity), ("quality", quality.score_quality)])
def test_classifiers_hold_out(spark, column, score):
    docs, labels, y = labelled(spark, column)
    got = [r for r in score(docs, labels).collect()]
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    test = [r for r in got if r.held_out and r.doc_id in y]
    assert sum(r.predicted == y[r.doc_id] for r in test) / len(test) > 0.95
    folds, held = (5, 0) if column == "toxic" else (3, 1)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % folds == held) for r in got)
    assert score(docs.limit(0), labels).count() == 0
    assert len({r.score for r in score(docs, labels.where("false")).collect()}) == 1


def test_language_model_base_and_gain(spark, rows):
    import math

    got = {r.doc_id: r for r in lm.score_texts(docs_of(spark, rows)).collect()}
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in rows}
    key = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10
    c = Counter(w for i, t in tokens.items() if key(i) for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c[w] > 0 for w in t), n, key(i) == 0)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values()) and all(r.score < 0 for r in got.values())


def test_empty_tables(spark):
    d = docs_of(spark, [(1, "a")]).limit(0)
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, toxic int, quality int")
    for out in (suffix.repeat_digests(d), minhash.near_duplicates(d), packing.pack_documents(d, WORD_BPE), mixing.mix_sources(d), lm.score_texts(d), toxicity.score_toxicity(d, labels), quality.score_quality(d, labels)):
        assert out.count() == 0


def test_weight_rows_grow_with_the_corpus():
    assert lm.row_bits(0) == 15 and [lm.row_bits(6 * 4**k) for k in (14, 16, 20, 30)] == [16, 18, 22, 32]


def small_tree(monkeypatch, r):
    monkeypatch.setattr(lm, "SHARED", 8)
    words = np.unique(r.integers(1, 2**63, 60).astype(np.uint64))
    return words, lm.grow_tree(words[:40], r.integers(1, 500, 40), np.array([0, 7, 3, 0, 1, 90, 2, 4]))


def test_leaves_sum_to_one_after_any_history(monkeypatch):
    """Whatever the weights are; leaves without tokens get nothing."""
    r = np.random.default_rng(1)
    _, tree = small_tree(monkeypatch, r)
    w, leaves = r.normal(size=(1 << 15, lm.FAN)).astype(np.float32), np.arange(48)
    for _ in range(5):
        features = np.repeat(r.integers(0, 2**63, (lm.FEATURES, 1)).astype(np.uint64), 48, axis=1)
        p = 10 ** lm.log_shares(tree, w, 15, leaves, features)
        assert p.sum() == pytest.approx(1, abs=1e-5) and p[40] + p[43] < 1e-20
    none = 10 ** lm.log_shares(tree, 0 * w, 15, leaves, features)
    weight = np.concatenate([tree.counts, tree.mass])
    assert none == pytest.approx(weight / weight.sum(), abs=1e-6)


def test_scores_against_plain_sums(monkeypatch):
    """Two documents: words with leaves of their own, shared ones and unseen ones, against a loop over tokens and classes."""
    import math

    import pyarrow as pa

    r = np.random.default_rng(2)
    words, tree = small_tree(monkeypatch, r)
    w, docs, n, v, unseen = r.normal(size=(1 << 15, lm.FAN)).astype(np.float16).astype(np.float32), [words[[1, 45, 3, 59, 1]], words[[50, 2]]], 900.0, 50, 0.1
    rest = {int(k): 2 for k in words[40:55] if tree.mass[int(k) >> 20 & 7]}
    k, places = np.unique(np.concatenate(docs), return_inverse=True)
    pages = lm._pages(w, np.zeros(len(w), np.float32))
    none = [None] * len(pages)
    block = pa.table({"part": [3, *none], "docs": [lm._piece([7, None], [5, 2], places), *none], "words": [k.tobytes(), *none], "page": [None, *pages["page"].to_pylist()], "w": [None, *pages["w"].to_pylist()]})
    given = pa.table({"k": [x - (x >> 63 << 64) for x in rest], "n": list(rest.values())})
    monkeypatch.setattr(lm, "SLICE", 4)
    got = lm._scored(tree, 15, n, v, unseen, 3)(block, given).to_pylist()
    for row, h in zip(got, docs):
        base = score = known = 0.0
        features = lm.history(h, np.arange(len(h)))
        for i, x in enumerate(h):
            own = list(words[:40]).index(x) if x in words[:40] else None
            c = tree.counts[own] if own is not None else rest.get(int(x), 0)
            leaf = own if own is not None else 40 + (int(x) >> 20 & 7)
            known, base = known + (c > 0), base + math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            p = 1.0
            for d in range(tree.depth[leaf]):
                node = tree.path[leaf, d]
                z = tree.shares[node].astype(float)
                for f in features[:, i]:
                    z = z + w[((int(f) ^ int(tree.keys[node])) * 0xD6E8FEB86659FD93 % 2**64) >> 49]
                p *= math.exp(z[tree.branch[leaf, d]]) / np.exp(z).sum()
            score += math.log10(unseen if not c else (1 - unseen) * p * (1 if own is not None else c / tree.mass[leaf - 40]))
        assert (row["n_tokens"], row["n_known"], row["held_out"]) == (len(h), known, True)
        assert row["base_score"] == pytest.approx(base) and row["score"] == pytest.approx(score, rel=1e-4)
    assert [row["doc_id"] for row in got] == [7, None]


def test_more_blocks_than_one_and_no_training_document(spark, rows, monkeypatch):
    """Small blocks change neither counts nor base scores; where nothing is learnt from, every token is an unseen one."""
    want = {r.doc_id: r[1:6] for r in lm.score_texts(docs_of(spark, rows)).collect()}
    blocked = lm._blocked
    monkeypatch.setattr(lm, "_blocked", lambda rounds, most: blocked(rounds, 400))
    got = lm.score_texts(docs_of(spark, rows)).collect()
    assert {r.doc_id: tuple(r[1:5]) for r in got} == {i: tuple(x[:4]) for i, x in want.items()} and len(got) == len(rows)
    assert all(r.base_score == pytest.approx(want[r.doc_id][4]) for r in got)
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = lm.score_texts(docs_of(spark, [(alone, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0)


def test_the_word_before_acts_inside_a_class(spark):
    """abx and aby are equally frequent, of one class, and end texts; abx follows p, aby follows q."""
    rows = [(i, "q aby" if i % 2 else "p abx") for i in range(400)]
    held = [i for i in range(10_000, 11_000) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    got = {r.doc_id: r.score for r in lm.score_texts(docs_of(spark, [*rows, *zip(held, ("p abx", "p aby", "q aby", "q abx"))])).collect()}
    assert got[held[0]] > got[held[1]] + 1 and got[held[2]] > got[held[3]] + 1


def test_rows_without_ids_and_repeated_rows(spark):
    """A thousand rows share a null id and two texts; ids on several texts; columns with the names used inside."""
    r = random.Random(11)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    one, two, own = text(30), text(40), [text(25) for _ in range(6)]
    rows = [(None, one)] * 600 + [(None, two)] * 400 + [(1, own[0]), (1, own[1]), (1, own[1]), (2, own[1]), (3, own[2]), (4, own[2] + " x"), (5, None), (6, ""), (None, None)]
    d = docs_of(spark, rows).withColumns({"fp": F.lit(1), "Times": F.lit(2), "stays": F.lit(3), "of_source": F.lit(4), "cdf": F.lit(5), "parts": F.lit(6)})
    kept = minhash.keep_one(d)
    assert kept.columns == d.columns
    assert Counter((x.doc_id, x.text) for x in kept.collect()) == Counter([(None, one), (None, two), (1, own[0]), (1, own[1]), (3, own[2]), (5, None), (6, ""), (None, None)])
    packed = packing.pack_documents(d, WORD_BPE, 64, group=128).collect()
    assert len({x.sequence_id >> 24 for x in packed}) > 4 and len(packed) >= len(rows)
    assert packing.sequences(d, WORD_BPE, 64).agg(F.sum(F.size("ids"))).first()[0] == sum(x.length for x in packed)
    mixed = mixing.mix_sources(d)
    assert mixed.columns == [*d.columns, "n_copies", "copy", "shuffle_key"] and {(x.of_source, x.cdf, x.parts) for x in mixed.collect()} == {(4, 5, 6)}
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(1000, 1400)], "doc_id long, quality int, toxic int")
    known = docs_of(spark, [(i, text(20) + (" vile vilest" * 6 if i % 4 == 0 else "")) for i in range(1000, 1400)])
    bad = docs_of(spark, [(None, own[4] + " vile vilest" * 6), (1, own[3] + " vile vilest" * 6), (1, own[5])])
    left = toxicity.reject_toxic(known.unionByName(bad).withColumn("FP", F.lit(1)), labels)
    assert [(x.doc_id, x.text) for x in left.where("doc_id < 1000 or doc_id is null").collect()] == [(1, own[5])]


def maximal(scores):
    """All maximal-scoring segments by their definition: the best one, then those left and right of it."""
    best = max(((sum(scores[i:j]), i - j, -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i = -best[2]
    j = i - best[1]
    return [*maximal(scores[:i]), (i, j, best[0]), *((j + a, j + b, s) for a, b, s in maximal(scores[j:]))]


def test_segments_against_their_definition():
    r = random.Random(2)
    assert toxicity.segments(np.array([])) == toxicity.segments(np.array([-1.0, 0.0])) == []
    for _ in range(300):
        scores = [r.randint(-9, 6) + r.random() for _ in range(r.randint(1, 25))]  # without ties
        got = toxicity.segments(np.array(scores))
        assert [x[:2] for x in got] == [x[:2] for x in maximal(scores)] and all(s == pytest.approx(t[2]) for (_, _, s), t in zip(got, maximal(scores)))


def test_toxic_weights_against_plain_counts(spark):
    """Bare words only, so a word of up to four letters is one feature."""
    import xxhash

    r = random.Random(4)
    texts = [(" ".join(r.choice(("vile", "ugly") if y and r.random() < 0.4 else ("sun", "sea", "tree", "rock", "ugly")) for _ in range(40)), y) for y in [0, 1] * 60]
    n = [Counter(w for t, z in texts if z == y for w in t.split()) for y in (0, 1)]
    total, want = [sum(c.values()) for c in n], {}
    for w in n[0] | n[1]:
        a = (n[0][w] + n[1][w]) * 500 / sum(total) + 0.5
        delta = np.log((n[1][w] + a) / (total[1] + 500)) - np.log((n[0][w] + a) / (total[0] + 500))
        error = np.sqrt(1 / (n[1][w] + a) + 1 / (n[0][w] + a))
        if delta > toxicity.CERTAIN * error and delta - error > toxicity.DRIFT:
            want[xxhash.xxh3_64_intdigest(w.encode(), seed=1)] = delta - error
    features, weights = toxicity.fit_weights(spark.createDataFrame([(t, y, 1.0) for t, y in texts], "text string, y int, share double"))
    assert want and dict(zip(features.tolist(), weights.tolist())) == pytest.approx(want, abs=1e-5)


def test_extreme_values_find_a_gumbel():
    r = np.random.default_rng(3)
    n = r.integers(10, 1000, 20_000)
    best = (np.log(n) + np.log(0.2) + r.gumbel(size=len(n))) / 0.7  # lambda 0.7, K 0.2
    rate, log_k = toxicity.extreme_values(np.full(20_000, 100), (np.log(100) + np.log(0.2) + r.gumbel(size=20_000)) / 0.7)
    assert rate == pytest.approx(0.7, rel=0.03) and log_k == pytest.approx(np.log(0.2), abs=0.15) and len(best)


def test_compressed_sizes_and_halves(spark):
    """Sizes equal those of the compressor itself; what a dictionary is built from is bounded in bytes."""
    import zstandard

    r = random.Random(6)
    good, bad = (" ".join(r.choice(w) for _ in range(3000)).encode() for w in (("alpha", "beta", "gamma"), ("x1", "y2", "zz")))
    texts = ["alpha beta gamma " * 20, "x1 zz y2 " * 20, "", "é" * 50]
    import pyarrow as pa

    (got,) = quality._sized(good, bad)([pa.record_batch([pa.array(range(4)), pa.array(texts)], ["doc_id", "text"])])
    for t, d in zip(texts, got["difference"].to_pylist()):
        size = [len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_dict_id=False).compress(t.encode())) for x in (good, bad)]
        assert d == pytest.approx((size[1] - size[0]) / (len(t.encode()) + 1))
    assert got["difference"][0].as_py() > 0 > got["difference"][1].as_py()


def test_whole_quality_score_by_hand(spark, monkeypatch):
    """Every step from the choice of the dictionaries' texts to the score; a text longer than all that a dictionary takes and a
    null one come first by hash and take no place."""
    most = 4000
    monkeypatch.setattr(quality, "TEXT_BYTES", most)
    r = random.Random(8)
    good = lambda: " ".join(r.choice(("river", "stone", "window", "garden", "letter", "music")) for _ in range(r.randint(20, 60)))
    bad = lambda: "".join(r.choice("xqzkw ") for _ in range(r.randint(100, 300)))
    label, texts = {i: int(i % 3 > 0) for i in range(240)}, {i: good() if i % 3 else bad() for i in range(240)}
    hashed = {x.id: x for x in spark.range(240).select("id", F.xxhash64("id").alias("h"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2)).alias("half")).collect()}
    known = sorted((i for i in texts if zlib.crc32(str(i).encode()) % 3 != 1), key=lambda i: hashed[i].h)
    first = [i for i in known if label[i] and hashed[i].half == 0][:2]
    texts |= dict(zip(first, ("long " * 1000, None)))

    dictionaries = []
    for y in (1, 0):
        taken, upto = [], 0
        for i in known:
            n = len((texts[i] or "").encode())
            if label[i] == y and hashed[i].half == 0 and texts[i] is not None and n <= most:
                upto += n
                taken += [texts[i].encode()] if upto <= most else []
        assert taken
        dictionaries.append(quality.build_dictionary(sorted(taken)))
    press = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in dictionaries]
    x = {}
    for i, t in texts.items():
        data = (t or "").encode()
        g, w = (len(p.compress(data)) for p in press)
        x[i] = [(w - g) / (len(data) + 1), min(g, w) / (len(data) + 1), np.log1p(len(data)), (w - g) / max(g, w, 1)]
    fit = [i for i in known if hashed[i].half == 1]
    model = fit_logistic(np.array([x[i] for i in fit]), np.array([label[i] for i in fit], float))
    labels = spark.createDataFrame(list(label.items()), "doc_id long, quality int")
    got = quality.score_quality(docs_of(spark, list(texts.items())), labels).collect()
    assert len(got) == 240
    for row in got:
        total = model["bias"] + sum(w * (v - m) / s for v, m, s, w in zip(x[row.doc_id], model["mean"], model["scale"], model["weights"]))
        want = 1 / (1 + np.exp(-total))
        assert row.score == pytest.approx(want, abs=1e-6) and row.predicted == int(row.score >= 0.5) and row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
