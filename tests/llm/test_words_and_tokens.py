"""Token counts, spelling variants and source divergence against brute force and SQL, with nulls, empties, ties and hot groups."""

import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from burstlake.llm import divergence, spelling, token_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, word string, n int, term string, tokens int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0, 1, "x", 2, "y", 3) for i, t, lang, source in rows], SCHEMA)


def library_count(text, library=Tokenizer.from_file(BYTE_BPE)):
    return len(library.encode(text or "", add_special_tokens=False))


def long_texts():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeßé'\n\t 1?ж漢") for _ in range(r.randint(1, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    return [
        None, "", "plain text, it's 42", some(900), some(3000), "x" * 5000, "ab" * 700 + " " + some(200) + " " * 900 + some(50), " " * 4000, "\n" * 301 + "a", "a" * 127 + " " * 2 + "b" * 300,
        "<|endoftext|>" * 60, some(60) + "<|endoftext|>" + some(60), "".join(r.choice("<|endoftext|> '") for _ in range(3000)), "don't we'll I've " * 90, "1" * 2000 + "," * 2000, "漢字" * 900 + some(20),
    ]


@pytest.mark.parametrize("chunk,overlap", [(128, 64), (1000, 200), (16_384, 512)])
def test_token_counts_equal_the_library(spark, chunk, overlap):
    texts = long_texts()
    rows = [(i if i else None, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s")]
    got = token_counts.count_tokens(docs_of(spark, rows), BYTE_BPE, 1024, chunk, overlap)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), library_count(t), library_count(t) > 1024) for i, t, _, _ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_units_of_every_plain_character_equal_the_library():
    units = token_counts.unit_counts(BYTE_BPE)
    for x in range(0x300):
        c = chr(x)
        for text in (f"a{c}b", f" {c}{c} 1{c}2", f"{c} {c}  {c}\n{c}", f"it'{c}s {c}'ll"):
            assert units.count(text) == library_count(text), hex(x)


def test_boundaries_are_those_of_units():
    units = token_counts.unit_counts(BYTE_BPE)
    text = "One  two<|endoftext|> it's\n\n 42"
    at, before, n = units.boundaries(text)
    assert [text[a:b] for a, b in zip(at, [*at[1:], None])] == ["One", " ", " two", "<|endoftext|>", " it", "'s", "\n\n", " 42"]
    assert before[0] == 0 and n == library_count(text)


def test_empty_table(spark):
    none = docs_of(spark, [(1, "x", "en", "s")]).where("false")
    assert token_counts.count_tokens(none, BYTE_BPE).count() == 0
    assert spelling.spelling_variants(none).count() == 0
    assert divergence.audit_sources(none).count() == 0


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def variants(rows):
    n, upper = Counter(), {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return [(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n]


def spelled(seed):
    r = random.Random(seed)
    rows = []
    base = ["necessary", "Straßenbahn", "définitive", "aaaaaaaa", "accommodate", "abababab", "ÀÉÎÕÜßñ", "x" * 300]
    for i in range(150):
        words = []
        for _ in range(60):
            w = r.choice(base)
            if r.random() < 0.2:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abé") + w[k:], w[:k] + r.choice("abÉ") + w[k + 1 :], w.upper(), w[:5]])
            words.append(w)
        rows.append((i if i % 40 else None, r.choice([" ", ", ", "-"]).join(words), "en", "s"))
    # chains of forms: each ten times as frequent as the one before
    rows += [(1000 + k, " ".join([w] * 10**k), "en", "s") for k, w in enumerate(("chainxx", "chainyx", "chainyy", "chainyyz"))]
    return [*rows, (1, None, "en", "s"), (2, "", "en", "s"), rows[3], (3, "été " * 5 + "l'éléphant éléphant", "fr", "s")]


@pytest.mark.parametrize("most", [2000, 3])
def test_spelling_variants_against_brute_force(spark, most):
    rows = spelled(5)
    got = [tuple(r) for r in spelling.spelling_variants(docs_of(spark, rows), most=most).collect()]
    want = variants(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[1] is not None for w in want) > 5 and any(w[1] != w[2] and w[1] for w in want)


def test_scan_of_a_sorted_list_against_pairs():
    r = random.Random(2)
    for c in (1, 2, 3, 7):
        words = sorted({"".join(r.choice("abc") for _ in range(c + r.randint(0, 1))) for _ in range(80)})
        want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if len(a) == c and len(b) >= c and one_edit(a, b)}
        assert set(spelling.near_in_list(words, c, 99)) == want and len(list(spelling.near_in_list(words, c, 99))) == len(want)
        some = {(i, j) for i, j in want if words[i][:1] != words[j][:1]}
        assert set(spelling.near_in_list(words, c, 1)) == some


def test_divergence_against_sql(spark, tables):
    r = random.Random(8)
    words = ["the", "The", "und", "çà", "ÉTÉ", "x1y", "", "漢字", *[f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]]
    rows = []
    for i in range(400):
        lang = r.choice(["en", "en", "en", "de", None])
        source = r.choice(["hot", "hot", "a", "b", "ß", None]) if lang == "en" else r.choice(["hot", "a"])
        rows.append((i, " ".join(r.choice(words[: 40 + 60 * len(source or "")]) for _ in range(r.randint(0, 30))), lang, source))
    rows += [(500, None, "en", "silent"), (501, "", "fr", "a"), (502, "seul", "fr", "b"), (503, "123 !?", None, None), rows[0], rows[0], (504, "alone " * 9, "it", "only")]
    d = docs_of(spark, rows)
    got = divergence.audit_sources(d)
    con = tables("/root/testdata/sf0.001")
    frame = d.select("doc_id", "text", "lang", "source").toPandas().astype({"text": "object"})
    con.register("frame", frame)
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM frame")
    want = con.execute(divergence.AUDIT_SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {("fr", "a", "pair", "b", 0, 1)} <= set(want) and len({w[4] for w in want if w[:3] == ("en", "hot", "term")}) < sum(w[:3] == ("en", "hot", "term") for w in want) > 30
    few = divergence.audit_sources(d, most=7).collect()
    assert sorted(map(tuple, few)) == sorted(w for w in want if w[2] == "pair" or w[5] <= 7)


def test_shares_are_exact_for_large_counts(spark):
    for count, total, terms in ((10**14 - 1, 28 * 10**13, 10**9), (0, 7, 3), (9_999_999_999, 10**13, 12345), (6, 6, 1)):
        got = spark.range(1).select(divergence.smoothed_share(F.lit(count), F.lit(total + terms)).alias("p")).first().p
        assert got == 1 + 10**9 * (count + 1) // (total + terms)
