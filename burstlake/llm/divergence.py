"""Source divergence audit by count cells: how far the words of a source are from those of its language and of other sources.

Terms are counted inside tasks and summed by (lang, source, term). What a term contributes depends on its counts alone, so
terms are grouped into cells of equal counts, the contribution is worked out once for each cell, and cells are ranked by it
with their cumulative multiplicity; only the cells of the first ranks are expanded into their terms again. For pairs of
sources the cells come from the terms' vectors of counts, each different vector once. All terms are first valued as if both
sources lacked them, then the terms that one has are corrected by its count, and the terms that both have by both counts, so
no term is paired with sources that lack it.

All arithmetic is in whole numbers of 64 bits, which hold up to 2.8e14 occurrences in a language and 8e9 kept terms.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_HELD = 400_000  #: sums that a task holds before it passes them on


def _counted(batches):
    """Sums (lang, source, term, n, docs) of what a task reads, passed on whenever _HELD are held."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            same = [pa.array([v], pa.string()).take(pa.array(np.zeros(len(terms), np.int64))) for v in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(terms, pa.binary()), pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, terms), pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if (lang, source) not in held:
                held[lang, source] = Counter(), Counter()
            n, docs = held[lang, source]
            terms = _TERM.findall(text.as_py().lower())
            size -= len(n)
            n.update(terms)
            docs.update(set(terms))
            size += len(n)
            if size >= _HELD:
                yield from rows()
                size = 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term and documents that have it; null columns count as empty.

    Terms are runs of letters A-Z, a-z and of characters beyond ASCII; only A-Z are lower-cased."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    part = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    found = part.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def smoothed_share(count: Column, of: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / of) in two steps, as 10^9 = 31250 * 32000, so that no product leaves 64 bits."""
    whole, rest = _div((count + 1) * 31250, of), ((count + 1) * 31250) % of
    return whole * 32000 + _div(rest * 32000, of) + 1


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: each source of a language against each other one, over all kept terms."""
    vectors = cut(kept.groupBy("lang", "counts").agg(F.count("*").alias("m")), "vectors")
    v = vectors.select("lang", "m", "counts", F.posexplode("counts").alias("i", "a"))
    both = v.select("lang", "m", "a", F.explode(F.slice("counts", F.col("i") + 2, F.size("counts"))).alias("b"))
    both = both.select("lang", F.col("a.source").alias("one"), F.col("b.source").alias("two"), F.col("a.n").alias("x"), F.col("b.n").alias("y"), "m")
    single = cut(v.groupBy("lang", F.col("a.source").alias("source"), F.col("a.n").alias("n")).agg(F.sum("m").alias("m")), "counts")
    side = lambda k: groups.select("lang", F.col("source").alias(k), F.col("of").alias(f"of_{k}"), F.when(F.col("terms") > 0, smoothed_share(F.lit(0), F.col("of"))).alias(f"none_{k}"), *(["terms"] if k == "one" else []))
    pairs = cut(side("one").join(side("two"), "lang").where(F.col("one") < F.col("two")), "pairs")  # as many rows as part "pair" has, halved
    key = ("lang", "one", "two")
    p, q, p0, q0 = smoothed_share(F.col("x"), F.col("of_one")), smoothed_share(F.col("y"), F.col("of_two")), F.col("none_one"), F.col("none_two")
    P, Q = F.col("p"), F.col("q")
    # Each kind of cell: m terms and what these add to the value that they have where counts still to come are taken for 0.
    kinds = [
        (both.join(pairs, list(key)).select(*key, "m", p0, q0, p.alias("p"), q.alias("q")), lambda f: f(P, Q) - f(P, q0) - f(p0, Q) + f(p0, q0)),
        (single.withColumnsRenamed({"source": "one", "n": "x"}).join(pairs, ["lang", "one"]).select(*key, "m", p0, q0, p.alias("p")), lambda f: f(P, q0) - f(p0, q0)),
        (single.withColumnsRenamed({"source": "two", "n": "y"}).join(pairs, ["lang", "two"]).select(*key, "m", p0, q0, q.alias("q")), lambda f: f(p0, Q) - f(p0, q0)),
        (pairs.where("terms > 0").select(*key, F.col("terms").alias("m"), p0, q0), lambda f: f(p0, q0)),
    ]
    back = lambda a, b: divergence(b, a)
    sums = [cells.select(*key, (F.col("m") * more(divergence)).alias("there"), (F.col("m") * more(back)).alias("back")) for cells, more in kinds]
    sums = sums[0].unionByName(sums[1]).unionByName(sums[2]).unionByName(sums[3]).groupBy(*key).agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    sums = pairs.select(*key).join(sums, list(key), "left")  # without kept terms: 0
    way = lambda a, b, v: F.struct(F.col(a).alias("source"), F.col(b).alias("item"), F.coalesce(F.col(v), F.lit(0)).alias("value"))
    return sums.select("lang", F.explode(F.array(way("one", "two", "there"), way("two", "one", "back"))).alias("w")).select("lang", "w.*")


def _terms(kept: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """lang, source, item, value, rank: the terms that a source has more of than its language, the first `most` of each."""
    x = kept.select("lang", "term", "all", F.explode("counts").alias("c")).select("lang", "term", "all", "c.source", "c.n")
    p, q = smoothed_share(F.col("n"), F.col("of")), smoothed_share(F.col("all"), F.col("of_lang"))
    valued = lambda df: df.withColumns({"p": p, "q": q}).where("p > q").withColumn("value", divergence(F.col("p"), F.col("q")))
    cells = valued(x.groupBy("lang", "source", "n", "all").agg(F.count("*").alias("m")).join(groups, ["lang", "source"]))
    levels = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    group = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    levels = levels.withColumn("k", F.row_number().over(group)).where(F.col("k") <= most)  # each level has a term at least
    before = F.coalesce(F.sum("m").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = cut(levels.withColumn("before", before).where(F.col("before") < most).select("lang", "source", "value", "before"), "levels")
    least = cut(groups.join(levels.groupBy("lang", "source").agg(F.min("value").alias("least")), ["lang", "source"]), "least")
    out = valued(x.join(least, ["lang", "source"])).where(F.col("value") >= F.col("least")).select("lang", "source", "term", "value")
    out = out.withColumn("k", F.row_number().over(Window.partitionBy("lang", "source", "value").orderBy("term"))).where(F.col("k") <= most)
    out = out.join(levels, ["lang", "source", "value"]).withColumn("rank", (F.col("before") + F.col("k")).cast("int")).where(F.col("rank") <= most)
    return out.select("lang", "source", F.col("term").alias("item"), "value", "rank")


def audit_sources(docs: DataFrame, least_docs: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others and from the language.

    Each language keeps the terms that at least `least_docs` of its documents have. With the share
    p = 1 + floor(10^9 (count + 1) / (N + V)) of a term in a source, N its occurrences of kept terms and V their number, and q
    the share elsewhere, f is floor((p - q)^2 / q). part "pair": f against each other source, summed over all kept terms.
    part "term": f against the language for terms with p > q that the source has, the first `most` ranks. Ranks go by value
    from the largest, ties by the item in UTF-8 order.

    Null text, lang and source are empty strings; each row is a document, repeated or not; a source without terms has its
    pairs; a language with one source has none; empty texts have no terms; an empty table gives no rows; other columns are
    ignored."""
    counts = term_counts(docs)
    entry = F.struct("source", "n")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(entry)).alias("counts"))
    kept = cut(kept.where(F.col("docs") >= least_docs).drop("docs"), "kept_terms")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    sizes = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    languages = kept.groupBy("lang").agg(F.sum("all").alias("total_lang"), F.count("*").alias("terms"))
    groups = docs.select(text("lang"), text("source")).distinct().join(sizes, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = groups.na.fill(0, ["total", "total_lang", "terms"])
    groups = cut(groups.select("lang", "source", "terms", (F.col("total") + F.col("terms")).alias("of"), (F.col("total_lang") + F.col("terms")).alias("of_lang")), "sources")
    pairs = _pairs(kept, groups).withColumn("part", F.lit("pair"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(_terms(kept, groups, most).withColumn("part", F.lit("term")).select(*columns))


AUDIT_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS terms FROM kept GROUP BY lang),
shared AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS all_n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sizes AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM shared GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, s.term, s.n, 1 + (1000000000 * (s.n + 1)) // (z.total + l.terms) AS p, 1 + (1000000000 * (s.all_n + 1)) // (l.total + l.terms) AS q
  FROM shared s JOIN sizes z USING (lang, source) JOIN langs l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
every AS (SELECT g.lang, g.source, h.source AS item FROM groups g JOIN groups h ON g.lang = h.lang AND g.source != h.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM every LEFT JOIN pairs USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
