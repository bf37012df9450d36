"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

PART = 256.0  #: a larger rate is the sum of several Poisson draws of at most this mean


def _uniform(*parts):
    """A number in [0, 1) from the md5 of the parts: 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """source, n_chars, rate, parts, cdf: the mean number of times that a source's documents are repeated.

    With weights, a source gets its weight's share of the characters (a source without one: none); without, a share in
    proportion to its own characters to the power `temperature`. The total is `epochs` times the corpus. A source without
    characters keeps the rate 1. cdf: P(Poisson(rate / parts) <= k) for k from 0 to where nothing is left in 52 bits."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("n_chars"))
    if weights is None:
        weight = F.sqrt("n_chars") if temperature == 0.5 else F.pow("n_chars", F.lit(float(temperature)))
    else:
        weight = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("n_chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("n_chars") > 0, F.lit(float(epochs)) * F.col("weight") * F.col("all_chars") / (F.col("all_weight") * F.col("n_chars"))).otherwise(F.lit(1.0))
    out = sizes.crossJoin(F.broadcast(total)).withColumn("rate", F.coalesce(rate, F.lit(0.0)))
    out = out.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 30).cast("int")
    cdf = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("c")),
        lambda s, k: F.struct((s["p"] * F.col("mean") / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * F.col("mean") / k)).alias("c")),
        lambda s: s["c"],
    )
    return out.select("source", "n_chars", "rate", "parts", cdf.alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """docs with each row repeated Poisson(rate of its source) times, in an order shuffled over the whole corpus.

    The count inverts the Poisson distribution at a uniform number made of seed and doc_id, so any run gives the same
    copies. Adds n_copies, copy (from 1) and shuffle_key, by which the rows are sorted. A null source is a source of its
    own; a null doc_id counts as the text "null"; rows that repeat a doc_id get equal counts; texts may be null or empty.
    Columns of these three names in docs are replaced."""
    docs = docs.drop("n_copies", "copy", "shuffle_key")
    columns = docs.columns
    from_, parts, cdf = (fresh(columns, x) for x in ("of_source", "parts", "cdf"))
    rates = cut(source_rates(docs, weights, temperature, epochs).select(F.col("source").alias(from_), F.col("parts").alias(parts), F.col("cdf").alias(cdf)), "rates")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    met = docs.join(rates, F.col("source").eqNullSafe(F.col(from_)))
    draws = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda i: _uniform(F.lit(str(seed)), name, i.cast("string")))
    draws = F.transform(draws, lambda u: F.size(F.filter(F.col(cdf), lambda c: c <= u)))
    met = met.withColumn("n_copies", F.aggregate(draws, F.lit(0), lambda a, x: a + x)).drop(from_, parts, cdf).where("n_copies > 0")
    met = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed} order"), name, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    return met.withColumn("shuffle_key", key).select(*columns, "n_copies", "copy", "shuffle_key").orderBy("shuffle_key", "doc_id", "copy")


MIX_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS n_chars, sqrt(CAST(sum(coalesce(length(text), 0)) AS DOUBLE)) AS weight
  FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN n_chars > 0 THEN 1.0::DOUBLE * weight * (SELECT sum(n_chars) FROM sizes) / ((SELECT sum(weight) FROM sizes) * n_chars) ELSE 1.0::DOUBLE END AS rate
  FROM sizes),
means AS (
  SELECT source, greatest(CAST(ceil(rate / 256.0::DOUBLE) AS INTEGER), 1) AS parts, rate / greatest(CAST(ceil(rate / 256.0::DOUBLE) AS INTEGER), 1) AS mean
  FROM rates),
cdf(source, parts, mean, k, p, c) AS (
  SELECT source, parts, mean, 0, exp(-mean), exp(-mean) FROM means
  UNION ALL
  SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean) + 30)),
draws AS (
  SELECT d.doc_id, d.source, m.parts, i.part,
         CAST('0x' || substr(md5('17|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '|' || CAST(i.part AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source, LATERAL (SELECT unnest(range(1, m.parts + 1)) AS part) i),
counts AS (
  SELECT s.doc_id, CAST(count(c.k) AS INTEGER) AS n_copies
  FROM draws s LEFT JOIN cdf c ON s.source IS NOT DISTINCT FROM c.source AND c.c <= s.u GROUP BY s.doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, n.n_copies, CAST(x.copy AS INTEGER) AS copy,
       CAST('0x' || substr(md5('17 order|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '|' || CAST(x.copy AS VARCHAR)), 1, 15) AS BIGINT) AS shuffle_key
FROM documents d JOIN counts n USING (doc_id), LATERAL (SELECT unnest(range(1, n.n_copies + 1)) AS copy) x
ORDER BY shuffle_key, d.doc_id, copy
"""
