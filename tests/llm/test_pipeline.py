"""The corpus pipeline stage by stage, and its registration."""

import __spark_entry__
import corpus_pipeline
from burstlake.llm import minhash, suffix, toxicity

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, [f for _, f in corpus_pipeline.STAGES]
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    one = stages[0](spark, docs, SF)
    ids = {r.doc_id for r in one.select("doc_id").collect()}
    assert one.columns == columns and ids == {r.doc_id for r in docs.select("doc_id").collect()} - bad
    kept = {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()}
    assert {r.doc_id for r in stages[1](spark, docs, SF).select("doc_id").collect()} == kept
    three = stages[2](spark, docs, SF)
    left = {r.doc_id: len((r.text or "").encode().split()) for r in three.collect()}
    gone = {r.doc_id: r.n_passage_words for r in suffix.repeat_digests(docs, words=50).collect()}
    assert any(gone.values()) and all(left[r.doc_id] == len((r.text or "").encode().split()) - gone[r.doc_id] for r in docs.collect())
    assert stages[3](spark, docs, SF).columns == columns
    assert {"sequence_id", "offset"} <= set(stages[4](spark, docs, SF).columns)
