"""The operators below token_source, keyed_questions and indexed_questions on whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import vocab
from lexispark.sources import corpus, tasks


def test_token_documents_give_whole_texts_back(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", vocab.byte_ids(F.col("text")).alias("tokens"))
    got = {r.doc_id: r.text for r in corpus.token_documents(rows, vocab.byte_text).collect()}
    assert got == {r.doc_id: r.text for r in docs.collect() if r.text} and max(map(len, got.values())) > 1000


def test_questions_keep_whole_texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"), F.split("text", " ").alias("choices"))
    indexed = tasks.indexed_questions(rows.withColumn("answer", F.lit(1)))
    keyed = tasks.keyed_questions(rows.withColumn("labels", F.array(*map(F.lit, "ABCD"))).withColumn("texts", F.col("choices")).withColumn("answer_key", F.lit("B")))
    want = {r.q_id: ("Question: " + r.question + "\nAnswer:", [" " + w for w in r.question.split(" ")], 1) for r in rows.collect()}
    for made in (indexed, keyed):
        assert {r.q_id: (r.prompt, r.choices, r.answer) for r in made.collect()} == want
