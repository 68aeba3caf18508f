"""The corpus pipeline: documents in, packed training sequences out.

Each stage calls one operator of ``lexispark.llm`` and takes (spark, docs, sf_dir), where
``docs`` is what the stage before kept. ``run`` writes every stage's result to the shared
folder and reads it back, so a lost executor costs tasks, not stages; what a stage stored on its
way is removed when its result is written.

Edge cases, stage by stage: null, empty and letterless texts pass toxicity (they have no sentence) and
go at the language stage, as ``und``; very long texts are read whole by every stage; of repeated
rows and of texts equal but for A-Z case one row stays after exact_dedup (the largest doc_id, null
the least), and of near copies one after near_dedup (the smallest doc_id); a document whose score
ties with a stage's threshold is toxic at 0.5 and kept at a language posterior of 0.5; rows with a
null doc_id are judged like others and do not teach; an empty table passes every stage and gives
no pieces; extra columns, whatever their names, are carried up to packing, which ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import byte_bpe, exact_dedup, language_id, packing, simhash, toxicity
from lexispark.llm.common import materialize_outside, read_table, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or over sentences stays below a half."""
    model = toxicity.fit_from_tables(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned: not ``und``, and a posterior of a half or more."""
    import public_tokenizers

    pieces = language_id.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return language_id.keep_determined(docs, language_id.fit_from_table(docs, pieces))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the row with the largest doc_id."""
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose 5-word shingles have a similarity of 0.8 or more the one
    with the smallest doc_id."""
    return simhash.keep_first(docs, similarity=simhash.SIMILARITY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 4096."""
    import public_tokenizers

    return packing.pack_documents(docs, byte_bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_undetermined),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Learned stages and tokenisation have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark, name):
            docs = materialize_outside(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
