"""Queries of the operators on ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import bloom_lm, byte_bpe, exact_dedup, importance, language_id, packing, simhash, toxicity
from lexispark.llm.common import fold, read_table


def op1_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed bigram log10 probability of every text, and the unigram base score."""
    return bloom_lm.score_documents(read_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit SimHash of 3-word shingles; components of fingerprints within 3 bits."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def language_model(spark: SparkSession, sf_dir: str) -> language_id.Model:
    """Fitted on documents with a language whose crc32 fold (of 4) is not 2."""
    import public_tokenizers

    pieces = language_id.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return language_id.fit_from_table(read_table(spark, sf_dir, "documents"), pieces)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text and its posterior."""
    docs = read_table(spark, sf_dir, "documents")
    found = language_id.predict_texts(docs, language_model(spark, sf_dir))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of at most 4096 ids."""
    import public_tokenizers

    vocabulary = byte_bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on labelled documents whose crc32 fold (of 5) is not 0."""
    return toxicity.fit_from_tables(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, and how many of its sentences offend."""
    scored = toxicity.score_texts(read_table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_offending")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the public byte-level vocabulary, hashed, and decoded again."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return byte_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal normalised texts; the row with the largest doc_id stays."""
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn by importance for ``benchmark``."""
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_bloom_lm": op1_bloom_lm,
    "op3_simhash": op3_simhash,
    "op5_language_id": op5_language_id,
    "op6_harmonic_packing": op6_harmonic_packing,
    "op7_toxicity": op7_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op11_importance": op11_importance,
}

ORACLE = {
    "op9_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
        FROM n JOIN g ON n.norm = g.norm""",
    # crc32 is linear: a byte's share in it depends on the byte and on how many follow
    "op11_importance": r"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        g AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        df AS (SELECT n, unnest(w || list_transform(range(1, greatest(1, len(w))), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
        gf AS (SELECT unnest(w || list_transform(range(1, greatest(1, len(w))), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM g),
        f AS (SELECT f, hex(encode(f)) AS h, octet_length(encode(f)) AS size FROM (SELECT f FROM df UNION SELECT f FROM gf) u),
        most AS (SELECT max(size) AS size FROM f),
        t AS (SELECT range AS i, list_reduce(list_prepend(range, range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM range(256)),
        share(behind, b, v) AS (SELECT 0, i, v FROM t UNION ALL SELECT behind + 1, b, xor(share.v // 256, t.v) FROM share JOIN t ON t.i = share.v % 256 WHERE behind < (SELECT size FROM most)),
        start(size, v) AS (SELECT 0, CAST(4294967295 AS BIGINT) UNION ALL SELECT size + 1, xor(start.v // 256, t.v) FROM start JOIN t ON t.i = start.v % 256 WHERE size < (SELECT size FROM most)),
        b AS (SELECT f, size, size - 1 - k AS behind, CAST('0x' || substr(h, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT) AS b FROM (SELECT *, unnest(range(size)) AS k FROM f) x),
        x AS (SELECT f, any_value(size) AS size, bit_xor(v) AS v FROM b JOIN share USING (behind, b) GROUP BY f),
        c AS (SELECT f, xor(xor(x.v, start.v), 4294967295) % 10000 AS bucket FROM x JOIN start USING (size)),
        s AS (SELECT bucket, count(*) AS s FROM df JOIN c USING (f) GROUP BY bucket),
        tt AS (SELECT bucket, count(*) AS t FROM gf JOIN c USING (f) GROUP BY bucket),
        gain AS (
            SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM df) + 10000) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM gf) + 10000)))) AS BIGINT) AS gain
            FROM s FULL JOIN tt USING (bucket)),
        m AS (SELECT n, count(*) AS k, sum(gain) AS total FROM df JOIN c USING (f) JOIN gain USING (bucket) GROUP BY n),
        w AS (SELECT d.n, doc_id, len(d.w) AS words, coalesce(k, 0) AS n_features, CAST(coalesce(floor(total / CAST(k AS DOUBLE)), 0) AS BIGINT) AS weight FROM d LEFT JOIN m USING (n)),
        z AS (
            SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM w),
        r AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (n)""",
}
