"""Text and tokenizer queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import vocab
from lexispark.operators.order import with_row_index
from lexispark.session import table
from lexispark.sources import corpus

#: Documents of a part at least, and parts at most.
DOCS_PER_PART = 64
MOST_PARTS = 64


def part_sizes(docs: DataFrame) -> tuple[int, int]:
    """(parts, documents of a part) for all rows of a table, from their number."""
    n = docs.count()
    size = max(DOCS_PER_PART, -(-n // MOST_PARTS))
    return -(-n // size), size


def special_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The special tokens and their ids."""
    return vocab.special_tokens(spark)


def byte_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(byte, id): ids of all bytes, from the expression that encodes texts."""
    return spark.range(256).select(F.col("id").cast("int").alias("byte")).select("byte", vocab.byte_id(F.col("byte")).alias("id"))


def doc_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level tokens of each document, with the closing eos."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("bigint").alias("n_tokens"))


def byte_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each byte-level id occurs in the corpus; counts combine before the shuffle."""
    return vocab.byte_counts(table(spark, sf_dir, "documents"))


def byte_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and those that byte-level encoding and decoding returns unchanged."""
    return vocab.round_trips(table(spark, sf_dir, "documents"))


def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of byte-level pre-tokens of each document (the pattern has no SQL: look-ahead)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(vocab.pretokens(F.col("text"))).cast("bigint").alias("n_pretokens"))


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text; the filter and the two columns reach the scan."""
    return corpus.raw_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


def token_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of token rows: every third has ``tokens``, others ``input_ids``, some neither."""
    docs = table(spark, sf_dir, "documents").select("doc_id", vocab.byte_ids(F.col("text")).alias("ids"))
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("ids")).when(F.col("doc_id") % 3 == 1, F.array().cast("array<int>")).alias("tokens"), F.when(F.col("doc_id") % 5 > 0, F.col("ids")).alias("input_ids"))
    return corpus.token_documents(rows, vocab.byte_text).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


def part_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of each document, for parts that are not there yet (2 and 5 are)."""
    have = spark.createDataFrame([(2,), (5,)], "part bigint")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    parts, size = part_sizes(docs)
    placed = corpus.assign_parts(docs, parts=parts, docs_per_part=size, have=have)
    return placed.select("doc_id", "part", corpus.part_name(F.col("part")).alias("name"))


def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global row numbers of orders by (date, key), in two levels."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return with_row_index(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_index")


QUERIES = {f.__name__: f for f in (special_tokens, byte_alphabet, doc_token_counts, byte_token_histogram, byte_round_trip, pretoken_counts, raw_documents, token_source, part_assignment, row_index)}

#: id of a byte value ``b`` in SQL.
BYTE_ID = "(CASE WHEN b BETWEEN 33 AND 126 THEN b - 33 WHEN b BETWEEN 161 AND 172 THEN b - 67 WHEN b BETWEEN 174 AND 255 THEN b - 68 WHEN b <= 32 THEN b + 188 WHEN b BETWEEN 127 AND 160 THEN b + 94 ELSE 255 END + 8)"
#: byte k (from 0) of the text t.
BYTE_AT = "CAST(('0x' || substr(hex(encode({t})), CAST(2 * {k} + 1 AS BIGINT), 2)) AS INTEGER)"
#: Documents of a part in SQL, as z(size).
PART_SIZE = f"z AS (SELECT greatest({DOCS_PER_PART}, (count(*) + {MOST_PARTS - 1}) // {MOST_PARTS}) AS size FROM documents)"

ORACLE = {
    "special_tokens": """
        SELECT CAST(id AS INTEGER) AS id, token FROM (VALUES (0, '<|pad|>'), (1, '<|bos|>'), (2, '<|eos|>'), (3, '<|system|>'), (4, '<|user|>'),
            (5, '<|assistant|>'), (6, '<|tool_call|>'), (7, '<|tool_result|>')) v(id, token)""",
    "byte_alphabet": """
        WITH b AS (SELECT CAST(range AS INTEGER) AS byte FROM range(256)),
        s AS (SELECT byte, CASE WHEN byte BETWEEN 33 AND 126 OR byte BETWEEN 161 AND 172 OR byte >= 174 THEN byte
                                ELSE 256 + (SELECT count(*) FROM b o WHERE o.byte < b.byte AND NOT (o.byte BETWEEN 33 AND 126 OR o.byte BETWEEN 161 AND 172 OR o.byte >= 174)) END AS stand_in FROM b)
        SELECT byte, CAST(7 + row_number() OVER (ORDER BY stand_in) AS INTEGER) AS id FROM s""",
    "doc_token_counts": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS n_tokens FROM documents",
    "byte_token_histogram": f"""
        WITH bytes AS (SELECT {BYTE_AT.format(t="text", k="k")} AS b FROM (SELECT text, unnest(range(octet_length(encode(text)))) AS k FROM documents) t)
        SELECT CAST({BYTE_ID} AS INTEGER) AS token, count(*) AS n FROM bytes GROUP BY 1""",
    "byte_round_trip": "SELECT count(*) AS n_docs, count(*) AS n_same FROM documents",
    "raw_documents": "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents WHERE text IS NOT NULL AND text <> ''",
    "token_source": """
        SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents
        WHERE length(text) > 0 AND (doc_id % 3 = 0 OR doc_id % 5 > 0)""",
    "part_assignment": f"""
        WITH {PART_SIZE}, r AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // size AS part FROM documents, z)
        SELECT doc_id, part, 'part_' || lpad(CAST(part AS VARCHAR), 5, '0') || '.jsonl' AS name FROM r WHERE part NOT IN (2, 5)""",
    "row_index": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders",
}
