"""Loaders of public layouts, checkpoints, sums in a tree and log-probabilities, each over a whole table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import vocab
from lexispark.functions.arrays import stable
from lexispark.model import evaluation, gradients, providers, training
from lexispark.operators.order import with_row_index
from lexispark.plans.text import BYTE_AT, BYTE_ID
from lexispark.session import shared_folder, store, table
from lexispark.sources import tasks

FAN_IN = 16


def loaded_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of ``benchmark`` in the layouts of the public task sets, two as JSON lines and two as Parquet,
    read by their loaders: prompt, choices, answer."""
    at = lambda name: shared_folder(spark, name)
    rows = table(spark, sf_dir, "benchmark")
    words, path = F.split("text", " "), {k: at(k) for k in ("word", "keyed", "indexed", "code")}
    labels = F.slice(F.array(*map(F.lit, "ABCDE")), 1, F.least(F.size(words), F.lit(5)))
    rows.select(F.col("text").alias("question"), F.concat("text", F.lit("\nso\n#### 1,"), F.lpad(F.col("item_id").cast("string"), 3, "0")).alias("answer")).write.json(path["word"])
    choices = F.struct(F.slice(words, 1, 5).alias("text"), labels.alias("label")).alias("choices")
    key = F.element_at(F.array(*map(F.lit, "ABCDEF")), (F.col("item_id") % 6 + 1).cast("int"))
    rows.select(F.concat(F.lit("id"), "item_id").alias("id"), F.col("text").alias("question"), choices, key.alias("answerKey")).write.parquet(path["keyed"])
    rows.select(F.col("text").alias("question"), words.alias("choices"), (F.col("item_id") % 4).cast("int").alias("answer")).write.json(path["indexed"])
    rows.select(F.concat(F.lit("Set/"), "item_id").alias("task_id"), F.col("text").alias("prompt"), F.lit("assert f()").alias("test"), F.lit("f").alias("entry_point")).write.parquet(path["code"])

    shown = lambda kind, prompt, n, answer: [F.lit(kind).alias("kind"), F.col(prompt).alias("prompt"), n.cast("bigint").alias("n_choices"), answer.cast("bigint").alias("answer")]
    word = tasks.load_word_problems(spark, path["word"] + "/*.json").select(*shown("word", "question", F.lit(0), F.col("gold")))
    keyed = tasks.load_keyed(spark, path["keyed"]).select(*shown("keyed", "prompt", F.size("choices"), F.col("answer")))
    indexed = tasks.load_indexed(spark, path["indexed"] + "/*.json").select(*shown("indexed", "prompt", F.size("choices"), F.col("answer")))
    code = tasks.load_problems(spark, path["code"]).select(*shown("code", "prompt", F.length("test"), F.length("entry_point")))
    return word.unionByName(keyed).unionByName(indexed).unionByName(code)


def checkpoint_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint of the labels' mean vectors as weights, read back: each value."""
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = cells.orderBy("label", "i").collect()  # one matrix: labels times components
    labels = sorted({r["label"] for r in rows})
    weights = np.array([r["x"] for r in rows]).reshape(len(labels), -1)
    path = shared_folder(spark, "tensors")
    training.write_tensors(spark, path, {"param": {"embed": weights, "norm": weights[:, 0]}, "first": {"embed": -weights}})
    found = training.read_tensors(spark, path)
    if not np.array_equal(found["param"]["norm"], weights[:, 0]):
        raise ValueError("a vector came back changed")
    kinds = [(kind, int(label), i, float(x)) for kind in ("param", "first") for label, row in zip(labels, found[kind]["embed"], strict=True) for i, x in enumerate(row)]
    made = spark.createDataFrame(kinds, "kind string, label int, i int, value double")
    return made.select("kind", "label", "i", stable(F.col("value")).alias("value"))


def tree_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of all vectors (of whole numbers) by label, added up sixteen parts at a time."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("name"), F.transform("embedding", lambda x: F.floor(64 * x.cast("double")).cast("double")).alias("x"))
    numbered = store(with_row_index(vectors, ["name", "vec_id"], "at"), "numbered")
    first = numbered.groupBy("name").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    most = first.agg(F.max("n")).first()[0] or 1

    @F.arrow_udf("binary")
    def packed(lists):
        import pyarrow as pa

        return pa.array([np.asarray(x, "<f8").tobytes() for x in lists.to_pylist()], pa.binary())

    parts = numbered.join(F.broadcast(first), "name").select("name", F.lit(0).alias("slice"), (F.col("at") - F.col("low")).cast("int").alias("part"), packed("x").alias("data"))  # one row a label
    total = gradients.tree_sum(parts, most, FAN_IN)

    @F.arrow_udf("array<double>")
    def unpacked(data):
        import pyarrow as pa

        return pa.array([np.frombuffer(x, "<f8") for x in data.to_pylist()], pa.list_(pa.float64()))

    return total.select("name", F.posexplode(unpacked("data")).alias("i", "total")).select(F.col("name").cast("int").alias("label"), "i", F.col("total").cast("bigint").alias("total"))


def turn_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of each turn and their summed log-probability under the add-one byte bigram model of all turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", vocab.with_specials(vocab.byte_ids(F.col("text")), bos=True, eos=True).alias("tokens"))
    model = providers.Bigram.fit_table(turns.select("tokens"), 264)
    return evaluation.sequence_logprobs(turns, model, key=["conv_id", "turn"]).select("conv_id", "turn", "n", stable(F.col("logp"), 4).alias("logp"))


QUERIES = {f.__name__: f for f in (loaded_tasks, checkpoint_tensors, tree_sums, turn_logprobs)}

ORACLE = {
    "loaded_tasks": """
        WITH b AS (SELECT *, len(string_split(text, ' ')) AS words, 'Question: ' || text || chr(10) || 'Answer:' AS asked FROM benchmark)
        SELECT 'word' AS kind, text AS prompt, CAST(0 AS BIGINT) AS n_choices, CAST('1' || lpad(CAST(item_id AS VARCHAR), 3, '0') AS BIGINT) AS answer FROM b
        UNION ALL SELECT 'keyed', asked, CAST(least(5, words) AS BIGINT), item_id % 6 FROM b WHERE item_id % 6 < least(5, words)
        UNION ALL SELECT 'indexed', asked, CAST(words AS BIGINT), item_id % 4 FROM b
        UNION ALL SELECT 'code', text, CAST(length('assert f()') AS BIGINT), CAST(1 AS BIGINT) FROM b""",
    "checkpoint_tensors": """
        WITH c AS (SELECT label, CAST(i AS INTEGER) AS i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS x FROM embeddings, range(64) t(i) GROUP BY label, i)
        SELECT 'param' AS kind, label, i, round(x, 6) + 0.0 AS value FROM c UNION ALL SELECT 'first', label, i, round(-x, 6) + 0.0 FROM c""",
    "tree_sums": """
        SELECT label, CAST(i AS INTEGER) AS i, CAST(sum(floor(64 * CAST(embedding[i + 1] AS DOUBLE))) AS BIGINT) AS total FROM embeddings, range(64) t(i) GROUP BY label, i""",
    "turn_logprobs": f"""
        WITH t AS (SELECT conv_id, turn, text, octet_length(encode(coalesce(text, ''))) AS n FROM conversations),
        r AS (SELECT conv_id, turn, k, n, CASE WHEN k BETWEEN 1 AND n THEN {BYTE_AT.format(t="text", k="(k - 1)")} ELSE 0 END AS b FROM (SELECT *, unnest(range(n + 2)) AS k FROM t) x),
        i AS (SELECT conv_id, turn, k, CASE WHEN k = 0 THEN 1 WHEN k = n + 1 THEN 2 ELSE {BYTE_ID} END AS id FROM r),
        p AS (SELECT conv_id, turn, lag(id) OVER (PARTITION BY conv_id, turn ORDER BY k) AS a, id AS b FROM i),
        c AS (SELECT a, b, count(*) AS c FROM p WHERE a IS NOT NULL GROUP BY a, b),
        m AS (SELECT a, sum(c) AS m FROM c GROUP BY a)
        SELECT conv_id, turn, count(*) AS n, round(sum(ln((c + 1) / CAST(m + 264 AS DOUBLE))), 4) + 0.0 AS logp FROM p JOIN c USING (a, b) JOIN m USING (a) GROUP BY conv_id, turn""",
}
