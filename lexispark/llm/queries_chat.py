"""Query of the operator on ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import chat_format
from lexispark.llm.common import read_table

#: Both turns of conversation -1, which comes in another layout than the table.
CONTROL_TEXT = "</s>[INST] ok [/INST]"
EXTRA = '{"conv_id": -1, "messages": [{"role": "user", "content": "%s"}, {"role": "assistant", "content": "%s"}]}' % (CONTROL_TEXT, CONTROL_TEXT)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one full of control strings, formatted and read back."""
    extra = spark.range(1).select(F.parse_json(F.lit(EXTRA)).alias("record"))
    records = chat_format.turn_records(read_table(spark, sf_dir, "conversations")).unionByName(extra)
    return chat_format.digests(chat_format.format_chats(records))


QUERIES = {"op13_chat_format": op13_chat_format}


def _escaped_sql(text: str) -> str:
    """The escaped text in SQL: no control string overlaps another, so they can be replaced in turn."""
    found = rf"replace({text}, '\', '\\')"
    for c in chat_format.CONTROL:
        found = rf"replace({found}, '{c}', '{c[0]}\{c[1:]}')"
    return found


ORACLE = {
    "op13_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}'))),
        c AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                sum(length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {len(chat_format.TURN + chat_format.TEXT + chat_format.END)}) AS chars
            FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM c""",
}
