from __future__ import annotations

import hashlib
import json
import random

import pytest
from oracle import canonical, connect
from pyspark.sql import functions as F

from lexispark.llm import chat_format as C
from lexispark.llm.queries_chat import CONTROL_TEXT, ORACLE, op13_chat_format

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def escaped(text):
    """By characters: a backslash is doubled, and follows the first character of a control string."""
    out = ""
    for i, c in enumerate(text):
        out += c + "\\" if c == "\\" or any(text.startswith(s, i) for s in C.CONTROL) else c
    return out


def brute(rows):
    """The contract by plain loops; rows are (conv_id, turn, role, text)."""
    groups: dict = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in groups.items():
        turns = [(role, text) for _, _, role, text in sorted(turns)]
        loss = "".join(text for role, text in turns if role == "assistant")
        whole = "".join(f"{C.TURN}{escaped(role)}{C.TEXT}{escaped(text)}{C.END}" for role, text in turns)
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(whole)))
    return sorted(out, key=str)


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    got = op13_chat_format(spark, sf_dir).toPandas()
    want = connect(sf_dir).execute(ORACLE["op13_chat_format"]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    assert sorted(got.itertuples(index=False, name=None), key=str) == brute(rows)


def random_text(rng):
    parts = [*C.CONTROL, "\\", "\\\\", "<", "[", "|", ">", "<\\", "\n", "\r\n", "$1", "é", "\U0001f600", " ", " ok ", "role", "\x00", "<|", "s>", "/s>", "INST]"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(12)))


def test_any_text_is_read_back(spark):
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "", "<|end|>", "a\nb", "\\", None]
    rows = [(rng.choice([*range(60), None]), rng.choice([None, *range(5)]), rng.choice(roles), rng.choice([None, random_text(rng), random_text(rng)])) for _ in range(900)]
    table = spark.createDataFrame(rows + rows[:40], SCHEMA).repartition(5)
    chats = C.format_chats(C.turn_records(table)).cache()
    assert sorted((tuple(r) for r in C.digests(chats).collect()), key=str) == brute(rows + rows[:40])
    for r in chats.collect():
        assert sum(m.chars for m in r.mask) == len(r.formatted) and r.formatted.count(C.END) == len(r.mask) == r.formatted.count(C.TURN)


def test_escape_leaves_no_control_string(spark):
    rng = random.Random(2)
    texts = [random_text(rng) for _ in range(2000)]
    table = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escape(F.col("t")).alias("e")).select("*", C.unescape(F.col("e")).alias("u"))
    for t, e, u in table.collect():
        assert u == t and e == escaped(t) and not any(c in e for c in C.CONTROL)


RECORDS = [
    ({"conv_id": 1, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"content": "a", "role": "assistant"}]}, "messages", [("system", "s"), ("user", "u"), ("assistant", "a")]),
    ({"id": "x", "source": {"url": "h", "tags": [1, 2]}, "conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a", "weight": 1}]}, "conversations", [("user", "u"), ("assistant", "a")]),
    ({"dialogue": [{"speaker": "bot", "text": "a"}]}, "dialogue", [("assistant", "a")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"output": "o", "instruction": "i", "input": "more", "system": "s"}, "instruction", [("system", "s"), ("user", "i\n\nmore"), ("assistant", "o")]),
    ({"instruction": "i", "output": None}, "instruction", [("user", "i"), ("assistant", "")]),
    ({"prompt": "p", "completion": "c", "x y": {}}, "prompt and completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "r", "system": "s"}, "prompt and response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": 42, "conv_id": 9}, "question and answer", [("user", "q"), ("assistant", "42")]),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "user", "content": None}, {"role": None, "content": "c"}]}, "messages", [("user", ""), ("", "c")]),
    ({"prompt": "p", "response": "r", "completion": "c"}, None, []),
    ({"prompt": "p"}, None, []),
    ({"messages": "text"}, None, []),
    ({"messages": [{"role": "user"}]}, None, []),
    ({}, None, []),
    ([1], None, []),
    (7, None, []),
]


@pytest.mark.parametrize("parsed", [False, True])
def test_layouts_are_selected_by_fingerprint(spark, parsed):
    table = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(-1, None), (-2, "no {json")], "n int, record string").coalesce(1).orderBy("n")
    table = table.select("n", F.try_parse_json("record").alias("record")) if parsed else table
    got = C.canonical(table).collect()
    assert [(r.layout, [(t.role, t.text) for t in r.turns]) for r in got] == [(None, []), (None, [])] + [(layout, turns) for _, layout, turns in RECORDS]
    assert [r.conv_id for r in got][2] == 1 and [r.conv_id for r in got][-10] == 9
    formatted = C.format_chats(table)
    assert formatted.count() == len(RECORDS) + 2
    unknown = {tuple(r.paths or []): r.n for r in C.unknown_layouts(table).collect()}
    assert unknown[("prompt",)] == 1 and unknown[("completion", "prompt", "response")] == 1


def test_paths_of_nested_records(spark):
    record = {"a": {"b": [{"c": 1, "d e": None}, {"c": "x", "f": [[True]]}]}, "g": [], "STRING": 1.5, "h`i": "2020-01-01", "j.k": {"l": {}}}
    table = spark.createDataFrame([(json.dumps(record),)], "record string").select(C.field_paths(F.parse_json("record")).alias("p"))
    assert sorted(table.first().p) == sorted(["a.b[].c", "a.b[].d e", "a.b[].f[][]", "g[]", "STRING", "h``i"])


def test_another_layout_is_one_line(spark):
    layouts = (*C.LAYOUTS, C.Layout("forum", pairs=(("user", ("post.title", "post.body")), ("assistant", ("best.body",))), key="post.id"))
    record = {"post": {"id": 5, "title": "t", "body": "b"}, "best": {"body": "a", "votes": 3}}
    table = spark.createDataFrame([(json.dumps(record),)], "record string")
    row = C.canonical(table, layouts=layouts).first()
    assert (row.conv_id, row.layout, [(t.role, t.text) for t in row.turns]) == (5, "forum", [("user", "t\n\nb"), ("assistant", "a")])
    assert C.canonical(table).first().layout is None


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.digests(C.format_chats(C.turn_records(empty))).count() == 0
    long = [(1, i, "assistant" if i % 2 else "user", "x<s>" * 200_000 if i < 2 else str(i)) for i in range(3000)]
    wide = spark.createDataFrame(long, SCHEMA).selectExpr("*", "1 AS messages", "'p' AS prompt", "2 AS record", "3 AS layout", "4 AS paths", "5 AS turns", "6 AS print", "7 AS mask", "8 AS formatted", "9 AS layout_no")
    assert [tuple(r) for r in C.digests(C.format_chats(C.turn_records(wide))).collect()] == brute(long)


def test_no_python_on_the_path(spark, sf_dir):
    plan = op13_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD"))
