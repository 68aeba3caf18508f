from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexispark.functions.vocab import byte_alphabet
from lexispark.operators import attention, chat

IDS = {b: i for b, _, i in byte_alphabet()}
CHATS = {
    1: [("system", "be"), ("user", "hi é"), ("assistant", "yo"), ("tool", "3"), ("assistant", "")],
    2: [("user", "<|eos|>"), ("assistant", "ok")],
    3: [("user", "x" * 30)],
}
ROLES = {"system": 3, "user": 4, "assistant": 5, "tool": 7}


def rendered(turns, prompt=False):
    out = [(1, 0)]
    for role, text in turns:
        on = int(role == "assistant")
        out += [(ROLES[role], 0)] + [(IDS[b], on) for b in text.encode()] + [(2, on)]
    return out + [(5, 0)] * prompt


def table(spark, chats=CHATS):
    rows = [(c, t, r, x) for c, turns in chats.items() for t, (r, x) in enumerate(turns)]
    return spark.createDataFrame(rows[::-1], "conv_id bigint, turn bigint, role string, text string")


def loop(chats, seq_len):
    """Sequential next-fit: (ids, mask, segments) rows of seq_len + 1."""
    rows, ids, seg = [], [], 0
    for c in sorted(chats):
        own = rendered(chats[c])[: seq_len + 1]
        if len(ids) + len(own) > seq_len + 1:
            rows.append(ids)
            ids, seg = [], 0
        ids = ids + [(i, m, seg) for i, m in own]
        seg += 1
    rows += [ids] if ids else []
    return [r + [(0, 0, -1)] * (seq_len + 1 - len(r)) for r in rows]


@pytest.mark.parametrize("prompt", [False, True])
def test_render(spark, prompt):
    got = {r.conv_id: [(t.id, t.mask) for t in r.tokens] for r in chat.render(table(spark), generation_prompt=prompt).collect()}
    assert got == {c: rendered(t, prompt) for c, t in CHATS.items()}


def test_render_messages(spark):
    rows = [(c, [{"role": r, "content": x} for r, x in t]) for c, t in CHATS.items()]
    df = spark.createDataFrame(rows, "conv_id bigint, messages array<struct<role: string, content: string>>")
    assert {r.conv_id: [(t.id, t.mask) for t in r.tokens] for r in chat.render_messages(df).collect()} == {c: rendered(t) for c, t in CHATS.items()}


def test_unknown_role_fails(spark):
    with pytest.raises(Exception, match="unknown role"):
        chat.render(table(spark, {1: [("narrator", "x")]})).collect()


@pytest.mark.parametrize("seq_len", [12, 24, 47, 200])
def test_packing_is_the_loop(spark, seq_len):
    got = chat.pack_conversations(chat.render(table(spark)), seq_len).orderBy("row").collect()
    want = loop(CHATS, seq_len)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g.input_ids == [x[0] for x in w[:-1]] and g.targets == [x[0] for x in w[1:]]
        assert g.loss_mask == [x[1] for x in w[1:]] and g.segment_ids == [x[2] for x in w[:-1]]


def test_no_conversations_give_no_rows(spark):
    assert chat.pack_conversations(chat.render(table(spark).limit(0)), 16).count() == 0


def test_collate(spark):
    df = spark.createDataFrame([(1, [5, 6, 7], 1), (2, [8], 1)], "id int, tokens array<int>, prompt_len int")
    rows = {r.id: r for r in chat.collate(df).collect()}
    assert rows[2].seq == [8, 0, 0] and rows[2].comp_mask == [False] * 3
    assert rows[1].seq == [5, 6, 7] and rows[1].comp_mask == [False, True, True]


def test_masks_are_metamorphic(spark):
    """Causality, window reach and segment isolation of the pairs."""
    tokens = spark.createDataFrame([(0, i, i // 4) for i in range(12)], "seq int, pos int, seg int")
    pairs = lambda **o: {(r.i, r.j) for r in attention.attention_pairs(tokens, **o).collect()}
    assert pairs() == {(i, j) for i in range(12) for j in range(i + 1)}
    assert pairs(window=3) == {(i, j) for i in range(12) for j in range(i + 1) if i - j < 3}
    assert pairs(segment="seg") == {(i, j) for i in range(12) for j in range(i + 1) if i // 4 == j // 4}


def test_masked_targets(spark):
    row = spark.range(1).select(chat.masked_targets(F.array(F.lit(4), F.lit(5)), F.array(F.lit(0), F.lit(1))).alias("t")).first()
    assert row.t == [-100, 5]
