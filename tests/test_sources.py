from __future__ import annotations

import random

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import packing
from lexispark.sources import corpus, shards, tasks


def test_synthetic_documents_are_reproducible(spark):
    a, b = ({r.doc_id: r.text for r in corpus.synthetic_documents(spark, n, seed=4).collect()} for n in (50, 20))
    assert all(a[i] == t for i, t in b.items())
    words = {w for t in a.values() for w in t.rstrip(".").split()}
    assert words <= set(corpus.SYNTHETIC_WORDS) and len(words) > 20
    assert all(20 <= len(t.split()) <= 120 and t.endswith(".") for t in a.values())
    assert a != {r.doc_id: r.text for r in corpus.synthetic_documents(spark, 50, seed=5).collect()}


def test_resolve_source(spark):
    assert corpus.resolve_source(spark, ["x", "y"]).count() == 2
    assert corpus.resolve_source(spark, lambda: ["x"]).first().text == "x"
    assert corpus.resolve_source(spark, "synthetic", n=3).count() == 3
    df = spark.range(1)
    assert corpus.resolve_source(spark, df) is df
    with pytest.raises(ValueError, match="unknown source"):
        corpus.resolve_source(spark, "nowhere")


def test_parts_round_trip_resume_and_atomicity(spark, tmp_path):
    path = str(tmp_path / "parts")
    texts = [f"doc {i} é x" if i % 3 else f'"quoted" {i}' for i in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert corpus.existing_parts(spark, path) == []
    written = corpus.write_parts(docs, path, parts=3, docs_per_part=10)
    assert [p.rsplit("/", 1)[1] for p in written] == ["part_00000.jsonl", "part_00001.jsonl", "part_00002.jsonl"]
    rows = corpus.read_parts(spark, path).orderBy("part", "line").collect()
    assert [r.text for r in rows] == texts and [r.line for r in rows[10:20]] == list(range(10))
    # a missing part is written again with its own documents, others are left alone
    for checksum in (tmp_path / "parts").glob(".*.crc"):  # the files change behind Hadoop's back here
        checksum.unlink()
    (tmp_path / "parts" / "part_00001.jsonl").unlink()
    (tmp_path / "parts" / "part_00000.jsonl").write_text('{"text": "kept"}\n\n')
    (tmp_path / "parts" / "part_7.jsonl").write_text("not a part")
    corpus.write_parts(docs, path, parts=2, docs_per_part=10)
    assert corpus.existing_parts(spark, path) == [0, 1, 2]
    rows = corpus.read_parts(spark, path, parts=2).orderBy("part", "line").collect()
    assert [r.text for r in rows] == ["kept", *texts[10:20]]
    corpus.write_parts(docs, path, parts=1, docs_per_part=10, overwrite=True)
    assert [r.text for r in corpus.read_parts(spark, path, parts=1).orderBy("line").collect()] == texts[:10]


def test_reading_a_line_without_text_fails(spark, tmp_path):
    (tmp_path / "part_00000.jsonl").write_text('{"other": 1}\n')
    with pytest.raises(Exception, match="no text"):
        corpus.read_parts(spark, str(tmp_path)).collect()


def test_conversations_and_task_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"messages": [{"role": "user", "content": "hé"}]}, ensure_ascii=False) + "\n\n")
    assert tasks.load_conversations(spark, str(tmp_path / "c.jsonl")).first().messages[0].content == "hé"
    (tmp_path / "q.jsonl").write_text('{"prompt": "p", "choices": [" a"], "answer": 0}\n')
    assert tasks.resolve_tasks(spark, str(tmp_path / "q.jsonl"), "mmlu").first().choices == [" a"]
    assert tasks.resolve_tasks(spark, None, "mmlu") is None
    assert tasks.resolve_tasks(spark, "sample", "humaneval").count() == 1
    tasks.register_task("mmlu", lambda s, limit: tasks.sample_questions(s).limit(limit or 9))
    assert tasks.resolve_tasks(spark, "table", "mmlu", 1).count() == 1


def test_synthetic_conversations_are_right(spark):
    for r in tasks.synthetic_conversations(spark, 100, seed=2).collect():
        question, answer = r.messages[0].content, int(r.messages[1].content)
        assert eval(question.removeprefix("What is ").rstrip("?")) == answer  # noqa: S307
        if len(r.messages) == 4:
            assert int(r.messages[3].content) == answer + int(r.messages[2].content.split()[2].rstrip("."))
    for r in tasks.arithmetic_bank(spark, 50).collect():
        a, b = r.question.removeprefix("What is ").rstrip("?").split(" + ")
        assert int(a) + int(b) == r.gold and 0 <= int(a) <= 20


def packed(spark, texts, shard, val=1):
    docs = spark.createDataFrame([(i, list(t)) for i, t in enumerate(texts)], "doc_id bigint, ids array<int>")
    with_eos = docs.withColumn("ids", F.concat("ids", F.array(F.lit(2))))
    placed = packing.token_offsets(with_eos, F.size("ids"), add_eos=False)
    return placed, packing.pack(placed, shard, val)


def test_packing_is_the_sequential_loop(spark, tmp_path):
    rng = np.random.default_rng(0)
    texts = [rng.integers(8, 264, rng.integers(0, 60)).tolist() for _ in range(80)]
    placed, cut = packed(spark, texts, 97, 2)
    stream = [t for x in texts for t in [*x, 2]]
    pieces = packing.shard_tokens_table(placed, 97)
    record = packing.manifest(cut, "f", 264)
    shards.write_corpus(pieces, cut, record, str(tmp_path / "c"))
    rows = shards.read_tokens(spark, str(tmp_path / "c")).orderBy("shard", "start").collect()
    assert [t for r in rows for t in r.tokens] == stream
    loaded = shards.load_manifest(spark, str(tmp_path / "c"))
    n = -(-len(stream) // 97)
    assert loaded.first().total_tokens == len(stream) and len(loaded.first().shards) == n
    assert shards.shards_for(loaded, "val").count() == 2
    assert {r.shard for r in shards.read_tokens(spark, str(tmp_path / "c"), "val").collect()} == {n - 2, n - 1}
    assert shards.matches_tokenizer(loaded, "f") and not shards.matches_tokenizer(loaded, "g")
    with pytest.raises(ValueError, match="another tokenizer"):
        shards.require_tokenizer(loaded, "g", 264)
    with pytest.raises(ValueError, match="exceed"):
        shards.require_tokenizer(loaded, "f", 100)
    again = shards.manifest_from_text(spark, packing.manifest_json(record.first()))
    assert again.first() == record.first()
    with pytest.raises(ValueError, match="fields differ"):
        shards.manifest_from_text(spark, '{"dtype": "uint16"}')


def test_one_shard_is_never_validation(spark):
    _, cut = packed(spark, [[9] * 5], 1000, 3)
    assert [(r.tokens, r.split) for r in cut.collect()] == [(6, "train")]
    docs = spark.createDataFrame([], "doc_id bigint, ids array<int>")
    assert packing.pack(packing.token_offsets(docs, F.size("ids"), add_eos=False), 10).count() == 0


def test_ids_beyond_16_bits_fail_the_write(spark, tmp_path):
    placed, cut = packed(spark, [[70_000]], 10, 0)
    with pytest.raises(Exception, match="16 bits"):
        shards.write_corpus(packing.shard_tokens_table(placed, 10), cut, packing.manifest(cut, "f", 1), str(tmp_path / "x"))


def test_raw_shards(spark, tmp_path):
    np.arange(10, dtype="<u2").tofile(tmp_path / "shard_00003.bin")
    rows = shards.read_raw_shards(spark, str(tmp_path), piece=4).orderBy("start").collect()
    assert [r.tokens for r in rows] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]] and rows[0].shard == 3


def test_sampler_is_uniform_restartable_and_exact(spark):
    stream = list(range(8, 200))
    placed, cut = packed(spark, [stream], 80, 1)
    pieces = packing.shard_tokens_table(placed, 80)
    whole = [*stream, 2]
    sampler = packing.WindowSampler(cut, pieces, context=16, seed=3)
    first = sampler.next_batch(20).orderBy("draw").collect()
    state = sampler.state()
    second = sampler.next_batch(20).orderBy("draw").collect()
    for r in first + second:
        at = r.shard * 80 + r.start
        assert r.tokens == whole[at : at + 17] and r.inputs == r.tokens[:-1] and r.targets == r.tokens[1:]
        assert r.start + 17 <= 80
    again = packing.WindowSampler(cut, pieces, context=16, seed=99)
    again.load_state(state)
    assert again.next_batch(20).orderBy("draw").collect() == second
    with pytest.raises(ValueError, match="holds a window"):
        packing.WindowSampler(cut, pieces, context=100)
    with pytest.raises(ValueError, match="another context"):
        packing.WindowSampler(cut, pieces, context=8).load_state(state)


def test_conversations_are_numbered_by_line(spark, tmp_path):
    for name, low, high in (("a.jsonl", 0, 40), ("b.jsonl", 40, 300)):
        (tmp_path / name).write_text("".join(json.dumps({"messages": [{"role": "user", "content": str(i) * 20}]}) + "\n" + "\n" * (i % 3 == 0) for i in range(low, high)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")  # several splits a file
    try:
        rows = tasks.load_conversations(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.conv_id: r.messages[0].content for r in rows} == {i: str(i) * 20 for i in range(300)}


def test_loaders_of_local_copies(spark, tmp_path):
    def lines(name, *rows):
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        return str(tmp_path / name)

    bank = lines("w.jsonl", {"question": "q1", "answer": "so\n#### 1,234"}, {"question": "q2", "answer": "no number"}, {"question": "q3", "answer": "#### -5"})
    assert sorted((r.question, r.gold, r.max_new) for r in tasks.load_word_problems(spark, bank).collect()) == [("q1", 1234, 256), ("q3", -5, 256)]
    assert tasks.load_word_problems(spark, bank, limit=1).collect()[0].question == "q1"
    keyed = lines("k.jsonl", {"id": "b", "question": "q", "choices": {"text": ["x", "y"], "label": ["A", "B"]}, "answerKey": "B"}, {"id": "a", "question": "p", "choices": {"text": ["x"], "label": ["1"]}, "answerKey": "2"})
    assert [tuple(r) for r in tasks.load_keyed(spark, keyed, limit=5).collect()] == [("Question: q\nAnswer:", [" x", " y"], 1)]
    indexed = lines("i.jsonl", {"question": "q", "choices": ["x", "y"], "answer": 1, "subject": "s"})
    spark.read.json(indexed).write.parquet(str(tmp_path / "i.parquet"))
    for path in (indexed, str(tmp_path / "i.parquet")):
        tasks.register_task("mmlu", tasks.local("mmlu", path))
        assert [tuple(r) for r in tasks.resolve_tasks(spark, "table", "mmlu", 3).collect()] == [("Question: q\nAnswer:", [" x", " y"], 1)]
    code = lines("c.jsonl", *({"task_id": f"T/{n}", "prompt": f"p{n}", "test": "t", "entry_point": "e"} for n in (10, 9, 1)))
    assert [r.prompt for r in tasks.load_problems(spark, code, limit=2).collect()] == ["p1", "p9"]


def test_draws_by_guide_table_are_those_of_the_intervals(spark):
    rng = random.Random(11)
    for sizes in ([5], [1, 1, 1], [1, 10_000, 1, 1, 50], [rng.randrange(0, 60) for _ in range(300)], [rng.choice([0, 1, 9000]) for _ in range(80)]):
        shards = spark.createDataFrame([(i, n + 8, "train") for i, n in enumerate(sizes)] + [(999, 50, "val")], "shard bigint, tokens bigint, split string")
        starts = packing.window_starts(shards, 8).cache()
        table, width, total = packing.guide_table(starts)
        assert total == sum(sizes) and table.count() <= 2 * sum(n > 0 for n in sizes)
        draws = spark.range(500).withColumnRenamed("id", "draw")
        u, s = (F.col("draw") * 37 + 5) % 499 / F.lit(499.0), (F.col("draw") * 11 + 3) % 251 / F.lit(251.0)
        placed = packing.draw_windows(starts, draws, u, s)
        got = {r.draw: (r.shard, r.start) for r in placed.collect()}
        ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
        for d in range(500):
            at = int((d * 37 + 5) % 499 / 499.0 * total)
            shard = next(i for i, end in enumerate(ends) if at < end)
            assert got[d] == (shard, int((d * 11 + 3) % 251 / 251.0 * sizes[shard]))
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("few", [False, True])
def test_windows_do_not_shuffle_a_piece_for_each_block(spark, few):
    import numpy as np

    tokens = np.random.default_rng(1).integers(0, 256, 50_000).tolist()
    pieces = spark.createDataFrame([(0, 0, tokens), (0, 50_000, tokens[:100]), (1, 0, [])], "shard bigint, start bigint, tokens array<int>")
    windows = spark.createDataFrame([(i, 0, 1_000 * i + 35) for i in range(51)], "draw bigint, shard bigint, start bigint")
    store = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    written = lambda: sum((x := spark.sparkContext._jsc.sc().statusStore().executorList(False)).apply(i).totalShuffleWrite() for i in range(store.size()))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = written()
    try:
        rows = packing.window_tokens(windows, pieces, 64, **({"few": True} if few else {})).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    stream = tokens + tokens[:100]
    assert {r.draw: r.tokens for r in rows} == {i: stream[1_000 * i + 35 : 1_000 * i + 100] for i in range(51)}
    assert written() - before < 4_000_000  # the piece is 0.2 MB; once for each block it is 150 MB
