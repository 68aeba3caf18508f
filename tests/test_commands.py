from __future__ import annotations

import json

import pytest

from lexispark import cli
from lexispark.functions import schedule
from lexispark.operators import scoring
from lexispark.streaming import ingest

CONFIG = schedule.get_config("nano", vocab_size=384, d_model=16, n_layers=1, n_q_heads=2, n_kv_heads=1, head_dim=8, mlp_hidden=16, context=16, window=8, micro_batch=2, grad_accum=1, warmup_steps=1, max_steps=4)


def test_all_commands_end_to_end(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    texts = [f"the quick brown fox number {i} jumps over the lazy dog" for i in range(40)]
    manifest = cli.prepare(spark, source=texts, parts_dir=at("parts"), parts=4, docs_per_part=10, tokenizer_path=at("tok"), data=at("data"), vocab_size=300, shard_tokens=200)
    assert manifest.first().total_tokens > 400
    common = {"tokenizer_path": at("tok"), "c": CONFIG}
    losses = cli.train(spark, data=at("data"), steps=2, out=at("base"), eval_every=2, **common)
    more = cli.train(spark, data=at("data"), steps=1, out=at("base2"), resume=at("base"), **common)
    assert len(losses) == 2 and len(more) == 1
    assert isinstance(cli.generate(spark, checkpoint=at("base"), prompt="the fox", max_new=3, **common), str)
    assert isinstance(cli.generate(spark, checkpoint=at("base"), message="hi", max_new=3, temperature=1.0, top_k=5, **common), str)
    with pytest.raises(ValueError, match="exactly one"):
        cli.generate(spark, checkpoint=at("base"), **common)
    assert len(cli.posttrain(spark, stage="sft", checkpoint=at("base"), out=at("sft"), steps=1, **common)) == 1
    assert len(cli.posttrain(spark, stage="grpo", checkpoint=at("sft"), out=at("grpo"), steps=1, **common)) == 1
    with pytest.raises(ValueError, match="unknown stage"):
        cli.posttrain(spark, stage="x", checkpoint=None, out=at("x"), steps=1, **common)
    found = cli.evaluate(spark, checkpoints={"base": at("base"), "sft": at("sft")}, data=at("data"), task_specs={"mmlu": "sample"}, n_windows=4, **common)
    assert {(r.checkpoint, r.metric) for r in found.collect()} == {(c, m) for c in ("base", "sft") for m in ("perplexity", "mmlu")}
    assert scoring.report(found).startswith("| Checkpoint")


def test_streamed_parts_are_packed_once(spark, tmp_path):
    parts, out = tmp_path / "parts", str(tmp_path / "out")
    parts.mkdir()

    def add(name, texts):
        (parts / name).write_text("".join(json.dumps({"text": t}) + "\n" for t in texts) + "\n")

    add("part_00000.jsonl", ["ab", "", "cde"])
    run = lambda: ingest.start_packing(ingest.stream_parts(spark, str(parts)), out, str(tmp_path / "ck")).awaitTermination()
    run()
    add("part_00001.jsonl", ["é", "xyz"])
    run()
    run()  # nothing new
    rows = sorted((r.offset, r.n_tokens) for r in spark.read.parquet(f"{out}/batch=*").collect())
    assert rows == [(0, 3), (3, 1), (4, 4), (8, 3), (11, 4)]
    query = ingest.token_totals(ingest.stream_parts(spark, str(parts))).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.n_docs, r.n_tokens) for r in spark.sql("SELECT * FROM totals").collect()) == [(2, 7), (3, 8)]
