"""Model queries read all rows of their tables and whole texts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import vocab
from lexispark.operators import chat
from lexispark.plans import models


class Seen(Exception):
    pass


def first_argument(monkeypatch, owner, name, at=0):
    def stop(*args, **kwargs):
        raise Seen(args[at])

    monkeypatch.setattr(owner, name, stop)


def test_uniform_perplexity_predicts_all_bytes(spark, sf_dir, monkeypatch):
    first_argument(monkeypatch, models.evaluation, "perplexity")
    with pytest.raises(Seen) as seen:
        models.uniform_perplexity(spark, sf_dir)
    got = seen.value.args[0].agg(F.sum(F.size("tokens") - 1)).first()[0]
    texts = [r.text.encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got == sum(max(0, len(t) - 1) for t in texts)


def test_windows(spark):
    rows = spark.createDataFrame([(list(range(n)),) for n in range(9)], "x array<int>").select("x", models.windows_of(F.col("x"), 3).alias("w")).collect()
    for x, windows in rows:
        assert [t for w in windows for t in w[1:]] == x[1:]
        assert [t for w in windows for t in w[:-1]] == x[:-1]
        assert all(2 <= len(w) <= 4 for w in windows)


def test_sampled_groups_learn_from_all_conversations(spark, monkeypatch):
    sf_dir = "/root/testdata/sf0.01"
    first_argument(monkeypatch, models.generation, "sample_groups", 1)
    with pytest.raises(Seen) as seen:
        models.sampled_groups(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(vocab.with_specials(vocab.byte_ids(F.col("text")), bos=True, eos=True).alias("ids"))
    want = models.providers.Bigram.fit((r.ids for r in rows.collect()), 264)
    assert np.array_equal(seen.value.args[0].log_p, want.log_p)


def test_transformer_loss_takes_all_supervised_tokens(spark, sf_dir, monkeypatch):
    first_argument(monkeypatch, models.training, "distributed_gradients")
    with pytest.raises(Seen) as seen:
        models.transformer_loss(spark, sf_dir)
    got = sorted(t for r in seen.value.args[0].collect() for t, m in zip(r.targets, r.mask, strict=True) if m)
    rendered = chat.render(spark.read.parquet(f"{sf_dir}/conversations.parquet")).collect()
    assert got == sorted(t.id for r in rendered for t in r.tokens if t.mask) and got
