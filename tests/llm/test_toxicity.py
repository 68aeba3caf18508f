from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from lexispark.llm import toxicity

CLEAN = "the river flows past old houses and green fields while people walk slowly home".split()
RUDE = ["vilox", "grumf"]


def corpus(rng, n, rate=0.3):
    texts, labels, bad = [], [], []
    for _ in range(n):
        y = int(rng.random() < rate)
        lines = [[rng.choice(CLEAN) for _ in range(rng.randrange(4, 12))] for _ in range(rng.randrange(2, 6))]
        where = rng.randrange(len(lines))
        if y:
            lines[where].insert(rng.randrange(len(lines[where])), rng.choice(RUDE) + rng.choice(["", "en", "ish", "ant"]))
        texts.append(". ".join(" ".join(line) for line in lines) + ".")
        labels.append(y)
        bad.append(" ".join(lines[where]) if y else None)
    return texts, labels, bad


@pytest.fixture(scope="module")
def model():
    texts, labels, _ = corpus(random.Random(1), 600)
    return toxicity.fit(texts, labels)


def test_held_out_documents_and_their_sentences(model):
    texts, labels, bad = corpus(random.Random(2), 300)
    scorer = toxicity.Scorer(model)
    for text, label, where in zip(texts, labels, bad, strict=True):
        p, z = scorer.score(text)
        assert (p >= 0.5) == bool(label)
        found = [" ".join(s) for s, x in zip(toxicity.sentences(text), z, strict=True) if x >= 0]
        assert found == ([where] if label else [])


def test_score_is_the_noisy_or_of_its_sentences(model):
    scorer = toxicity.Scorer(model)
    text = "the vilox river. old houses grumfish! green\nvilox"
    misses = 1 - model.leak
    for words in toxicity.sentences(text):
        weight = sum(float(model.weights[toxicity.features(w)].sum()) for w in set(words))
        z = model.bias + weight if weight > 0 else toxicity.NEVER
        misses *= 1 - 1 / (1 + np.exp(-z))
    assert scorer.score(text)[0] == pytest.approx(1 - misses)


def test_sentences():
    assert toxicity.sentences("A b. C!?\n\nd") == [["a", "b"], ["c"], ["d"]]
    assert toxicity.sentences(None) == toxicity.sentences(" ... ") == []


def test_without_both_classes_the_base_rate():
    assert toxicity.Scorer(toxicity.fit([], [])).score("x y")[0] == pytest.approx(0.0, abs=1e-9)
    assert toxicity.Scorer(toxicity.fit(["a"], [1])).score("x y")[0] == pytest.approx(1.0)


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "vilox you"), (3, "vilox you"), (None, "old houses"), (4, "old houses. " * 20_000)]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id bigint, text string, score double, label string")
    got = sorted((str(r.doc_id), r.predicted, len(r.offending)) for r in toxicity.score_texts(docs, model, locate=True).collect())
    assert got == [("1", 0, 0), ("2", 0, 0), ("3", 1, 1), ("3", 1, 1), ("4", 0, 0), ("None", 0, 0)]
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


def test_query_on_whole_table(spark):
    from lexispark.llm.queries_text import op7_toxicity

    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op7_toxicity(spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    labelled = [(got[r.doc_id], r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.doc_id in got]
    held = [(g.predicted, y) for g, y in labelled if g.held_out]
    assert sum(p == y for p, y in held) >= 0.93 * len(held)
    assert sum(p and not y for p, y in held) <= 1


def test_fit_is_a_minimum_of_the_likelihood():
    """The loss by plain loops, at the fitted parameters and beside them."""
    texts, labels, _ = corpus(random.Random(3), 200)
    model = toxicity.fit(texts, labels)
    share = {1: toxicity.TOXIC_SHARE / sum(labels), 0: (1 - toxicity.TOXIC_SHARE) / (len(labels) - sum(labels))}

    def loss(weights, bias, leak):
        total = toxicity.L1 * float(weights.sum())
        for text, label in zip(texts, labels, strict=True):
            miss = 1 - leak
            for words in toxicity.sentences(text):
                own = {f for w in words for f in toxicity.features(w)}
                if any(model.weights[f] > 0 for f in own):
                    miss *= 1 / (1 + np.exp(bias + sum(weights[f] for f in own)))
            p = min(max(1 - miss, 1e-12), 1 - 1e-12)
            total -= share[label] * np.log(p if label else 1 - p)
        return total

    fitted = loss(model.weights, model.bias, model.leak)
    assert fitted < 0.1 * loss(np.zeros_like(model.weights), -4.0, 0.02)
    for f in np.argsort(-model.weights)[:4]:
        lower = model.weights.copy()
        lower[f] -= 1.5
        assert loss(lower, model.bias, model.leak) > 0.98 * fitted  # prefixes of a word stand in for each other
    halved = model.weights * 0.2
    assert loss(halved, model.bias, model.leak) > 1.5 * fitted
    assert loss(model.weights, model.bias - 3, model.leak) > fitted and loss(model.weights, model.bias, model.leak + 0.05) > fitted


def test_query_scores_are_plain_loops(spark, sf_dir):
    from lexispark.llm.queries_text import op7_toxicity, toxicity_model

    model = toxicity_model(spark, sf_dir)
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op7_toxicity(spark, sf_dir).collect():
        miss, offending = 1 - model.leak, 0
        for words in toxicity.sentences(rows[r.doc_id]):
            weight = sum(float(model.weights[toxicity.features(w)].sum()) for w in set(words))
            p = 1 / (1 + np.exp(-(model.bias + weight))) if weight > 0 else 0.0
            miss, offending = miss * (1 - p), offending + (p >= 0.5)
        assert r.score == pytest.approx(1 - miss, abs=1e-9)
        assert r.predicted == int(r.score >= 0.5) and r.n_offending == offending
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
