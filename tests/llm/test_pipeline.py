from __future__ import annotations

import public_tokenizers as P
import tokenizers

import corpus_pipeline
from lexispark.llm import language_id, toxicity
from lexispark.llm.common import materialize, read_table
from test_exact_dedup import low
from test_packing import check_layout
from test_simhash import brute_similar


def test_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in read_table(spark, sf_dir, "documents").collect()]
    docs = read_table(spark, sf_dir, "documents")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"test-{name}")
        results.append(docs)
    for r in results[:-1]:
        assert r.columns == list(rows[0])
    kept = [sorted(r.doc_id for r in x.collect()) for x in results[:-1]]

    model = toxicity.fit_from_tables(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    scorer = toxicity.Scorer(model)
    rows = [r for r in rows if scorer.score(r["text"])[0] < 0.5]
    assert kept[0] == sorted(r["doc_id"] for r in rows) and len(rows) < 200

    predictor = language_id.Predictor(language_id.fit_from_table(results[0], language_id.read_pieces(P.path("piece_bpe_32k.model"))))
    labels, scores = predictor.predict([r["text"] for r in rows])
    rows = [r for r, label, s in zip(rows, labels, scores, strict=True) if label != "und" and s >= 0.5]
    assert kept[1] == sorted(r["doc_id"] for r in rows)

    best: dict = {}
    for r in rows:
        n = low(r["text"])
        if n not in best or r["doc_id"] > best[n]["doc_id"]:
            best[n] = r
    rows = list(best.values())
    assert kept[2] == sorted(r["doc_id"] for r in rows)

    component = brute_similar([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if component[r["doc_id"]] == r["doc_id"]]
    assert kept[3] == sorted(r["doc_id"] for r in rows)

    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    check_layout(results[-1].collect(), [(r["doc_id"], r["text"]) for r in rows], 4096, library)


def test_run_is_the_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "test")
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == sorted(docs.collect())


def test_repeated_rows_and_clashing_columns(spark):
    text = "some quite ordinary words that stand in one line for this test of the stages"
    base = read_table(spark, "/root/testdata/sf0.001", "documents").where("doc_id < 60")
    extra = spark.createDataFrame([(100_000, text, "en", "s", 1), (100_000, text, "en", "s", 1), (100_001, None, None, None, None)], base.schema)
    docs = base.unionByName(extra).selectExpr("*", "1 AS kept", "'x' AS score", "'y' AS fingerprint", "1 AS _key", "2 AS _sha", "3 AS _hash", "4 AS h", "5 AS fp", "6 AS cell", "7 AS rows", "8 AS k", "9 AS label", "10 AS l")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns[5:8] == ["kept", "score", "fingerprint"] and docs.columns[-1] == "l"
    assert docs.where("doc_id = 100000").count() == 1
    assert docs.where("doc_id = 100001").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_empty_table(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.count() == 0
