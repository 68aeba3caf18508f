"""Every operator gives the same whatever extra columns a table has."""

from __future__ import annotations

import public_tokenizers as P
import pytest

from lexispark.llm import bloom_lm, byte_bpe, centroids, chat_format, exact_dedup, html_extract, importance, language_id, packing, simhash, topk, toxicity, url_filter
from lexispark.llm.queries_pages import URL_RULES

#: Names that operators give to columns of their own.
NAMES = (
    "_key _sha _hash _id _block _text h fp cell slot chain norm n k l t u x y row rank rows value values position members part place start length offset "
    "sequence_id host path rule ruled text_sha256 kept keep_id group_size score predicted lang_pred difference fold accepted at serial edge bound need "
    "token bucket total weight falling unkeyed before cluster n_words record layout paths turns print messages prompt formatted mask small "
    "a b root node first lowest component_id fingerprint held_out n_tokens chunk number word c kind id body shown digest query_id v draw label"
).split()

DOCS = [(1, "One word after another, and the river flows on.", "en", "s", 1), (1, "One word after another, and the river flows on.", "en", "s", 1), (2, None, None, None, None), (None, "", "en", "s", 0), (3, "Der Fluss ist still und das Haus ist alt.", "de", "s", 2), (4, "x " * 30_000, "de", "t", 3)]
PAGES = [(1, "http://a.net/de/1", "<article><p>A sentence of some length, which ends here.</p></article>"), (1, "http://a.net/de/1", "<p>a"), (2, None, None), (None, "http://b.org/es/2", ""), (3, "http://c.fr/x", "<div>b</div>")]
TURNS = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (None, None, None, "</s>"), (2, 0, "assistant", "x " * 30_000)]
VECTORS = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [3.0, -1.0]), (None, [1.0, 1.0]), (2, None), (3, [float("nan"), 1.0]), (40, [])]


def documents(make):
    return "doc_id bigint, text string, lang string, source string, n_chars bigint", DOCS, make


def pages(make):
    return "page_id bigint, url string, html string", PAGES, make


PIECES = ["\u2581", "a", "e", "n", "r", "the", "der", "is"]
CASES = {
    "op1": documents(bloom_lm.score_documents),
    "op2": ("vec_id bigint, embedding array<float>", VECTORS, topk.exact_top_k),
    "op3": documents(simhash.near_duplicates),
    "op3 similar": documents(simhash.similar_documents),
    "op4": pages(lambda t: html_extract.extract_pages(t, html_extract.fit_from_table(t))),
    "op5": documents(lambda t: language_id.predict_texts(t, language_id.fit_from_table(t, PIECES))),
    "op6": documents(lambda t: packing.pack_documents(t, byte_bpe.read_vocabulary(P.path("word_bpe_49k.json")))),
    "op7": documents(lambda t: toxicity.score_texts(t, toxicity.fit_from_tables(t, t.selectExpr("doc_id", "n_chars % 2 AS toxic", "lang", "text")))),
    "op8": documents(lambda t: byte_bpe.encode_texts(t, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digest=True)),
    "op9": documents(exact_dedup.exact_groups),
    "op10": pages(lambda t: url_filter.judge(t, URL_RULES)),
    "op11": documents(lambda t: importance.resample(t, t, min_words=2, percent=50)),
    "op12": ("vec_id bigint, embedding array<float>", VECTORS, lambda t: centroids.cluster(t, k=2, size=2)),
    "op13": ("conv_id bigint, turn bigint, role string, text string", TURNS, lambda t: chat_format.digests(chat_format.format_chats(chat_format.turn_records(t)))),
    "keep exact": documents(exact_dedup.keep_rows),
    "keep near": documents(simhash.keep_first),
    "keep similar": documents(lambda t: simhash.keep_first(t, similarity=0.8)),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_extra_columns_change_nothing(spark, name):
    schema, rows, make = CASES[name]
    plain = spark.createDataFrame(rows, schema).coalesce(1)
    own = set(plain.columns)
    wide = plain.selectExpr("*", *[f"{i} AS {n}" for i, n in enumerate(NAMES) if n not in own])
    want, got = make(plain), make(wide)
    if name.startswith("keep"):
        assert got.columns == wide.columns
        got = got.select(*plain.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert make(wide.limit(0)).count() == 0
