from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from lexispark.llm import language_id as L

PIECES = [L.MARK, "a", "b", "ab", "ba", "aba", L.MARK + "a", L.MARK + "ab", "c"]


def brute(word, theta, index):
    """Sum over all segmentations of the marked word, by recursion."""
    text = L.MARK + word

    def total(i):
        if i == len(text):
            return 1.0
        out = 0.0
        for j in range(i + 1, len(text) + 1):
            piece = text[i:j]
            p = theta[index[piece]] if piece in index else (L.UNKNOWN if j == i + 1 else 0.0)
            out += p * total(j)
        return out

    return total(0)


def brute_counts(word, theta, index, size):
    """Expected piece counts over all segmentations."""
    text, out = L.MARK + word, np.zeros(size)
    weights = []

    def walk(i, p, used):
        if i == len(text):
            weights.append((p, used))
            return
        for j in range(i + 1, len(text) + 1):
            row = index.get(text[i:j], -1 if j == i + 1 else None)
            if row is not None:
                walk(j, p * theta[row], [*used, row])

    walk(0, 1.0, [])
    z = sum(p for p, _ in weights)
    for p, used in weights:
        for row in used:
            out[row] += p / z
    return out


def tables(rng, languages=2):
    seg = L.Segmenter(PIECES)
    t = rng.random((seg.size + 2, languages))
    t[0], t[-1] = 0.0, L.UNKNOWN
    return seg, t


def test_forward_pass_sums_all_segmentations():
    seg, t = tables(np.random.default_rng(1))
    rng = random.Random(1)
    words = ["".join(rng.choice("abcx") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    got = seg.log_probability(words, t)
    for word, row in zip(words, got, strict=True):
        assert np.exp(row) == pytest.approx([brute(word, t[:, c], seg.index) for c in range(2)])
        assert seg._scaled(word, t) == pytest.approx(row)


def test_long_words_do_not_underflow():
    seg, t = tables(np.random.default_rng(2))
    a, b = (seg.log_probability(["ab" * n], t)[0] for n in (2000, 4000))
    assert np.isfinite(b).all() and (b < a).all() and b == pytest.approx(2 * a, rel=0.01)
    assert np.isfinite(seg.log_probability(["x" * 3000], t)).all()


def test_expected_counts():
    seg, t = tables(np.random.default_rng(3), 1)
    words, counts = ["ab", "abab", "cx", "a"], np.array([1.0, 2.0, 3.0, 0.5])
    want = sum(n * brute_counts(w, t[:, 0], seg.index, len(t)) for w, n in zip(words, counts, strict=True))
    assert seg.expected_counts(list(seg.by_length(words)), counts, t[:, 0]) == pytest.approx(want)


def test_em_raises_likelihood_and_separates(monkeypatch):
    pieces = L.read_pieces(P.path("piece_bpe_32k.model"))
    assert len(pieces) == len(set(pieces)) > 20_000
    words = {"aa": Counter("the thing that thought there".split() * 30), "bb": Counter("der die das nicht ein eine".split() * 30)}
    model = L.fit(words, pieces)
    assert model.table[1:-1].sum(axis=0) == pytest.approx([1, 1])
    got = L.Predictor(model).predict(["That thing", "nicht die eine", None, "", "12 ,. ²", "中文"])
    assert got[0][:2] == ["aa", "bb"] and got[0][2:5] == ["und"] * 3 and got[1][2:5] == [0.0] * 3
    assert 0.4 < got[1][5] < 0.7  # characters that neither language has seen


def test_cache_overflow_changes_nothing(monkeypatch):
    pieces = L.read_pieces(P.path("piece_bpe_32k.model"))
    model = L.fit({"a": Counter(["the"]), "b": Counter(["der"])}, pieces)
    texts = ["the der das", "these are words", "und so weiter"] * 200
    want = L.Predictor(model).predict(texts)
    monkeypatch.setattr(L, "CACHE_WORDS", 3)
    assert L.Predictor(model).predict(texts) == want


def test_edges(spark):
    pieces = L.read_pieces(P.path("piece_bpe_32k.model"))
    nothing = L.fit({}, pieces)
    docs = spark.createDataFrame([(1, "a text", "q", 1.0), (None, None, "q", 1.0), (1, "a text", None, 1.0)], "doc_id bigint, text string, lang_pred string, score double")
    assert {(r.lang_pred, r.score) for r in L.predict_texts(docs, nothing).collect()} == {("und", 0.0)}
    assert L.keep_determined(docs, nothing).count() == 0
    assert L.predict_texts(docs.limit(0), nothing).count() == 0
    model = L.fit({"en": Counter(["a", "text"])}, pieces)
    kept = L.keep_determined(docs, model)
    assert kept.columns == docs.columns and kept.count() == 2


def test_query_on_whole_table(spark, sf_dir):
    from lexispark.llm.queries_text import op5_language_id

    got = {r.doc_id: r for r in op5_language_id(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [r for r in docs if got[r.doc_id].held_out and r.lang]
    assert held and sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)


def test_long_words_are_learned():
    seg, t = tables(np.random.default_rng(4), 1)
    word = "abacabxb" * 5  # 40 letters
    batches = [((word, 0), None, None)]
    got = seg.expected_counts(batches, np.array([2.0]), t[:, 0])
    short = "abacab"
    assert seg._long_counts(short, 3.0, t[:, 0]) == pytest.approx(3 * brute_counts(short, t[:, 0], seg.index, len(t)))
    lengths = np.array([0, *map(len, PIECES), 1])
    assert got @ lengths == pytest.approx(2 * 41)  # every segmentation covers the word and its mark
    model = L.fit({"aa": Counter({word: 5}), "bb": Counter({"cccc" * 10: 5})}, PIECES)
    assert L.Predictor(model).predict([word, "c" * 40])[0] == ["aa", "bb"]


def test_query_is_brute_force_on_a_small_table(spark, monkeypatch):
    monkeypatch.setattr(L, "FIT_DOCS", 6)
    rng = random.Random(5)
    docs = []
    for i in range(60):
        lang = rng.choice(["p", "q", None])
        letters_ = {"p": "aaab", "q": "abbc", None: "abc"}[lang]
        docs.append((i, " ".join("".join(rng.choice(letters_) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(0, 5))), lang))
    docs += [(100, None, "p"), (101, "12", "q"), (None, "ab", "p"), (7, "zz " + "ab" * 20, "p")]
    table = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], "doc_id bigint, text string, lang string, k int, l int, t int, word int").repartition(3)
    model = L.fit_from_table(table, PIECES)
    got = {(r.doc_id, r.lang_pred): r.score for r in L.predict_texts(table, model).collect()}

    # the same by plain loops: choice, EM over all segmentations, products over words
    order = dict(table.selectExpr("doc_id", "shiftrightunsigned(xxhash64(doc_id), 11) AS h").distinct().collect())
    index = {piece: i + 1 for i, piece in enumerate(PIECES)}
    theta = {}
    for lang in ("p", "q"):
        keys = {i for i, _, own in docs if own == lang and i is not None and zlib.crc32(str(i).encode()) % 4 != 2}
        chosen = sorted(keys, key=lambda i: (order[i], i))[:6]
        words = Counter(w for i, t, own in docs if own == lang and i in chosen for w in (t or "").split() if w.isalpha())
        p = np.full(len(PIECES) + 2, 1.0 / len(PIECES))
        for _ in range(L.ROUNDS):
            p[0], p[-1] = 0.0, L.UNKNOWN
            expected = sum((n * (brute_counts(w, p, index, len(p)) if len(w) < 20 else L.Segmenter(PIECES)._long_counts(w, 1.0, p)) for w, n in words.items()), np.zeros(len(p)))[1:-1] + L.ALPHA
            p[1:-1] = expected / expected.sum()
        p[-1] = L.UNKNOWN
        theta[lang] = p
    for i, text, _ in docs:
        words = [w for w in (text or "").split() if w.isalpha()]
        if not words:
            assert got[i, "und"] == 0.0
            continue
        product = {lang: np.prod([brute(w, theta[lang], index) if len(w) < 20 else np.exp(L.Segmenter(PIECES)._scaled(w, theta[lang][:, None])[0]) for w in words]) for lang in theta}
        best = max(sorted(product), key=product.get)
        assert got[i, best] == pytest.approx(product[best] / sum(product.values()))
