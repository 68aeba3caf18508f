from __future__ import annotations

import json
import random
from collections import Counter

import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

from lexispark.functions import bpe, vocab
from lexispark.operators import checks

TEXTS = ["plain words", "  spaces  around  ", "tab\tand\nline", "naïve café 中文 \U0001f600", "", "it's we'll 12 ,.!", "<|eos|> in text", "a b\x85c\x1f"]


def corpus(n=300, seed=0):
    rng = random.Random(seed)
    words = "the quick brown fox jumps over lazy dog gradients flow attention heads".split()
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 30))) + "." for _ in range(n)]


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame([(t,) for t in corpus()], "text string")
    return bpe.train(docs, 360)


def test_byte_ids_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "text string")
    rows = df.select("text", vocab.byte_ids(F.col("text")).alias("a"), vocab.byte_ids_expression(F.col("text")).alias("b"), vocab.byte_text(vocab.byte_ids(F.col("text"))).alias("back")).collect()
    library = {b: i for b, _, i in vocab.byte_alphabet()}
    for r in rows:
        assert r.a == r.b == [library[x] for x in (r.text or "").encode()]
        assert r.back == (r.text or "")


def test_alphabet_equals_the_library():
    from tokenizers import pre_tokenizers

    assert {c for _, c, _ in vocab.byte_alphabet()} == set(pre_tokenizers.ByteLevel.alphabet())
    assert sorted(i for _, _, i in vocab.byte_alphabet()) == list(range(8, 264))


def test_pretokens_equal_the_library(spark):
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    df = spark.createDataFrame([(t,) for t in TEXTS + corpus(20)], "text string")
    for r in df.select("text", vocab.pretokens(F.col("text")).alias("p")).collect():
        assert [b - a for _, (a, b) in split.pre_tokenize_str(r.text)] == [len(x) for x in r.p]


def test_training_equals_the_library(trained):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    backend = Tokenizer(models.BPE())
    backend.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    backend.train_from_iterator(corpus(), trainers.BpeTrainer(vocab_size=360, min_frequency=2, special_tokens=vocab.SPECIAL_TOKENS, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    assert {t: i for i, t in enumerate(trained.tokens)} == backend.get_vocab()
    for text in TEXTS[:6] + corpus(30, seed=9):
        assert trained.encode(text) == backend.encode(text).ids


def test_distributed_learning_is_the_same(spark):
    docs = spark.createDataFrame([(t,) for t in corpus(40)], "text string")
    counts = bpe.word_counts(docs)
    local = bpe.learn_merges({r["word"]: r["n"] for r in counts.collect()}, 276)
    assert bpe.learn_merges_distributed(counts, 276, cut_every=5).merges == local.merges


def test_round_trip_specials_and_storage(spark, trained, tmp_path):
    for text in TEXTS:
        assert trained.decode(trained.encode(text)) == text
    assert trained.encode("a", add_bos=True, add_eos=True)[0::2] == [1, 2]
    assert trained.encode("<|eos|>", allow_special=True) == [2]
    assert trained.decode([1, *trained.encode("hi"), 2]) == "hi"
    trained.save(spark, str(tmp_path / "tok"))
    again = bpe.BpeTokenizer.load(spark, str(tmp_path / "tok"))
    assert again.fingerprint() == trained.fingerprint() and again.encode("the fox") == trained.encode("the fox")
    with pytest.raises(ValueError, match="missing"):
        bpe.BpeTokenizer(["a"], [])
    checks.require_tokens(trained.vocabulary(spark), vocab.special_tokens(spark))
    with pytest.raises(ValueError, match="missing"):
        checks.require_tokens(trained.vocabulary(spark).where("id > 2"), vocab.special_tokens(spark))


def test_min_frequency_stops():
    assert bpe.learn_merges({"ab": 1, "cd": 1}, 1000, min_frequency=2).merges == []
    assert bpe.learn_merges({}, 300).vocab_size == 264


def test_public_layout_is_read_by_the_library_and_back(trained):
    library = tokenizers.Tokenizer.from_str(trained.to_public_json())
    for text in TEXTS:
        assert library.encode(text, add_special_tokens=False).ids == trained.encode(text, allow_special=True)
    again = bpe.BpeTokenizer.from_public_json(library.to_str())
    assert (again.tokens, again.merges) == (trained.tokens, trained.merges)
    record = json.loads(trained.to_public_json())
    record["model"]["merges"] = [" ".join(m) for m in record["model"]["merges"]]
    assert bpe.BpeTokenizer.from_public_json(json.dumps(record)).merges == trained.merges
    with pytest.raises(ValueError, match="byte-level"):
        bpe.BpeTokenizer.from_public_json(json.dumps(record | {"pre_tokenizer": None}))


def varied(n=120, seed=3):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(3, 12))) for _ in range(n)]


@pytest.mark.parametrize(("cut_every", "top"), [(1, 1 << 17), (6, 1 << 17), (32, 1 << 17), (8, 5)])
def test_incremental_merges_are_the_local_ones(spark, cut_every, top):
    counts = bpe.word_counts(spark.createDataFrame([(t,) for t in varied()], "text string")).cache()
    size = 264 + (12 if cut_every == 1 or top == 5 else 60)
    local = bpe.learn_merges({r["word"]: r["n"] for r in counts.collect()}, size)
    work = []
    assert bpe.learn_merges_distributed(counts, size, cut_every=cut_every, top=top, work=work).merges == local.merges
    assert sum(done for done, _ in work) == len(local.merges) and all(done for done, _ in work)
    if cut_every == 32:
        assert len(work) < len(local.merges) / 2  # rounds accept several merges


def test_a_merge_visits_the_words_that_hold_its_pair(spark):
    counts = bpe.word_counts(spark.createDataFrame([(t,) for t in varied()], "text string")).cache()
    words = {r["word"]: r["n"] for r in counts.collect()}
    work = []
    merges = bpe.learn_merges_distributed(counts, 264 + 15, cut_every=1, work=work).merges
    assert len(work) == len(merges) == 15
    coder = bpe.BpeTokenizer(bpe.base_tokens(), [])
    spelled = [[coder.tokens[i] for i in coder.encode_word(w)] for w in words]
    for pair, (_, visited) in zip(merges, work, strict=True):
        holding = sum(pair in zip(x, x[1:], strict=False) for x in spelled)
        assert holding <= visited <= holding + len(words) // 50  # a posting can outlive its pair
        spelled = [bpe._merged(x, pair, "".join(pair)) for x in spelled]
    assert work[-1][1] < len(words) / 3


def test_a_token_made_twice(spark):
    # "abc" comes first from ab+c, later from a+bc
    counts = {"abc": 50, "ab": 60, "xbc": 40, "bc": 45, "aabcd": 30, "zabcd": 30, "yabc": 9, "abca": 8, "abcabc": 7, "bcbc": 6}
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    local = bpe.learn_merges(counts, 300).merges
    for cut_every, top in ((1, 99), (7, 99), (4, 3)):
        assert bpe.learn_merges_distributed(table, 300, cut_every=cut_every, top=top).merges == local


def test_round_trips_make_ids_of_a_step_at_a_time(spark, monkeypatch):
    table = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "text string")
    assert [tuple(r) for r in vocab.round_trips(table).collect()] == [(len(TEXTS) + 1, len(TEXTS) + 1)]
    assert [tuple(r) for r in vocab.round_trips(table.where("false")).collect()] == [(0, 0)]
    texts = pa.array(["", None, "a" * 30, "é" * 7, "", "b" * 200, "c", None])
    slices = list(vocab.byte_slices(texts, 50))
    assert [x for s in slices for x in s.to_pylist()] == texts.to_pylist()
    assert all(len(s) == 1 or sum(len((x or "").encode()) for x in s.to_pylist()) <= 50 for s in slices)
    # of a batch of any size, ids of one step are made together
    seen, whole = [], vocab._ids_of
    monkeypatch.setattr(vocab, "_ids_of", lambda t: seen.append(len("".join(t.to_pylist()))) or whole(t))
    monkeypatch.setattr(vocab, "STEP_BYTES", 1000)
    assert [r.to_pylist() for r in mapped(lambda df: vocab.round_trips(df))([pa.record_batch([pa.array(["x" * 90] * 500)], ["text"])])] == [[{"n_docs": 500, "n_same": 500}]]
    assert sum(seen) == 45_000 and max(seen) <= 1000


def mapped(call):
    """The function that ``call`` hands to mapInArrow."""

    class Table:
        sparkSession = None
        select = lambda self, *columns: self

        def mapInArrow(self, run, schema):
            raise Found(run)

    class Found(Exception):
        pass

    with pytest.raises(Found) as found:
        call(Table())
    return found.value.args[0]


def test_bigram_counts_hold_a_slice_at_a_time(monkeypatch):
    from lexispark.model import providers

    rng = random.Random(2)
    sequences = [[rng.randrange(9) for _ in range(rng.randrange(5))] for _ in range(700)] + [None]
    column = pa.array(sequences, pa.list_(pa.int32()))
    want = Counter(p for s in sequences for p in zip(s or [], (s or [])[1:], strict=False))
    adjacent, seen = providers.adjacent, []
    monkeypatch.setattr(providers, "adjacent", lambda c, v: seen.append(len(c)) or adjacent(c, v))
    for tile in (1 << 20, 50):  # a matrix for the task, or pairs of each slice
        monkeypatch.setattr(providers, "TILE", tile)
        got = Counter()
        for batch in mapped(lambda df: providers.Bigram.fit_table(df, 9))([pa.record_batch([column.slice(0, 300)], ["t"]), pa.record_batch([column.slice(300)], ["t"])]):
            for pair, n in zip(*batch.to_pydict().values(), strict=True):
                got[divmod(pair, 9)] += n
        assert got == want
    assert max(seen) <= providers.SEQUENCES


def test_merges_of_all_words_at_once_are_those_word_by_word(monkeypatch):
    rng = random.Random(11)
    cases = [{"aaaa": 3, "aaa": 5, "baaab": 2, "abab": 7, "": 2, "x": 9, "é" * 5: 4}, {"abc": 50, "ab": 60, "xbc": 40, "bc": 45, "aabcd": 30, "abcabc": 7, "bcbc": 6}]
    cases += [{"".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))): rng.randrange(1, 9) for _ in range(300)} for _ in range(5)]
    monkeypatch.setattr(bpe, "PATIENCE", 0)
    for counts in cases:
        found = []
        for few in (0, 1, 20, 1 << 40):  # from word by word at once to never
            monkeypatch.setattr(bpe, "FEW_PLACES", few)
            found.append(bpe.learn_merges(counts, 420).merges)
        assert found[0] == found[1] == found[2] == found[3] and len(found[0]) > 4


def test_a_merge_of_all_words_makes_no_step_for_each(monkeypatch):
    rng = random.Random(12)
    counts = {"".join(rng.choice("abcd") for _ in range(9)): 1 for _ in range(5_000)}
    monkeypatch.setattr(bpe, "_merged", lambda *a: pytest.fail("a word was merged alone"))
    assert len(bpe.learn_merges(counts, 264 + 20).merges) == 20


def test_decoding_looks_an_id_up_once(trained, monkeypatch):
    coder, seen = bpe.BpeTokenizer(trained.tokens, trained.merges), []
    spelled = coder._spelled
    monkeypatch.setattr(coder, "_spelled", lambda i, skip: seen.append(i) or spelled(i, skip))
    ids = [*coder.encode("the fox jumps") * 50, -1, coder.vocab_size, 2]
    assert coder.decode(ids) == "the fox jumps" * 50 and coder.decode(ids, skip_special=False) == "the fox jumps" * 50 + "<|eos|>"
    assert max(Counter(seen).values()) == 2  # with specials and without
