"""Language identification by segmentation-marginalised unigrams (operator 5).

The vocabulary is that of a public sentence-piece model, fixed; per language a probability of
each piece is learned. A word's probability under a language is the sum over all ways to cut
it into pieces of the product of their probabilities, which a forward pass computes; a text's
is the product over its words. The piece probabilities are the expected counts over all
segmentations (forward and backward pass) of EM, started from equal probabilities.

Words are runs of letters in lower case with the word-start mark; what has no letters says
nothing about the language. Forward passes are run for many words of one length at a time.

The fit reads a bounded sample: ``FIT_DOCS`` documents of each language by hash of their keys, whole and
of any length, and of their distinct words the ``FIT_WORDS`` most frequent. What is broadcast is a table
of pieces times languages. The score is the posterior of the predicted language, all being equally
likely beforehand.

Edge cases: null and empty texts and texts without a letter are ``und`` with score 0; without
labelled rows every text is ``und`` with score 0; ties go to the alphabetically first language;
very long words are learned and scored exactly, by passes kept in range; very long texts are read
whole; rows with a null key are predicted but not learned; repeated rows repeat their result; an
empty table gives no rows; extra columns, whatever their names, are ignored, and carried by
``keep_determined``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import filter_rows, fold, letters, map_rows, materialize

UNDETERMINED = "und"
FIT_DOCS = 400
FIT_WORDS = 100_000
ROUNDS = 3
#: Smoothing of piece probabilities, and the probability of a character outside the vocabulary.
ALPHA = 0.02
UNKNOWN = 1e-8
#: Words up to this length are scored in batches; longer ones by the scaled pass.
BATCH_LENGTH = 28
CACHE_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentence-piece model, lower-cased, each once, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return list(dict.fromkeys(model.id_to_piece(i).lower() for i in ids))


@lru_cache(maxsize=256)
def _spans(n: int, longest: int) -> tuple[list[tuple[int, int]], list[list[tuple[int, int]]]]:
    """All (start, end) with end - start <= longest, and by end the (start, index of span)."""
    spans = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - longest), j)]
    by_end: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(spans):
        by_end[j].append((i, k))
    return spans, by_end


class Segmenter:
    """Piece lookups over a fixed vocabulary. Row 0 of a table stands for no piece."""

    def __init__(self, pieces: list[str]):
        self.index = {piece: i + 1 for i, piece in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.size = len(pieces)

    def lookup(self, word: str, spans) -> list[int]:
        """Piece row of each span; 0 for none, -1 for a single character outside the vocabulary."""
        get = self.index.get
        return [get(word[i:j], 0 if j - i > 1 else -1) for i, j in spans]

    def by_length(self, words: list[str]):
        """Batches of marked words of equal length: (positions in ``words``, rows, by_end)."""
        groups: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            groups.setdefault(len(word) + 1, []).append(k)
        for n, members in groups.items():
            spans, by_end = _spans(n, self.longest) if n <= BATCH_LENGTH else (None, None)
            if spans is None:
                for k in members:
                    yield [k], None, None
                continue
            for at in range(0, len(members), 4096):
                own = members[at : at + 4096]
                yield own, np.array([self.lookup(MARK + words[k], spans) for k in own], dtype=np.int32), by_end

    def log_probability(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """log P(word) by language; table: [1 + pieces + 1, languages], last row: unknown."""
        out = np.empty((len(words), table.shape[1]))
        for own, rows, by_end in self.by_length(words):
            if rows is None:
                out[own[0]] = self._scaled(words[own[0]], table)
                continue
            forward = [np.ones((len(own), table.shape[1]))]
            for j in range(1, len(by_end)):
                forward.append(sum(forward[i] * table[rows[:, k]] for i, k in by_end[j]))
            out[own] = np.log(np.maximum(forward[-1], 1e-300))
        return out

    def _scaled(self, word: str, table: np.ndarray) -> np.ndarray:
        """The same pass for a long word, kept in range by a factor per position."""
        text, scale = MARK + word, np.zeros(table.shape[1])
        recent = [np.ones(table.shape[1])]
        for j in range(1, len(text) + 1):
            now = np.zeros(table.shape[1])
            for back in range(1, min(len(recent), self.longest) + 1):
                row = self.index.get(text[j - back : j], -1 if back == 1 else 0)
                if row:
                    now += recent[-back] * table[row]
            recent.append(now)
            if (low := now.max()) < 1e-100:
                factor = 1.0 / max(low, 1e-300)
                recent = [x * factor for x in recent[-self.longest :]]
                scale -= np.log(factor)
            else:
                recent = recent[-self.longest :]
        return scale + np.log(np.maximum(recent[-1], 1e-300))

    def _long_counts(self, word: str, count: float, theta: np.ndarray) -> np.ndarray:
        """Expected piece counts of one long word, by passes over logarithms."""
        text = MARK + word
        n, add = len(text), np.logaddexp.reduce
        spans = [[(i, self.index.get(text[i:j], -1 if j - i == 1 else 0)) for i in range(max(0, j - self.longest), j)] for j in range(1, n + 1)]
        spans = [[(i, row) for i, row in own if row] for own in spans]  # by end: (start, row) of pieces
        forward, backward = np.full(n + 1, -np.inf), [[] for _ in range(n + 1)]
        forward[0], log = 0.0, np.log(np.maximum(theta, 1e-300))
        for j, own in enumerate(spans, 1):
            forward[j] = add([forward[i] + log[row] for i, row in own])
        total, after = np.zeros(len(theta)), np.full(n + 1, -np.inf)
        after[n] = 0.0
        for j in range(n, 0, -1):
            if backward[j]:
                after[j] = add(backward[j])
            for i, row in spans[j - 1]:
                backward[i].append(after[j] + log[row])
                total[row] += count * np.exp(forward[i] + log[row] + after[j] - forward[n])
            backward[j] = []
        return total

    def expected_counts(self, batches: list, counts: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Expected piece counts over all segmentations of weighted words (one language), given
        as batches of ``by_length``; a long word stands for its position."""
        total = np.zeros(len(theta))
        for own, rows, by_end in batches:
            if rows is None:
                word, k = own
                total += self._long_counts(word, counts[k], theta)
                continue
            n = len(by_end) - 1
            p = theta[rows]
            forward, backward = np.zeros((n + 1, len(own))), np.zeros((n + 1, len(own)))
            forward[0] = backward[n] = 1.0
            for j in range(1, n + 1):
                for i, k in by_end[j]:
                    forward[j] += forward[i] * p[:, k]
            for j in range(n, 0, -1):
                for i, k in by_end[j]:
                    backward[i] += backward[j] * p[:, k]
            weight = counts[own] / np.maximum(forward[n], 1e-300)
            share = np.empty(p.shape)
            for j in range(1, n + 1):
                for i, k in by_end[j]:
                    share[:, k] = weight * forward[i] * p[:, k] * backward[j]
            total += np.bincount(rows.ravel() % len(total), weights=share.ravel(), minlength=len(total))  # -1 is the last
        return total


class Model:
    def __init__(self, pieces: list[str], languages: list[str], table: np.ndarray):
        self.pieces, self.languages, self.table = pieces, languages, table


def fit(words: dict[str, Counter], pieces: list[str]) -> Model:
    """EM per language from word counts; a few rounds over the sample's distinct words."""
    languages = sorted(words)
    segmenter = Segmenter(pieces)
    table = np.zeros((segmenter.size + 2, len(languages)))
    for column, language in enumerate(languages):
        distinct = sorted(words[language])
        counts = np.array([words[language][w] for w in distinct], dtype=np.float64)
        theta = np.full(segmenter.size + 2, 1.0 / max(1, segmenter.size))
        batches = [((distinct[own[0]], own[0]) if rows is None else own, rows, by_end) for own, rows, by_end in segmenter.by_length(distinct)]
        for _ in range(ROUNDS):
            theta[0], theta[-1] = 0.0, UNKNOWN
            expected = segmenter.expected_counts(batches, counts, theta)[1:-1] + ALPHA
            theta[1:-1] = expected / expected.sum()
        table[1:-1, column] = theta[1:-1]
    table[-1] = UNKNOWN
    return Model(pieces, languages, table)


def split_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def fit_from_table(docs: DataFrame, pieces: list[str], *, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_out: int = 2) -> Model:
    """Fit from labelled documents outside the held-out fold.

    FIT_DOCS keys a language are chosen by hash before any text is read: rows whose hash is beyond
    what so many of a language's keys need go at once, the few that are left are ranked.
    """
    usable = docs.select(F.col(key).alias("k"), F.col(lang).alias("l")).where("l IS NOT NULL AND k IS NOT NULL")
    usable = usable.where(fold("k", folds) != held_out).distinct()
    sizes = usable.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    draw = F.shiftrightunsigned(F.xxhash64("k"), 11) / F.lit(float(1 << 53))
    enough = FIT_DOCS + 8 * math.sqrt(FIT_DOCS) + 40  # fewer than FIT_DOCS are left with a chance below 1e-12
    near = usable.withColumn("draw", draw).join(sizes, "l").where(F.col("draw") * F.col("n") <= enough)
    rank = F.row_number().over(Window.partitionBy("l").orderBy("draw", "k"))
    chosen = materialize(near.select("k", "l", rank.alias("rank")).where(F.col("rank") <= FIT_DOCS).drop("rank"), "language-sample")
    # FIT_DOCS keys a language: a bounded side.
    texts = docs.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).join(F.broadcast(chosen), ["k", "l"])

    def make():
        def step(rows):
            found: dict[tuple, int] = {}
            for language, value in zip(rows["l"], rows["t"], strict=True):
                for word in split_words(value):
                    found[language, word] = found.get((language, word), 0) + 1
            return {"l": [x for x, _ in found], "word": [w for _, w in found], "n": list(found.values())}

        return step

    counts = map_rows(texts.select("l", "t"), "l string, word string, n bigint", make).groupBy("l", "word").agg(F.sum("n").alias("n"))
    often = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "word"))
    words: dict[str, Counter] = {}
    for row in counts.withColumn("rank", often).where(F.col("rank") <= FIT_WORDS).toLocalIterator():
        words.setdefault(row["l"], Counter())[row["word"]] = row["n"]
    return fit(words, pieces)


class Predictor:
    def __init__(self, model: Model):
        self.model = model
        self.segmenter = Segmenter(model.pieces)
        self.index: dict[str, int] = {}
        self.logs = np.empty((1024, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        if not new:
            return
        if len(self.index) + len(new) > CACHE_WORDS and self.index:
            self.index.clear()
            new = list(words)
        base = len(self.index)
        while base + len(new) > len(self.logs):
            self.logs = np.concatenate([self.logs, np.empty_like(self.logs)])
        self.logs[base : base + len(new)] = self.segmenter.log_probability(new, self.model.table)
        self.index.update(zip(new, range(base, base + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        languages = self.model.languages
        labels, scores = [], []
        for at in range(0, len(texts), 256):
            words = [split_words(t) for t in texts[at : at + 256]]
            if languages:
                self.learn(set().union(*words))
            for text, own in zip(texts[at : at + 256], words, strict=True):
                if not own or not languages or not letters(text):
                    labels.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total = self.logs[np.fromiter(map(self.index.__getitem__, own), np.int64, len(own))].sum(axis=0)
                evidence = np.exp(total - total.max())
                best = int(evidence.argmax())
                labels.append(languages[best])
                scores.append(float(evidence[best] / evidence.sum()))
        return labels, scores


def predict_texts(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every text; a narrow map."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def make():
        predictor = Predictor(shared.value)

        def step(rows):
            labels, scores = predictor.predict(rows["t"])
            return {"k": rows["k"], "lang_pred": labels, "score": scores}

        return step

    return map_rows(rows, f"k {dict(rows.dtypes)['k']}, lang_pred string, score double", make).withColumnRenamed("k", key)


def keep_determined(docs: DataFrame, model: Model, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without texts of no determinable language: ``und``, or a score below ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predictor = Predictor(shared.value)

        def keep(texts):
            labels, scores = predictor.predict(texts)
            return [label != UNDETERMINED and score >= least for label, score in zip(labels, scores, strict=True)]

        return keep

    return filter_rows(docs, text, make)
