"""Toxicity by multiple-instance learning (operator 7).

A document is a bag of sentences. A logistic model gives each sentence a probability; the
document's is their noisy-or, 1 - (1 - leak) * product(1 - p). Only document labels are seen:
the gradient of the document's log-likelihood reaches the sentences through the noisy-or, so
the sentences that explain a label are found on the way and can be reported.

A sentence's features are its words and their first 3 to 6 letters (inflected forms share
them), hashed into a table of fixed size. The model is fitted on the driver from a bounded
sample of labelled documents, ``FIT_ROWS`` a class, chosen by hash; that table is all that is
broadcast. Scoring is a narrow map over whole texts.

Edge cases: null and empty texts have no sentence and score the leak; without labelled rows of
both classes every score is the label's base rate (0 without any); a document with labels of both
classes counts as toxic; very long texts are scored whole (the fit's sample has texts of at most
``FIT_CHARS`` characters); repeated rows repeat their scores, and teach once; null keys are scored
like others and do not teach; an empty table gives no rows; extra columns, whatever their names, are
ignored, and carried by ``keep_clean``.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import filter_rows, fold, map_rows

#: Labelled documents of each class that the fit reads, and the longest text among them.
FIT_ROWS = 4_000
FIT_CHARS = 20_000
#: Slots of the weight table (a power of two).
SLOTS = 1 << 18
#: Screening: toxic documents that hold a feature, in standard deviations beyond chance and at least.
LEAST_EXCESS = 3.5
LEAST_SUPPORT = 4
PREFIXES = (3, 4, 5, 6)
EPOCHS = 150
RATE = 0.3
L1 = 2e-5
#: Weight of the toxic class in the likelihood; the other has the rest.
TOXIC_SHARE = 0.35
#: Logit of a sentence without any telling feature, so that length alone never offends.
NEVER = -50.0
#: Words whose weight a Python worker remembers.
CACHE_WORDS = 300_000

#: Words, and marks or line ends that close a sentence.
_TOKEN = re.compile(r"\w+|[.!?\n]+")


def features(word: str) -> list[int]:
    """Slots of a lower-cased word: itself and its prefixes."""
    names = ["=" + word] + [f"{n}{word[:n]}" for n in PREFIXES if len(word) > n]
    return [zlib.crc32(name.encode("utf-8", "surrogatepass")) & (SLOTS - 1) for name in names]


def sentences(text: str | None) -> list[list[str]]:
    """Lower-cased words by sentence; sentences without words are left out."""
    out: list[list[str]] = [[]]
    for token in _TOKEN.findall((text or "").lower()):
        if token[0] in ".!?\n":
            if out[-1]:
                out.append([])
        else:
            out[-1].append(token)
    return out if out[-1] else out[:-1]


def noisy_or(log_misses: np.ndarray, leak: float) -> float:
    return 1.0 - (1.0 - leak) * float(np.exp(log_misses.sum()))


def _log_miss(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z)), without overflow."""
    return -np.logaddexp(0.0, z)


class Model:
    """weights: float32[SLOTS]; a sentence's logit is bias plus the weights of its words, or
    NEVER where these are all zero."""

    def __init__(self, weights: np.ndarray, bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak


def fit(texts: list[str], labels: list[int]) -> Model:
    """Fit by full-batch gradient steps (Adam) on the documents' log-likelihood."""
    y = np.asarray(labels, dtype=np.float64)
    rate = float(y.mean()) if len(y) else 0.0
    if len(set(labels)) < 2:
        return Model(np.zeros(SLOTS, dtype=np.float32), -30.0, rate)

    slots, sizes, document_of = array("i"), array("i"), array("i")
    seen = np.zeros((2, SLOTS), dtype=np.int64)  # documents of each class that hold a feature
    for d, text in enumerate(texts):
        first = len(slots)
        for words in sentences(text):
            own = {f for w in words for f in features(w)}
            slots.extend(own)
            sizes.append(len(own))
            document_of.append(d)
        seen[labels[d]][np.unique(np.array(slots[first:], dtype=np.int64))] += 1
    slot, doc = np.asarray(slots), np.asarray(document_of)
    n_docs, n_sent = len(y), len(doc)
    sent = np.repeat(np.arange(n_sent, dtype=np.int32), np.asarray(sizes))

    # Screening: features that more toxic documents hold than chance explains.
    seen0, seen1 = seen
    n1, n0 = y.sum(), (1 - y).sum()
    share = (seen1 + seen0) / n_docs
    excess = (seen1 - n1 * share) / np.sqrt(np.maximum(n1 * n0 / n_docs * share * (1 - share), 1e-12))
    kept = np.flatnonzero((excess >= LEAST_EXCESS) & (seen1 >= LEAST_SUPPORT))
    dense = np.full(SLOTS, -1, dtype=np.int64)
    dense[kept] = np.arange(len(kept))
    use = dense[slot] >= 0
    col, row = dense[slot[use]], sent[use]

    has = np.bincount(row, minlength=n_sent) > 0
    theta = np.zeros(len(kept) + 2)  # weights, bias, leak's logit
    theta[-2], theta[-1] = -4.0, np.log(0.02)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    per_class = np.where(y == 1, TOXIC_SHARE / n1, (1 - TOXIC_SHARE) / n0)
    for step in range(1, EPOCHS + 1):
        z = np.where(has, theta[-2] + np.bincount(row, weights=theta[col], minlength=n_sent), NEVER)
        leak = 1 / (1 + np.exp(-theta[-1]))
        log_miss = np.bincount(doc, weights=_log_miss(z), minlength=n_docs) + np.log1p(-leak)
        p = -np.expm1(log_miss)
        # d(loss)/d(log_miss): label 1 pulls misses down, label 0 up
        g = per_class * np.where(y == 1, np.exp(log_miss) / np.maximum(p, 1e-9), -1.0)
        dz = -g[doc] / (1 + np.exp(-z))
        grad = np.zeros_like(theta)
        grad[:-2] = np.bincount(col, weights=dz[row], minlength=len(kept)) + L1
        grad[-2] = dz.sum()
        grad[-1] = -(g * leak).sum()
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        theta -= RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * m / (np.sqrt(v) + 1e-10)
        theta[:-2] = np.maximum(theta[:-2], 0.0)  # a word can offend, not excuse
        theta[-1] = min(theta[-1], np.log(0.1))
    weights = np.zeros(SLOTS, dtype=np.float32)
    weights[kept] = theta[:-2]
    return Model(weights, float(theta[-2]), float(1 / (1 + np.exp(-theta[-1]))))


def fit_from_tables(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held_out: int = 0) -> Model:
    """Fit from labelled documents outside the held-out fold.

    The sample's keys come from the small label table, so only its texts - at most
    2 * FIT_ROWS of at most FIT_CHARS characters - are looked up and brought together.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key, folds) != held_out))
    one_each = usable.groupBy(key).agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64(key)
    chosen = None
    for y in (0, 1):
        part = one_each.where(F.col("y") == y).orderBy(order, key).limit(FIT_ROWS)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(key), F.col(text).alias("_text")).where(F.length("_text").between(1, FIT_CHARS))
    rows = texts.join(F.broadcast(chosen), key).select(key, "_text", "y").dropDuplicates([key]).collect()
    rows.sort(key=lambda r: r[0])
    return fit([r["_text"] for r in rows], [r["y"] for r in rows])


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def word_weight(self, word: str) -> float:
        return float(self.model.weights[features(word)].sum())

    def logits(self, text: str | None) -> np.ndarray:
        """One logit per sentence that has words; a repeated word of a sentence counts once."""
        known, bias = self.known, self.model.bias
        if len(known) > CACHE_WORDS:
            known.clear()
        out = []
        for words in sentences(text):
            own = set(words)
            for word in own.difference(known):
                known[word] = self.word_weight(word)
            weight = sum(map(known.__getitem__, own))
            out.append(bias + weight if weight > 0 else NEVER)
        return np.asarray(out, dtype=np.float64)

    def score(self, text: str | None) -> tuple[float, np.ndarray]:
        z = self.logits(text)
        return min(1.0, max(0.0, noisy_or(_log_miss(z), self.model.leak))), z


def score_texts(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", locate: bool = False) -> DataFrame:
    """(key, score, predicted, n_offending), and with ``locate`` the offending sentences' text.

    A sentence offends if its own probability is at least a half.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"{key} {dict(docs.dtypes)[key]}, score double, predicted int, n_offending int" + ", offending array<string>" * locate

    def make():
        scorer = Scorer(shared.value)

        def step(rows):
            out = {key: rows[key], "score": [], "predicted": [], "n_offending": [], "offending": []}
            for value in rows[text]:
                p, z = scorer.score(value)
                out["score"].append(p)
                out["predicted"].append(int(p >= 0.5))
                out["n_offending"].append(int((z >= 0).sum()))
                if locate:
                    out["offending"].append([" ".join(words) for words, x in zip(sentences(value), z, strict=True) if x >= 0])
            return out

        return step

    return map_rows(docs.select(key, text), schema, make)


def keep_clean(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` without the rows scored a half or more; a narrow map, no row is moved."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: [scorer.score(t)[0] < 0.5 for t in texts]

    return filter_rows(docs, text, make)
