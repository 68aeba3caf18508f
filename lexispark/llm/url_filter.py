"""URL filtering by rules and a character language-model ratio (operator 10).

Rules (host, path) come first: a rule fits its host and all subdomains where the URL's path
starts with the rule's path, and the longest fitting rule decides. Other URLs are judged by two
smoothed variable-order Markov models over the characters of host and path, one learned from
accepted and one from rejected URLs. The judgement is the difference of their log-likelihoods
divided by the number of characters, against a threshold calibrated on URLs held out of the
counts.

Which URLs teach: rejected are those that a rule blocks, accepted those that a rule allows. URLs
that no rule speaks of are unlabelled: they show what URLs look like, so the accepted model counts
them too, at a weight at which all of them together weigh as much as the accepted; the threshold is
calibrated on labelled URLs alone. Hosts are dealt into ``FOLDS`` folds, and counts are kept per fold: a URL
is judged by the counts of the other folds alone, so no URL, ruled or not, is judged by models that
have seen it or its host, and the threshold, too, is one for unseen hosts.

Counts are exact: a context of up to five bytes, its order and the symbol after it are one
64-bit number, and the table of counts by that number stays in Spark, as large as the URLs make
it. URLs are scored in blocks of ``1 << BLOCK_BITS`` rows: the distinct numbers of a block are joined
with the table, and the counts found meet the block's URLs. No counts come to the driver.

Edge cases: null and empty URLs and URLs without ``://`` have empty host and path, fit no rule, teach
nothing and are judged by the models (of the end mark alone); where the rules block nothing, or
allow nothing, all verdicts of the method are allow; of fitting rules of equal length the
alphabetically first decides; very long URLs are judged whole; rows with a null key are judged
like others; repeated rows teach and are judged one by one; an empty table gives no rows; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import LOWER, SLICE_ROWS, UPPER, fold, map_rows, materialize, worker_task


@dataclass(frozen=True)
class Rule:
    verdict: str  # "allow" | "block"
    host: str
    path: str  # starts with "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, pattern: str) -> Rule:
    """A rule of a pattern like ``net/de/``."""
    host, slash, path = pattern.partition("/")
    return Rule(verdict, host.lower(), slash + path)


ORDER = 5
BLOCK_BITS = 12
STRENGTH = 2.0
FOLDS = 5
BINS = 2000
SPAN = 10.0  # differences per character are put into bins between -SPAN and SPAN


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER)
    return host, F.regexp_extract(text, pattern, 2)


def apply_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule name, verdict) of the longest fitting rule, or nulls. For short rule lists."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        own = F.endswith(F.concat(F.lit("."), host), F.lit("." + r.host)) & (F.length(host) > 0)
        fits = own & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


# --- variable-order Markov models of exact counts ----------------------------------------

_PAD, _END = 1, 2


def symbols(text: str | None) -> bytes:
    """UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass")


def _keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every symbol of every text (and its end mark): text number, and per order the numbers
    of (context, symbol) and of (context): arrays [ORDER + 1, n]. No two of them share a number:
    bits 0 to 7 are the symbol, 8 to 47 the context, 48 to 50 the order, 52 marks a context."""
    coded = [bytes([_PAD] * ORDER) + symbols(t) + bytes([_END]) for t in texts]
    flat = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    owner = np.repeat(np.arange(len(coded)), lengths)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(np.arange(len(flat)) - first >= ORDER)
    pair, context = np.empty((ORDER + 1, len(at)), np.int64), np.empty((ORDER + 1, len(at)), np.int64)
    state = np.zeros(len(at), dtype=np.int64)
    for order in range(ORDER + 1):
        if order:
            state = state | flat[at - order] << 8 * order
        pair[order] = order << 48 | state | flat[at]
        context[order] = _CONTEXT | order << 48 | state
    return owner[at], pair, context


_CONTEXT = 1 << 52


@dataclass
class Model:
    """(key, accepted, rejected, unlabelled): counts of (context, symbol) and of contexts, an array with
    a place for each fold; the weight of the unlabelled, and the threshold."""

    counts: DataFrame
    weight: float
    threshold: float


def _log10_probability(pair: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Of each symbol, from the counts [ORDER + 1, n]: interpolated from order 0 to ORDER."""
    p = np.full(pair.shape[1], 1.0 / 256)
    for order in range(ORDER + 1):
        p = (pair[order] + STRENGTH * p) / (context[order] + STRENGTH)
    return np.log10(p)


def text_differences(texts: list[str | None], folds: np.ndarray, keys: np.ndarray, accepted: np.ndarray, rejected: np.ndarray) -> np.ndarray:
    """Length-normalised log10-likelihood difference, accepted less rejected, per text, by the
    counts [FOLDS, keys] of all folds but the text's own; ``keys`` ascend and end with one that no
    text has and whose counts are 0."""
    owner, pair, context = _keys(texts)
    own = folds[owner]
    places = []
    for wanted in (pair, context):
        at = np.searchsorted(keys, wanted)
        places.append(np.where(keys[at] == wanted, at, len(keys) - 1))
    logs = []
    for counts in (accepted, rejected):
        others = counts.sum(axis=0)[None, :] - counts
        logs.append(_log10_probability(*(others[own[None, :], at] for at in places)))
    return np.bincount(owner, weights=logs[0] - logs[1], minlength=len(texts)) / np.bincount(owner, minlength=len(texts))


def in_blocks(df: DataFrame) -> DataFrame:
    """``df`` (with text and fold) written once, with the number of each row's block: a row is in
    the same block wherever it is read."""
    block = F.shiftrightunsigned(F.monotonically_increasing_id(), BLOCK_BITS)
    return materialize(df.withColumn("_block", block), "url-blocks")


def count_symbols(labelled: DataFrame) -> DataFrame:
    """(key, accepted, rejected, unlabelled) of (text, fold, accepted): how often URLs of each class and
    fold have a key; null is unlabelled. Each batch adds up its own counts first."""

    def make():
        def step(rows):
            out: dict[str, list] = {"accepted": [], "fold": [], "key": [], "n": []}
            groups: dict[tuple, list] = {}
            for text, fold_, accepted in zip(rows["text"], rows["fold"], rows["accepted"], strict=True):
                groups.setdefault((accepted, fold_), []).append(text)
            for (accepted, fold_), texts in groups.items():
                key, n = np.unique(np.concatenate(_keys(texts)[1:]), return_counts=True)
                out["key"] += key.tolist()
                out["n"] += n.tolist()
                out["accepted"] += [accepted] * len(key)
                out["fold"] += [fold_] * len(key)
            return out

        return step

    counts = map_rows(labelled.select("text", "fold", "accepted"), "accepted boolean, fold int, key bigint, n bigint", make)
    of = lambda side, i: F.sum(F.when(side & (F.col("fold") == i), F.col("n")).otherwise(0))
    sides = {"accepted": F.col("accepted"), "rejected": ~F.col("accepted"), "unlabelled": F.col("accepted").isNull()}
    return counts.groupBy("key").agg(*[F.array(*[of(side, i) for i in range(FOLDS)]).alias(name) for name, side in sides.items()])


def fit(labelled: DataFrame) -> Model | None:
    """Models and threshold from rows of ``in_blocks`` with text, fold and accepted (null: unlabelled).
    None if accepted or rejected are missing."""
    counts = materialize(count_symbols(labelled), "url-counts")
    urls = counts.where(F.col("key") == _END).first()  # every URL ends once
    if urls is None or not sum(urls["accepted"]) or not sum(urls["rejected"]):
        return None
    unlabelled = sum(urls["unlabelled"])
    model = Model(counts, sum(urls["accepted"]) / unlabelled if unlabelled else 0.0, 0.0)
    model.threshold = calibrated_threshold(labelled.where("accepted IS NOT NULL"), model)
    return model


def calibrated_threshold(labelled: DataFrame, model: Model) -> float:
    """The difference that least confuses the URLs, both classes weighing the same.

    Differences are counted in bins; of equally good thresholds the middle is taken.
    """
    scored = score(labelled, model, ["accepted"])
    at = F.least(F.greatest(F.floor((F.col("difference") + SPAN) * (BINS / (2 * SPAN))), F.lit(0)), F.lit(BINS - 1))
    bins = np.zeros((2, BINS))
    for row in scored.groupBy("accepted", at.cast("int").alias("bin")).count().collect():
        bins[int(row["accepted"]), row["bin"]] += row["count"]
    rate = bins / bins.sum(axis=1, keepdims=True)
    # threshold at the lower edge of bin b: accepted below are lost, rejected from b on are let in
    lost = np.concatenate([[0.0], np.cumsum(rate[1])])
    let_in = 1.0 - np.concatenate([[0.0], np.cumsum(rate[0])])
    cost = np.round(lost + let_in, 12)
    best = np.flatnonzero(cost == cost.min())
    return float((best[0] + best[-1]) / 2 * (2 * SPAN / BINS) - SPAN)


def score(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and the length-normalised difference of every row of ``in_blocks``."""
    kinds, weight = dict(rows.dtypes), model.weight
    rows = rows.select("_block", "text", "fold", *keep)

    def make():
        def step(batch):
            out: dict[str, list] = {"_block": [], "key": []}
            blocks = np.array(batch["_block"])
            for b in np.unique(blocks).tolist():
                texts = [batch["text"][i] for i in np.flatnonzero(blocks == b)]
                key = np.unique(np.concatenate(_keys(texts)[1:]))
                out["key"] += key.tolist()
                out["_block"] += [b] * len(key)
            return out

        return step

    wanted = map_rows(rows.select("_block", "text"), "_block bigint, key bigint", make).distinct()
    found = wanted.join(model.counts, "key")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        with worker_task("url-score"):
            keys = right["key"].to_numpy()
            order = np.argsort(keys)
            keys = np.r_[keys[order], np.iinfo(np.int64).max]
            side = {}
            for name in ("accepted", "rejected", "unlabelled"):
                values = pc.list_flatten(right[name].combine_chunks()).to_numpy(zero_copy_only=False).reshape(-1, FOLDS)
                side[name] = np.r_[values[order], np.zeros((1, FOLDS), np.int64)].T
            sides = [side["accepted"] + weight * side["unlabelled"], side["rejected"]]
            folds = left["fold"].to_numpy()
            parts = [text_differences(left["text"].slice(at, SLICE_ROWS).to_pylist(), folds[at : at + SLICE_ROWS], keys, *sides) for at in range(0, left.num_rows, SLICE_ROWS)]
            return left.select(keep).append_column("difference", pa.array(np.concatenate(parts)))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", difference double"
    return rows.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(add, schema)


def judge(pages: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: key, host, path, rule, verdict, and the method's difference (null without models)."""
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(key).alias("_id"), host.alias("host"), path.alias("path"))
    name, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", name).withColumn("ruled", verdict).withColumn("text", F.concat("host", "path"))
    parsed = in_blocks(parsed.withColumn("fold", fold("host", FOLDS).cast("int")))
    teach = parsed.where("host <> ''").withColumn("accepted", F.col("ruled") == "allow")
    model = fit(teach)
    if model is None:
        judged = parsed.withColumn("difference", F.lit(None).cast("double"))
        method = F.lit("allow")
    else:
        judged = score(parsed, model, ["_id", "host", "path", "rule", "ruled"])
        method = F.when(F.col("difference") >= F.lit(model.threshold), "allow").otherwise("block")
    return judged.select(F.col("_id").alias(key), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "difference")
