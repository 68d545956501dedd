"""Toxicity by maximum-scoring segments of token log-odds.

Learning compares in how many toxic and clean documents each token and token prefix occurs: log-odds with an
informative Dirichlet prior (each feature's share of all documents), kept where the likelihood ratio is
significant among so many features. A word scores the best of its features, any other word slightly below zero. One linear scan finds every maximal segment of positive
score in a text. Scores of segments follow an extreme-value law in a text of n words, so the evidence is
lambda * score - ln n, and a logistic curve maps it to the chance of the label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.llm import _words
from matrel.llm._io import table, written
from matrel.llm._labels import held_out, training_rows

#: Bytes of the prefixes that count as features beside the whole token.
PREFIXES = (4, 5, 6)
#: Features kept, at most: the most significant ones. Bounds the model that is sent to the tasks.
FEATURES = 20_000
#: Of four learned texts (by hash, so that copies stay together) one is for the calibration, the rest for the features.
CALIBRATION = 4
#: Strength of the prior, as a share of the labelled documents.
PRIOR = 0.03
#: Score of a word without evidence; a segment bridges gaps of about its score over this.
NEUTRAL = -0.1


def _features(words: _words.Words) -> list[np.ndarray]:
    return [words.hash, *[words.prefix_hash(k) for k in PREFIXES]]


@dataclass(frozen=True)
class Toxicity:
    """A fitted model: significant features with their log-odds, and the calibration."""

    hashes: np.ndarray  # ascending
    odds: np.ndarray
    rate: float = 1.0  # lambda of the extreme-value law
    slope: float = 1.0
    bias: float = -3.0

    def word_scores(self, words: _words.Words) -> np.ndarray:
        out = np.full(len(words.hash), NEUTRAL)
        if not len(self.hashes):
            return out
        for h in _features(words):
            maybe = np.flatnonzero(self._sieve()[(h & np.uint64(0xFFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[maybe]
            rows = maybe[hit]
            out[rows] = np.maximum(out[rows], self.odds[at[hit]])
        return out

    def _sieve(self) -> np.ndarray:
        found = self.__dict__.get("_s")
        if found is None:
            found = np.zeros(1 << 20, bool)
            found[(self.hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True
            object.__setattr__(self, "_s", found)
        return found

    def chance(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """From the best segment's score and the number of words to the chance of label 1."""
        x = self.slope * evidence(best, n, self.rate) + self.bias
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def evidence(best: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
    """lambda * score - ln n: how far the best segment is out in the tail of the extreme-value law."""
    return rate * best - np.log(np.maximum(n, 1))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), in order: one scan, linear in the words.

    Only positive words can begin or end a segment; between them the running total does. Each held segment knows the last one
    before it with a smaller total at its left, so the search for that one follows these links and passes each segment once.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[int, int, float, float, int]] = []  # start, stop, total before, total after, the link
    for k in np.flatnonzero(scores > 0).tolist():
        start, stop, low, high = k, k + 1, total[k], total[k + 1]
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= high:
                held.append((start, stop, low, high, j))
                break
            # it and all after it become one with this segment
            start, _, low, _, link = held[j]
            del held[j:]
            j = link
    return [(a, b, high - low) for a, b, low, high, _ in held]


def _scored(model: Toxicity, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, float]]], _words.Words]:
    words = _words.Words(*_words.string_buffer(column), separator=_words.PUNCTUATED)
    scores = model.word_scores(words)
    first = words.first
    n = np.diff(first)
    found: list[list[tuple[int, int, float]]] = [[] for _ in range(len(n))]
    hot = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(scores > 0)])[first]))
    for d in hot.tolist():
        found[d] = segments(scores[first[d] : first[d + 1]])
    best = np.array([max((s for _, _, s in x), default=0.0) for x in found])
    return best, n, found, words


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id") -> Toxicity:
    """A model of the labelled rows that aren't held out (at most ``_labels.SAMPLE``).

    Without rows of both labels there is nothing to learn: the model then gives every text the share of label 1 met, or 0.
    """
    rows = written(training_rows(docs, labels, label, text, key).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(CALIBRATION))), "toxicity-sample")
    sums = rows.agg(F.sum("y").alias("bad"), F.count("y").alias("all")).first()
    bad, clean = float(sums["bad"] or 0), float(sums["all"] - (sums["bad"] or 0))
    if not bad or not clean:
        return Toxicity(np.zeros(0, np.uint64), np.zeros(0), 1.0, 0.0, 500.0 if bad else -500.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _words.slices(whole, "text"):
                words = _words.Words(*_words.string_buffer(batch.column(0)), separator=_words.PUNCTUATED)
                doc = np.repeat(np.arange(batch.num_rows), words.counts())
                h = np.concatenate(_features(words))
                d = np.tile(doc, 1 + len(PREFIXES))
                real = h != 0
                h, d = h[real], d[real]
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, d = h[once], d[once]
                y = batch.column(1).to_numpy()[d]
                names, at = np.unique(h, return_inverse=True)
                a = np.bincount(at, y, len(names))
                b = np.bincount(at, 1 - y, len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(a), pa.array(b)], names=["h", "a", "b"])

    counted = rows.where("part > 0").select("text", "y").mapInArrow(_words.tidy(count), "h long, a double, b double").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counted = written(counted.where("a + b > 2"), "toxicity-features")
    learned = rows.where("part > 0").agg(F.sum("y").alias("bad"), F.count("y").alias("all")).first()
    bad = float(learned["bad"] or 0)
    clean = float(learned["all"] - bad)
    share = min(max(bad / max(1.0, bad + clean), 1e-6), 1 - 1e-6)
    n = F.col("a") + F.col("b")
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("a"), share) + part(F.col("b"), 1 - share))
    a, b = F.col("a") + PRIOR * n, F.col("b") + PRIOR * n
    mass = PRIOR * (bad + clean)
    odds = F.log(a / (bad + mass - a + 1)) - F.log(b / (clean + mass - b + 1))
    # what the largest of so many ratios would reach by chance
    level = 2 * math.log(max(2, counted.count()))
    judged = counted.where(F.col("a") > n * share).select("h", odds.alias("odds"), ratio.alias("ratio")).where(F.col("ratio") >= level)
    kept = judged.orderBy(F.desc("ratio"), "h").limit(FEATURES).collect()
    hashes = np.array([r["h"] for r in kept], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = Toxicity(hashes[order], np.array([r["odds"] for r in kept])[order] if kept else np.zeros(0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _words.slices(whole, "text"):
                words = _words.Words(*_words.string_buffer(batch.column(0)), separator=_words.PUNCTUATED)
                best, n, _, _ = _scored(model, batch.column(0))
                x = np.concatenate([[0.0], np.cumsum(np.where(model.word_scores(words) > 0, 1, 0))])
                yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(n.astype(np.float64)), batch.column(1), pa.array(np.diff(x[words.first]))], names=["best", "n", "y", "hits"])

    # as many short rows as the sample has
    got = rows.where("part = 0").select("text", "y").mapInArrow(_words.tidy(score), "best double, n double, y double, hits double").toPandas()
    if got["y"].nunique() < 2:
        got = rows.select("text", "y").mapInArrow(_words.tidy(score), "best double, n double, y double, hits double").toPandas()
    best, n, y = got["best"].to_numpy(), got["n"].to_numpy(), got["y"].to_numpy()
    rate = _rate(got["hits"].to_numpy()[y == 0].sum() / max(1.0, n[y == 0].sum()), model.odds)
    slope, bias = _logistic(evidence(best, n, rate), y)
    return Toxicity(model.hashes, model.odds, rate, slope, bias)


def _rate(share: float, odds: np.ndarray) -> float:
    """lambda > 0 with E[exp(lambda * score)] = 1 over the words of clean texts, a share of which has positive scores.

    It is 1, as for exact log-odds, where there is no such root: without positive scores, or if their mean isn't negative.
    """
    if not len(odds) or share <= 0:
        return 1.0
    low, high = 1e-3, 1.0
    value = lambda t: share * float(np.exp(t * odds).mean()) + (1 - share) * math.exp(t * NEUTRAL) - 1
    if value(low) >= 0:
        return 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and bias of a logistic curve, by Newton steps with a little ridge."""
    centre, width = x.mean(), x.std() or 1.0
    a = np.stack([(x - centre) / width, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(0.0, w[0] / width)
    return float(slope), float(w[1] - slope * centre)


def keep_clean(docs: DataFrame, model: Toxicity, text: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``most``. A null text counts as empty."""
    rest = F.struct(F.lit(True).alias("there"), *[F.col(f"`{c}`") for c in docs.columns if c != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _words.slices(whole, "text"):
                best, n, _, _ = _scored(model, batch.column(1))
                yield batch.filter(pa.array(model.chance(best, n) < most))

    # each text goes to Python once, and back only if it stays
    rows = docs.select(rest.alias("rest"), F.col(text).alias("text"))
    out = rows.mapInArrow(_words.tidy(run), rows.schema)
    return out.select(*[(F.col("text") if c == text else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def score(docs: DataFrame, model: Toxicity, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``key, score, spans``, one for each row of ``docs``.

    ``score`` is the chance of label 1, ``spans`` every toxic passage as (start, stop, score): byte places in the UTF-8 text and the
    segment's log-odds. A null text counts as empty and has no span; a null key stays null; repeated rows stay; an empty table gives
    an empty one; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
        for whole in batches:
            for batch in _words.slices(whole, "text"):
                best, n, found, words = _scored(model, batch.column(1))
                spans = []
                for d, parts in enumerate(found):
                    base, lead = words.first[d], words.off[d]
                    spans.append([{"start": int(words.start[base + a] - lead), "stop": int(words.end[base + b - 1] - lead), "score": s} for a, b, s in parts])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.chance(best, n)), pa.array(spans, kind)], names=["key", "score", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_words.tidy(run), f"key {kind}, score double, spans array<struct<start:bigint,stop:bigint,score:double>>").withColumnRenamed("key", key)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
