"""Quality by a sparse ensemble of rules.

Each text is described by statistics. Small trees, each grown on a resample of the labelled rows, are taken apart
into rules: conjunctions of thresholds along their paths. A lasso logistic regression weighs the rules and leaves most
out, and what is left is compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matrel.llm import _words
from matrel.llm._io import table
from matrel.llm._labels import held_out, training_rows

#: The statistics of a text, all shares and means, so that none grows with its length but the logarithms.
STATISTICS = ("log_words", "word_length", "upper", "symbol", "digit", "exclaim", "bar", "repeat", "distinct", "top_word", "line_words", "stop", "log_bytes")
TREES, DEPTH, CUTS = 40, 3, 24
#: Labelled rows each tree is grown on, drawn anew from the bounded sample that is learned from.
RESAMPLE = 4000
_SEED = 71

_UPPER, _LETTER, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT[48:58] = True
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?"]] = True


def text_statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; an empty text has all zeros."""
    off, data = _words.string_buffer(column)
    size = np.diff(off)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[off])

    words = _words.Words(off, data)
    n = words.counts()
    some, first = np.maximum(n, 1), words.first
    doc = np.repeat(np.arange(len(n)), n)
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    distinct, top = np.zeros(len(n)), np.zeros(len(n))
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            own = np.sort(words.hash[a:b])
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            distinct[d] = len(edge) - 1
            top[d] = np.diff(edge).max()
    bytes_ = np.maximum(size, 1)
    letters = np.maximum(per_text(_LETTER[data]), 1)
    breaks = per_text(data == 10) + 1
    length = np.zeros(len(n))
    np.add.at(length, doc, words.end - words.start)
    stop = per_text(data == 46)
    out = np.stack([np.log1p(n), length / some, per_text(_UPPER[data]) / letters, per_text(_SYMBOL[data]) / bytes_, per_text(_DIGIT[data]) / bytes_, per_text(data == 33) / bytes_, per_text(data == 124) / bytes_, np.diff(np.concatenate([[0], np.cumsum(same)])[first]) / some, distinct / some, top / some, np.log1p(n / breaks), stop / some, np.log1p(size)], 1)
    out[size == 0] = 0.0
    return out


def statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``key, *STATISTICS``, one for each row of ``docs``; a null text counts as empty; further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _words.slices(whole, "text"):
                x = text_statistics(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(x[:, k])) for k in range(x.shape[1])]], names=["key", *STATISTICS])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_words.tidy(run), f"key {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))
    return out.withColumnRenamed("key", key)


#: A rule: (statistic, whether above, threshold), all of which must hold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def column(self) -> Column:
        """The chance of label 1 as one expression over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for k, above, t in rule:
                c = F.col(STATISTICS[k])
                holds = holds & ((c > t) if above else (c <= t))
            total = total + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + hold(self.rules, x) @ np.array(self.weights, float).reshape(-1))))


def hold(rules: tuple[Rule, ...] | list[Rule], x: np.ndarray) -> np.ndarray:
    """Which rows each rule holds for (rows x rules, 0 or 1)."""
    out = np.ones((len(x), len(rules)))
    for r, rule in enumerate(rules):
        for k, above, t in rule:
            out[:, r] *= (x[:, k] > t) if above else (x[:, k] <= t)
    return out


def _binned(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each statistic as the number of its cuts (quantiles of all rows) that lie below the value, and the cuts."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1])) for k in range(x.shape[1])]
    return np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1), cuts


def _paths(bins: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, depth: int, lead: Rule) -> list[Rule]:
    """Rules of one tree: the paths to all its nodes but the root. Splits lower the Gini impurity most."""
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return []
    best = (0.0, 0, 0)
    n, ones = len(y), y.sum()
    for k in rng.choice(bins.shape[1], max(1, bins.shape[1] // 2), replace=False):
        a = np.cumsum(np.bincount(bins[:, k], minlength=len(cuts[k]) + 1))[:-1]
        p = np.cumsum(np.bincount(bins[:, k], y, len(cuts[k]) + 1))[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((a >= 5) & (a <= n - 5), p * p / a + (ones - p) ** 2 / (n - a) - ones * ones / n, 0.0)
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), int(k), int(gain.argmax()))
    gain, k, cut = best
    if gain <= 1e-9:
        return []
    out = []
    for above in (False, True):
        rule = (*lead, (k, above, float(cuts[k][cut])))
        side = (bins[:, k] > cut) == above
        out += [rule, *_paths(bins[side], cuts, y[side], rng, depth - 1, rule)]
    return out


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights under an absolute penalty, by accelerated proximal gradients; the bias is free."""
    n, m = a.shape
    w, bias = np.zeros(m), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    full = np.concatenate([a, np.ones((n, 1))], 1)
    v = np.ones(m + 1)
    for _ in range(20):  # the largest eigenvalue, for the step
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / max(1e-9, np.linalg.norm(full.T @ (full @ v)))
    z, t = np.append(w, bias), 1.0
    ahead = z.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ ahead, -30, 30)))
        new = ahead - step * (full.T @ (p - y)) / n
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - z)
        z, t = new, t_new
    return z[:m], float(z[m])


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4) -> RuleEnsemble:
    """The ensemble of labelled statistics. With one label only, no rule: everything gets that label's chance."""
    if not len(y) or y.min() == y.max():
        return RuleEnsemble((), (), 6.0 if len(y) and y[0] else -6.0 if len(y) else 0.0)
    rng = np.random.default_rng(_SEED)
    rules: dict[Rule, None] = {}
    bins, cuts = _binned(x)
    for _ in range(TREES):
        rows = rng.choice(len(y), min(len(y), RESAMPLE))
        for rule in _paths(bins[rows], cuts, y[rows], rng, DEPTH, ()):
            rules[rule] = None
    kept = list(rules)
    if not kept:
        return RuleEnsemble((), (), float(np.log(y.mean() / (1 - y.mean()))))
    a = hold(kept, x)
    _, single = np.unique(a, axis=1, return_index=True)
    kept = [kept[k] for k in sorted(single)]
    a = a[:, sorted(single)]
    w, bias = _lasso(a, y, penalty)
    used = np.flatnonzero(np.abs(w) > 1e-3)
    return RuleEnsemble(tuple(kept[k] for k in used), tuple(float(w[k]) for k in used), bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id") -> RuleEnsemble:
    """The ensemble of the labelled rows that aren't held out (at most ``_labels.SAMPLE``, whose statistics come to the driver)."""
    rows = training_rows(docs, labels, label, text, key)
    got = statistics(rows.select(F.col("y").alias("doc_id"), "text")).toPandas()
    got = got.sort_values(list(got.columns)).reset_index(drop=True)  # whatever order they came in
    return fit_rules(got[list(STATISTICS)].to_numpy(np.float64), got["doc_id"].to_numpy(np.float64))


def score(docs: DataFrame, model: RuleEnsemble, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``key, score, *STATISTICS``, one for each row of ``docs``.

    A null or empty text has all statistics zero and is scored like any other; a null key stays null; repeated rows stay; an
    empty table gives an empty one.
    """
    return statistics(docs, text, key).withColumn("score", model.column())


def keep_good(docs: DataFrame, model: RuleEnsemble, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``least``. A null text counts as empty."""
    rest = F.struct(F.lit(True).alias("there"), *[F.col(f"`{c}`") for c in docs.columns if c != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _words.slices(whole, "text"):
                x = text_statistics(batch.column(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(x[:, k])) for k in range(x.shape[1])]], names=["rest", "text", *STATISTICS])

    # each text goes to Python once; the rules are column expressions
    rows = docs.select(rest.alias("rest"), F.col(text).alias("text"))
    out = rows.mapInArrow(_words.tidy(run), T.StructType([*rows.schema.fields, *[T.StructField(s, T.DoubleType()) for s in STATISTICS]])).where(model.column() >= least)
    return out.select(*[(F.col("text") if c == text else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
