"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; every later model sees the log odds that the earlier
ones gave. In training these come from models that did not see the row (``FOLDS`` folds), so a later
model learns how far it may trust them. Features are the words of a text and their first 4 to 6
letters, at the rate per hundred words; the ``FEATURES`` most telling ones per category are kept.

The classifier is fitted on at most ``TRAIN_ROWS`` labelled documents of each label combination, the
first in a fixed hash order of their ids (so reruns agree); intercepts are moved back to the shares of
all labelled rows. Scoring is one scan of the whole texts with the weights broadcast, no shuffle.

Defined results: null and empty texts get the probabilities of an empty text; labels that are null in a
category's columns are left out; a category without both classes among the labels, or an empty label
table, gives that share (0 if none) to all; repeated rows are scored one by one; other columns pass
through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plantlog.llm.common import saved

#: Chain order: name and condition over the label columns.
CATEGORIES = (("spam", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_spam", "toxic = 1 AND quality = 0"))
TRAIN_ROWS, FOLDS, FEATURES, PREFIXES, RECALL = 2500, 5, 400, (3, 4, 5, 6), 1.5
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 200_000


def grams(word: str) -> list[str]:
    """The word itself and its beginnings (marked by a hyphen)."""
    return [word, *[word[:n] + "-" for n in PREFIXES if len(word) >= n]]


def counts(text: str | None) -> tuple[Counter, int]:
    words = Counter(_WORD.findall((text or "").lower()))
    return words, sum(words.values())


@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]
    vocabulary: dict[str, int]
    weights: tuple[np.ndarray, ...]
    biases: tuple[float, ...]

    def matrix(self, texts: list[str | None], cache: dict) -> np.ndarray:
        x = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        for i, text in enumerate(texts):
            words, n = counts(text)
            for word, k in words.items():
                at = cache.get(word)
                if at is None:
                    if len(cache) > _CACHE:
                        cache.clear()
                    at = cache[word] = tuple(self.vocabulary[g] for g in grams(word) if g in self.vocabulary)
                for j in at:
                    x[i, j] += k
            if n:
                x[i] *= 100 / n
        return np.log1p(x)

    def predict(self, x: np.ndarray) -> np.ndarray:
        odds = np.zeros((len(x), 0))
        for w, b in zip(self.weights, self.biases):
            z = np.clip(np.hstack((x, odds)) @ w + b, -30, 30)
            odds = np.hstack((odds, z[:, None]))
        return 1 / (1 + np.exp(-odds))


def fit_linear(x: np.ndarray, y: np.ndarray, rows: np.ndarray, steps: int = 150, ridge: float = 2e-4):
    """Logistic regression by accelerated gradient descent; ``rows`` weighs the rows."""
    x, rows = np.ascontiguousarray(x, np.float32), (rows / rows.sum()).astype(np.float32)
    share = float(np.clip((rows * y).sum(), 1e-6, 1 - 1e-6))
    b = v_b = float(np.log(share / (1 - share)))
    w = np.zeros(x.shape[1])
    v = w.copy()
    if not 0 < y.sum() < len(y):
        return w, b
    rate = 4 / (np.sqrt(rows)[:, None] * x).ravel().dot((np.sqrt(rows)[:, None] * x).ravel())
    for k in range(steps):
        d = rows * (1 / (1 + np.exp(-np.clip(x @ v + v_b, -30, 30))) - y)
        new, new_b = v - rate * (x.T @ d + ridge * v), v_b - 4 * d.sum()
        m = k / (k + 3)
        v, v_b = new + m * (new - w), new_b + m * (new_b - b)
        w, b = new, new_b
    return w, b


def operating_point(odds: np.ndarray, y: np.ndarray, rows: np.ndarray) -> float:
    """The log odds above which rows are best taken for positive: the best F score, with recall counting
    ``RECALL`` times as much as precision, over the out-of-fold odds; half way to the next lower row. Few
    positive labels leave a model's odds low, their order is what it learned."""
    if not 0 < y.sum() < len(y):
        return 0.0
    order = np.argsort(-odds, kind="stable")
    hit, all_ = np.cumsum((rows * y)[order]), np.cumsum(rows[order])
    score = (1 + RECALL ** 2) * hit / (RECALL ** 2 * hit[-1] + all_)
    # A cut between equal odds is none.
    score[:-1][odds[order][1:] == odds[order][:-1]] = 0
    best = int(np.argmax(score))
    low = odds[order[best + 1]] if best + 1 < len(y) else odds[order[best]] - 1
    return float((odds[order[best]] + low) / 2)


def _select(sample: DataFrame, names: list[str]) -> list[str]:
    """The features whose document shares differ most between a category's classes."""
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, np.ndarray] = {}
            marks = np.array([batch.column(c).to_numpy() for c in names]).T
            for text, mark in zip(batch.column("text").to_pylist(), marks):
                row = np.concatenate(([1], mark))
                for g in {g for w in counts(text)[0] for g in grams(w)}:
                    seen[g] = seen[g] + row if g in seen else row
            table = np.array(list(seen.values()), np.int64).reshape(len(seen), n + 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[
                pa.array(table[:, j]) for j in range(n + 1)]], ["g", "n", *names])

    found = sample.mapInArrow(run, "g string, n long, " + ", ".join(f"{c} long" for c in names)).groupBy(
        "g").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).where("n >= 3")
    totals = sample.agg(F.count("*"), *[F.sum(c) for c in names]).first()
    kept: dict[str, None] = {}
    for j, c in enumerate(names):
        pos, all_ = totals[j + 1] or 0, totals[0]
        if not 0 < pos < all_:
            continue
        p, q = F.col(c) / pos, (F.col("n") - F.col(c)) / (all_ - pos)
        score = F.abs(p - q) / F.sqrt(F.greatest(p + q, F.lit(0.02)))
        kept.update(dict.fromkeys(r["g"] for r in found.orderBy(F.desc(score), "g").limit(FEATURES).collect()))
    return list(kept)


def train(docs: DataFrame, labels: DataFrame, categories: tuple = CATEGORIES, doc_id: str = "doc_id",
          text: str = "text", rows_per_class: int = TRAIN_ROWS) -> Chain:
    names = [n for n, _ in categories]
    marked = labels.select(F.col(doc_id).alias("id"), *[
        F.expr(f"CAST({e} AS INT)").alias(n) for n, e in categories]).dropna().dropDuplicates(["id"])
    shares = {tuple(r[n] for n in names): r["count"] for r in marked.groupBy(*names).count().collect()}
    # A hash threshold takes about the wanted number of each class; a shared order makes it exact.
    order = F.xxhash64("id")
    picks = [marked.where(F.struct(*names) == F.struct(*[F.lit(v) for v in mark])).orderBy(order, "id").limit(
        rows_per_class) for mark in sorted(shares)]
    if not picks:
        return Chain(tuple(names), {}, tuple(np.zeros(j) for j in range(len(names))), (-30.0,) * len(names))
    chosen = picks[0]
    for p in picks[1:]:
        chosen = chosen.union(p)
    sample = saved(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(
        F.broadcast(saved(chosen, "toxic-chosen")), "id").dropDuplicates(["id"]), "toxic-sample")
    vocabulary = {g: j for j, g in enumerate(_select(sample, names))}
    blank = Chain(tuple(names), vocabulary, (), ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            x = blank.matrix(batch.column("text").to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[batch.column(c) for c in names], pa.array(
                [r.tobytes() for r in x], pa.binary())], ["id", *names, "x"])

    kind = sample.schema["id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} int" for c in names) + ", x binary").toPandas()
    got = got.sort_values("id", kind="stable")
    x = np.array([np.frombuffer(b, np.float32) for b in got["x"]]).reshape(len(got), -1)
    y = got[names].to_numpy().astype(float)
    combos = [tuple(int(v) for v in r) for r in y]
    taken = Counter(combos)
    rows = np.array([shares[c] / taken[c] for c in combos])
    fold = np.arange(len(x)) % FOLDS
    weights, biases, odds = [], [], np.zeros((len(x), 0))
    for j in range(len(names)):
        xj, own = np.hstack((x, odds)), np.zeros(len(x))
        for f in range(FOLDS):
            train_, test = fold != f, fold == f
            if train_.any() and test.any():
                w, b = fit_linear(xj[train_], y[train_, j], rows[train_])
                own[test] = np.clip(xj[test] @ w + b, -30, 30)
        w, b = fit_linear(xj, y[:, j], rows)
        edge = operating_point(own, y[:, j], rows)
        weights.append(w)
        biases.append(b - edge)
        odds = np.hstack((odds, own[:, None] - edge))
    return Chain(tuple(names), vocabulary, tuple(weights), tuple(biases))


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and ``p``, one probability per category in chain order."""
    model = docs.sparkSession.sparkContext.broadcast(chain)
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            column = batch.column("text")
            for lo in range(0, len(column), 512):
                part = column.slice(lo, 512)
                p = model.value.predict(model.value.matrix(part.to_pylist(), cache))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, 512), pa.array(list(np.round(p, 6)), pa.list_(pa.float64()))],
                    ["row", "p"])

    return rows.mapInArrow(run, f"row {docs.schema.simpleString()}, p array<double>")
