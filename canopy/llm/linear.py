"""Logistic regression on sparse presence features, fitted on a bounded sample of labelled rows.

Spark gathers feature counts of the sample and encodes its rows; the fit itself sees at most `most_rows` rows of at
most `most_features` features and runs on the driver. Scoring runs over all rows inside Spark tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Sample:
    """Rows as runs of feature numbers, with their labels."""

    vocabulary: dict[str, int]
    index: np.ndarray
    edge: np.ndarray
    labels: dict[str, np.ndarray]
    #: A hash of each row's text, for folds: copies are held out together.
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.edge) - 1


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def labelled_sample(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """text and the label columns of at most most_rows labelled documents, those of the smallest id hash.

    A doc_id labelled several times takes its largest labels, one with several texts the last of them in order; null ids
    and null texts are left out.
    """
    names = [c for c in labels.columns if c != "doc_id"]
    once = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(c).alias(c) for c in names))
    picked = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text")
    joined = rows.join(F.broadcast(picked), "doc_id")  # bounded by most_rows
    return joined.groupBy("doc_id").agg(F.max("text").alias("text"), *(F.max(c).alias(c) for c in names)).drop("doc_id")


def encode_sample(
    sample: DataFrame, features: Callable[[str], Iterable[str]], categories: list[str], most_features: int, least_rows: int = 5
) -> Sample:
    """The sample's features: those of the largest chi-squared statistic for any category, in at least least_rows rows."""

    def count(frames):
        for frame in frames:
            rows = [
                (w, 1, *(int(x) for x in marks))
                for text, *marks in zip(frame["text"], *(frame[c] for c in categories))
                for w in set(features(text))
            ]
            yield pd.DataFrame(rows, columns=["word", "n", *categories])

    schema = "word string, n long, " + ", ".join(f"{c} long" for c in categories)
    total = sample.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in categories)).first()
    n = total["n"]
    counts = sample.mapInPandas(count, schema).groupBy("word").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in categories))

    def chi(c):
        rate = (total[c] or 0) / max(1, n)
        gap = F.col(c) - F.col("n") * rate
        return gap * gap / (F.col("n") * max(rate * (1 - rate), 1e-9))

    best = counts.where(F.col("n") >= least_rows).orderBy(F.greatest(F.lit(0.0), *map(chi, categories)).desc(), "word").limit(most_features)
    vocabulary = {w: k for k, w in enumerate(sorted(r["word"] for r in best.select("word").collect()))}

    def encode(frames):
        for frame in frames:
            out = frame[["hash", *categories]].copy()
            out["index"] = [sorted(vocabulary[w] for w in set(features(t)) if w in vocabulary) for t in frame["text"]]
            yield out

    schema = "hash long, " + ", ".join(f"{c} int" for c in categories) + ", index array<int>"
    rows = sample.withColumn("hash", F.xxhash64("text")).mapInPandas(encode, schema).toPandas()
    rows = rows.sort_values(["hash", *categories], kind="stable")
    runs = [np.asarray(x, np.int64) for x in rows["index"]]
    edge = np.concatenate(([0], np.cumsum([len(x) for x in runs]))).astype(np.int64)
    index = np.concatenate(runs) if runs else np.zeros(0, np.int64)
    return Sample(vocabulary, index, edge, {c: rows[c].to_numpy(np.float64) for c in categories}, rows["hash"].to_numpy(np.int64))


def matrix(sample: Sample, extra: np.ndarray) -> np.ndarray:
    """The sample as a dense table: a column for each feature, the extra columns, and ones for the bias."""
    out = np.zeros((len(sample), len(sample.vocabulary) + extra.shape[1] + 1))
    out[np.repeat(np.arange(len(sample)), np.diff(sample.edge)), sample.index] = 1
    out[:, len(sample.vocabulary) : -1] = extra
    out[:, -1] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 3.0, rounds: int = 12) -> np.ndarray:
    """Weights of penalised logistic regression by Newton steps; the last one is the bias, which has no penalty."""
    w = np.zeros(x.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = logit(rate)
    if not len(y) or y.min() == y.max():
        return w
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return w


def out_of_fold(x: np.ndarray, y: np.ndarray, hashes: np.ndarray, folds: int) -> np.ndarray:
    """Every row's margin by a model that was fitted without its fold. Equal texts have equal hashes and share a fold."""
    fold, out = hashes % folds, np.zeros(len(y))
    for k in range(folds):
        out[fold == k] = x[fold == k] @ fit(x[fold != k], y[fold != k])
    return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability at which F1 is largest; above 1 if there is nothing to find."""
    if not len(y) or not y.sum():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1
    best = int(np.argmax(f1))
    low = p[order][best + 1] if best + 1 < len(y) else 0.0
    return float((p[order][best] + low) / 2)
