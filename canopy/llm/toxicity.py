"""Toxicity by a classifier chain.

The categories are predicted in order. Each is a linear model on the words of a text and on the log-odds of all earlier
categories. While fitting, those log-odds are out-of-fold predictions, so that a later model learns how far earlier ones
can be trusted on texts they have not seen; afterwards they come from the earlier models themselves.

The chain runs from the coarse to the narrow: `review` (toxic or of low quality), `toxic`, and `toxic_junk` (both). A
text is rejected at the probability of `toxic` that was best (F1) out of fold.

The models are fitted on at most MOST_ROWS labelled documents and MOST_FEATURES words, those that tell most (both are
parameters); folds go by the text's hash, so that copies are held out together. Every document is scored on its whole text.
Null and empty texts have no words and get the base rates. Without labels, or with labels of one kind only, nothing is
rejected. Null labels count as unlabelled. Rows are kept one for one, repeated ones too; extra columns don't matter,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm import linear

MOST_ROWS, MOST_FEATURES, FOLDS = 6000, 250, 3
CATEGORIES = ["review", "toxic", "toxic_junk"]
_words = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    return _words((text or "").lower())


@dataclass
class Chain:
    vocabulary: dict[str, int]
    #: Of each category: weights of the words, of the earlier categories' log-odds, and the bias.
    models: list[np.ndarray]
    threshold: float


def categories(labels: DataFrame) -> DataFrame:
    toxic, poor = F.col("toxic") > 0, F.col("quality") <= 0
    return labels.where("toxic IS NOT NULL AND quality IS NOT NULL").select(
        "doc_id", (toxic | poor).cast("int").alias("review"), toxic.cast("int").alias("toxic"), (toxic & poor).cast("int").alias("toxic_junk")
    )


def fit_chain(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_features: int = MOST_FEATURES, folds: int = FOLDS) -> Chain:
    sample = linear.encode_sample(linear.labelled_sample(docs, categories(labels), most_rows), words, CATEGORIES, most_features)
    extra, models, threshold = np.zeros((len(sample), 0)), [], 1.1
    for category in CATEGORIES:
        y = sample.labels[category]
        x = linear.matrix(sample, extra)
        held_out = linear.out_of_fold(x, y, sample.hashes, folds)
        models.append(linear.fit(x, y))
        if category == "toxic":
            threshold = linear.best_threshold(linear.sigmoid(held_out), y)
        extra = np.column_stack([extra, np.clip(held_out, -8, 8)])
    return Chain(sample.vocabulary, models, threshold)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_review, p_toxic, p_toxic_junk, is_toxic for every row."""
    return _scored(docs.select("doc_id", "text"), chain).select("doc_id", "p.*", "is_toxic")


def _scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with the probabilities as p, and is_toxic, in one pass over the rows."""
    session = docs.sparkSession
    wide = len(chain.vocabulary)
    known = session.sparkContext.broadcast((chain.vocabulary, np.array([m[:wide] for m in chain.models])))
    bias, more = [float(m[-1]) for m in chain.models], [m[wide:-1] for m in chain.models]

    @F.pandas_udf("struct<p_review double, p_toxic double, p_toxic_junk double>")
    def probabilities(text: pd.Series) -> pd.DataFrame:
        vocabulary, weights = known.value
        found = [np.fromiter((vocabulary[w] for w in vocabulary.keys() & words(t)), np.int64) for t in text]
        sums = np.array([weights[:, x].sum(axis=1) for x in found]).reshape(len(found), len(bias))
        before = np.zeros((len(found), 0))
        for k in range(len(bias)):
            margin = sums[:, k] + bias[k] + before @ more[k]
            before = np.column_stack([before, np.clip(margin, -8, 8)])
            sums[:, k] = margin
        return pd.DataFrame(linear.sigmoid(sums), columns=["p_review", "p_toxic", "p_toxic_junk"])

    out = docs.withColumn("p", probabilities("text"))
    return out.withColumn("is_toxic", F.col("p.p_toxic") >= chain.threshold)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit_chain(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the chain rejects."""
    chain = fit_chain(docs, labels)
    renamed = docs.select(F.struct("*").alias("row"), F.col("text"))
    return _scored(renamed, chain).where(~F.col("is_toxic")).select("row.*")
