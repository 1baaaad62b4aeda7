"""Document quality by hierarchical empirical Bayes.

A classifier on the style of a text (shares of marks, digits and capitals, word lengths, repetition) gives the evidence
of a document: its log-odds less the base rate's. Evidence is pooled over the site: hosts and their paths have good and
poor documents in unknown shares, with Beta priors. A path's posterior share is shrunk toward its host's, and a host's
toward the global one, with strengths estimated by moments from the spread of the shares, so that a site of few documents
says little. A document's score is its own evidence plus the log-odds of its path's posterior, where the document itself
does not count.

Sites are pooled by grouped aggregation over all documents: sums of probabilities and of their squares, first by path,
then by host, then over all. Documents meet their path's sums by a join that Spark may split if one host has a third of
them. The classifier is fitted on at most MOST_ROWS labelled documents and MOST_FEATURES features (parameters).

Null and empty texts have the features of an empty text. Null hosts and paths form a site of their own. Without labels
of both kinds there is no evidence, and every document is kept. Rows are kept one for one, repeated ones too. Extra
columns don't matter, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm import linear
from canopy.llm.common import materialize

MOST_ROWS, MOST_FEATURES, FOLDS = 6000, 250, 3
#: A document is kept from this posterior probability on, which is where keeping and dropping are equally likely right.
KEEP = 0.5
_MARKS = re.compile(r"[^\w\s.,;:!?'\"()-]")


def _bin(name: str, value: float, steps: list[float]) -> str:
    return f"{name}{sum(value >= s for s in steps)}"


def style(text: str | None) -> list[str]:
    """Binned style measures of a text, as features."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    shares = [0.002, 0.01, 0.03, 0.08, 0.2, 0.4]
    lower = text.lower()
    return [
        _bin("marks", len(_MARKS.findall(text)) / chars, shares),
        _bin("pipes", text.count("|") / n, shares),
        _bin("bangs", (text.count("!") + text.count("?")) / n, shares),
        _bin("capitals", sum(map(str.isupper, text)) / chars if text != lower else 0, [0.005, 0.02, 0.05, 0.1, 0.3, 0.6]),
        _bin("digits", sum(map(text.count, "0123456789")) / chars, shares),
        _bin("stops", (text.count(".") + text.count(",")) / n, [0.02, 0.06, 0.12, 0.2, 0.3, 0.5]),
        _bin("distinct", len(set(words)) / n, [0.1, 0.25, 0.4, 0.55, 0.7, 0.9]),
        _bin("length", len(words), [5, 20, 60, 150, 400, 2000]),
        _bin("word", len(text) / n, [3, 4, 5, 6, 7, 9]),
        _bin("lines", text.count("\n") / n, [0.005, 0.02, 0.05, 0.1, 0.3]),
        _bin("links", lower.count("http") / n, [0.001, 0.01, 0.05]),
    ]


@dataclass
class Style:
    vocabulary: dict[str, int]
    weights: np.ndarray
    base: float


def fit_style(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_features: int = MOST_FEATURES) -> Style:
    marked = labels.where("quality IS NOT NULL").select("doc_id", (F.col("quality") > 0).cast("int").alias("good"))
    sample = linear.encode_sample(linear.labelled_sample(docs, marked, most_rows), style, ["good"], most_features)
    y = sample.labels["good"]
    weights = linear.fit(linear.matrix(sample, np.zeros((len(sample), 0))), y)
    if not len(y) or y.min() == y.max():
        base = 0.99
        return Style({}, np.array([linear.logit(base)]), base)
    return Style(sample.vocabulary, weights, float(y.mean()))


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep: float = KEEP) -> DataFrame:
    """doc_id, host, path, evidence, host_rate, path_rate, score, keep: one row per row of docs."""
    session = docs.sparkSession
    fitted = fit_style(docs, labels)
    known = session.sparkContext.broadcast((fitted.vocabulary, fitted.weights))
    base = float(linear.logit(fitted.base))

    def evidence(text: pd.Series) -> pd.Series:
        vocabulary, weights = known.value
        return pd.Series([weights[-1] + sum(weights[vocabulary[f]] for f in style(t) if f in vocabulary) - base for t in text], dtype=float)

    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(host.cast("string"), F.lit("")).alias("host"),
            F.coalesce(path.cast("string"), F.lit("")).alias("path"),
            F.pandas_udf(evidence, "double")("text").alias("evidence"),
        ).withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + base))))
    )
    paths = materialize(rows.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("good")))
    rate = F.col("good") / F.col("n")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    # one row each: the global share, and the spread of the shares of hosts and of paths within hosts
    spread_hosts = hosts.agg(
        F.sum("host_n").alias("n"),
        F.sum("host_good").alias("good"),
        F.count("*").alias("sites"),
        F.sum(F.col("host_good") * F.col("host_good") / F.col("host_n")).alias("squares"),
    ).first()
    spread_paths = (
        paths.join(hosts, "host")
        .agg(F.count("*").alias("sites"), F.sum(F.col("n") * F.pow(rate - F.col("host_good") / F.col("host_n"), F.lit(2.0))).alias("squares"))
        .first()
    )
    total = spread_hosts["n"] or 1.0
    mean = min(max((spread_hosts["good"] or 0.0) / total, 1e-6), 1 - 1e-6)

    def strength(variance: float, sites: float) -> float:
        """Documents that the prior is worth: sampling alone would spread the shares by mean (1 - mean) sites / total."""
        between = max(variance - mean * (1 - mean) * sites / total, 1e-9)
        return float(min(max(mean * (1 - mean) / between - 1, 1.0), 10_000.0))

    host_strength = strength((spread_hosts["squares"] or 0.0) / total - mean * mean, spread_hosts["sites"])
    path_strength = strength((spread_paths["squares"] or 0.0) / total, spread_paths["sites"])
    # one row a site, written so that Spark knows its size: it is sent to the rows while it is small, and where it isn't,
    # a frequent site's rows can be split
    sites = materialize(paths.join(hosts, "host"))
    joined = rows.join(sites, ["host", "path"])
    # the document's own probability is taken out of both levels
    host_rate = (F.col("host_good") - F.col("p") + host_strength * mean) / (F.col("host_n") - 1 + host_strength)
    joined = joined.withColumn("host_rate", host_rate)
    path_rate = (F.col("good") - F.col("p") + path_strength * F.col("host_rate")) / (F.col("n") - 1 + path_strength)
    joined = joined.withColumn("path_rate", F.least(F.greatest(path_rate, F.lit(1e-6)), F.lit(1 - 1e-6)))
    joined = joined.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))))))
    return joined.select(
        "doc_id", "host", "path", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= keep).alias("keep")
    )
