"""Connected components over link tables, and streaming over sorted groups inside a task."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from canopy.llm.common import drop_table, materialize


def grouped(frames, keys: list[str]):
    """Frames of one key each, from batches sorted by the keys; a group may span batches."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        change = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
        change[0] = False
        edges = [0, *change.nonzero()[0].tolist(), len(frame)]
        if held and (held[-1][keys].iloc[-1] != frame[keys].iloc[0]).any():
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        for low, high in zip(edges, edges[1:]):
            if low:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(frame.iloc[low:high])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and a mark of their set, taken while they are written."""
    seen = Observation()
    count, mix = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("mix")
    return materialize(edges.observe(seen, count, mix)), (seen.get["n"], seen.get["mix"])


def connected(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node in links(a long, b long).

    Large-star and small-star rounds: each is two aggregations to a minimum and two joins, and no neighbour list is
    ever gathered. Links may repeat, and may point either way; loops are ignored. A round that changes anything points
    some node at a smaller one and none at a larger one, so that the rounds end by themselves.
    """
    edges, mark = _marked(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        before, last = edges, mark
        edges, mark = _marked(small)
        drop_table(before)
        if mark == last:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
