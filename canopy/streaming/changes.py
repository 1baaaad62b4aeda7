"""Change feeds: what changed since a cookie, in batch, and the same as a stream.

A feed is a table with a growing number per change. The cookie is the largest number seen; without one, everything is new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canopy.operators import cursors


def since(feed: DataFrame, number: str, cookie: int | None = None, condition: Column | None = None) -> DataFrame:
    """The changes after the cookie; both predicates reach the scan."""
    out = feed if cookie is None else feed.where(F.col(number) > cookie)
    return out if condition is None else out.where(condition)


def next_cookie(changes: DataFrame, number: str, cookie: int | None = None) -> int | None:
    found = changes.agg(F.max(number)).first()[0]
    return cookie if found is None else found


def chunk(feed: DataFrame, number: str, cookie: int | None, most: int) -> DataFrame:
    """The next changes, at most so many, in order."""
    return since(feed, number, cookie).orderBy(number).limit(most)


def latest(changes: DataFrame, key: str, number: str) -> DataFrame:
    """Each key's last change: one struct maximum a key, combined before the shuffle."""
    rest = [c for c in changes.columns if c not in (key, number)]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), number).alias("_last"), F.max(number).alias(number))
    return last.select(key, number, "_last.*")


def new_values(changes: DataFrame, key: str, number: str, value: str) -> DataFrame:
    """Only what a change adds: values that its key had in no earlier change."""
    first = changes.groupBy(key, value).agg(F.min(number).alias(number))
    return changes.join(first.select(key, number), [key, number], "left_semi")


def ancestors_first(changes: DataFrame, depth: str, number: str) -> DataFrame:
    return changes.orderBy(depth, number)


def watch(
    spark: SparkSession,
    path: str,
    schema,
    handler: Callable[[DataFrame, bool], None],
    checkpoint: str,
    condition: Column | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Calls handler(changes, is_first) for what is there and then for each later batch that isn't empty.

    Without an interval the query ends when it has caught up; the checkpoint holds the place to resume from.
    """
    stream = spark.readStream.schema(schema).parquet(path)
    if condition is not None:
        stream = stream.where(condition)

    def each(batch: DataFrame, number: int) -> None:
        if number == 0 or not batch.isEmpty():
            handler(batch, number == 0)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def running_counts(spark: SparkSession, path: str, schema, key: str, table: str, checkpoint: str) -> StreamingQuery:
    """Changes of each key so far, kept by the engine's own state store."""
    counts = spark.readStream.schema(schema).parquet(path).groupBy(key).agg(F.count("*").alias("changes"))
    writer = counts.writeStream.outputMode("complete").format("memory").queryName(table)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def numbered(changes: DataFrame, key: str, number: str) -> DataFrame:
    """Each change with its place among its key's, however many those are."""
    return cursors.numbered(changes, [key], [F.col(number)], "version")
