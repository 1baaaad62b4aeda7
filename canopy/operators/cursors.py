"""Cursors over ordered results: pages, list views around a target, and ranges of long attributes.

Ranks of a whole result come from one range shuffle: the rows are sorted over many partitions, each row is numbered within
its own, and a row's rank adds what the partitions before it hold. No task sees all rows. The sorted rows are written
once, so that every page and window after the first is a read of some rows by their rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.model import DirectoryError, SearchRequest
from canopy.operators.search import Directory
from canopy.sources.scratch import materialize

PAGE = 1000


def ranked(rows: DataFrame, order: list[Column], rank: str = "rank", total: str | None = None) -> DataFrame:
    """rows with their 1-based rank, and their number, by a distributed sort.

    The sorted rows are written to the shared folder: a task that runs again can't deal them to other partitions.
    """
    kept = materialize(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part, at = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    # one row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), F.sum("n").over(every).alias("_all"))
    out = kept.withColumn("_part", part).join(F.broadcast(starts), "_part")
    out = out.withColumn(rank, (F.col("_before") + at + 1).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_all").cast("long"))
    return out.drop("_place", "_part", "_before", "_all")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str, first: int = 1) -> DataFrame:
    """rows with their number within their key, in order: ranks of the whole less the key's first one.

    A key of any size is sorted over as many partitions as it needs.
    """
    held = ranked(rows, [*map(F.col, keys), *order], "_rank")
    firsts = held.groupBy(*keys).agg(F.min("_rank").alias("_first"))
    return held.join(firsts, keys).withColumn(name, (F.col("_rank") - F.col("_first") + first).cast("long")).drop("_rank", "_first")


def _plain(frame: DataFrame) -> DataFrame:
    return frame.drop(*[c for c in frame.columns if c.startswith("_sort_")])


@dataclass
class Pages:
    """Pages of a search in order: iterate, or ask for page k of the whole. The result is sorted and written once."""

    directory: Directory
    request: SearchRequest
    size: int = PAGE

    @cached_property
    def _sorted(self) -> DataFrame:
        rows, order = self.directory.sorted_keys(self.request)
        # in order and with their ranks, so that a page reads the files and row groups that hold it
        return materialize(_plain(ranked(rows, order)))

    def __iter__(self) -> Iterator[DataFrame]:
        many = -(-self._sorted.count() // self.size)
        for number in range(1, many + 1):
            yield self.page(number).orderBy("pos").drop("pos")

    def numbered(self) -> DataFrame:
        """Every row with its rank and its page, from 1."""
        return self._sorted.withColumn("page", F.ceil(F.col("rank") / self.size).cast("long"))

    def page(self, number: int) -> DataFrame:
        """The rows of one page, with their place in the whole as pos."""
        own = F.col("rank").between((number - 1) * self.size + 1, number * self.size)
        return self._sorted.where(own).withColumnRenamed("rank", "pos")


@dataclass
class ListView:
    """A window of a sorted result around a target: by offset, by percentage or by value."""

    directory: Directory
    request: SearchRequest
    before: int = 0
    after: int = 100

    def _window(self, target) -> DataFrame:
        rows, order = self.directory.sorted_keys(self.request)
        held = ranked(rows, order, "list_offset", "list_size")
        goal = target(held)
        return _plain(held.where(F.col("list_offset").between(F.greatest(F.lit(1), goal - self.before), goal + self.after)))

    def at_offset(self, offset: int, count: int = 0) -> DataFrame:
        """Around an offset in a list that the client takes to have count entries (0: it doesn't know)."""
        size = F.col("list_size")
        goal = F.lit(offset) if not count else F.round(size * offset / count)
        return self._window(lambda held: F.least(F.greatest(goal, F.lit(1)), size).cast("long"))

    def at_percent(self, percent: float) -> DataFrame:
        return self.at_offset(round(min(max(percent, 0), 100)), 100)

    def at_value(self, value) -> DataFrame:
        """Around the first entry whose first sort key is at least the value; behind the last one if there is none."""
        if not self.request.sort:
            raise DirectoryError("a list view by value needs a sort key")
        key = self.request.sort[0]
        c = F.col(f"_sort_{key.attribute.lower()}")
        hit = (c <= value) | c.isNull() if key.descending else (c >= value) | c.isNull()

        def goal(held: DataFrame) -> Column:
            found = held.agg(F.min(F.when(hit, F.col("list_offset"))).alias("first"), F.max("list_size").alias("size")).first()
            return F.lit(found["first"] if found["first"] is not None else (found["size"] or 0) + 1)

        return self._window(goal)


@dataclass
class ViewPosition:
    """What a client of a list view keeps: offset, size and, in percent, where it stands."""

    offset: int = 1
    size: int = 0
    before: int = 0
    after: int = 100
    percent: bool = False

    def target(self) -> int:
        """The offset to ask for: in percent of the known size, once there is one."""
        if not self.percent:
            return self.offset
        share = min(max(self.offset, 0), 100)
        return round(self.size / 100 * share) if self.size else share

    def position(self) -> int:
        return round(self.offset / (self.size / 100)) if self.percent and self.size else self.offset

    def at_end(self) -> bool:
        return self.offset + self.after >= self.size

    def at_start(self) -> bool:
        return self.offset == 1 or self.before != 0 and self.offset - self.before <= 1

    def forward(self, n: int) -> int:
        return min(self.position() + n, 100) if self.percent else self.offset + n

    def backward(self, n: int) -> int:
        return max(self.position() - n, 0)


def attribute_range(values: Column, low: int, high: int | None = None) -> Column:
    """Values low..high of a long attribute, both included, from 0; to the end without high."""
    return F.slice(values, low + 1, F.size(values) if high is None else high - low + 1)


def range_option(option: str) -> tuple[int, int | None]:
    """(low, high) of range=low-high; high is None for *."""
    low, _, high = option.lower().removeprefix("range=").partition("-")
    return int(low), None if high in ("*", "") else int(high)


def has_more(option: str, size: int) -> bool:
    high = range_option(option)[1]
    return high is not None and high + 1 < size


def exploded(frame: DataFrame, column: str, low: int = 0, high: int | None = None) -> DataFrame:
    """A row for each value of a range, with its place."""
    part = attribute_range(F.col(column), low, high)
    return frame.select(*[c for c in frame.columns if c != column], F.posexplode(part).alias("_at", "value")).withColumn(
        "value_index", (F.col("_at") + low).cast("long")
    ).drop("_at")


def ranged_values(values: DataFrame, low: int = 0, high: int | None = None, key: str = "dn", value: str = "value") -> DataFrame:
    """Values low..high of every entry's long attribute, from rows (key, value), each with its place, from 0."""
    out = numbered(values, [key], [F.col(value)], "value_index", first=0)
    inside = F.col("value_index") >= low
    return out.where(inside if high is None else inside & (F.col("value_index") <= high))


def union(*results: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)


def get(entries: DataFrame, dn: str) -> DataFrame:
    """The entries of exactly that name."""
    return entries.where(F.col("dn") == dn)


def has(entries: DataFrame, dn: str) -> bool:
    return not get(entries, dn).isEmpty()


def remove(entries: DataFrame, others: DataFrame) -> DataFrame:
    return entries.join(others.select("dn"), "dn", "left_anti")
