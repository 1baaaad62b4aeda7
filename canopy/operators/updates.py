"""Updates of entry tables as transformations: the result is the new table, to be written elsewhere or swapped in.

Entries have a dn column and, in the generic layout, attrs map<string, array<string>>.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import names
from canopy.model import DirectoryError, ResultCode

_TEXTS = "array<string>"


@dataclass(frozen=True)
class Change:
    """kind is add, delete or replace; a deletion without values drops the attribute."""

    kind: str
    attribute: str
    values: tuple[str, ...] = ()


#: The numbers of the kinds of change.
KINDS = {"add": 0, "delete": 1, "replace": 2}


class Edit:
    """Editing of one entry that keeps the changes made, for modify().

    A removal without values records nothing.
    """

    def __init__(self, dn: str, changes: Iterable[Change] = ()):
        self.dn, self.changes = dn, list(changes)

    def _record(self, kind: str, attribute: str, values) -> Edit:
        self.changes.append(Change(kind, attribute, tuple(str(v) for v in values)))
        return self

    def add(self, attribute: str, *values) -> Edit:
        return self._record("add", attribute, values)

    def remove(self, attribute: str, *values) -> Edit:
        return self._record("delete", attribute, values) if values else self

    def reset(self, *attributes: str) -> Edit:
        for a in attributes:
            self._record("delete", a, ())
        return self

    def set(self, attribute: str, *values) -> Edit:
        return self._record("replace", attribute, values)

    def has(self, change: Change) -> bool:
        return change in self.changes

    def without(self, *changes: Change) -> Edit:
        return Edit(self.dn, (c for c in self.changes if c not in changes))

    def apply(self, entries: DataFrame, check: bool = False) -> DataFrame:
        return modify(entries, self.dn, self.changes, check)

    def rows(self, spark: SparkSession) -> DataFrame:
        """The changes as a log: seq, dn, kind, attribute, values."""
        log = [(k, self.dn, KINDS[c.kind], c.attribute, list(c.values)) for k, c in enumerate(self.changes)]
        return spark.createDataFrame(log, "seq long, dn string, kind int, attribute string, values array<string>")


def save(entries: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a new state of the entries to a new folder and read it back; the old one stays as it is."""
    entries.write.partitionBy(*partition_by).parquet(path)
    return entries.sparkSession.read.parquet(path)


def add(entries: DataFrame, new: DataFrame, check: bool = True) -> DataFrame:
    """Entries and the new ones, whose names must be free and whose parents must be there (or be new, or be roots)."""
    if check:
        if not new.join(entries.select("dn"), "dn", "left_semi").isEmpty():
            raise DirectoryError("an entry has that name", ResultCode.ENTRY_ALREADY_EXISTS)
        every = entries.select("dn").unionByName(new.select("dn")).select(F.col("dn").alias("_parent"))
        orphans = new.withColumn("_parent", names.parent_of(F.col("dn"))).where(F.col("_parent").isNotNull()).join(every, "_parent", "left_anti")
        if not orphans.isEmpty():
            raise DirectoryError("an entry's parent is missing", ResultCode.NO_SUCH_OBJECT)
    return entries.unionByName(new, allowMissingColumns=True)


def delete(entries: DataFrame, dn: str, check: bool = True) -> DataFrame:
    """Without a leaf."""
    if check:
        below = entries.where(names.is_below(F.col("dn"), dn)).select("dn").limit(2).collect()
        if not any(r["dn"].lower() == dn.lower() for r in below) and entries.where(F.lower("dn") == dn.lower()).isEmpty():
            raise DirectoryError(f"no entry {dn}", ResultCode.NO_SUCH_OBJECT)
        if len(below) > 1:
            raise DirectoryError(f"{dn} has entries below it", ResultCode.NOT_ALLOWED_ON_NON_LEAF)
    return entries.where(F.lower("dn") != dn.lower())


def delete_subtree(entries: DataFrame, base: str) -> DataFrame:
    return entries.where(~names.is_below(F.col("dn"), base))


def changed(values: Column, change: Change) -> Column:
    """An attribute's values after one change; no values is an absent attribute (NULL)."""
    have = F.coalesce(values, F.array().cast(_TEXTS))
    given = F.array(*map(F.lit, change.values)).cast(_TEXTS)
    if change.kind == "add":
        out = F.concat(have, F.array_except(given, have))
    elif change.kind == "delete":
        out = F.filter(have, lambda v: ~F.array_contains(given, v)) if change.values else F.array().cast(_TEXTS)
    elif change.kind == "replace":
        out = given
    else:
        raise DirectoryError(f"no change of kind {change.kind}")
    return F.when(F.size(out) > 0, out)


def _without(attrs: Column, key: str) -> Column:
    return F.map_filter(attrs, lambda k, v: k != key)


def modify(entries: DataFrame, dn: str, changes: list[Change], check: bool = False) -> DataFrame:
    """The generic layout with the changes made in order on one entry.

    With check, adding a value that is there and deleting one that isn't are errors, as is a missing entry.
    """
    here, attrs, wrong = F.lower("dn") == dn.lower(), F.col("attrs"), []
    for c in changes:
        key = c.attribute.lower()
        have = F.coalesce(F.try_element_at(attrs, F.lit(key)), F.array().cast(_TEXTS))
        given = F.array(*map(F.lit, c.values)).cast(_TEXTS)
        if c.kind == "add":
            wrong.append(F.when(F.arrays_overlap(have, given), int(ResultCode.ATTRIBUTE_OR_VALUE_EXISTS)))
        elif c.kind == "delete":
            missing = F.size(F.array_except(given, have)) > 0 if c.values else F.size(have) == 0
            wrong.append(F.when(missing, int(ResultCode.NO_SUCH_ATTRIBUTE)))
        own = changed(F.try_element_at(attrs, F.lit(key)), c)
        rest = _without(attrs, key)
        attrs = F.when(own.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), own)))
    if check:
        found = entries.where(here).select(F.coalesce(*wrong, F.lit(0)).alias("code")).first()
        if found is None:
            raise DirectoryError(f"no entry {dn}", ResultCode.NO_SUCH_OBJECT)
        if found["code"]:
            raise DirectoryError(f"{ResultCode(found['code']).words} in {dn}", ResultCode(found["code"]))
    return entries.withColumn("attrs", F.when(here, attrs).otherwise(F.col("attrs")))


def rename(entries: DataFrame, dn: str, rdn: str | None = None, new_parent: str | None = None, delete_old: bool = True) -> DataFrame:
    """The entry and all below it under a new RDN, a new parent, or both.

    In the generic layout the RDN's attribute follows: the new value is added and the old one goes, or stays as well.
    """
    own = names.parts(dn)
    new_rdn = rdn or own[0]
    above = names.parent(dn) if new_parent is None else new_parent
    goal = f"{new_rdn},{above}" if above else new_rdn
    c = F.col("dn")
    here, below = F.lower(c) == dn.lower(), F.endswith(F.lower(c), F.lit("," + dn.lower()))
    moved = F.when(here, F.lit(goal)).when(below, F.concat(F.left(c, F.length(c) - len(dn)), F.lit(goal))).otherwise(c)
    out = entries.withColumn("_here", here).withColumn("dn", moved)
    if "attrs" in entries.columns and rdn is not None:
        (old_name, old_value), (new_name, new_value) = names.pairs(own[0])[0], names.pairs(rdn)[0]
        steps = [Change("delete", old_name, (old_value,))] if delete_old else []
        steps.append(Change("add", new_name, (new_value,)))
        edited = modify(out.withColumns({"_dn": F.col("dn"), "dn": F.when(F.col("_here"), F.lit(goal)).otherwise(F.lit(""))}), goal, steps)
        out = edited.withColumn("dn", F.col("_dn")).drop("_dn")
    return out.drop("_here")
