"""The schema-less layout: entries(dn, attrs map<string, array<string>>), as a relation or as a table of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import names
from canopy.sources.scratch import materialize

SCHEMA = "dn string, attrs map<string,array<string>>"


def from_entries(spark: SparkSession, entries: dict[str, dict]) -> DataFrame:
    """Entry literals; a scalar value stands for a list of one."""
    rows = [(dn, {k.lower(): [str(x) for x in (v if isinstance(v, (list, tuple)) else [v])] for k, v in own.items()}) for dn, own in entries.items()]
    return with_names(spark.createDataFrame(rows, SCHEMA))


def with_names(entries: DataFrame) -> DataFrame:
    """Adds rdns, parent and depth, once, for scopes and joins."""
    return entries.withColumns({"rdns": names.rdns(F.col("dn")), "parent": names.parent_of(F.col("dn")), "depth": names.depth(F.col("dn"))})


def from_mapped(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Typed columns as a map of texts; absent values have no key."""
    own = F.map_from_arrays(F.array(*(F.lit(c.lower()) for c in columns)), F.array(*(F.col(c).cast("string") for c in columns)))
    own = F.transform_values(F.map_filter(own, lambda k, v: v.isNotNull()), lambda k, v: F.array(v))
    return frame.select("dn", own.alias("attrs"))


def project(entries: DataFrame, wanted: list[str], types_only: bool = False) -> DataFrame:
    """Only the wanted attributes, all if none are named; with types_only their values are left out."""
    low = [w.lower() for w in wanted if w not in ("*", "+")]
    attrs = F.map_filter("attrs", lambda k, v: k.isin(low) | F.split(k, ";")[0].isin(low)) if low else F.col("attrs")
    if types_only:
        attrs = F.transform_values(attrs, lambda k, v: F.array().cast("array<string>"))
    return entries.withColumn("attrs", attrs)


def ranged(entries: DataFrame, attribute: str | None = None) -> DataFrame:
    """dn, attribute, low, high, values: the attributes that came in part, as their range option says (high: null for the last part)."""
    rows = entries.select("dn", F.explode("attrs").alias("description", "values"))
    option = F.regexp_extract("description", r"(?i);range=([0-9]+)-([0-9]+|\*)", 0)
    name = names.attribute_name(F.col("description"))
    part = lambda k: F.regexp_extract("description", r"(?i);range=([0-9]+)-([0-9]+|\*)", k)
    out = rows.where(option != "") if attribute is None else rows.where((option != "") & (F.lower(name) == attribute.lower()))
    return out.select("dn", name.alias("attribute"), part(1).cast("long").alias("low"), F.when(part(2) != "*", part(2)).cast("long").alias("high"), "values")


def dereference(entries: DataFrame, targets: DataFrame | None = None, attribute: str = "aliasedObjectName") -> DataFrame:
    """Entries with every alias replaced by the entry that it names, each once; aliases that lead nowhere or in a ring go.

    Aliases are followed by a join on the name, one step of all chains at a time.
    """
    targets = entries if targets is None else targets
    goal = F.lower(F.try_element_at(F.try_element_at("attrs", F.lit(attribute.lower())), F.lit(1)))
    known = targets.select(F.col("dn").alias("_dn"), F.col("attrs").alias("_attrs"), F.lower("dn").alias("_goal"))
    out = entries.where(goal.isNull()).select("dn", "attrs")
    open_ = materialize(entries.where(goal.isNotNull()).select(goal.alias("_goal")).distinct())
    seen = open_
    while not open_.isEmpty():
        reached = materialize(open_.join(known, "_goal").select(F.col("_dn").alias("dn"), F.col("_attrs").alias("attrs")))
        out = out.unionByName(reached.where(goal.isNull()))
        # each step leads to names not seen before, so that rings end it
        open_ = materialize(reached.where(goal.isNotNull()).select(goal.alias("_goal")).distinct().join(seen, "_goal", "left_anti"))
        seen = seen.unionByName(open_)
    return out.withColumn("_low", F.lower("dn")).dropDuplicates(["_low"]).drop("_low")


def root_dse(
    spark: SparkSession,
    contexts: list[str],
    extensions: list[str],
    vendor: str,
    paging: bool = True,
    attributes: tuple[str, ...] = (),
    types_only: bool = False,
    hook: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The directory's description of itself, one row: the attributes asked for, all if none are; hook may change it first."""
    # The protocol version and the paging control's number.
    control = "1.2.840.113556.1.4.319" if paging else None
    row = (", ".join(contexts), ", ".join(extensions), "3", vendor, control)
    out = spark.createDataFrame([row], "namingContexts string, supportedExtension string, supportedLDAPVersion string, vendorName string, supportedControl string")
    out = out if hook is None else hook(out)
    wanted = {a.lower() for a in attributes if a not in ("*", "+")}
    shown = [c for c in out.columns if not wanted or c.lower() in wanted]
    return out.select(*(F.col(c).isNotNull().alias(c) if types_only else F.col(c) for c in shown))
