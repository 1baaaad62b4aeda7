"""Entries of one object class as a relation with typed columns, and the tree they form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from canopy.functions.names import escape_value_column


@dataclass(frozen=True)
class Detail:
    """Where the values of a multi-valued attribute stand: a row each, with the entry's key."""

    rows: Callable[[], DataFrame]
    key: str
    own: str

    def exists(self, test: Column) -> Column:
        """Whether the entry has a value that passes: a semi join, or an anti join where it is negated."""
        return self.rows().where((F.col(self.key) == F.col(self.own).outer()) & test).exists()


@dataclass(frozen=True)
class Attribute:
    """How an attribute is stored and compared.

    syntax: ci_string, cs_string, int, double, bool, time, dn. multi: the column is an array of values. With a detail,
    the array is made only to be shown: filters, sorting and ranges use the rows.
    """

    column: str
    syntax: str = "cs_string"
    multi: bool = False
    detail: Detail | None = field(default=None, compare=False)


@dataclass
class Relation:
    """frame(needed) gives a DataFrame with at least the needed columns, so that joins come in only when asked for.

    path: from the root down, (attribute, value) for fixed parts of the name and (attribute, None) for a key column of
    that name. deleted: a SQL condition that tells tombstones, which only a request that asks for them shows.
    """

    object_class: str
    frame: Callable[[set[str]], DataFrame]
    path: list[tuple[str, str | None]]
    attributes: dict[str, Attribute] = field(default_factory=dict)
    deleted: str | None = None

    def find(self, name: str) -> Attribute | None:
        """By full description first, then by the name without options."""
        name = name.lower()
        return self.attributes.get(name) or self.attributes.get(name.split(";")[0])

    def keys(self) -> set[str]:
        return {a for a, fixed in self.path if fixed is None}

    def dn(self, frame: DataFrame) -> Column:
        def shown(name: str, fixed: str | None) -> Column:
            if fixed is not None:
                return F.lit(f"{name}={fixed}")
            text = isinstance(frame.schema[name].dataType, StringType)
            return F.concat(F.lit(f"{name}="), escape_value_column(F.col(name)) if text else F.col(name))

        return F.concat_ws(",", *(shown(*step) for step in reversed(self.path)))
