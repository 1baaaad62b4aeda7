"""Search over a directory: scope, filter, projection, order and limits, as one DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import filters as f
from canopy.functions import names
from canopy.model import DirectoryError, ResultCode, Scope, SearchRequest, SortKey
from canopy.operators.predicates import MATCHING_RULES, Predicates
from canopy.sources.relation import Attribute, Relation


#: OID -> change of a search's result: (DataFrame, value) -> DataFrame.
CONTROLS: dict[str, Callable[[DataFrame, object], DataFrame]] = {}


def register_control(oid: str):
    """A control of one's own: what it does to the entries found, before they are sorted and limited."""

    def add(change):
        CONTROLS[oid] = change
        return change

    return add


class Directory:
    """Relations under one root. default_base is searched if a request names none."""

    def __init__(self, relations: Iterable[Relation], default_base: str | None = None):
        self.relations, self.default_base = list(relations), default_base

    def known(self, name: str) -> bool:
        return name.lower() == "objectclass" or any(r.find(name) for r in self.relations)

    def search(self, request: SearchRequest | None = None, **options) -> DataFrame:
        """dn, objectClass and the attributes of the entries that match.

        One relation's typed columns come back as they are; several relations are united by name.
        """
        request = (request or SearchRequest()).with_(**options)
        out, _ = self.sorted_keys(request)
        if request.sort:
            out = out.orderBy(*self.order(request.sort))
        if request.size_limit:
            out = out.limit(request.size_limit)
        hidden = [c for c in out.columns if c.startswith("_sort_")]
        return out.drop(*hidden)

    def _united(self, node, base: str, request: SearchRequest) -> DataFrame:
        """The relations that can match, united; if none can, an empty result with the columns of the first in scope."""
        found = []
        for relation in self.relations:
            within = _within(relation, base, request.scope)
            if within is not False:
                predicates = Predicates(relation, self.known)
                condition = predicates.column(node)
                if relation.deleted and not request.show_deleted and condition is not False:
                    alive = ~F.coalesce(F.expr(relation.deleted), F.lit(False))
                    condition = alive if condition is True else condition & alive
                found.append((relation, within, condition, predicates.used))
        if not found:
            raise DirectoryError(f"nothing is in scope under {base}", ResultCode.NO_SUCH_OBJECT)
        live = [x for x in found if x[2] is not False] or [(*found[0][:2], F.lit(False), set())]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self._of(*x, request) for x in live])

    def _of(self, relation: Relation, within, condition, used: set[str], request: SearchRequest) -> DataFrame:
        shown = self._shown(relation, request)
        sort = {k.attribute.lower(): relation.find(k.attribute) for k in request.sort}
        by_rows = {n: a for n, a in sort.items() if a is not None and a.detail}
        needed = used | relation.keys() | {a.column for _, a in shown} | {a.column for n, a in sort.items() if a and n not in by_rows}
        frame = relation.frame(needed)
        if within is not True:
            frame = frame.where(within)
        if condition is not True:
            frame = frame.where(condition)
        for name, a in by_rows.items():
            lows = a.detail.rows().groupBy(F.col(a.detail.key).alias("_key")).agg(F.min(_folded(F.col(a.column), a)).alias(f"_low_{name}"))
            frame = frame.join(lows, F.col(a.detail.own) == F.col("_key"), "left").drop("_key")
        columns = [relation.dn(frame).alias("dn"), F.lit(relation.object_class).alias("objectClass")]
        for name, a in shown:
            c = F.col(a.column)
            if request.types_only:
                c = (F.coalesce(F.size(c), F.lit(0)) > 0) if a.multi else c.isNotNull()
            columns.append(c.alias(name))
        for name, a in sort.items():
            if a is not None:
                value = F.col(f"_low_{name}") if name in by_rows else _sort_value(a)
                columns.append(value.alias(f"_sort_{name}"))
        return frame.select(*columns)

    @staticmethod
    def _shown(relation: Relation, request: SearchRequest) -> list[tuple[str, Attribute]]:
        wanted = [a for a in request.attributes if a not in ("*", "+")]
        if request.attributes == ("1.1",):
            return []
        if not wanted:
            return list(relation.attributes.items())
        return [(a, relation.find(a)) for a in wanted if relation.find(a)]

    def _check_sort(self, keys: tuple[SortKey, ...]) -> None:
        for k in keys:
            if not self.known(k.attribute):
                raise DirectoryError(f"no attribute {k.attribute} to sort by", ResultCode.NO_SUCH_ATTRIBUTE)
            if k.rule and k.rule.lower() not in MATCHING_RULES:
                raise DirectoryError(f"no rule {k.rule}", ResultCode.INAPPROPRIATE_MATCHING)

    @staticmethod
    def order(keys: Iterable[SortKey]) -> list[Column]:
        """Entries without the key count as larger than all others; the name breaks ties."""
        out = []
        for k in keys:
            c = F.col(f"_sort_{k.attribute.lower()}")
            out.append(c.desc_nulls_first() if k.descending else c.asc_nulls_last())
        return [*out, F.col("dn").asc()]

    def sorted_keys(self, request: SearchRequest) -> tuple[DataFrame, list[Column]]:
        """The unordered result with its sort columns, and the order: for cursors."""
        base = self.default_base if request.base is None else request.base
        if base is None:
            raise DirectoryError("no base to search under")
        node = f.parse(request.filter) if isinstance(request.filter, str) else request.filter
        self._check_sort(request.sort)
        out = self._united(node, base, request)
        for oid, value in request.controls:
            if oid not in CONTROLS:
                raise DirectoryError(f"no control {oid}", ResultCode.UNAVAILABLE_CRITICAL_EXTENSION)
            out = CONTROLS[oid](out, value)
        return out, self.order(request.sort)

    def get(self, dn: str, *attributes: str) -> DataFrame:
        """The entry of a name: one row, or none."""
        return self.search(SearchRequest(base=dn, scope=Scope.BASE, attributes=attributes, show_deleted=True))

    def has(self, dn: str) -> bool:
        try:
            return not self.get(dn, "1.1").isEmpty()
        except DirectoryError as e:
            if e.code == ResultCode.NO_SUCH_OBJECT:
                return False
            raise

    def values(self, object_class: str, attribute: str) -> DataFrame:
        """dn, value: a row for each value of a multi-valued attribute, whose array is never made."""
        relation = next((r for r in self.relations if r.object_class.lower() == object_class.lower()), None)
        a = relation.find(attribute) if relation else None
        if a is None or not a.detail:
            raise DirectoryError(f"{attribute} of {object_class} has no rows of its own", ResultCode.NO_SUCH_ATTRIBUTE)
        frame = relation.frame(relation.keys())
        rows = a.detail.rows().select(F.col(a.detail.key).alias("_key"), F.col(a.column).alias("_value")).where("_value IS NOT NULL")
        own = frame.withColumn("_dn", relation.dn(frame)).select("_dn", F.col(a.detail.own).alias("_own"))
        return own.join(rows, F.col("_own") == F.col("_key")).select(F.col("_dn").alias("dn"), F.col("_value").alias("value"))

    def compare(self, dn: str, attribute: str, value: str) -> DataFrame:
        """One row, matches: whether the entry has the value. No row if there is no such entry."""
        test = f.equal(attribute, value)
        for relation in self.relations:
            within = _within(relation, dn, Scope.BASE)
            if within is False:
                continue
            predicates = Predicates(relation, self.known)
            condition = predicates.column(test)
            frame = relation.frame(predicates.used | relation.keys()).where(within)
            a = relation.find(attribute)
            if a is not None and a.detail:
                there = lambda rows, yes: rows.select(F.lit(dn).alias("dn"), F.lit(yes).alias("matches"))
                return there(frame.where(condition), True).unionByName(there(frame.where(~condition), False))
            hit = F.lit(condition) if isinstance(condition, bool) else F.coalesce(condition, F.lit(False))
            return frame.select(F.lit(dn).alias("dn"), hit.alias("matches"))
        raise DirectoryError(f"no entry {dn}", ResultCode.NO_SUCH_OBJECT)

    def by_class(self, base: str | None = None) -> DataFrame:
        """Entries of each object class under a base."""
        base = self.default_base if base is None else base
        out = None
        for r in self.relations:
            within = _within(r, base, Scope.SUBTREE)
            if within is False:
                continue
            frame = r.frame(r.keys())
            frame = frame if within is True else frame.where(within)
            counted = frame.agg(F.count("*").alias("entries")).select(F.lit(r.object_class).alias("objectClass"), "entries")
            out = counted if out is None else out.unionByName(counted)
        return out


def _within(relation: Relation, base: str, scope: str) -> Column | bool:
    """The scope as a predicate on the relation's keys, so that it reaches the scan."""
    wanted = names.pairs(base)[::-1]
    path = relation.path
    if len(wanted) > len(path) or scope == Scope.BASE and len(wanted) != len(path) or scope == Scope.ONE and len(path) != len(wanted) + 1:
        return False
    out: Column | bool = True
    for (name, value), (own, fixed) in zip(wanted, path):
        if name != own:
            return False
        if fixed is not None:
            if fixed.lower() != value.lower():
                return False
            continue
        test = F.col(own) == (int(value) if _is_integer(value) else value)
        out = test if out is True else out & test
    return out


def _is_integer(value: str) -> bool:
    return value.lstrip("-").isdigit()


def _folded(c: Column, a: Attribute) -> Column:
    return F.lower(c) if a.syntax in ("ci_string", "dn") else c


def _sort_value(a: Attribute) -> Column:
    """What an entry is sorted by: its lowest value, case ignored where the syntax says so."""
    return _folded(F.array_min(F.col(a.column)) if a.multi else F.col(a.column), a)


def expected_count(found: DataFrame, least: int, most: int) -> DataFrame:
    """found, if it has least..most rows; checked on most + 1 rows at the utmost."""
    n = found.limit(most + 1).count()
    if not least <= n <= most:
        raise DirectoryError(f"{'over ' * (n > most)}{min(n, most)} entries, expected {least} to {most}", ResultCode.CONSTRAINT_VIOLATION)
    return found


def size_limited(found: DataFrame, limit: int) -> tuple[DataFrame, ResultCode]:
    """The first rows, and whether there were more."""
    more = found.limit(limit + 1).count() > limit
    return found.limit(limit), ResultCode.SIZE_LIMIT_EXCEEDED if more else ResultCode.SUCCESS
