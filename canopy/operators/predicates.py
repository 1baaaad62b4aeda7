"""Filters as Column predicates.

Negations are pushed to the leaves, so that positive leaves and "absent or different" both reach the Parquet scan. Nested
containers of one kind become one, equalities of one attribute one look-up, and the rest a tree of logarithmic depth, so
that filters may have many thousand branches.
A leaf is true, false or undefined. An attribute that an entry lacks makes a leaf false, hence its negation true; one
that no relation knows makes both undefined (NULL), as does a value that its syntax can't read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy.functions import filters as f
from canopy.model import DirectoryError, ResultCode
from canopy.sources.relation import Attribute, Relation

#: name or OID in lower case -> (value of the attribute, assertion) -> predicate
MATCHING_RULES: dict[str, Callable[[Column, str], Column]] = {}
COMPILERS: dict[type, Callable] = {}


def register_matching_rule(*rule_names: str):
    def add(rule):
        MATCHING_RULES.update({n.lower(): rule for n in rule_names})
        return rule

    return add


def register_filter(kind: type, compiler: Callable) -> None:
    """Compiler for nodes of a kind of one's own: (node, relation, positive, known) -> Column or bool."""
    COMPILERS[kind] = compiler


# Names and numbers of the matching rules.
@register_matching_rule("caseIgnoreMatch", "2.5.13.2")
def _ignore(value, text):
    return F.lower(value.cast("string")) == text.lower()


@register_matching_rule("caseExactMatch", "2.5.13.5")
def _exact(value, text):
    return value.cast("string") == text


@register_matching_rule("integerMatch", "2.5.13.14")
def _integer(value, text):
    return value.cast("long") == int(text)


@register_matching_rule("1.2.840.113556.1.4.803")
def _all_bits(value, text):
    return value.cast("long").bitwiseAND(F.lit(int(text))) == int(text)


@register_matching_rule("1.2.840.113556.1.4.804")
def _some_bits(value, text):
    return value.cast("long").bitwiseAND(F.lit(int(text))) != 0


def read_time(text: str) -> datetime | None:
    """GeneralizedTime, with or without fraction and zone; without a zone, UTC."""
    found = re.fullmatch(r"(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)?(\d\d)?(?:[.,](\d+))?(Z|[+-]\d{2,4})?", text)
    if not found:
        return None
    y, mo, d, h, mi, s, part, zone = found.groups()
    try:
        at = datetime(int(y), int(mo), int(d), int(h), int(mi or 0), int(s or 0), int(((part or "") + "000000")[:6]), timezone.utc)
    except ValueError:
        return None
    if zone and zone != "Z":
        shift = int(zone[1:3]) * 60 + int(zone[3:5] or 0)
        at = datetime.fromtimestamp(at.timestamp() - (shift if zone[0] == "+" else -shift) * 60, timezone.utc)
    return at.replace(tzinfo=None)


def _literal(syntax: str, text: str):
    """The assertion as a value of the syntax; None if it can't be read."""
    try:
        if syntax == "int":
            return int(text)
        if syntax == "double":
            return float(text)
    except ValueError:
        return None
    if syntax == "bool":
        return {"TRUE": True, "FALSE": False}.get(text.upper())
    if syntax == "time":
        at = read_time(text)
        return None if at is None else F.lit(at).cast("timestamp_ntz")
    return text.lower() if syntax in ("ci_string", "dn") else text


def _folded(value: Column, syntax: str) -> Column:
    return F.lower(value) if syntax in ("ci_string", "dn") else value


def _substring(value: Column, node: f.Substring, fold: Callable[[str], str]) -> Column:
    initial, final = fold(node.initial or ""), fold(node.final or "")
    middle = [fold(x) for x in node.any]
    checks = [value.startswith(initial)] if initial else []
    checks += [value.endswith(final)] if final else []
    checks += [value.contains(x) for x in middle]
    if len(checks) > 1:
        # the parts in order and apart; the simple checks stay for the scan
        quoted = [re.sub(r"([\\.\[\]{}()*+?^$|#&~ -])", r"\\\1", x) for x in (initial, *middle, final)]
        checks.append(value.rlike(r"(?s)\A" + ".*".join(quoted) + r"\z"))
    return reduce(lambda a, b: a & b, checks)


UNDEFINED = None
#: Levels of alternating containers that a predicate may have, once nested ones of a kind are one.
MOST_LEVELS = 200


@dataclass
class _Group:
    """A conjunction (every) or a disjunction of groups, of leaves (node, positive) and of constants."""

    every: bool
    parts: list = field(default_factory=list)
    level: int = 0


def _flattened(node) -> _Group:
    """The filter with negations at its leaves and nested containers of one kind as one, whatever its depth."""
    root = _Group(True)
    rest = [(node, True, root)]
    while rest:
        node, positive, into = rest.pop()
        if isinstance(node, f.Not):
            rest.append((node.child, not positive, into))
        elif isinstance(node, (f.And, f.Or)):
            every = isinstance(node, f.And) == positive
            if not node.children:
                into.parts.append(every)
                continue
            if every != into.every and len(node.children) > 1:
                group = _Group(every, level=into.level + 1)
                if group.level > MOST_LEVELS:
                    raise DirectoryError(f"a filter of more than {MOST_LEVELS} levels", ResultCode.UNWILLING_TO_PERFORM)
                into.parts.append(group)
                into = group
            rest.extend((c, positive, into) for c in reversed(node.children))
        else:
            into.parts.append((node, positive))
    return root


def balanced(columns: list[Column], join: Callable[[Column, Column], Column]) -> Column:
    """All columns joined by a tree of logarithmic depth."""
    while len(columns) > 1:
        columns = [join(*columns[k : k + 2]) if k + 1 < len(columns) else columns[k] for k in range(0, len(columns), 2)]
    return columns[0]


class Predicates:
    """Compiles filters for one relation; known tells whether any relation has an attribute."""

    def __init__(self, relation: Relation, known: Callable[[str], bool]):
        self.relation, self.known = relation, known
        self.used: set[str] = set()

    def column(self, node) -> Column | bool:
        """True, False or NULL for each entry; a plain bool if it is the same for all."""
        out = self._compile(_flattened(node))
        return F.lit(None).cast("boolean") if out is UNDEFINED else out

    def _compile(self, group: _Group):
        parts, equal = [], {}
        for part in group.parts:
            if isinstance(part, _Group):
                parts.append(self._compile(part))
            elif isinstance(part, bool):
                parts.append(part)
            elif part[1] != group.every and (found := self._equality(part[0])):
                attribute, value = found
                equal.setdefault(attribute.column, (attribute, []))[1].append(value)
            else:
                parts.append(self._node(*part))
        # equalities of one attribute, any of which will do, are one look-up
        for attribute, found in equal.values():
            one = len(found) == 1
            test = lambda v, a=attribute, x=found, one=one: _folded(v, a.syntax) == x[0] if one else _folded(v, a.syntax).isin(x)
            parts.append(self._leaf(attribute, test, not group.every))
        return self._combined(parts, group.every)

    def _equality(self, node) -> tuple[Attribute, object] | None:
        """Attribute and value of a plain equality."""
        if type(node) is not f.Compare or node.op != "=" or type(node) in COMPILERS or node.attribute.lower() == "objectclass":
            return None
        attribute = self.relation.find(node.attribute)
        value = None if attribute is None else _literal(attribute.syntax, node.value)
        return None if value is None else (attribute, value)

    def _node(self, node, positive: bool):
        if type(node) in COMPILERS:
            return COMPILERS[type(node)](node, self.relation, positive, self.known)
        if isinstance(node, f.Extensible):
            return self._extensible(node, positive)
        if node.attribute.lower() == "objectclass":
            return self._object_class(node, positive)
        attribute = self.relation.find(node.attribute)
        if attribute is None:
            return (not positive) if self.known(node.attribute) else UNDEFINED
        if isinstance(node, f.Present):
            return self._presence(attribute, positive)
        return self._leaf(attribute, self._test(attribute, node), positive)

    @staticmethod
    def _combined(children: list, conjunction: bool):
        """Kleene's and / or, constants folded: a relation whose predicate is False is not read at all."""
        if any(c is (not conjunction) for c in children):
            return not conjunction
        rest = [F.lit(None).cast("boolean") if c is UNDEFINED else c for c in children if c is not conjunction]
        if not rest:
            return conjunction
        return balanced(rest, (lambda a, b: a & b) if conjunction else (lambda a, b: a | b))

    def _object_class(self, node, positive: bool):
        own = self.relation.object_class.lower()
        if isinstance(node, f.Present):
            return positive
        if isinstance(node, f.Substring):
            hit = re.fullmatch(".*".join(re.escape(x.lower()) for x in (node.initial or "", *node.any, node.final or "")), own, re.S) is not None
        else:
            hit = node.op in ("=", "~=") and node.value.lower() in (own, "top")
        return hit == positive

    def _presence(self, attribute: Attribute, positive: bool) -> Column:
        if attribute.detail:
            there = attribute.detail.exists(F.col(attribute.column).isNotNull())
            return there if positive else ~there
        self.used.add(attribute.column)
        c = F.col(attribute.column)
        if attribute.multi:
            there = F.coalesce(F.size(c), F.lit(0)) > 0
            return there if positive else ~there
        return c.isNotNull() if positive else c.isNull()

    def _leaf(self, attribute: Attribute, test, positive: bool):
        """The predicate for an attribute from a test of one value."""
        if test is UNDEFINED:
            return UNDEFINED
        if attribute.detail:
            some = attribute.detail.exists(test(F.col(attribute.column)))
            return some if positive else ~some
        self.used.add(attribute.column)
        c = F.col(attribute.column)
        if attribute.multi:
            some = F.exists(c, lambda v: F.coalesce(test(v), F.lit(False)))
            return some if positive else F.coalesce(~some, F.lit(True))
        return test(c) if positive else c.isNull() | ~test(c)

    @staticmethod
    def _test(attribute: Attribute, node):
        syntax = attribute.syntax
        if isinstance(node, f.Substring):
            fold = str.lower if syntax in ("ci_string", "dn") else str
            return lambda v: _substring(_folded(v.cast("string"), syntax), node, fold)
        if node.op == "~=" and "approximate" in MATCHING_RULES:
            return lambda v: MATCHING_RULES["approximate"](v, node.value)
        value = _literal(syntax, node.value)
        if value is None:
            return UNDEFINED
        if node.op in ("=", "~="):
            return lambda v: _folded(v, syntax) == value
        if node.op == ">=":
            return lambda v: _folded(v, syntax) >= value
        return lambda v: _folded(v, syntax) <= value

    def _extensible(self, node: f.Extensible, positive: bool):
        rule = MATCHING_RULES.get(node.rule.lower()) if node.rule else None
        if node.rule and rule is None:
            return UNDEFINED

        def of(attribute: Attribute):
            if rule is None:
                return self._leaf(attribute, self._test(attribute, f.Compare("", "=", node.value)), positive)
            try:
                rule(F.lit(None), node.value)
            except ValueError:
                return UNDEFINED
            return self._leaf(attribute, lambda v: rule(v, node.value), positive)

        if node.attribute:
            attribute = self.relation.find(node.attribute)
            if attribute is None:
                out = [(not positive) if self.known(node.attribute) else UNDEFINED]
            else:
                out = [of(attribute)]
        else:
            out = [x for x in map(of, self.relation.attributes.values()) if x is not UNDEFINED]
        if node.dn:
            for name, fixed in self.relation.path:
                if node.attribute and name != node.attribute.lower():
                    continue
                if fixed is not None:
                    out.append((fixed.lower() == node.value.lower()) == positive)
                elif rule is None:
                    out.append(self._leaf(Attribute(name, "int"), self._test(Attribute(name, "int"), f.Compare("", "=", node.value)), positive))
                else:
                    out.append(self._leaf(Attribute(name), lambda v: rule(v, node.value), positive))
            out = [x for x in out if x is not UNDEFINED] or out
        return self._combined(out, not positive)
