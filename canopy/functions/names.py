"""Distinguished names: small Python helpers for plan time, and Column forms for data.

A name is split at commas that no odd run of backslashes precedes; blanks before a part are dropped. The empty name has
no parts and no parent.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy.model import DirectoryError, ResultCode


def parts(name: str) -> list[str]:
    """The RDNs of a name, leaf first."""
    if not name:
        return []
    out, held, escaped = [], "", False
    for c in name:
        if c == "," and not escaped:
            out.append(held)
            held = ""
        else:
            held += c
        escaped = c == "\\" and not escaped
    return [p.lstrip() for p in [*out, held]]


def pairs(name: str) -> list[tuple[str, str]]:
    """(attribute in lower case, value) of every RDN's first pair."""
    found = []
    for part in parts(name):
        attribute, sign, value = re.split(r"(?<!\\)\+", part)[0].partition("=")
        if not sign:
            raise DirectoryError(f"no value in {part!r}", ResultCode.INVALID_DN_SYNTAX)
        found.append((attribute.strip().lower(), unescape(value)))
    return found


def unescape(value: str) -> str:
    """Backslash pairs: two hex digits are a byte, any other character is itself."""
    raw = re.sub(rb"\\([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), value.encode())
    return re.sub(r"\\(.)", r"\1", raw.decode("utf-8", "replace"))


def parent(name: str) -> str | None:
    own = parts(name)
    return ",".join(own[1:]) if len(own) > 1 else None


def is_valid(name: str) -> bool:
    return all("=" in p for p in parts(name))


def escape_value(value: str) -> str:
    """A value as it stands in an RDN."""
    # Characters that have a meaning in names.
    out = re.sub(r'[\\+,"<>;=]', lambda m: f"\\{ord(m[0]):02x}", value)
    if out[:1] in ("#", " "):
        out = f"\\{ord(out[0]):02x}{out[1:]}"
    if out[-1:] == " ":
        out = f"{out[:-1]}\\20"
    return out


def escape_assertion(value: str) -> str:
    """A value as it stands in a filter: the filter's own marks and control bytes in hex."""
    if re.fullmatch(r"(\\[0-9a-fA-F]{2})*", value):
        return value
    return re.sub(r"[\\*()\x00-\x1f\x7f]", lambda m: f"\\{ord(m[0]):02x}", value)


def escape_all(value: str) -> str:
    return "".join(f"\\{b:02x}" for b in value.encode())


def unescape_assertion(value: str) -> str:
    raw = re.sub(rb"\\([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), value.encode())
    return raw.decode("utf-8", "surrogateescape")


def escape_value_column(value: Column) -> Column:
    """escape_value() on data, by nested replacement."""
    out = F.replace(value.cast("string"), F.lit("\\"), F.lit("\\5c"))
    for mark in '+,"<>;=':
        out = F.replace(out, F.lit(mark), F.lit(f"\\{ord(mark):02x}"))
    out = F.regexp_replace(out, "^#", r"\\23")
    return F.regexp_replace(F.regexp_replace(out, "^ ", r"\\20"), " $", r"\\20")


def rdns(name: Column) -> Column:
    """array<string>, leaf first. Escaped commas are those behind a backslash, as in data that escape_value() wrote."""
    split = F.transform(F.split(name, r"(?<!\\),"), lambda p: F.ltrim(p))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(split)


def rdn(name: Column) -> Column:
    return F.try_element_at(rdns(name), F.lit(1))


def parent_of(name: Column) -> Column:
    own = rdns(name)
    return F.when(F.size(own) > 1, F.array_join(F.slice(own, 2, F.size(own)), ","))


def depth(name: Column) -> Column:
    return F.size(rdns(name))


def rdn_name(part: Column) -> Column:
    return F.split(part, "=", 2)[0]


def rdn_value(part: Column) -> Column:
    return F.try_element_at(F.split(part, "=", 2), F.lit(2))


def is_valid_column(name: Column) -> Column:
    return F.forall(rdns(name), lambda p: F.contains(p, F.lit("=")))


def is_multivalued(part: Column) -> Column:
    return F.size(F.split(part, r"(?<!\\)\+")) > 1


def authorization_id(name: Column) -> Column:
    """dn:... for what reads as a name, else u:..."""
    return F.when((name != "") & is_valid_column(name), F.concat(F.lit("dn:"), name)).otherwise(F.concat(F.lit("u:"), name))


def extended_dn(name: Column, guid: Column, sid: Column | None = None, dashed: bool = True) -> Column:
    """The name behind its identifiers: <GUID=...>;<SID=...>;name. A missing SID is left out; dashed=False takes the dashes from the GUID."""
    shown = guid if dashed else F.replace(guid, F.lit("-"), F.lit(""))
    second = F.lit("") if sid is None else F.coalesce(F.concat(F.lit("<SID="), sid.cast("string"), F.lit(">;")), F.lit(""))
    return F.concat(F.lit("<GUID="), shown, F.lit(">;"), second, name)


#: The flags of a security descriptor's parts.
OWNER, GROUP, DACL, SACL = 1, 2, 4, 8


def descriptor_part(part: Column, flag: int, flags: Column | int) -> Column:
    """A part of a security descriptor, shown if its flag is among those asked for."""
    asked = F.lit(flags) if isinstance(flags, int) else flags
    return F.when(asked.bitwiseAND(F.lit(flag)) != 0, part)


def options(description: str) -> list[str]:
    """The options of an attribute description, in lower case and in order: member;Range=0-9;lang-en."""
    return sorted(o.lower() for o in description.split(";")[1:] if o)


def has_option(description: str, option: str) -> bool:
    return option.lower() in options(description)


def options_start_with(description: str, text: str) -> bool:
    return any(o.startswith(text.lower()) for o in options(description))


def attribute_name(description: Column) -> Column:
    return F.split(description, ";", 2)[0]


def options_column(description: Column) -> Column:
    """options() on data, as an array."""
    own = F.split(F.lower(description), ";")
    return F.array_sort(F.filter(F.slice(own, 2, F.size(own)), lambda o: o != ""))


def description_column(name: Column, own: Column) -> Column:
    """A description from a name and its options: in lower case, options in order, so that equal ones read the same."""
    return F.array_join(F.concat(F.array(F.lower(name)), F.array_sort(F.transform(own, F.lower))), ";")


def is_below(name: Column, base: str) -> Column:
    """The base itself or what stands under it, without regard to case."""
    low, own = F.lower(name), ",".join(parts(base)).lower()
    return F.lit(True) if not own else (low == own) | F.endswith(low, F.lit("," + own))
