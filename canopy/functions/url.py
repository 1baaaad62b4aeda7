"""Search requests as URLs: scheme://host:port/base?attributes?scope?filter?extensions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from canopy.model import DirectoryError, Scope, SearchRequest

# The scope words of the URL form.
_SCOPES = {"": Scope.BASE, "base": Scope.BASE, "one": Scope.ONE, "sub": Scope.SUBTREE}


@dataclass(frozen=True)
class Extension:
    """An extension of a URL: a name, whether it is critical, and a value."""

    name: str
    value: str | None = None
    critical: bool = False

    def __str__(self):
        shown = quote(self.name, safe="=!").replace(",", "%2c")
        value = "" if self.value is None else "=" + quote(self.value, safe="=!").replace(",", "%2c")
        return f"{'!' * self.critical}{shown}{value}"


def parse_extension(text: str) -> Extension:
    critical = text.startswith("!")
    name, sign, value = text[critical:].partition("=")
    if not name:
        raise DirectoryError(f"no name in extension {text!r}")
    return Extension(unquote(name), unquote(value) if sign else None, critical)


@dataclass(frozen=True)
class SearchUrl:
    base: str = ""
    attributes: tuple[str, ...] = ()
    scope: str | None = None
    filter: str | None = None
    host: str | None = None
    port: int | None = None
    secure: bool = False
    extensions: tuple[Extension, ...] = field(default=())

    def request(self) -> SearchRequest:
        return SearchRequest(
            filter=self.filter or "(objectClass=*)", base=self.base, scope=_SCOPES[self.scope or ""], attributes=self.attributes
        )

    def __str__(self):
        keep = "=,:;/()&|!*<>~ "
        rest = [
            ",".join(quote(a, safe=";") for a in self.attributes),
            self.scope or "",
            quote(self.filter or "", safe=keep.replace(" ", "")),
            ",".join(map(str, self.extensions)),
        ]
        while rest and not rest[-1]:
            rest.pop()
        place = (self.host or "") + (f":{self.port}" if self.port else "")
        return f"ldap{'s' * self.secure}://{place}/{'?'.join([quote(self.base, safe='=,'), *rest])}"


def parse(url: str) -> SearchUrl:
    found = re.fullmatch(r"(?i)(ldaps?)://([^/?:]*)(?::(\d+))?(?:/(.*))?", url, re.S)
    if not found:
        raise DirectoryError(f"not a search URL: {url!r}")
    scheme, host, port, rest = found.groups()
    base, attributes, scope, condition, extensions = ((rest or "").split("?") + [""] * 5)[:5]
    if scope.lower() not in _SCOPES:
        raise DirectoryError(f"no scope {scope!r}")
    return SearchUrl(
        unquote(base),
        tuple(unquote(a) for a in attributes.split(",") if a),
        scope.lower() or None,
        unquote(condition) or None,
        host or None,
        int(port) if port else None,
        scheme.lower() == "ldaps",
        tuple(parse_extension(e) for e in extensions.split(",") if e),
    )
