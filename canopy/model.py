"""Requests, results and errors of the directory."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import IntEnum
from typing import Any


class Scope:
    BASE, ONE, SUBTREE = "base", "one", "sub"


class Deref:
    """Whether aliases are followed: not at all, in the entries found, in the base, or in both."""

    NEVER, SEARCHING, FINDING, ALWAYS = "never", "searching", "finding", "always"


class ResultCode(IntEnum):
    """The protocol's result codes."""

    SUCCESS = 0
    OPERATIONS_ERROR = 1
    PROTOCOL_ERROR = 2
    TIME_LIMIT_EXCEEDED = 3
    SIZE_LIMIT_EXCEEDED = 4
    COMPARE_FALSE = 5
    COMPARE_TRUE = 6
    AUTH_METHOD_NOT_SUPPORTED = 7
    STRONGER_AUTH_REQUIRED = 8
    REFERRAL = 10
    ADMIN_LIMIT_EXCEEDED = 11
    UNAVAILABLE_CRITICAL_EXTENSION = 12
    CONFIDENTIALITY_REQUIRED = 13
    SASL_BIND_IN_PROGRESS = 14
    NO_SUCH_ATTRIBUTE = 16
    UNDEFINED_ATTRIBUTE_TYPE = 17
    INAPPROPRIATE_MATCHING = 18
    CONSTRAINT_VIOLATION = 19
    ATTRIBUTE_OR_VALUE_EXISTS = 20
    INVALID_ATTRIBUTE_SYNTAX = 21
    NO_SUCH_OBJECT = 32
    ALIAS_PROBLEM = 33
    INVALID_DN_SYNTAX = 34
    ALIAS_DEREFERENCING_PROBLEM = 36
    INAPPROPRIATE_AUTHENTICATION = 48
    INVALID_CREDENTIALS = 49
    INSUFFICIENT_ACCESS_RIGHTS = 50
    BUSY = 51
    UNAVAILABLE = 52
    UNWILLING_TO_PERFORM = 53
    LOOP_DETECT = 54
    NAMING_VIOLATION = 64
    OBJECT_CLASS_VIOLATION = 65
    NOT_ALLOWED_ON_NON_LEAF = 66
    NOT_ALLOWED_ON_RDN = 67
    ENTRY_ALREADY_EXISTS = 68
    OBJECT_CLASS_MODS_PROHIBITED = 69
    AFFECTS_MULTIPLE_DSAS = 71
    VIRTUAL_LIST_VIEW_ERROR = 76
    OTHER = 80
    CANCELED = 118
    NO_SUCH_OPERATION = 119
    TOO_LATE = 120
    CANNOT_CANCEL = 121
    ASSERTION_FAILED = 122
    AUTHORIZATION_DENIED = 123
    SYNC_REFRESH_REQUIRED = 4096

    @property
    def words(self) -> str:
        return self.name.lower().replace("_", " ")


class DirectoryError(Exception):
    def __init__(self, message: str, code: ResultCode = ResultCode.OPERATIONS_ERROR):
        super().__init__(message)
        self.code = code


class FilterParseError(DirectoryError):
    pass


@dataclass(frozen=True)
class SortKey:
    attribute: str
    descending: bool = False
    rule: str | None = None


@dataclass(frozen=True)
class SearchRequest:
    """What to search for. Empty attributes mean all; a size limit of 0 means none.

    Tombstones are shown only if asked for. controls name plan changes that were registered, with their values.
    """

    filter: Any = "(objectClass=*)"
    base: str | None = None
    scope: str = Scope.SUBTREE
    attributes: tuple[str, ...] = ()
    types_only: bool = False
    size_limit: int = 0
    sort: tuple[SortKey, ...] = ()
    show_deleted: bool = False
    controls: tuple[tuple[str, Any], ...] = ()

    def with_(self, **changes) -> SearchRequest:
        return replace(self, **changes)
