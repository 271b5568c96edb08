"""Expression trees and queries; they print as their normal form."""

from __future__ import annotations

from dataclasses import dataclass, field

MESSAGE = "_msg"
ANY = "*"
#: Operators that the stored language runs, that tags may use, and those that are designed only.
FIELD_OPS = ("=", "!=")
TAG_OPS = ("=", "!=")
MORE_OPS = ("~", "!~", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Predicate:
    key: str
    op: str
    value: str
    wild: bool = False
    #: len: the operator applies to the value's length.
    function: str | None = None

    def __str__(self) -> str:
        key = f"{self.function}({self.key})" if self.function else self.key
        return f"({key} {self.op} {self.value})"


@dataclass(frozen=True)
class Both:
    left: Expression
    right: Expression

    def __str__(self) -> str:
        return f"({self.left} AND {self.right})"


@dataclass(frozen=True)
class Either:
    left: Expression
    right: Expression

    def __str__(self) -> str:
        return f"({self.left} OR {self.right})"


Expression = Predicate | Both | Either


@dataclass(frozen=True)
class Pipe:
    """A step after the filter: its name, its arguments and the field that it makes."""

    name: str
    args: tuple[str, ...] = ()
    into: str | None = None


@dataclass(frozen=True)
class LogQuery:
    """start and end are nanoseconds, both inclusive. stream_ids, if not None, are the only streams."""

    start: int
    end: int
    tags: Expression | None = None
    fields: Expression | None = None
    stream_ids: tuple[str, ...] | None = None
    pipes: tuple[Pipe, ...] = field(default=())

    def __str__(self) -> str:
        return f"[{self.start},{self.end}]" + f" {{{self.tags}}}" * (self.tags is not None) + f" {self.fields}" * (self.fields is not None)


def predicates(e: Expression | None) -> list[Predicate]:
    if e is None:
        return []
    return [e] if isinstance(e, Predicate) else predicates(e.left) + predicates(e.right)
