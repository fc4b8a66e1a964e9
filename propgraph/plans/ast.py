"""What a query says, as plain data."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    of: Expr
    key: str


@dataclass(frozen=True)
class Index(Expr):
    of: Expr
    at: Expr | None
    end: Expr | None = None
    slice: bool = False


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapOf(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # NOT, -, IS NULL, IS NOT NULL
    x: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    a: Expr
    b: Expr


@dataclass(frozen=True)
class HasLabel(Expr):
    of: str
    labels: tuple[str, ...]


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Case(Expr):
    of: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    default: Expr | None


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    labels: tuple[str, ...]
    props: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class RelPattern:
    var: str | None
    types: tuple[str, ...]
    props: tuple[tuple[str, Expr], ...]
    direction: str  # out, in, both
    hops: tuple[int, int | None] | None


@dataclass(frozen=True)
class Path:
    var: str | None
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...]
    shortest: bool = False


@dataclass(frozen=True)
class Exists(Expr):
    paths: tuple[Path, ...]
    where: Expr | None


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool


@dataclass
class Match:
    paths: tuple[Path, ...]
    optional: bool
    where: Expr | None = None


@dataclass
class Projection:
    items: tuple[Item, ...]
    star: bool
    distinct: bool
    order: tuple[Order, ...] = ()
    skip: Expr | None = None
    limit: Expr | None = None
    where: Expr | None = None
    final: bool = False


@dataclass
class Unwind:
    expr: Expr
    var: str


@dataclass
class Create:
    paths: tuple[Path, ...]


@dataclass
class Merge:
    path: Path
    on_create: tuple[Any, ...] = ()
    on_match: tuple[Any, ...] = ()


@dataclass
class SetProp:
    var: str
    key: str
    expr: Expr


@dataclass
class SetLabels:
    var: str
    labels: tuple[str, ...]


@dataclass
class SetAll:
    var: str
    expr: Expr
    replace: bool


@dataclass
class RemoveProp:
    var: str
    key: str


@dataclass
class RemoveLabels:
    var: str
    labels: tuple[str, ...]


@dataclass
class Change:
    """SET or REMOVE."""

    items: tuple[Any, ...]


@dataclass
class Delete:
    names: tuple[str, ...]
    detach: bool


@dataclass
class Query:
    clauses: list[Any] = field(default_factory=list)


@dataclass
class Union:
    parts: list[Query]
    all: list[bool]


WRITES = (Create, Merge, Change, Delete)


def walk(x: Any) -> Iterator[Any]:
    """``x`` and everything in it."""
    yield x
    if isinstance(x, (list, tuple)):
        for y in x:
            yield from walk(y)
    elif is_dataclass(x):
        for f in fields(x):
            yield from walk(getattr(x, f.name))
