"""Syntax tree of the query language: expressions, patterns, clauses."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class Expr:
    def children(self) -> list[Expr]:
        out: list[Expr] = []

        def walk(x: Any) -> None:
            if isinstance(x, Expr):
                out.append(x)
            elif isinstance(x, (tuple, list)):
                for y in x:
                    walk(y)

        for f in fields(self):
            walk(getattr(self, f.name))
        return out


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
    base: Expr
    key: str


@dataclass(frozen=True)
class ListLit(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapLit(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    x: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    a: Expr
    b: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    x: Expr
    negated: bool


@dataclass(frozen=True)
class Case(Expr):
    operand: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    default: Expr | None


@dataclass(frozen=True)
class Index(Expr):
    x: Expr
    i: Expr


@dataclass(frozen=True)
class Slice(Expr):
    x: Expr
    a: Expr | None
    b: Expr | None


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class ListComp(Expr):
    var: str
    source: Expr
    where: Expr | None
    project: Expr | None


@dataclass(frozen=True)
class Quantifier(Expr):
    kind: str
    var: str
    source: Expr
    where: Expr | None


@dataclass(frozen=True)
class Reduce(Expr):
    acc: str
    init: Expr
    var: str
    source: Expr
    step: Expr


@dataclass(frozen=True)
class HasLabel(Expr):
    x: Expr
    labels: tuple[str, ...]


@dataclass(frozen=True)
class NodePat(Expr):
    var: str | None
    labels: tuple[str, ...]
    props: MapLit | None


@dataclass(frozen=True)
class RelPat(Expr):
    var: str | None
    types: tuple[str, ...]
    direction: str  # out, in or both
    props: MapLit | None
    length: tuple[int, int | None] | None = None  # of a variable-length pattern


@dataclass(frozen=True)
class PathPat(Expr):
    var: str | None
    elements: tuple[Any, ...]
    function: str | None = None


@dataclass(frozen=True)
class PatternComp(Expr):
    pattern: PathPat
    where: Expr | None
    project: Expr


@dataclass(frozen=True)
class Exists(Expr):
    patterns: tuple[PathPat, ...]
    where: Expr | None


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str


@dataclass
class Clause:
    pass


@dataclass
class Match(Clause):
    patterns: list[PathPat]
    where: Expr | None = None
    optional: bool = False


@dataclass
class Projection(Clause):
    items: list[Item]
    star: bool = False
    distinct: bool = False
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    skip: Expr | None = None
    limit: Expr | None = None
    where: Expr | None = None
    final: bool = False


@dataclass
class Unwind(Clause):
    expr: Expr
    var: str


@dataclass
class Create(Clause):
    patterns: list[PathPat]


@dataclass
class Merge(Clause):
    pattern: PathPat
    on_create: list[Any] = field(default_factory=list)
    on_match: list[Any] = field(default_factory=list)


@dataclass
class SetItem:
    var: str
    key: str | None  # None: a map or labels
    value: Expr | None
    mode: str  # prop, merge, replace, label


@dataclass
class SetClause(Clause):
    items: list[SetItem]


@dataclass
class Remove(Clause):
    items: list[SetItem]


@dataclass
class Delete(Clause):
    names: list[str]
    detach: bool = False


@dataclass
class Foreach(Clause):
    var: str
    source: Expr
    clauses: list[Clause]


@dataclass
class CallProc(Clause):
    name: str
    args: list[Expr]
    yields: list[tuple[str, str]]


@dataclass
class CallSub(Clause):
    query: Query


@dataclass
class LoadCsv(Clause):
    source: Expr
    var: str
    headers: bool
    separator: str = ","


@dataclass
class Schema(Clause):
    action: str  # create_index, drop_index, show_indexes, create_constraint, drop_constraint, show_constraints
    options: dict[str, Any]
    where: Expr | None = None


@dataclass
class Query:
    parts: list[list[Clause]]
    union_all: list[bool] = field(default_factory=list)
