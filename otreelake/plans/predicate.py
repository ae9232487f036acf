"""Predicates as pruning knows them: AND, OR, comparisons of a column with a value, IN and IS [NOT] NULL.

They are read from Catalyst's own expressions (plans/catalyst.py), so quoting, escapes, comments and casts are Spark's. What is not understood is
opaque, which prunes nothing: Spark evaluates the predicate itself again on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Compare:
    column: str
    op: str  # = < <= > >=
    value: object


@dataclass(frozen=True)
class IsIn:
    column: str
    values: tuple


@dataclass(frozen=True)
class IsNull:
    column: str
    negated: bool = False


@dataclass(frozen=True)
class Opaque:
    """Anything that says nothing about files."""


@dataclass(frozen=True)
class And:
    """Without parts: always true."""

    parts: tuple


@dataclass(frozen=True)
class Or:
    """Without parts: never true."""

    parts: tuple


Predicate = Compare | IsIn | IsNull | Opaque | And | Or
FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}
_NOT = {"<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def negate(p: Predicate) -> Predicate:
    """Rows for which p is false; null counts as neither."""
    if isinstance(p, And):
        return Or(tuple(map(negate, p.parts)))
    if isinstance(p, Or):
        return And(tuple(map(negate, p.parts)))
    if isinstance(p, IsNull):
        return IsNull(p.column, not p.negated)
    if isinstance(p, Compare) and p.op in _NOT:
        return Compare(p.column, _NOT[p.op], p.value)
    return Opaque()


def conjuncts(p: Predicate) -> Iterator[Predicate]:
    for part in p.parts if isinstance(p, And) else (p,):
        if isinstance(part, And):
            yield from conjuncts(part)
        else:
            yield part
