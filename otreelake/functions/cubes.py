"""Cubes: nodes of the tree that halves [0, 1]^d along every axis at every level.

A cube is its dimension count, its depth and a Morton code of d bits a level; the root has depth 0 and code 0. Of a level's bits the first axis
has the highest. Ancestors are right shifts, so codes of one depth sort in the order of the space-filling curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols of the string form, six bits each.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bits that a code may take.
CODE_BITS = 60


def max_depth(dimensions: int) -> int:
    return min(30, CODE_BITS // dimensions)


@dataclass(frozen=True)
class Cube:
    dimensions: int
    depth: int = 0
    code: int = 0

    def parent(self) -> Cube | None:
        return Cube(self.dimensions, self.depth - 1, self.code >> self.dimensions) if self.depth else None

    def ancestor(self, depth: int) -> Cube:
        return Cube(self.dimensions, depth, self.code >> self.dimensions * (self.depth - depth))

    def first_child(self) -> Cube:
        return Cube(self.dimensions, self.depth + 1, self.code << self.dimensions)

    def children(self) -> Iterator[Cube]:
        first = self.first_child()
        return (Cube(self.dimensions, first.depth, first.code + k) for k in range(1 << self.dimensions))

    def next_sibling(self) -> Cube | None:
        last = (self.code + 1) % (1 << self.dimensions) == 0
        return None if self.depth == 0 or last else Cube(self.dimensions, self.depth, self.code + 1)

    def is_ancestor_of(self, other: Cube) -> bool:
        """A cube is its own ancestor."""
        return self.dimensions == other.dimensions and self.depth <= other.depth and other.ancestor(self.depth) == self

    def cells(self) -> list[int]:
        """The cube's place along every axis, of 2^depth."""
        d, cells = self.dimensions, [0] * self.dimensions
        for level in range(self.depth):
            group = self.code >> d * (self.depth - 1 - level)
            for axis in range(d):
                cells[axis] = cells[axis] << 1 | group >> d - 1 - axis & 1
        return cells

    def bounds(self) -> list[tuple[float, float]]:
        width = 0.5**self.depth
        return [(c * width, (c + 1) * width) for c in self.cells()]

    def contains(self, point: list[float]) -> bool:
        """Half-open, but closed at 1."""
        return all(low <= x < high or x == high == 1.0 for x, (low, high) in zip(point, self.bounds(), strict=True))

    def order_key(self) -> tuple[int, int]:
        """Sorts cubes of one tree in pre-order."""
        return self.code << self.dimensions * (max_depth(self.dimensions) - self.depth), self.depth

    def string(self) -> str:
        """Symbols level by level; the root is empty."""
        d, width = self.dimensions, -(-self.dimensions // 6)
        out = []
        for level in range(self.depth):
            group = (self.code >> d * (self.depth - 1 - level) & (1 << d) - 1) << 6 * width - d
            out += [SYMBOLS[group >> 6 * (width - 1 - k) & 63] for k in range(width)]
        return "".join(out)

    @staticmethod
    def parse(dimensions: int, text: str) -> Cube:
        width = -(-dimensions // 6)
        if len(text) % width:
            raise ValueError(f"{text!r} is no cube of {dimensions} dimensions")
        code = 0
        for at in range(0, len(text), width):
            group = 0
            for c in text[at : at + width]:
                group = group << 6 | SYMBOLS.index(c)
            code = code << dimensions | group >> 6 * width - dimensions
        return Cube(dimensions, len(text) // width, code)

    def encode(self) -> bytes:
        return self.depth.to_bytes(4, "big") + self.code.to_bytes(8, "big")

    @staticmethod
    def decode(dimensions: int, data: bytes) -> Cube:
        return Cube(dimensions, int.from_bytes(data[:4], "big"), int.from_bytes(data[4:], "big"))


def containers(point: list[float], parent: Cube | None = None) -> Iterator[Cube]:
    """The cubes that hold a point, from the root (or the child of parent) down to the deepest."""
    d = len(point)
    deepest = max_depth(d)
    code = morton([min(int(x * (1 << deepest)), (1 << deepest) - 1) for x in point], deepest)
    for depth in range(0 if parent is None else parent.depth + 1, deepest + 1):
        yield Cube(d, depth, code >> d * (deepest - depth))


def morton(cells: list[int], depth: int) -> int:
    code = 0
    for level in range(depth):
        for cell in cells:
            code = code << 1 | cell >> depth - 1 - level & 1
    return code


def cell_column(coordinate: Column, depth: int) -> Column:
    """The cell, of 2^depth, that a coordinate in [0, 1] lies in."""
    return F.least(F.floor(coordinate * F.lit(float(1 << depth))).cast("long"), F.lit((1 << depth) - 1))


def code_column(cells: list[Column], depth: int) -> Column:
    """The code at a depth of rows with these cells: an expression of shifts, so it stays in generated code."""
    d = len(cells)
    code = F.lit(0).cast("long")
    for level in range(depth):
        for axis, cell in enumerate(cells):
            bit = F.shiftright(cell, depth - 1 - level).bitwiseAND(F.lit(1).cast("long"))
            code = code.bitwiseOR(F.shiftleft(bit, d * (depth - 1 - level) + d - 1 - axis))
    return code


class CubeTable:
    """A tree's cubes by depth, as sorted arrays, for looking up many codes at once."""

    def __init__(self, dimensions: int, cubes: dict[Cube, int]) -> None:
        """cubes: each with its greatest weight; a cube's number is its place in pre-order."""
        self.dimensions = dimensions
        self.cubes = sorted(cubes, key=Cube.order_key)
        number = {c: i for i, c in enumerate(self.cubes)}
        self.levels = []
        for depth in range(max((c.depth for c in cubes), default=0) + 1):
            own = sorted((c for c in cubes if c.depth == depth), key=lambda c: c.code)
            self.levels.append((np.array([c.code for c in own], np.int64), np.array([cubes[c] for c in own], np.int64), np.array([number[c] for c in own], np.int64)))

    def assign(self, codes: np.ndarray, depth: int, weights: np.ndarray) -> np.ndarray:
        """The number of each row's cube: the first from the root whose greatest weight is no less than the row's, or else the last that is known."""
        out = np.zeros(len(codes), np.int64)
        open_ = np.ones(len(codes), bool)
        for level, (known, greatest, number) in enumerate(self.levels):
            own = codes >> self.dimensions * (depth - level)
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            found = open_ & (known[at] == own) if len(known) else np.zeros(len(codes), bool)
            out[found] = number[at[found]]
            open_ = found & (weights > greatest[at])
            if not open_.any():
                break
        return out
