"""The index build: from rows to cubes.

The weight and the coordinates are Column expressions. Which cubes there are follows from how many rows lie in each cell of the unit cube: a cube with
more rows than the cube size keeps the lowest weights, up to its parent's greatest weight plus cube size over rows, and the rest goes to
its children. The counts come from one aggregate by cell at a depth that follows from the number of rows; where cells are still too
full, their rows alone are counted again at a greater depth. Only cells, some for each cube, reach the driver.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import transforms as tf
from ..functions.cubes import Cube, CubeTable, cell_column, code_column, max_depth
from ..functions.weights import MAX_WEIGHT, from_fraction, to_fraction, weight
from ..sources.log import Revision

#: Counting starts with cells for about so many times the expected number of cubes.
CELLS_PER_CUBE = 16
#: The most cells that one count may give.
MAX_CELLS_BITS = 22


def cells(df: DataFrame, revision: Revision, depth: int) -> tuple[DataFrame, list[Column]]:
    """df with a column for each axis that holds the row's cell, and those columns."""
    names = [f"_cell{k}" for k in range(len(revision.transformers))]
    inside = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), t.column(F.col(f"`{c.name}`")))) for c, t in zip(revision.transformers, revision.transformations, strict=True)]
    return df.withColumns({n: cell_column(x, depth) for n, x in zip(names, inside, strict=True)}), [F.col(n) for n in names]


@dataclass(frozen=True)
class Placed:
    """What indexing rows needs: the revision, the cubes with their greatest weights and expected rows, and whether the revision is new."""

    revision: Revision
    weights: dict[Cube, int]
    expected: dict[Cube, float]
    new_revision: bool
    rows: int
    #: Cells of the greatest depth with more rows than the cube size: points that so many rows share. Their rows have few weights, so the expected rows say nothing of them.
    heavy: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64), compare=False)

    @property
    def depth(self) -> int:
        return max(1, max((c.depth for c in self.weights), default=0))


def next_revision(df: DataFrame, transformers: list[tf.Transformer], cube_size: int, stats: dict, current: Revision | None) -> tuple[Revision, bool, int]:
    """The revision that the data needs, whether it is new, and the number of rows: one aggregate.

    User statistics go over those of the data but do not narrow them. A change of columns is an error; of cube size, a policy or a
    mapping that no longer holds all values makes a new revision."""
    if cube_size <= 0:
        raise AnalysisError("the cube size must be positive")
    wanted = [c for t in transformers for c in t.statistics()]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *wanted).first().asDict()
    rows = row.pop("_rows")
    merged = {**{k: v for t in transformers for k, v in stats.items() if k.startswith(f"{t.name}_")}}
    for t in transformers:
        low, high = (stats.get(f"{t.name}_{end}") for end in ("min", "max"))
        if t.policy == "linear" and low is not None and high is not None and not tf.number(low, t.kind) < tf.number(high, t.kind):
            raise AnalysisError(f"{t.name}_min must be less than {t.name}_max")
        if t.policy == "linear":
            for end, pick in (("min", min), ("max", max)):
                known = [tf.number(v, t.kind) for v in (stats.get(f"{t.name}_{end}"), row.get(f"{t.name}_{end}")) if v is not None]
                merged[f"{t.name}_{end}"] = pick(known) if known else None
    now = int(time.time() * 1000)
    if current is None or not current.transformers:
        made = tuple(t.transformation(merged) for t in transformers)
        return Revision((current.id if current else 0) + 1, now, cube_size, tuple(transformers), made), True, rows
    if [t.name for t in transformers] != current.columns:
        raise AnalysisError(f"the table is indexed on {current.columns}, not on {[t.name for t in transformers]}")
    made, changed = [], cube_size != current.cube_size
    for t, old, mapping in zip(transformers, current.transformers, current.transformations, strict=True):
        if t.policy in ("quantiles", "histogram") and merged.get(f"{t.name}_{t.policy}") is None and old.policy == t.policy:
            made.append(mapping)
        elif t != old:
            made.append(t.transformation(merged))
            changed = True
        else:
            new = t.update(mapping, merged)
            made.append(new or mapping)
            changed |= new is not None
    revision = replace(current, id=current.id + 1, timestamp=now, cube_size=cube_size, transformers=tuple(transformers), transformations=tuple(made)) if changed else current
    return revision, changed, rows


#: Codes and numbers by depth: sorted arrays, for trees of any size without an object for each node.
Level = tuple[np.ndarray, np.ndarray]
_NONE: Level = (np.zeros(0, np.int64), np.zeros(0))
#: Cells that a broadcast table may hold; with more of them the join is a shuffle.
MOST_BROADCAST = 1_000_000


def cell_levels(df: DataFrame, revision: Revision, rows: int) -> dict[int, Level]:
    """Rows in each cell by depth, deep enough that no cell holds more than the cube size, but where the depth ends. No cell lies in another."""
    d = len(revision.transformers)
    deepest = max_depth(d)
    bits = min(MAX_CELLS_BITS, math.ceil(math.log2(max(2, CELLS_PER_CUBE * rows / revision.cube_size))))
    depth = min(deepest, max(1, -(-bits // d)))
    out: dict[int, Level] = {}
    open_, before = None, 0
    while True:
        placed, own = cells(df, revision, depth)
        found = placed.select(code_column(own, depth).alias("cell"))
        if open_ is not None:
            full = df.sparkSession.createDataFrame(pa.table({"full": open_}))
            full = F.broadcast(full) if len(open_) <= MOST_BROADCAST else full
            found = found.join(full, F.shiftright("cell", d * (depth - before)) == F.col("full"), "left_semi")
        table = found.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toArrow()  # 2^22 rows at most, as arrays
        codes, n = table["cell"].to_numpy(), table["n"].to_numpy()
        order = np.argsort(codes)
        codes, n = codes[order], n[order]
        too_full = (n > revision.cube_size) & (depth < deepest)
        out[depth] = codes[~too_full], n[~too_full].astype(float)
        if not too_full.any():
            return out
        open_, before = codes[too_full], depth
        depth = min(deepest, depth + max(1, -(-8 // d)))


def cell_counts(df: DataFrame, revision: Revision, rows: int) -> dict[Cube, int]:
    """The same as cubes."""
    d = len(revision.transformers)
    return {Cube(d, depth, int(c)): int(n) for depth, level in cell_levels(df, revision, rows).items() for c, n in zip(*level, strict=True)}


def summed(*levels: Level) -> Level:
    """Levels of one depth as one."""
    codes, at = np.unique(np.concatenate([c for c, _ in levels]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in levels]), len(codes)) if len(codes) else np.zeros(0)


def upward(levels: dict[int, Level], dimensions: int) -> list[Level]:
    """From the root on: every node with what lies in it and below."""
    out: list[Level] = []
    below = _NONE
    for depth in range(max(levels, default=0), -1, -1):
        here = summed(levels.get(depth, _NONE), below)
        out.append(here)
        below = here[0] >> dimensions, here[1]
    return out[::-1]


def looked_up(level: Level, codes: np.ndarray, missing: float = 0.0) -> np.ndarray:
    known, values = level
    if not len(known):
        return np.full(len(codes), missing)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, values[at], missing)


def existing_domains(cubes: dict[Cube, tuple[int, int]], dimensions: int) -> list[Level]:
    """Rows in the region of every stored cube: its own and those below; what ancestors hold is shared down in proportion."""
    by_depth: dict[int, list[tuple[int, int]]] = {}
    for cube, (_, n) in cubes.items():
        by_depth.setdefault(cube.depth, []).append((cube.code, n))
    levels = {depth: summed((np.array([c for c, _ in own], np.int64), np.array([n for _, n in own], float))) for depth, own in by_depth.items()}
    if not levels:
        return []
    below = upward(levels, dimensions)
    out = [below[0]]
    for codes, n in below[1:]:
        parents = codes >> dimensions
        siblings = summed((parents, n))
        whole = looked_up(siblings, parents)
        out.append((codes, looked_up(out[-1], parents) * np.divide(n, whole, out=np.zeros_like(n), where=whole > 0)))
    return out


def added(a: list[Level], b: list[Level]) -> list[Level]:
    return [summed(*(x[k] for x in (a, b) if k < len(x))) for k in range(max(len(a), len(b)))]


def cube_weights(sizes: list[Level], cube_size: int, dimensions: int) -> list[Level]:
    """The share of weights of every cube, from the root down: a cube of no more rows than the cube size takes all; any other up to its parent's share plus cube
    size over rows. Nothing lies below a cube that takes all."""
    out: list[Level] = []
    for depth, (codes, n) in enumerate(sizes):
        above = looked_up(out[-1], codes >> dimensions, 1.0) if depth else np.zeros(len(codes))
        kept = above < 1.0
        codes, n, above = codes[kept], n[kept], above[kept]
        out.append((codes, np.where(n * (1 - above) <= cube_size, 1.0, np.minimum(1.0, above + cube_size / np.maximum(n, 1e-300)))))
        if not len(codes):
            break
    return out


def indexed(own: list[Level], sizes: list[Level], revision: Revision, new: bool, rows: int) -> Placed:
    """The cubes of regions of these sizes, and how many rows each gets of data with the regions own."""
    d = len(revision.transformers)
    shares = cube_weights(sizes, revision.cube_size, d)
    weights: dict[Cube, int] = {}
    expected: dict[Cube, float] = {}
    for depth, (codes, share) in enumerate(shares):
        here = looked_up(own[depth], codes) if depth < len(own) else np.zeros(len(codes))
        for code, s, n in zip(codes.tolist(), share.tolist(), here.tolist(), strict=True):
            cube = Cube(d, depth, code)
            greatest = weights[cube] = MAX_WEIGHT if s >= 1.0 else from_fraction(s)
            below = to_fraction(weights[parent]) if (parent := cube.parent()) is not None else 0.0
            expected[cube] = max(0.0, to_fraction(greatest) - below) * n
    return Placed(revision, weights, expected, new, rows)


def place(df: DataFrame, transformers: list[tf.Transformer], cube_size: int, stats: dict, current: Revision | None, existing: dict[Cube, tuple[int, int]]) -> Placed | None:
    """How to index df; None if it is empty. existing: the stored cubes of the current revision."""
    revision, new, rows = next_revision(df, transformers, cube_size, stats, current)
    return placed_in(df, revision, {} if new else existing, new, rows) if rows else None


def replace_rows(df: DataFrame, revision: Revision, existing: dict[Cube, tuple[int, int]]) -> Placed | None:
    """For optimising: the cubes of the revision with the weights that all its rows give now."""
    rows = df.count()
    return placed_in(df, revision, existing, False, rows) if rows else None


def placed_in(df: DataFrame, revision: Revision, existing: dict[Cube, tuple[int, int]], new: bool, rows: int) -> Placed:
    d = len(revision.transformers)
    counts = cell_levels(df, revision, rows)
    own = upward(counts, d)
    codes, n = counts.get(max_depth(d), _NONE)
    return replace(indexed(own, added(own, existing_domains(existing, d)), revision, new, rows), heavy=codes[n > revision.cube_size])


def heavy_rows(df: DataFrame, placed: Placed) -> dict[int, int]:
    """Of the rows at heavy points, how many go to each cube (by number): one aggregate over those rows, where there are such points."""
    if not len(placed.heavy):
        return {}
    d = len(placed.revision.transformers)
    points = df.sparkSession.createDataFrame(pa.table({"_heavy": placed.heavy}))  # rows / cube size at most
    points = F.broadcast(points) if len(placed.heavy) <= MOST_BROADCAST else points
    with_cells, own = cells(df, placed.revision, max_depth(d))
    there = with_cells.withColumn("_code", code_column(own, max_depth(d))).join(points, F.col("_code") == F.col("_heavy"), "left_semi").select(*(f"`{c}`" for c in df.columns))
    return {r["_cube"]: r["n"] for r in with_cubes(there, placed, dict.fromkeys(placed.weights, 0)).groupBy("_cube").agg(F.count(F.lit(1)).alias("n")).collect()}  # cubes on their paths at most


def with_cubes(df: DataFrame, placed: Placed, groups: dict[Cube, int], parts: np.ndarray | None = None) -> DataFrame:
    """df with _weight, _cube (a number in pre-order), _group (of its file), _part (of so many that the group has) and _code (the place on the space-filling curve). Only the code and the weight pass through Python, in batches."""
    revision = placed.revision
    d, depth = len(revision.transformers), placed.depth
    table = CubeTable(d, placed.weights)
    group_of = np.array([groups[c] for c in table.cubes], np.int64)
    part_of = np.ones(int(group_of.max()) + 1, np.int64) if parts is None else parts
    sent = df.sparkSession.sparkContext.broadcast((table, group_of, part_of))

    @F.pandas_udf("struct<cube:bigint,file_group:bigint,parts:bigint>")
    def assigned(code: pd.Series, own_weight: pd.Series) -> pd.DataFrame:
        cubes, file_groups, its_parts = sent.value
        number = cubes.assign(code.to_numpy(np.int64), depth, own_weight.to_numpy(np.int64))
        return pd.DataFrame({"cube": number, "file_group": file_groups[number], "parts": its_parts[file_groups[number]]})

    with_cells, own = cells(df, revision, depth)
    weighed = with_cells.withColumns({"_weight": weight(*(f"`{c}`" for c in revision.columns)), "_code": code_column(own, depth)})
    return weighed.withColumn("_at", assigned("_code", "_weight")).select(*(f"`{c}`" for c in df.columns), "_weight", F.col("_at.cube").alias("_cube"), F.col("_at.file_group").alias("_group"), F.pmod(F.monotonically_increasing_id(), F.col("_at.parts")).alias("_part"), "_code")


def roll_up(expected: dict[Cube, float], limit: float) -> dict[Cube, Cube]:
    """The cube that names each cube's file: from the deepest level up, a group of fewer rows than limit joins its parent's."""
    members: dict[Cube, list[Cube]] = {c: [c] for c in expected}
    rows = dict(expected)
    for depth in range(max((c.depth for c in expected), default=0), 0, -1):
        for cube in sorted((c for c in rows if c.depth == depth), key=lambda c: c.code):
            if rows[cube] < limit:
                parent = cube.parent()
                rows[parent] = rows.get(parent, 0) + rows.pop(cube)
                members.setdefault(parent, []).extend(members.pop(cube))
    return {c: name for name, own in members.items() for c in own}
