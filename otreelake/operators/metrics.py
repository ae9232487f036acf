"""What an index looks like: its blocks, cubes, files and levels, and how much of it a sample touches."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cubes import Cube
from ..functions.transforms import exact_quantiles
from ..functions.weights import MAX_WEIGHT, from_fraction, normalized
from ..sources.log import UNINDEXED, Revision, Snapshot

BLOCK_SCHEMA = "cubeId string, depth int, filePath string, revisionID bigint, fileSize bigint, fileModificationTime bigint, minWeight int, maxWeight int, blockElementCount bigint, isLeaf boolean"


def blocks(spark: SparkSession, snapshot: Snapshot, revision: Revision) -> DataFrame:
    """A row for each block of a revision, with its file and whether its cube has no stored cube below it. Files that are not indexed count as one root block."""
    d = max(1, len(revision.transformers))
    width = -(-d // 6)
    found = [(f, b) for f in snapshot.files_of(revision.id) for b in f.blocks or (UNINDEXED,)]
    inner = {b.cube[:k] for _, b in found for k in range(0, len(b.cube), width)}
    columns = {
        "cubeId": [b.cube for _, b in found], "depth": [len(b.cube) // width for _, b in found], "filePath": [f.path for f, _ in found], "revisionID": [f.revision for f, _ in found],
        "fileSize": [f.size for f, _ in found], "fileModificationTime": [f.modified for f, _ in found], "minWeight": [b.min_weight for _, b in found], "maxWeight": [b.max_weight for _, b in found],
        "blockElementCount": [b.elements or (0 if f.blocks else f.elements) for f, b in found], "isLeaf": [b.cube not in inner for _, b in found],
    }
    # As arrays, in Arrow's form, since a large table has some 10^6 blocks.
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    types = dict(c.split() for c in BLOCK_SCHEMA.split(", "))
    return spark.createDataFrame(pa.table({name: pa.array(values, kinds[types[name]]) for name, values in columns.items()}), BLOCK_SCHEMA)


def cube_status(found: DataFrame, cube_size: int) -> DataFrame:
    """A row for each cube: greatest weight (the least over its blocks), normalised weight and rows."""
    cubes = found.groupBy("cubeId", "depth").agg(F.min("maxWeight").alias("maxWeight"), F.sum("blockElementCount").alias("elementCount"), F.min("isLeaf").alias("isLeaf"), F.count(F.lit(1)).alias("blockCount"))
    return cubes.withColumn("normalizedWeight", normalized(F.col("maxWeight"), F.col("elementCount"), cube_size))


def size_stats(df: DataFrame, column: str) -> dict:
    """Count, average, standard deviation and exact quartiles of a column."""
    c = F.col(column)
    row = df.agg(F.count(c).alias("count"), F.avg(c).alias("avg"), F.stddev(c).alias("stddev")).first()
    quartiles = exact_quantiles(df, column, [0.0, 0.25, 0.5, 0.75, 1.0])
    whole = isinstance(df.schema[column].dataType, T.IntegralType)
    return {"count": row["count"], "avg": int(row["avg"] or 0), "stddev": int(row["stddev"] or 0), "quartiles": [int(q) if whole else q for q in quartiles]}


def least_height(elements: int, cube_size: int, dimensions: int) -> int:
    """The height of a tree whose inner cubes are all full and have all children."""
    if not elements:
        return 0
    r = 1 << dimensions
    return max(1, math.ceil(math.log(math.ceil(elements / cube_size) * (r - 1) + 1, r) - 1e-9))


def truncated(value: float, places: int = 2) -> float:
    return math.trunc(value * 10**places) / 10**places


@dataclass(frozen=True)
class IndexMetrics:
    revision: Revision
    elements: int
    dimensions: int
    height: int
    desired_cube_size: int
    fanout: float
    max_fanout: int
    cubes: dict
    block_sizes: dict
    files: dict
    inner_levels: DataFrame
    leaf_levels: DataFrame

    def __str__(self) -> str:
        head = [("Revision", self.revision.id), ("Elements", self.elements), ("Dimensions", self.dimensions), ("Height", f"{self.height} (least {least_height(self.elements, self.desired_cube_size, self.dimensions)})"), ("Desired cube size", self.desired_cube_size), ("Cubes", self.cubes["count"]), ("Blocks", self.block_sizes["count"]), ("Files", self.files["count"]), ("Fan-out", f"{self.fanout} (most {self.max_fanout})"), ("Indexed on", ",".join(f"{t.name}:{t.policy}" for t in self.revision.transformers))]
        sizes = [("", "count", "avg", "stddev", "quartiles"), *((name, s["count"], s["avg"], s["stddev"], ",".join(map(str, s["quartiles"]))) for name, s in (("cubes", self.cubes), ("blocks", self.block_sizes), ("file bytes", self.files)))]
        levels = [[tuple(df.columns), *map(tuple, df.collect())] for df in (self.inner_levels, self.leaf_levels)]
        return "\n\n".join([tabulate(head), tabulate(sizes), "Inner cubes\n" + tabulate(levels[0]), "Leaf cubes\n" + tabulate(levels[1])])


def tabulate(rows: list[tuple]) -> str:
    """Rows as text, columns padded to the widest."""
    cells = [[str(c) for c in row] for row in rows]
    widths = [max((len(row[k]) for row in cells if k < len(row)), default=0) for k in range(max(map(len, cells), default=0))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(row, widths)).rstrip() for row in cells)


def levels(cubes: DataFrame) -> DataFrame:
    """By depth: cubes, average rows and average normalised weight."""
    return cubes.groupBy("depth").agg(F.count(F.lit(1)).alias("cubeCount"), F.sum("blockCount").alias("blockCount"), F.avg("elementCount").alias("avgElements"), F.avg("normalizedWeight").alias("avgNormalizedWeight")).orderBy("depth")


def index_metrics(spark: SparkSession, snapshot: Snapshot, revision: Revision) -> IndexMetrics:
    found = blocks(spark, snapshot, revision)
    cubes = cube_status(found, revision.cube_size)
    d = len(revision.transformers)
    top = cubes.agg(F.sum("elementCount").alias("n"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("all"), F.sum((~F.col("isLeaf")).cast("int")).alias("inner")).first()
    children = (top["all"] or 0) - 1
    files = found.select("filePath", "fileSize").distinct()
    return IndexMetrics(
        revision, top["n"] or 0, d, (top["depth"] if top["depth"] is not None else -1) + 1, revision.cube_size, truncated(children / top["inner"]) if top["inner"] else 0.0, 1 << d,
        size_stats(cubes, "elementCount"), size_stats(found, "blockElementCount"), size_stats(files, "fileSize"), levels(cubes.where("NOT isLeaf")), levels(cubes.where("isLeaf")),
    )


def sampling_info(found: DataFrame, fraction: float) -> DataFrame:
    """Files, rows and bytes that a sample touches, and all there are."""
    files = found.groupBy("filePath").agg(F.max("fileSize").alias("bytes"), F.sum("blockElementCount").alias("rows"), F.min("minWeight").alias("least"))
    hit = F.col("least") < F.lit(from_fraction(fraction) if fraction < 1 else MAX_WEIGHT)
    of = lambda c: F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0)).alias(f"{c}_read")
    return files.agg(F.sum(hit.cast("bigint")).alias("files_read"), F.count(F.lit(1)).alias("files"), of("rows"), F.sum("rows").alias("rows"), of("bytes"), F.sum("bytes").alias("bytes"))


def tree_json(found: DataFrame, revision: Revision, fraction: float = 0.0) -> str:
    """The stored cubes as nodes and parent-child edges, for drawing; those that a sample touches are marked."""
    d = len(revision.transformers)
    threshold = from_fraction(fraction)
    cubes = found.groupBy("cubeId").agg(F.min("minWeight").alias("least"), F.min("maxWeight").alias("most"), F.sum("blockElementCount").alias("n")).orderBy("cubeId").collect()
    nodes = [{"id": r["cubeId"], "depth": Cube.parse(d, r["cubeId"]).depth, "minWeight": r["least"], "maxWeight": r["most"], "elements": r["n"], "sampled": r["least"] < threshold} for r in cubes]
    known = {n["id"] for n in nodes}
    edges = [{"source": p, "target": n["id"]} for n in nodes if n["id"] and (p := Cube.parse(d, n["id"]).parent().string()) in known]
    return json.dumps({"nodes": nodes, "edges": edges})
