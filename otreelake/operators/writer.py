"""Writing indexed rows: one Parquet file for each group of cubes, then one aggregate for their blocks and statistics."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cubes import Cube, CubeTable
from ..sources.log import Block, IndexFile, Store
from .index import Placed, heavy_rows, roll_up, with_cubes

#: Columns, from the first on, that get statistics.
STATS_COLUMNS = 32
#: One write gives about so many files with a group of cubes each; with more groups, neighbours of one depth share a file of so many rows at most.
FILES = 250
SHARED_ROWS = 1_000_000
_COMPARABLE = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


def nullable(schema: T.StructType) -> T.StructType:
    """The schema as it is stored: everything may be null."""

    def relaxed(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, relaxed(f.dataType), True, f.metadata) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(relaxed(t.elementType), True)
        return T.MapType(relaxed(t.keyType), relaxed(t.valueType), True) if isinstance(t, T.MapType) else t

    return relaxed(schema)


def plain(value: object) -> object:
    """A statistic as JSON keeps it."""
    if isinstance(value, dt.datetime | dt.date):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    return None if isinstance(value, float) and not math.isfinite(value) else value


def moment(micros: int) -> dt.datetime | None:
    """A time in UTC; None beyond Python's years."""
    try:
        return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=micros)
    except OverflowError:
        return None


def stats_columns(schema: T.StructType) -> list[T.StructField]:
    return [f for f in schema.fields[:STATS_COLUMNS] if isinstance(f.dataType, _COMPARABLE)]


def aggregates(fields: list[T.StructField]) -> list:
    """Least and greatest value and number of nulls of every column; no bounds for columns with NaN. Those of timestamps are microseconds."""
    out = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        odd = F.sum(F.isnan(c).cast("int")) if isinstance(f.dataType, T.FloatType | T.DoubleType) else F.lit(0)
        x = F.unix_micros(c) if isinstance(f.dataType, T.TimestampType) else c
        out += [F.when(odd == 0, F.min(x)).alias(f"min{i}"), F.when(odd == 0, F.max(x)).alias(f"max{i}"), F.sum(c.isNull().cast("bigint")).alias(f"nulls{i}")]
    return out


def collected(rows: list[dict], fields: list[T.StructField]) -> dict:
    """Statistics of a file from those of its blocks."""
    stats: dict = {"numRecords": sum(r["n"] for r in rows), "minValues": {}, "maxValues": {}, "nullCount": {}}
    for i, f in enumerate(fields):
        stats["nullCount"][f.name] = sum(r[f"nulls{i}"] for r in rows)
        for name, pick in (("min", min), ("max", max)):
            if all(r[f"{name}{i}"] is not None or r[f"nulls{i}"] == r["n"] for r in rows):
                known = [r[f"{name}{i}"] for r in rows if r[f"{name}{i}"] is not None]
                found = pick(known) if known else None
                if isinstance(f.dataType, T.TimestampType) and found is not None:
                    found = moment(found)
                if (stored := plain(found)) is not None:
                    stats[f"{name}Values"][f.name] = stored
    return stats


def shared_files(size: dict[Cube, float], shared: float) -> dict[Cube, int]:
    """The number of each group's file: a file takes groups of one depth along the space-filling curve as long as they have no more than `shared` rows together."""
    out: dict[Cube, int] = {}
    file, depth, rows = -1, -1, 0.0
    for name in sorted(size, key=lambda c: (c.depth, c.code)):
        if name.depth != depth or rows + size[name] > shared:
            file, depth, rows = file + 1, name.depth, 0.0
        out[name] = file
        rows += size[name]
    return out


def write_files(df: DataFrame, placed: Placed, store: Store, data_change: bool = True) -> list[IndexFile]:
    """df's rows as files below data/, described.

    A group of cubes holds half the cube size or more, where there are as many, and is one file: leaves are rarely full, and with the whole size as limit
    nearly all would lie in their parents' files. Where a table has very many groups, those next to each other at one depth share a file, since a file costs the
    driver and a task some time however small it is. A group of more than two cube sizes (rows equal in all indexed columns end in one cube, however many) is dealt out to
    several files. Rows are shuffled once, by group; in a file they lie along the space-filling curve, so that Parquet's pages hold small ranges of the indexed columns and ranges read
    few of them. Blocks and statistics come
    from the written files, of which the scan needs only the indexed and the described columns, so the input is not computed again."""
    names = roll_up(placed.expected, placed.revision.cube_size / 2)
    size = dict.fromkeys(names.values(), 0.0)
    for cube, name in names.items():
        size[name] += placed.expected[cube]
    cubes = CubeTable(len(placed.revision.transformers), placed.weights).cubes
    for k, n in heavy_rows(df, placed).items():
        size[names[cubes[k]]] += n
    shared = min(SHARED_ROWS, sum(size.values()) / FILES)
    number = shared_files(size, shared)
    groups = {cube: number[name] for cube, name in names.items()}
    staging = f"_staging-{uuid.uuid4().hex}"
    expected = np.zeros(max(number.values()) + 1)
    for name, k in number.items():
        expected[k] += size[name]
    parts = np.maximum(1, np.ceil(expected / (2 * max(placed.revision.cube_size, shared)))).astype(np.int64)
    rows = with_cubes(df, placed, groups, parts)
    try:
        rows.repartition(int(parts.sum()), "_group", "_part").sortWithinPartitions("_group", "_code").drop("_weight", "_cube", "_part", "_code").write.partitionBy("_group").parquet(f"{store.root}/{staging}")
        return described(df, placed, store, staging, groups, data_change)
    finally:
        store.delete(staging)


def described(df: DataFrame, placed: Placed, store: Store, staging: str, groups: dict, data_change: bool) -> list[IndexFile]:
    spark = df.sparkSession
    fields = stats_columns(df.schema)
    cubes = CubeTable(len(placed.revision.transformers), placed.weights).cubes
    staged = spark.read.schema(nullable(df.schema)).parquet(f"{store.root}/{staging}").select(*(f"`{c}`" for c in df.columns), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"))
    found = with_cubes(staged, placed, groups).groupBy("_file", "_cube").agg(F.count(F.lit(1)).alias("n"), F.min("_weight").alias("least"), F.min("_size").alias("size"), *aggregates(fields))
    by_file: dict[str, list[dict]] = {}
    for r in found.collect():  # a row for each block
        by_file.setdefault(r["_file"], []).append(r.asDict())
    out = []
    now = int(time.time() * 1000)
    for source, blocks in sorted(by_file.items()):
        relative = source[source.index(staging) :]
        name = f"data/{uuid.uuid4().hex}.parquet"
        store.move(relative, name)
        made = tuple(Block(cubes[b["_cube"]].string(), b["least"], placed.weights[cubes[b["_cube"]]], b["n"]) for b in sorted(blocks, key=lambda b: b["_cube"]))
        out.append(IndexFile(name, blocks[0]["size"], now, placed.revision.id, made, collected(blocks, fields), data_change))
    return out


def describe_plain(df: DataFrame, schema: T.StructType) -> dict[str, dict]:
    """Statistics of files that are not indexed, by path."""
    fields = stats_columns(schema)
    found = df.withColumn("_file", F.col("_metadata.file_path")).groupBy("_file").agg(F.count(F.lit(1)).alias("n"), *aggregates(fields))
    return {r["_file"]: collected([r.asDict()], fields) for r in found.collect()}

