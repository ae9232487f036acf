"""spark.read.format("otree"): a thin source in pure Python over tables on a local or mounted file system.

It reads all files: Spark keeps a Python reader between the queries of one DataFrame, so filters that one query pushes down would hold for the
next. The scan of OTreeTable prunes, reads natively and is to be preferred.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from .log import Log


class LocalStore:
    """What a snapshot needs of Store, without a JVM."""

    def __init__(self, path: str) -> None:
        self.root = path.removeprefix("file://").removeprefix("file:")

    def list(self, name: str) -> list[tuple[str, int, int]]:
        folder = os.path.join(self.root, name)
        return [(e.name, e.stat().st_size, e.stat().st_mtime_ns) for e in os.scandir(folder)] if os.path.isdir(folder) else []

    def read(self, name: str) -> str:
        with open(os.path.join(self.root, name), encoding="utf-8") as f:
            return f.read()


def local_log(path: str) -> Log:
    log = Log.__new__(Log)
    log.spark, log.store = None, LocalStore(path)
    return log


class OTreeReader(ds.DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[ds.InputPartition]:
        return [ds.InputPartition(path) for path in local_log(self.path).snapshot().files] or [ds.InputPartition(None)]

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        names = self.schema.names
        with pq.ParquetFile(os.path.join(LocalStore(self.path).root, partition.value), coerce_int96_timestamp_unit="us") as file:
            for batch in file.iter_batches(columns=[n for n in names if n in file.schema_arrow.names]):
                yield pa.RecordBatch.from_arrays([batch[n] if n in batch.schema.names else pa.nulls(len(batch)) for n in names], names=names)


class OTreeSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "otree"

    def schema(self) -> T.StructType:
        return local_log(self.options["path"]).snapshot().schema

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        return OTreeReader(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OTreeSource)
