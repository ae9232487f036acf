"""A table layout for approximate queries on Spark: multi-dimensional, sample-aware clustering of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog
from .context import use, using
from .errors import AnalysisError, CommitConflict, OTreeError
from .plans.samples import push_samples
from .session import disable, enable
from .table import OTreeTable

__all__ = ["AnalysisError", "Catalog", "CommitConflict", "OTreeError", "OTreeTable", "disable", "enable", "push_samples", "read_table", "use", "using", "write_table"]


def read_table(spark: SparkSession, path: str, **scan) -> DataFrame:
    return OTreeTable(spark, path).scan(**scan)


def write_table(df: DataFrame, path: str, mode: str = "error", **options) -> OTreeTable:
    table = OTreeTable(df.sparkSession, path)
    table.write(df, mode, **options)
    return table
