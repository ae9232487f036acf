"""Configuration keys, read from the Spark session, with their defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows that a cube is meant to hold.
CUBE_SIZE = ("spark.otreelake.index.defaultCubeSize", 5_000_000)
#: How often a commit that lost a race is tried again.
RETRIES = ("spark.otreelake.index.numberOfRetries", 2)
#: Whether columns to index are chosen where none are named, and how many.
AUTO_COLUMNS = ("spark.otreelake.index.columnsToIndex.auto", False)
AUTO_COLUMNS_MAX = ("spark.otreelake.index.columnsToIndex.auto.max", 3)
#: Commits between two checkpoints of the log.
CHECKPOINT_EVERY = ("spark.otreelake.log.checkpointInterval", 10)


def get(spark: SparkSession, key: tuple[str, int | bool]) -> int | bool:
    """The session's value of a key, in the default's type."""
    name, default = key
    value = spark.conf.get(name, str(default))
    return value.lower() == "true" if isinstance(default, bool) else int(value)
