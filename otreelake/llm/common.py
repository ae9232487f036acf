"""What the operators of this subpackage share: table reads, lineage cuts, Arrow mapping, fixed patterns."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts and bytes in one Arrow batch, and texts in one batch of the Parquet reader; a task holds one of each at a time, so they bound its memory.
BATCH_ROWS, BATCH_BYTES, READ_ROWS = 1000, 16 << 20, 512


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batch sizes to what whole texts need; larger ones that the session has go down, smaller ones stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        held = spark.conf.get(key).removesuffix("b")
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all runs on this machine, else an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="otreelake-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame, rows: int | None = None, each: int = 20_000) -> DataFrame:
    """df, computed once and written to the shared folder; a lost executor costs no recomputation of what lies before.

    rows: about how many there are; then no more files are written than hold `each` of them (12 at least), instead of one for every shuffle partition."""
    shared_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(12, rows // each))).checkpoint(eager=True)


class Columns(dict):
    """A batch's columns by name, as lists; each is converted when it is first read."""

    def __init__(self, names: list[str], batch: pa.RecordBatch) -> None:
        self.arrays = dict(zip(names, batch.columns, strict=True))

    def __missing__(self, name: str) -> list:
        self[name] = values = self.arrays[name].to_pylist()
        return values


def map_batches(df: DataFrame, fn: Callable[..., dict], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """Arrow batches through fn, which gets Columns and returns lists by column name; columns of the schema that it does not return pass as they are.

    setup() runs once a partition, on the executor; its result is fn's second argument."""
    small_batches(df.sparkSession)
    names = df.columns
    out_type = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = () if setup is None else (setup(),)
        for batch in batches:
            cols = Columns(names, batch)
            got = fn(cols, *made)
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) if f.name in got else cols.arrays[f.name].cast(f.type) for f in out_type], schema=out_type)

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, keep: Callable[..., list[bool]], setup: Callable[[], object] | None = None) -> DataFrame:
    """The rows of df for which keep, given Columns, says true; all columns pass as they are."""
    small_batches(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = () if setup is None else (setup(),)
        for batch in batches:
            yield batch.filter(pa.array(keep(Columns(names, batch), *made), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def n_words(text: Column) -> Column:
    """Words in text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def buckets_for(rows: int) -> int:
    """A power of two for splitting rows by hash: buckets of a few hundred rows in small tables, of up to 20,000 in large ones."""
    return 1 << max(4, max(rows // 20_000, min(rows // 400, 4096)).bit_length() - 1)
