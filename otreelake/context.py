"""The parts of the engine that can be replaced, and the ones in use.

A part is any object with the methods of its protocol. `use(index_manager=..., ...)` puts parts in place for the process, `using(...)` for a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields, replace
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession

from .functions.cubes import Cube
from .functions.transforms import Transformer
from .operators import columns, index, writer
from .operators.index import Placed
from .sources.log import IndexFile, Log, Revision, Store


@runtime_checkable
class IndexManager(Protocol):
    """Finds where rows belong."""

    def place(self, df: DataFrame, transformers: list[Transformer], cube_size: int, stats: dict, current: Revision | None, existing: dict[Cube, tuple[int, int]]) -> Placed | None: ...

    def replace_rows(self, df: DataFrame, revision: Revision, existing: dict[Cube, tuple[int, int]]) -> Placed | None: ...


@runtime_checkable
class DataWriter(Protocol):
    """Writes rows where they belong, and describes the files."""

    def write_files(self, df: DataFrame, placed: Placed, store: Store, data_change: bool = True) -> list[IndexFile]: ...


@runtime_checkable
class ColumnsSelector(Protocol):
    """Chooses the columns to index where none are named."""

    def select_columns(self, df: DataFrame, most: int) -> list[str]: ...


@runtime_checkable
class MetadataManager(Protocol):
    """Opens a table's log."""

    def open_log(self, spark: SparkSession, path: str) -> Log: ...


class LogFiles:
    """The log of sources/log.py."""

    def open_log(self, spark: SparkSession, path: str) -> Log:
        return Log(spark, path)


@dataclass(frozen=True)
class Parts:
    index_manager: IndexManager = index
    data_writer: DataWriter = writer
    columns_selector: ColumnsSelector = columns
    metadata_manager: MetadataManager = LogFiles()


_PROTOCOLS = {"index_manager": IndexManager, "data_writer": DataWriter, "columns_selector": ColumnsSelector, "metadata_manager": MetadataManager}
_parts = Parts()


def parts() -> Parts:
    return _parts


def use(**given) -> Parts:
    """Puts parts in place; without any, the engine's own. Returns those before."""
    global _parts
    for name, part in given.items():
        if name not in _PROTOCOLS:
            raise TypeError(f"there is no part {name}; there are {[f.name for f in fields(Parts)]}")
        if not isinstance(part, _PROTOCOLS[name]):
            raise TypeError(f"{name} has not the methods of {_PROTOCOLS[name].__name__}")
    before, _parts = _parts, replace(_parts, **given) if given else Parts()
    return before


@contextmanager
def using(**given) -> Iterator[None]:
    """The same for a block."""
    global _parts
    before = use(**given)
    try:
        yield
    finally:
        _parts = before
