"""The engine as part of a session: spark.sql, df.sample, spark.read.format("otree") and df.write.format("otree").

enable(spark) wraps PySpark's own methods. A wrapped method does what it did before unless the session is enabled and the call is about our format, our tables or a
sample of their rows.
"""

from __future__ import annotations

import functools
import re
import weakref

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.classic.dataframe import DataFrame as ClassicFrame
from pyspark.sql.readwriter import DataFrameReader, DataFrameWriter

from .catalog import Catalog
from .errors import AnalysisError
from .plans.catalyst import kind
from .plans.samples import push_samples
from .plans.statements import FORMAT, concerns, parsed
from .table import OTreeTable

_CATALOGS: weakref.WeakKeyDictionary[SparkSession, Catalog] = weakref.WeakKeyDictionary()
_WRAPPED: list[str] = []


def enable(spark: SparkSession, root: str | None = None) -> Catalog:
    """From now on the session knows our tables. root: the catalog's folder; without it, `otree` in the warehouse."""
    if not _WRAPPED:
        wrap()
    found = _CATALOGS[spark] = Catalog(spark, root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{FORMAT}")
    return found


def disable(spark: SparkSession) -> None:
    _CATALOGS.pop(spark, None)


def wrapper(owner: type, name: str):
    """Puts a function that gets the old method in the place of a method."""

    def put(fn):
        old = getattr(owner, name)

        @functools.wraps(old)
        def method(self, *args, **kwargs):
            return fn(old, self, *args, **kwargs)

        setattr(owner, name, method)
        _WRAPPED.append(f"{owner.__name__}.{name}")
        return method

    return put


def named(options: dict, *names: str) -> str | None:
    """An option's value, whatever the case of its name."""
    lower = {k.lower(): v for k, v in options.items()}
    return next((str(lower[n.lower()]) for n in names if n.lower() in lower), None)


def read(spark: SparkSession, path: str, options: dict) -> DataFrame:
    table = OTreeTable(spark, path)
    version = named(options, "versionAsOf")
    return table.frame(None if version is None else int(version))


def write_options(options: dict) -> dict:
    """The writer's options as arguments of OTreeTable.write."""
    size, merge, overwrite = (named(options, n) for n in ("cubeSize", "mergeSchema", "overwriteSchema"))
    app, number = named(options, "txnAppId"), named(options, "txnVersion")
    if (app is None) != (number is None):
        raise AnalysisError("txnAppId and txnVersion go together")
    return {
        "columns": named(options, "columnsToIndex"), "cube_size": int(size) if size else None, "column_stats": named(options, "columnStats"), "merge_schema": merge is not None and merge.lower() == "true",
        "overwrite_schema": overwrite is not None and overwrite.lower() == "true", "txn": (app, int(number)) if app else None, "user_metadata": named(options, "userMetadata"), "options": options,
    }


def ours(x) -> bool:
    return getattr(x, "_otree_format", "").lower() == FORMAT


def wrap() -> None:
    @wrapper(SparkSession, "sql")
    def sql(old, self, query, args=None, **kwargs):
        catalog = _CATALOGS.get(self)
        if catalog is None or args or kwargs:
            return old(self, query, args, **kwargs)
        try:
            plan = parsed(self, query)
        except ParseException:  # a script, or an error that Spark tells itself
            return old(self, query)
        if kind(plan) == "ShowTables":
            return old(self, query) if plan.pattern().isDefined() or not kind(plan.namespace()).startswith("CurrentNamespace") else catalog.sql(query).union(old(self, query))
        made = catalog.sql(query) if concerns(catalog, plan) else old(self, query)
        return push_samples(made) if re.search("TABLESAMPLE", query, re.I) else made

    @wrapper(SparkSession, "table")
    def session_table(old, self, name):
        catalog = _CATALOGS.get(self)
        return catalog.table(name).frame() if catalog is not None and catalog.exists(name) else old(self, name)

    @wrapper(ClassicFrame, "sample")
    def sample(old, self, *args, **kwargs):
        made = old(self, *args, **kwargs)
        return push_samples(made) if self.sparkSession in _CATALOGS else made

    for owner in (DataFrameReader, DataFrameWriter):

        @wrapper(owner, "format")
        def format_(old, self, source):
            self._otree_format = source
            return self if source.lower() == FORMAT else old(self, source)

        @wrapper(owner, "option")
        def option(old, self, key, value):
            self.__dict__.setdefault("_otree_options", {})[key] = value
            return old(self, key, value)

        @wrapper(owner, "options")
        def options(old, self, **given):
            self.__dict__.setdefault("_otree_options", {}).update(given)
            return old(self, **given)

    @wrapper(DataFrameReader, "load")
    def load(old, self, path=None, format=None, schema=None, **given):
        if format is not None:
            self.format(format)
        if not ours(self):
            return old(self, path, None, schema, **given)
        options = {**getattr(self, "_otree_options", {}), **given}
        path = path or named(options, "path")
        if not isinstance(path, str):
            raise AnalysisError("a path is needed")
        return read(self._spark, path, options)

    @wrapper(DataFrameReader, "table")
    def reader_table(old, self, name):
        catalog = _CATALOGS.get(self._spark)
        return read(self._spark, catalog.table(name).path, getattr(self, "_otree_options", {})) if catalog is not None and catalog.exists(name) else old(self, name)

    @wrapper(DataFrameWriter, "mode")
    def mode(old, self, how):
        self._otree_mode = how
        return old(self, how)

    @wrapper(DataFrameWriter, "partitionBy")
    def partition_by(old, self, *cols):
        self._otree_partitions = cols
        return old(self, *cols)

    def prepared(writer, format_, mode_, partitions, given: dict) -> dict | None:
        """The options of a write in our format, or None if it is none."""
        if format_ is not None:
            writer.format(format_)
        if mode_ is not None:
            writer.mode(mode_)
        if not ours(writer):
            return None
        if partitions or getattr(writer, "_otree_partitions", ()):
            raise AnalysisError("tables are clustered by their index and cannot be partitioned")
        return {**getattr(writer, "_otree_options", {}), **given}

    @wrapper(DataFrameWriter, "save")
    def save(old, self, path=None, format=None, mode=None, partitionBy=None, **given):  # noqa: N803
        found = prepared(self, format, mode, partitionBy, given)
        if found is None:
            return old(self, path, None, None, partitionBy, **given)
        path = path or named(found, "path")
        if not path:
            raise AnalysisError("a path is needed")
        OTreeTable(self._spark, path).write(self._df, getattr(self, "_otree_mode", None) or "error", **write_options(found))

    @wrapper(DataFrameWriter, "saveAsTable")
    def save_as_table(old, self, name, format=None, mode=None, partitionBy=None, **given):  # noqa: N803
        catalog = _CATALOGS.get(self._spark)
        found = prepared(self, format, mode, partitionBy, given)
        if found is None or catalog is None:
            return old(self, name, None, None, partitionBy, **given)
        how = (getattr(self, "_otree_mode", None) or "error").lower()
        there = catalog.exists(name)
        if there and how == "append":
            catalog.table(name).write(self._df, "append", **write_options(found))
        elif there and how == "ignore":
            return None
        else:
            wanted = write_options(found)
            wanted.pop("overwrite_schema")
            catalog.create_as(name, self._df, "create_or_replace" if how == "overwrite" else "create", named(found, "path"), **wanted)
        return None

    @wrapper(DataFrameWriter, "insertInto")
    def insert_into(old, self, tableName, overwrite=None):  # noqa: N803
        catalog = _CATALOGS.get(self._spark)
        if catalog is None or not catalog.exists(tableName):
            return old(self, tableName, overwrite)
        replaces = overwrite if overwrite is not None else getattr(self, "_otree_mode", "") == "overwrite"
        return (catalog.insert_overwrite if replaces else catalog.insert_into)(tableName, self._df)
