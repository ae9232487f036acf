"""Tables by name: definition, insertion, alteration, and SQL over them.

A catalog is a folder. A managed table lies in it under its name; the entry of an external one holds its location.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import AnalysisError
from .operators.writer import nullable
from .plans import statements as st
from .sources.log import Store
from .table import OTreeTable, read_compatible

_PART = r"[A-Za-z_][A-Za-z_0-9]*"
#: A table's name, or a namespace's and a table's.
_NAME = re.compile(rf"(?:({_PART})\.)?{_PART}")


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.store = Store(spark, root)

    # -- entries ----------------------------------------------------------------------------------------------------

    def _entry(self, name: str) -> dict | None:
        file = f"_catalog/{name.lower()}.json"
        return json.loads(self.store.read(file)) if self.store.exists(file) else None

    def _enter(self, name: str, location: str | None) -> str:
        match = _NAME.fullmatch(name)
        if not match:
            raise AnalysisError(f"{name} is no table name")
        if match[1] and match[1].lower() not in self.namespaces():
            raise AnalysisError(f"there is no namespace {match[1]}")
        path = location or f"{self.store.root}/{name.lower()}"
        self.store.create(f"_catalog/{name.lower()}.json", json.dumps({"location": path, "external": location is not None}), overwrite=True)
        return path

    def exists(self, name: str) -> bool:
        return self._entry(name) is not None

    def table(self, name: str) -> OTreeTable:
        """By name, or by absolute path."""
        if name.startswith("/") or re.match(r"[a-z][a-z0-9+.-]*:/", name):
            return OTreeTable.for_path(self.spark, name)
        entry = self._entry(name)
        if entry is None:
            raise AnalysisError(f"there is no table {name}")
        return OTreeTable.for_path(self.spark, entry["location"])

    def tables(self, namespace: str | None = None) -> list[str]:
        """Names of all tables, those in namespaces with theirs; or of those in one."""
        found = sorted(n.removesuffix(".json") for n, *_ in self.store.list("_catalog") if n.endswith(".json"))
        return found if namespace is None else [n.partition(".")[2] for n in found if n.startswith(f"{namespace.lower()}.")]

    # -- namespaces -------------------------------------------------------------------------------------------------

    def namespaces(self) -> list[str]:
        return sorted(n.removesuffix(".json") for n, *_ in self.store.list("_namespaces") if n.endswith(".json"))

    def create_namespace(self, name: str, properties: dict | None = None, if_not_exists: bool = False) -> None:
        if not re.fullmatch(_PART, name) or name.lower() == st.FORMAT:
            raise AnalysisError(f"{name} is no namespace's name")
        if name.lower() in self.namespaces():
            if if_not_exists:
                return
            raise AnalysisError(f"namespace {name} already exists")
        self.store.create(f"_namespaces/{name.lower()}.json", json.dumps({k: str(v) for k, v in (properties or {}).items()}))

    def namespace_properties(self, name: str) -> dict[str, str]:
        if name.lower() not in self.namespaces():
            raise AnalysisError(f"there is no namespace {name}")
        return json.loads(self.store.read(f"_namespaces/{name.lower()}.json"))

    def alter_namespace(self, name: str, set_: dict | None = None, unset: list[str] | None = None) -> None:
        held = {k: v for k, v in self.namespace_properties(name).items() if k not in (unset or ())} | {k: str(v) for k, v in (set_ or {}).items()}
        self.store.create(f"_namespaces/{name.lower()}.json", json.dumps(held), overwrite=True)

    def drop_namespace(self, name: str, if_exists: bool = False, cascade: bool = False) -> None:
        if name.lower() not in self.namespaces():
            if if_exists:
                return
            raise AnalysisError(f"there is no namespace {name}")
        inside = self.tables(name)
        if inside and not cascade:
            raise AnalysisError(f"namespace {name} has tables {inside}")
        for t in inside:
            self.drop(f"{name}.{t}")
        self.store.delete(f"_namespaces/{name.lower()}.json")

    # -- definition -------------------------------------------------------------------------------------------------

    def create(self, name: str, schema: T.StructType | str | None = None, properties: dict | None = None, location: str | None = None, if_not_exists: bool = False, partitioned_by: list[str] | None = None, description: str | None = None) -> OTreeTable:
        """CREATE TABLE. Over a location that holds a table, the schema must be its own or is taken from it; there are no partitions."""
        if partitioned_by:
            raise AnalysisError("tables are clustered by their index and cannot be partitioned")
        if self.exists(name):
            if if_not_exists:
                return self.table(name)
            raise AnalysisError(f"{name} already exists")
        path = location or f"{self.store.root}/{name.lower()}"
        table = OTreeTable.for_path(self.spark, path)
        wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if table.exists():
            held = table.snapshot().schema
            if wanted is not None and not (read_compatible(held, nullable(wanted)) and len(held) == len(wanted)):
                raise AnalysisError(f"the schema is not that of the table at {path}")
        elif wanted is None:
            raise AnalysisError(f"there is no table at {path} to take a schema from")
        else:
            table.create(wanted, properties, description)
        self._enter(name, location)
        return table

    def create_as(self, name: str, df: DataFrame, mode: str = "create", location: str | None = None, **options) -> OTreeTable:
        """CREATE (OR REPLACE) TABLE AS and REPLACE TABLE AS; mode: create, replace (the table must exist) or create_or_replace. Nothing is written where the mode forbids it."""
        there = self.exists(name)
        if mode == "create" and there:
            raise AnalysisError(f"{name} already exists")
        if mode == "replace" and not there:
            raise AnalysisError(f"there is no table {name} to replace")
        if mode not in ("create", "replace", "create_or_replace"):
            raise AnalysisError(f"there is no mode {mode}")
        table = self.table(name) if there else OTreeTable.for_path(self.spark, location or f"{self.store.root}/{name.lower()}")
        table.write(df, "overwrite" if there else "error", overwrite_schema=there, **options)
        if not there:
            self._enter(name, location)
        return table

    def drop(self, name: str, if_exists: bool = False) -> None:
        """An external table's files stay."""
        entry = self._entry(name)
        if entry is None:
            if if_exists:
                return
            raise AnalysisError(f"there is no table {name}")
        self.store.delete(f"_catalog/{name.lower()}.json")
        if not entry["external"]:
            self.store.delete(name.lower())

    def rename(self, name: str, new: str) -> None:
        entry = self._entry(name)
        if entry is None or self.exists(new):
            raise AnalysisError(f"{name} cannot be renamed {new}")
        if not entry["external"]:
            self.store.move(name.lower(), new.lower())
        self._enter(new, entry["location"] if entry["external"] else None)
        self.store.delete(f"_catalog/{name.lower()}.json")

    def set_properties(self, name: str, **properties) -> None:
        self.table(name).update_metadata(set_=properties)

    def unset_properties(self, name: str, *keys: str) -> None:
        self.table(name).update_metadata(unset=list(keys), operation="UNSET TBLPROPERTIES")

    # -- data -------------------------------------------------------------------------------------------------------

    def insert_into(self, name: str, df: DataFrame, by_name: bool = False) -> None:
        self.table(name).insert(df, by_name)

    def insert_overwrite(self, name: str, df: DataFrame, by_name: bool = False) -> None:
        self.table(name).insert(df, by_name, overwrite=True)

    def sql(self, text: str) -> DataFrame:
        """A statement over the catalog's tables and otree.`path`. Spark parses it; what it says of our tables is done here, all else by Spark.

        Queries: each mention of a table is a frame of its own, whose filters choose its files while Spark plans; `t TABLESAMPLE (p PERCENT)` takes the rows with
        weights in the fraction, `t VERSION AS OF n` and `t TIMESTAMP AS OF 'time'` those of a version. Also INSERT INTO and OVERWRITE (by position or BY NAME),
        CREATE TABLE and CREATE, REPLACE TABLE AS with USING otree, DROP and TRUNCATE TABLE, ALTER TABLE ... RENAME TO, ADD COLUMNS, SET and UNSET TBLPROPERTIES,
        SHOW TABLES, SHOW TBLPROPERTIES and DESCRIBE TABLE. Only SHOW TABLES without a namespace lists our tables, and only those."""
        return st.run(self, text)

    def at_time(self, name: str, millis: int) -> int:
        """The newest version of a table that is no younger than a time."""
        found = [h["version"] for h in self.table(name).history() if h["timestamp"] <= millis]
        if not found:
            raise AnalysisError(f"{name} has no version as old as that")
        return max(found)
