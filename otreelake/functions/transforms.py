"""Mappings of column values to [0, 1].

A transformer is a column's policy (which statistics it needs, how a mapping is made of them); a transformation is one frozen mapping, as a Column
expression for rows and as a function for the literals of predicates. Transformations know whether another supersedes them and how to merge.
"""

from __future__ import annotations

import bisect
import datetime as dt
import json
import math
import random
import re
from dataclasses import asdict, dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError
from .weights import HASHED, hash_of

NUMERIC = ("double", "int", "bigint", "float", "smallint", "tinyint")
ORDERED = (*NUMERIC, "decimal", "timestamp", "timestamp_ntz", "date")


def type_name(data_type: T.DataType) -> str:
    """The name of an indexable type; an error for any other."""
    name = data_type.simpleString()
    name = "decimal" if name.startswith("decimal") else name
    if name not in ORDERED and name != "string":
        raise AnalysisError(f"{name} is not supported.")
    return name


def number_column(column: Column, kind: str) -> Column:
    """Values of an ordered type as doubles: dates and timestamps in microseconds of their own calendar."""
    if kind == "date":
        return F.unix_date(column).cast("double") * 86_400_000_000.0
    if kind == "timestamp":
        return F.unix_micros(column).cast("double")
    if kind == "timestamp_ntz":
        seconds = (F.hour(column) * 3600 + F.minute(column) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("long")
        return (F.unix_date(column.cast("date")).cast("long") * 86_400_000_000 + seconds).cast("double")
    return column.cast("double")


def number(value: object, kind: str, zone: dt.tzinfo = dt.timezone.utc) -> float:
    """The same for a literal."""
    if isinstance(value, str):
        value = dt.date.fromisoformat(value) if kind == "date" else dt.datetime.fromisoformat(value.replace("Z", "+00:00")) if kind.startswith("timestamp") else float(value)
    if isinstance(value, dt.datetime):
        if kind == "timestamp_ntz":
            value = value.replace(tzinfo=None)
        elif value.tzinfo is None:
            value = value.replace(tzinfo=zone)
        epoch = dt.datetime(1970, 1, 1, tzinfo=value.tzinfo and dt.timezone.utc)
        return float((value - epoch) // dt.timedelta(microseconds=1))
    if isinstance(value, dt.date):
        return (value - dt.date(1970, 1, 1)).days * 86_400_000_000.0
    return float(value)


@dataclass(frozen=True)
class Empty:
    """All rows at 0; what files that are not indexed have."""

    kind: str = "string"

    def column(self, c: Column) -> Column:
        return F.lit(0.0)

    def point(self, value: object, spark: SparkSession | None = None) -> float:
        return 0.0

    def superseded_by(self, new: Transformation) -> bool:
        return not isinstance(new, Empty)

    def merge(self, new: Transformation) -> Transformation:
        return new


@dataclass(frozen=True)
class Identity:
    """A column with a single value, or none but nulls."""

    value: float | None
    kind: str = "double"

    def column(self, c: Column) -> Column:
        return F.lit(0.0)

    def point(self, value: object, spark: SparkSession | None = None) -> float:
        return 0.0 if value is None or self.value is None else float(number(value, self.kind) - self.value)

    def superseded_by(self, new: Transformation) -> bool:
        if isinstance(new, Identity):
            return new.value is not None and new.value != self.value
        return not isinstance(new, Empty)

    def merge(self, new: Transformation) -> Transformation:
        if isinstance(new, Identity) and None not in (self.value, new.value) and self.value != new.value:
            return linear(min(self.value, new.value), max(self.value, new.value), self.kind)
        if isinstance(new, Linear) and self.value is not None:
            return new.widened(self.value, self.value)
        return self if isinstance(new, Empty) else new


@dataclass(frozen=True)
class Linear:
    """(value - low) / (high - low); null is a value of its own, kept with the mapping."""

    low: float
    high: float
    null_value: float
    kind: str

    def column(self, c: Column) -> Column:
        return (F.coalesce(number_column(c, self.kind), F.lit(self.null_value)) - F.lit(self.low)) / F.lit(self.high - self.low)

    def point(self, value: object, spark: SparkSession | None = None) -> float:
        """Not clamped: bounds of a query may lie outside."""
        return ((self.null_value if value is None else number(value, self.kind)) - self.low) / (self.high - self.low)

    def superseded_by(self, new: Transformation) -> bool:
        if isinstance(new, Linear):
            return new.low < self.low or new.high > self.high
        if isinstance(new, Identity):
            return new.value is not None and not self.low <= new.value <= self.high
        return not isinstance(new, Empty)

    def widened(self, low: float, high: float) -> Linear:
        return linear(min(self.low, low), max(self.high, high), self.kind, self.null_value)

    def merge(self, new: Transformation) -> Transformation:
        if isinstance(new, Linear):
            return self.widened(new.low, new.high)
        if isinstance(new, Identity):
            return self if new.value is None else self.widened(new.value, new.value)
        return self if isinstance(new, Empty) else new


def linear(low: float, high: float, kind: str, null_value: float | None = None) -> Linear:
    """A null's place is drawn from [low, high) by the bounds themselves, so equal bounds give equal mappings."""
    if not high > low:
        raise AnalysisError(f"the range must have low < high, not {low} and {high}")
    return Linear(low, high, random.Random(f"{low}:{high}").uniform(low, high) if null_value is None else null_value, kind)


@dataclass(frozen=True)
class Hash:
    """31 bits of the value's hash; only equality finds a place."""

    null_value: int = 42
    kind: str = "string"

    def column(self, c: Column) -> Column:
        return F.when(c.isNull(), F.lit(self.null_value)).otherwise(F.hash(c)).bitwiseAND(0x7FFFFFFF).cast("double") / 2147483647.0

    def point(self, value: object, spark: SparkSession | None = None) -> float:
        if value is None:
            return float(self.null_value & 0x7FFFFFFF) / 2147483647.0
        if self.kind in HASHED:
            return float(hash_of(value, self.kind) & 0x7FFFFFFF) / 2147483647.0
        spark = spark or SparkSession.active()
        typed = F.lit(value).cast(self.kind if self.kind != "decimal" else "double")
        return spark.range(1).select(self.column(typed)).first()[0]

    def superseded_by(self, new: Transformation) -> bool:
        return not isinstance(new, Hash | Empty)

    def merge(self, new: Transformation) -> Transformation:
        return self if isinstance(new, Hash | Empty) else new


@dataclass(frozen=True)
class Quantiles:
    """The place among sorted quantiles: of numbers with linear interpolation, of strings the interval's index."""

    quantiles: tuple
    kind: str

    def __post_init__(self) -> None:
        if len(self.quantiles) < 2 or list(self.quantiles) != sorted(self.quantiles):
            raise AnalysisError("quantiles must be two or more sorted values")

    def column(self, c: Column) -> Column:
        last = len(self.quantiles) - 1
        if self.kind == "string":
            listed = F.lit(list(self.quantiles)).cast("array<string>")
            return F.when(c.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (F.size(F.filter(listed, lambda q: q <= c)) - 1) / F.lit(float(last))))
        x = number_column(c, self.kind)
        listed = F.lit(list(self.quantiles)).cast("array<double>")
        at = F.size(F.filter(listed, lambda q: q <= x))
        low, high = F.element_at(listed, F.greatest(at, F.lit(1))), F.element_at(listed, F.least(at + 1, F.lit(last + 1)))
        inside = (at - 1 + F.when(high > low, (x - low) / (high - low)).otherwise(0.0)) / float(last)
        return F.when(x.isNull() | (at == 0), F.lit(0.0)).when(at > last, F.lit(1.0)).otherwise(inside)

    def point(self, value: object, spark: SparkSession | None = None) -> float:
        last = len(self.quantiles) - 1
        if value is None:
            return 0.0
        if self.kind == "string":
            return max(0.0, (bisect.bisect_right(self.quantiles, str(value)) - 1) / last)
        x = number(value, self.kind)
        at = bisect.bisect_right(self.quantiles, x)
        if at == 0 or at > last:
            return 0.0 if at == 0 else 1.0
        low, high = self.quantiles[at - 1], self.quantiles[at]
        return (at - 1 + (x - low) / (high - low)) / last

    def superseded_by(self, new: Transformation) -> bool:
        return not isinstance(new, Empty) and new != self

    def merge(self, new: Transformation) -> Transformation:
        return self if isinstance(new, Empty) else new


Transformation = Empty | Identity | Linear | Hash | Quantiles
_CLASSES = {c.__name__: c for c in (Empty, Identity, Linear, Hash, Quantiles)}


def to_json(t: Transformation) -> dict:
    return {"className": type(t).__name__, **asdict(t)}


def from_json(data: dict) -> Transformation:
    """Also reads two names of earlier mappings that sent everything, or nulls, to 0."""
    data = dict(data)
    name = data.pop("className")
    if name in ("IdentityToZero", "NullToZero"):
        return Identity(data.get("value"), data.get("kind", "double"))
    if name == "Quantiles":
        data["quantiles"] = tuple(data["quantiles"])
    return _CLASSES[name](**data)


#: Bins of a string histogram when none are given.
DEFAULT_HISTOGRAM = tuple("abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Transformer:
    """A column to index: its name, its policy and its type."""

    name: str
    policy: str
    kind: str

    def statistics(self) -> list[Column]:
        """What the policy needs of the data; NaN is no bound."""
        if self.policy != "linear":
            return []
        x = number_column(F.col(f"`{self.name}`"), self.kind)
        x = F.when(~F.isnan(x), x)
        return [F.min(x).alias(f"{self.name}_min"), F.max(x).alias(f"{self.name}_max")]

    def transformation(self, stats: dict) -> Transformation:
        if self.policy == "hashing":
            return Hash(kind=self.kind)
        if self.policy in ("quantiles", "histogram"):
            values = stats.get(f"{self.name}_{self.policy}")
            if values is None and self.policy == "histogram":
                values = DEFAULT_HISTOGRAM
            if values is None:
                raise AnalysisError(f"quantiles of {self.name} are needed: give {self.name}_quantiles in column_stats")
            if (self.kind == "string") != isinstance(values[0], str):
                raise AnalysisError(f"quantiles of {self.name} do not fit its type {self.kind}")
            return Quantiles(tuple(values if self.kind == "string" else [number(v, self.kind) for v in values]), self.kind)
        low, high = (None if (v := stats.get(f"{self.name}_{end}")) is None else number(v, self.kind) for end in ("min", "max"))
        if low is None or high is None or low == high:
            return Identity(high if low is None else low, self.kind)
        return linear(low, high, self.kind)

    def update(self, current: Transformation, stats: dict) -> Transformation | None:
        """The merged mapping if the data's supersedes the current one, else None."""
        new = self.transformation(stats)
        return current.merge(new) if current.superseded_by(new) else None


POLICIES = ("linear", "hashing", "quantiles", "histogram")
_SPEC = re.compile(r"([^:]+):([A-Za-z]+)")


def parse_columns(specs: str | list[str], schema: T.StructType) -> list[Transformer]:
    """Transformers of `a,b:hashing`; without a policy, strings are hashed and ordered types linear."""
    out = []
    for spec in specs.split(",") if isinstance(specs, str) else specs:
        match = _SPEC.fullmatch(spec.strip())
        name, policy = (match[1], match[2].lower()) if match else (spec.strip(), None)
        if name not in schema.names:
            raise AnalysisError(f"column {name} does not exist")
        kind = type_name(schema[name].dataType)
        policy = policy or ("hashing" if kind == "string" else "linear")
        if policy not in POLICIES:
            raise AnalysisError(f"there is no transformer called {policy}")
        if policy == "histogram" and kind != "string" or policy == "linear" and kind == "string":
            raise AnalysisError(f"{policy} does not fit {name}, which is {kind}")
        out.append(Transformer(name, policy, kind))
    return out


def parse_stats(text: str | dict | None) -> dict:
    """column_stats: `<column>_min`, `_max`, `_quantiles` and `_histogram` by name."""
    if text is None:
        return {}
    try:
        stats = json.loads(text) if isinstance(text, str) else dict(text)
    except ValueError as e:
        raise AnalysisError(f"column_stats is no valid JSON: {e}") from None
    if not isinstance(stats, dict) or stats and all(v is None for v in stats.values()):
        raise AnalysisError("column_stats holds no value")
    return {k: float(v) if isinstance(v, Decimal) else v for k, v in stats.items()}


def compute_quantiles(df: DataFrame, column: str, n: int = 50, relative_error: float = 0.1) -> list:
    """n + 1 quantiles of a number column, or the least string of each of n range partitions."""
    kind = type_name(df.schema[column].dataType)
    if kind in (*NUMERIC, "decimal"):
        numbers, shares = df.select(F.col(column).cast("double").alias("c")).where("c IS NOT NULL AND NOT isnan(c)"), [k / n for k in range(n + 1)]
        found = numbers.approxQuantile("c", shares, relative_error) if relative_error else exact_quantiles(numbers, "c", shares)
        return sorted(set(found)) if len(set(found)) > 1 else found
    if kind != "string":
        raise AnalysisError(f"quantiles of {kind} are not supported")
    parts = df.where(F.col(column).isNotNull()).select(F.col(column).alias("c")).repartitionByRange(n, "c")
    return [r["low"] for r in parts.groupBy(F.spark_partition_id()).agg(F.min("c").alias("low")).orderBy("low").collect()]


#: Bits of a number that one pass of exact_quantiles tells apart.
DIGIT = 16


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """The least values of a number column that have at least these shares of its rows at or below them; NaN is above all, nulls do not count.

    Four passes, each of which counts the next 16 bits of the numbers that begin like one of those sought: nothing is shuffled or kept but counts, 65,536 for each share at most."""
    numbers = df.select(F.col(f"`{column}`").cast("double").alias("c"))
    prefixes, ranks = np.zeros(1, np.uint64), None
    at = np.zeros(len(shares), np.int64)  # which of the prefixes is each share's
    for shift in range(64 - DIGIT, -1, -DIGIT):
        found = numbers.mapInArrow(digit_counts(prefixes, shift), "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(prefixes) << DIGIT, np.int64)
        counts[found["bin"].to_numpy()] = found["n"].to_numpy()
        upto = counts.reshape(len(prefixes), -1).cumsum(1)
        if ranks is None:
            if not upto[0, -1]:
                return []
            ranks = [max(1, math.ceil(p * int(upto[0, -1]))) for p in shares]
        keys = []
        for k, rank in enumerate(ranks):
            own = upto[at[k]]
            digit = int(np.searchsorted(own, rank))
            ranks[k] = rank - (int(own[digit - 1]) if digit else 0)
            keys.append(int(prefixes[at[k]]) << DIGIT | digit)
        prefixes, at = np.unique(np.array(keys, np.uint64), return_inverse=True)
    bits = np.array([int(prefixes[k]) for k in at], np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, bits ^ top, ~bits).view(np.float64).tolist()


def digit_counts(prefixes: np.ndarray, shift: int):
    """For mapInArrow: of the numbers whose bits above the digit at shift are one of the sorted prefixes, how many have each digit. Bits are turned so that they sort as the numbers do."""

    def counted(batches):
        total = np.zeros(len(prefixes) << DIGIT, np.int64)
        top = np.uint64(1 << 63)
        for batch in batches:
            x = batch.column(0).drop_null().to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
            x[np.isnan(x)] = np.nan  # one NaN for all
            bits = x.view(np.uint64)
            bits = np.where(bits & top, ~bits, bits ^ top)
            place = np.zeros(len(bits), np.int64)
            if shift + DIGIT < 64:
                above = bits >> np.uint64(shift + DIGIT)
                place = np.minimum(np.searchsorted(prefixes, above), len(prefixes) - 1)
                known = prefixes[place] == above
                bits, place = bits[known], place[known]
            digit = (bits >> np.uint64(shift) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
            total += np.bincount(place << DIGIT | digit, minlength=len(total))
        (bins,) = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(bins, pa.int64()), "n": pa.array(total[bins], pa.int64())})

    return counted


def compute_histogram(df: DataFrame, column: str, n: int = 50) -> list[str]:
    """The same over the distinct strings."""
    return compute_quantiles(df.select(column).distinct(), column, n)
