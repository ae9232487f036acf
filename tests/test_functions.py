from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from otreelake.errors import AnalysisError
from otreelake.functions import transforms as tf
from otreelake.functions import weights as W
from otreelake.functions.cubes import Cube, CubeTable, cell_column, code_column, containers, max_depth, morton

points = st.integers(1, 4).flatmap(lambda d: st.lists(st.floats(0, 1), min_size=d, max_size=d))


def test_weights():
    assert [W.from_fraction(f) for f in (0.0, 0.1, 0.3, 1.0)] == [W.MIN_WEIGHT, -1717986918, -858993459, W.MAX_WEIGHT]
    assert W.to_fraction(W.MIN_WEIGHT) == 0 and W.to_fraction(W.MAX_WEIGHT) == 1
    assert all(abs(W.to_fraction(W.from_fraction(f)) - f) < 1e-9 for f in (0.01, 0.5, 0.999))


@settings(max_examples=150, deadline=None)
@given(points)
def test_containers(point):
    path = list(containers(point))
    assert path[0] == Cube(len(point)) and len(path) == max_depth(len(point)) + 1
    for outer, inner in zip(path[:12], path[1:12]):
        assert inner.parent() == outer and outer.is_ancestor_of(inner) and inner in outer.children()
        assert inner.contains(point)
        assert Cube.parse(len(point), inner.string()) == inner and Cube.decode(len(point), inner.encode()) == inner
    rest = list(containers(point, path[3]))
    assert rest == path[4:]


def test_cube_algebra():
    root = Cube(2)
    children = list(root.children())
    assert [c.code for c in children] == [0, 1, 2, 3] and children[0] == root.first_child()
    assert children[0].next_sibling() == children[1] and children[3].next_sibling() is None and root.next_sibling() is None
    assert children[1].bounds() == [(0.0, 0.5), (0.5, 1.0)]
    assert not children[1].is_ancestor_of(children[2]) and root.is_ancestor_of(root)
    assert children[3].contains([1.0, 1.0]) and not children[0].contains([0.5, 0.1])
    assert root.string() == "" and Cube.parse(7, Cube(7, 2, 9999).string()) == Cube(7, 2, 9999)
    tree = [root, *children, *children[1].children()]
    assert sorted(tree, key=Cube.order_key) == [root, children[0], children[1], *children[1].children(), children[2], children[3]]


def test_codes_in_spark(spark):
    rng = random.Random(1)
    rows = [(rng.random(), rng.random(), rng.random()) for _ in range(200)] + [(0.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = df.select("a", "b", "c", code_column([cell_column(F.col(x), 7) for x in "abc"], 7).alias("code")).collect()
    for r in got:
        assert r["code"] == morton([min(int(x * 128), 127) for x in (r["a"], r["b"], r["c"])], 7)


def test_assign_takes_the_first_cube_that_accepts():
    root = Cube(1)
    low, high = root.children()
    table = CubeTable(1, {root: 10, low: 50, high: W.MAX_WEIGHT})
    codes = np.array([0, 0, 0, 3, 3])
    got = table.assign(codes, 2, np.array([5, 20, 90, 10, 99]))
    assert [table.cubes[k] for k in got] == [root, low, low, root, high]


KINDS = [("int", [3, -7, 12, None]), ("bigint", [10**12, 5, None]), ("double", [0.5, -2.25, None]), ("float", [0.5, 1.5]), ("smallint", [1, 9]), ("decimal(10,2)", ["1.25", "-3.50"]), ("date", [dt.date(2020, 1, 5), dt.date(1969, 3, 1), None]),
         ("timestamp", [dt.datetime(2021, 5, 1, 10, 0, 1, 5), dt.datetime(1950, 1, 1)]), ("timestamp_ntz", [dt.datetime(2021, 5, 1, 10, 0, 1, 5), dt.datetime(1950, 1, 1, 23, 59, 59, 999999)])]


@pytest.mark.parametrize(("kind", "values"), KINDS)
def test_linear_on_rows_and_literals(spark, kind, values):
    df = spark.createDataFrame([(None if v is None else str(v),) for v in values], "t string").select(F.col("t").cast(kind).alias("x"))
    (t,) = tf.parse_columns("x", df.schema)
    mapping = t.transformation(df.agg(*t.statistics()).first().asDict())
    got = [r["p"] for r in df.select(mapping.column(F.col("x")).alias("p")).collect()]
    want = [mapping.point(None if v is None else float(v) if kind.startswith("decimal") else v) for v in values]
    assert got == pytest.approx(want, abs=1e-9) and all(0 <= p <= 1 for p in got)


@pytest.mark.parametrize("mapping", [tf.Quantiles((1.0, 2.0, 4.0, 8.0), "double"), tf.Quantiles(("b", "d", "m"), "string"), tf.Hash(), tf.Hash(kind="bigint"), tf.Identity(3.0), tf.Empty()])
def test_other_mappings_on_rows_and_literals(spark, mapping):
    values = [None, "a", "b", "c", "m", "zz"] if mapping.kind == "string" else [None, 0, 1, 2, 3, 8, 9]
    kind = "string" if mapping.kind == "string" else "bigint"
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    got = [r["p"] for r in df.select(mapping.column(F.col("x")).alias("p")).collect()]
    if not isinstance(mapping, tf.Identity):
        assert got == pytest.approx([mapping.point(v, spark) for v in values])
    assert all(0 <= p <= 1 for p in got)
    assert tf.from_json(tf.to_json(mapping)) == mapping
    if isinstance(mapping, tf.Quantiles):
        assert got[1:] == sorted(got[1:])


def test_supersede_and_merge():
    narrow, wide, point, hashed, empty = tf.linear(0, 10, "int"), tf.linear(-5, 20, "int"), tf.Identity(15.0, "int"), tf.Hash(), tf.Empty()
    assert narrow.superseded_by(wide) and not wide.superseded_by(narrow)
    assert narrow.superseded_by(point) and not wide.superseded_by(point)
    assert narrow.merge(point).high == 15 and narrow.merge(wide).low == -5 and narrow.merge(wide).null_value == narrow.null_value
    assert point.superseded_by(tf.Identity(16.0)) and not point.superseded_by(tf.Identity(None))
    merged = point.merge(tf.Identity(16.0, "int"))
    assert (merged.low, merged.high) == (15, 16)
    assert not hashed.superseded_by(tf.Hash()) and hashed.superseded_by(wide)
    assert empty.superseded_by(hashed) and not hashed.superseded_by(empty) and hashed.merge(empty) == hashed and empty.merge(hashed) == hashed
    a, b = tf.Quantiles((1.0, 2.0), "double"), tf.Quantiles((1.0, 3.0), "double")
    assert a.superseded_by(b) and not a.superseded_by(a) and a.merge(b) == b


def test_specs_and_errors(spark):
    schema = spark.createDataFrame([], "a int, s string, b boolean, d double").schema
    assert [(t.name, t.policy) for t in tf.parse_columns("a,s,d:QUANTILES", schema)] == [("a", "linear"), ("s", "hashing"), ("d", "quantiles")]
    for bad in ("x", "b", "a:nothing", "s:linear", "a:histogram"):
        with pytest.raises(AnalysisError):
            tf.parse_columns(bad, schema)
    for bad in ("{", '{"a_min": null}'):
        with pytest.raises(AnalysisError):
            tf.parse_stats(bad)
    with pytest.raises(AnalysisError):
        tf.Quantiles((2.0, 1.0), "double")
    with pytest.raises(AnalysisError):
        tf.linear(1, 1, "int")
    (t,) = tf.parse_columns("d:quantiles", schema)
    with pytest.raises(AnalysisError):
        t.transformation({})
    (t,) = tf.parse_columns("s:histogram", schema)
    assert t.transformation({}).quantiles == tf.DEFAULT_HISTOGRAM


def test_compute_quantiles(spark):
    df = spark.range(101).select(F.col("id").alias("n"), F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("s"))
    assert tf.compute_quantiles(df, "n", 4, 0.0) == [0, 25, 50, 75, 100]
    strings = tf.compute_quantiles(df, "s", 5)
    assert strings == sorted(strings) and strings[0] == "k000" and len(strings) == 5
    assert tf.compute_histogram(df.union(df), "s", 5)[0] == "k000"
    with pytest.raises(AnalysisError):
        tf.compute_quantiles(df.select(F.current_date().alias("d")), "d")


def test_hash_of_literals_is_sparks(spark):
    rng = random.Random(6)
    made = {
        "string": ["", "a", "ab", "abc", "abcd", "ünïcödé", "x" * 37, "🙂"], "int": [0, 1, -1, 2**31 - 1, -(2**31)], "smallint": [5, -5], "tinyint": [7, -128], "bigint": [0, 1 << 60, -(1 << 60), -1],
        "double": [0.0, -0.0, 1.5, -2.25e300], "float": [0.0, 1.5, -2.25], "date": [dt.date(1970, 1, 1), dt.date(2024, 2, 29), dt.date(1900, 1, 1)],
    }
    made["string"] += ["".join(rng.choices("abc é🙂", k=rng.randrange(30))) for _ in range(30)]
    for kind, values in made.items():
        df = spark.createDataFrame([(v,) for v in values], f"v {kind}").select(F.hash("v").alias("h"), tf.Hash(kind=kind).column(F.col("v")).alias("x"))
        assert [(r["h"], r["x"]) for r in df.collect()] == [(W.hash_of(v, kind), tf.Hash(kind=kind).point(v)) for v in values], kind


def test_exact_quantiles_are_those_of_the_sorted_numbers(spark):
    """Negative, equal, infinite and tiny numbers, nulls and NaN, over several partitions."""
    n = F.col("id")
    odd = F.when(n % 17 == 0, None).when(n % 17 == 1, F.lit(float("-inf"))).when(n % 17 == 2, F.lit(-0.0)).when(n % 17 == 3, F.lit(5e-324)).when(n % 17 == 4, F.lit(float("nan"))).otherwise(((n * 7919) % 1009 - 500) / 7)
    df = spark.range(0, 5000, 1, 5).select(odd.alias("x"))
    known = sorted(r["x"] for r in df.collect() if r["x"] is not None and r["x"] == r["x"])
    shares = [0.0, 0.03, 0.25, 0.5, 0.501, 0.75, 1.0]
    found = tf.exact_quantiles(df.where("NOT isnan(x)"), "x", shares)
    assert found == [known[max(1, math.ceil(p * len(known))) - 1] for p in shares]
    assert math.isnan(tf.exact_quantiles(df, "x", [1.0])[0]) and tf.exact_quantiles(df.limit(0), "x", shares) == []
