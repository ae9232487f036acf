from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from otreelake import AnalysisError, Catalog, CommitConflict, OTreeTable, read_table, write_table
from otreelake.functions.cubes import Cube, containers
from otreelake.functions.weights import from_fraction
from otreelake.operators import index, metrics
from otreelake.operators.columns import select_columns
from otreelake.sources.datasource import register
from otreelake.sources.log import Block, Log
from otreelake.streaming import ingest


def bag(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def rows(spark):
    """20,000 rows with odd values in every column."""
    n = F.col("id")
    return spark.range(20_000).select(
        ((n * 7919) % 20_011).alias("a"), F.when(n % 11 != 0, (n * 31) % 1000).cast("int").alias("b"), F.concat(F.lit("k"), n % 50).alias("s"),
        F.when(n % 13 == 0, F.lit(float("nan"))).otherwise(n / 7).alias("x"), F.timestamp_seconds(n * 3600).alias("t"), F.date_add(F.lit(dt.date(2020, 1, 1)), (n % 400).cast("int")).alias("d"),
        F.array(n, n + 1).alias("list"), F.struct(n.alias("u"), F.lit(None).cast("string").alias("v")).alias("pair"), (n / 3).cast("decimal(12,3)").alias("m"),
    )


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    return write_table(rows, str(tmp_path_factory.mktemp("t") / "one"), columns="a,b", cube_size=1000)


def test_reading_gives_what_was_written(table, rows):
    assert bag(table.scan()) == bag(rows)
    assert sum(f.stats["numRecords"] for f in table.files()) == sum(b.elements for f in table.files() for b in f.blocks) == 20_000
    assert table.scan().schema.simpleString() == rows.schema.simpleString()


def test_tree_invariants(table, rows):
    state = table.snapshot()
    cubes = state.cubes(state.latest)
    for cube, (greatest, _) in cubes.items():
        if cube.depth:
            assert cubes[cube.parent()][0] <= greatest
    for f in table.files():
        for r in table.read_files([f], state.schema).select("a", "b", F.hash("a", "b").alias("w")).collect():
            path = list(containers([min(1.0, max(0.0, x)) for x in state.latest.point([r["a"], r["b"]])]))
            fitting = [b for b in f.blocks if Cube.parse(2, b.cube) in path and b.min_weight <= r["w"] <= b.max_weight]
            assert fitting, r


PREDICATES = ["a < 300", "a BETWEEN 5000 AND 5100 AND b > 500", "b IS NULL", "b IS NOT NULL AND a > 19000", "a IN (3, 4, 19999)", "s = 'k7'", "s >= 'k4' AND a < 4000", "x > 2000", "isnan(x) AND a < 900", "t < TIMESTAMP'1970-02-01 00:00:00'", "d = DATE'2020-03-01'",
              "a = 1 OR b = 2 OR s LIKE 'k1%'", "NOT (a >= 100 OR b < 50)", "m > 6000", "a > 50000", "a * 2 < 100", "pair.u < 10", "1000 > a", "a = 5 AND a = 6"]


@pytest.mark.parametrize("where", PREDICATES)
def test_predicates_lose_nothing(table, rows, where):
    assert bag(table.scan(where)) == bag(rows.where(where))
    assert {f.path for f in table.files(where)} <= {f.path for f in table.files()}


def test_predicates_prune(table):
    everything = len(table.files())
    assert len(table.files("a < 300")) < everything and table.files("a > 50000") == [] and len(table.files("a * 2 < 100")) == everything


def test_samples(table, rows):
    before = set()
    for f in (0.02, 0.1, 0.3, 0.7, 1.0):
        got = set(bag(table.scan(sample=f, columns=["a", "b", "x"])))
        assert got == set(bag(rows.where(F.hash("a", "b") < from_fraction(f)).select("a", "b", "x")))
        assert before <= got
        before = got
        assert abs(len(got) / 20_000 - f) < 0.02
    assert len(table.files(sample=0.02)) < len(table.files())
    parts = [table.scan(sample=p).count() for p in ((0.0, 0.4), (0.4, 1.0))]
    assert sum(parts) == 20_000
    assert table.scan("a < 4000", 0.5).count() == rows.where("a < 4000").where(F.hash("a", "b") < from_fraction(0.5)).count()
    with pytest.raises(ValueError):
        table.scan(sample=1.5)


@pytest.mark.parametrize("columns", ["a", "s", "b,s,x", "t,d", "m,a", "x", "s:histogram,a", "d,b,s,t"])
def test_every_type_can_be_indexed(spark, rows, tmp_path, columns):
    table = write_table(rows, str(tmp_path / "t"), columns=columns, cube_size=2000)
    assert bag(table.scan().select("a", "x")) == bag(rows.select("a", "x"))
    for where in ("s = 'k7'", "t > TIMESTAMP_NTZ'1971-01-01 00:00:00' AND d < DATE'2020-02-01'", "x < 100 OR b IS NULL"):
        assert table.scan(where).count() == rows.where(where).count()
    names = [c.split(":")[0] for c in columns.split(",")]
    assert table.scan(sample=0.2).count() == rows.where(F.hash(*names) < from_fraction(0.2)).count()


def test_constant_null_and_skewed_columns(spark, tmp_path):
    df = spark.range(3000).select(F.lit(5).alias("one"), F.lit(None).cast("double").alias("none"), F.lit(1).cast("bigint").alias("same"))
    table = write_table(df, str(tmp_path / "t"), columns="one,none,same", cube_size=100)
    assert table.scan("one = 5").count() == 3000 and table.scan("one = 6").count() == 0 and table.scan("none IS NULL").count() == 3000
    skewed = spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("j"))
    table = write_table(skewed, str(tmp_path / "u"), columns="k,j", cube_size=200)
    assert table.scan("k = 7").count() == 4000 and bag(table.scan()) == bag(skewed)


def test_append_and_revisions(spark, tmp_path):
    df = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    table = write_table(df, str(tmp_path / "t"), columns="a,b", cube_size=300)
    assert table.revision_ids() == [0, 1]
    table.append(df.where("a > 100"))
    assert table.revision_ids() == [0, 1]
    table.append(df.withColumn("a", F.col("a") + 5000))
    assert table.revision_ids() == [0, 1, 2] and table.revision(2).transformations[0].high == 6999
    table.append(df, cube_size=500)
    assert table.cube_size() == 500 and table.cube_size(1) == 300
    assert table.append(df.limit(0)) is False
    assert table.scan().count() == 2000 + 1899 + 2000 + 2000
    assert table.scan("a BETWEEN 5000 AND 5009").count() == 10
    assert table.snapshot(0).latest.id == 1 and table.snapshot().revision_at(table.revision(1).timestamp).id >= 1
    with pytest.raises(AnalysisError):
        table.append(df, columns="b,a")
    with pytest.raises(AnalysisError):
        table.revision(9)
    table.overwrite(df, columns="b")
    assert table.revision_ids() == [0, 1] and table.indexed_columns() == ["b"] and table.scan().count() == 2000
    assert table.scan(version=0).count() == 2000


def test_column_stats_widen(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("a"))
    table = write_table(df, str(tmp_path / "t"), columns="a", cube_size=30, column_stats='{"a_min": 0, "a_max": 1000}')
    table.append(df.withColumn("a", F.col("a") + 800))
    assert table.revision_ids() == [0, 1]
    with pytest.raises(AnalysisError):
        write_table(df, str(tmp_path / "u"), columns="a", column_stats={"a_min": 5, "a_max": 5})


def test_modes_schema_and_options(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("a"), F.lit("x").alias("s"))
    path = str(tmp_path / "t")
    with pytest.raises(AnalysisError):
        write_table(df, path)
    table = write_table(df, path, columns="a")
    with pytest.raises(AnalysisError):
        write_table(df, path, columns="a")
    assert table.write(df, "ignore") is False
    with pytest.raises(AnalysisError):
        table.append(df.withColumn("n", F.lit(1)))
    with pytest.raises(AnalysisError):
        table.append(df.withColumn("a", F.col("a").cast("string")))
    table.append(df.withColumn("n", F.lit(1)), merge_schema=True)
    assert table.scan("n = 1").count() == 10 and read_table(spark, path, columns=["n"]).count() == 20
    with pytest.raises(AnalysisError):
        table.write(df.withColumn("_cube", F.lit(1)))
    with pytest.raises(AnalysisError):
        OTreeTable.for_path(spark, str(tmp_path / "none")).scan()
    spark.conf.set("spark.otreelake.index.columnsToIndex.auto", "true")
    try:
        assert write_table(df, str(tmp_path / "auto")).indexed_columns() == ["a", "s"]
    finally:
        spark.conf.unset("spark.otreelake.index.columnsToIndex.auto")


def test_commits_conflict_once_and_raise_in_the_end(spark, tmp_path, monkeypatch):
    df = spark.range(50).select(F.col("id").alias("a"))
    table = write_table(df, str(tmp_path / "t"), columns="a", cube_size=20)
    with pytest.raises(CommitConflict):
        table.log.commit(0, [])
    real, lost = Log.commit, []

    def losing(self, version, actions):
        if len(lost) < 1:
            lost.append(version)
            real(self, version, [{"commitInfo": {"operation": "OTHER"}}])
            raise CommitConflict("lost")
        return real(self, version, actions)

    monkeypatch.setattr(Log, "commit", losing)
    assert table.append(df) and table.scan().count() == 100
    monkeypatch.setattr(Log, "commit", lambda self, version, actions: (_ for _ in ()).throw(CommitConflict("lost")))
    files = len(list((tmp_path / "t" / "data").glob("*.parquet")))
    with pytest.raises(CommitConflict):
        table.append(df)
    monkeypatch.setattr(Log, "commit", real)
    assert table.scan().count() == 100 and len(list((tmp_path / "t" / "data").glob("*.parquet"))) == files


def test_log_checkpoints(spark, tmp_path):
    df = spark.range(5).select(F.col("id").alias("a"))
    table = write_table(df, str(tmp_path / "t"), columns="a")
    for version in range(12):
        table.append(df, txn=("app", version))
    assert (tmp_path / "t" / "_log" / f"{10:020d}.checkpoint").exists()
    (tmp_path / "t" / "_log" / f"{3:020d}.json").rename(tmp_path / "gone")
    state = table.snapshot()
    assert state.version == 12 and table.scan().count() == 65 and state.transactions == {"app": 11}
    assert table.append(df, txn=("app", 11)) is False


def test_hooks(spark, tmp_path):
    df = spark.range(5).select(F.col("id").alias("a"))
    table = OTreeTable.for_path(spark, str(tmp_path / "t"))
    options = {"preCommitHook.h": "tests.test_table:hook", "preCommitHook.h.arg": "seen"}
    table.write(df, columns="a", options=options)
    assert table.history()[0]["tags"] == {"h.seen": 1}


def hook(actions, argument):
    return {argument: sum("add" in a for a in actions)}


def test_staging_and_optimizing(spark, rows, tmp_path):
    part = rows.select("a", "b", "x")
    table = write_table(part.where("a % 2 = 0"), str(tmp_path / "t"), columns="a,b", cube_size=1000)
    for k in (1, 3):
        table.stage(part.where(f"a % 4 = {k}"))
    want = bag(part)
    assert bag(table.scan()) == want and len(table.snapshot().files_of(0)) >= 2
    half = table.scan(sample=0.3).count()
    assert half == part.where(F.hash("a", "b") < from_fraction(0.3)).count()
    assert table.optimize(0, 0.3) >= 1 and table.snapshot().files_of(0)
    table.optimize(0)
    assert not table.snapshot().files_of(0) and bag(table.scan()) == want and table.scan(sample=0.3).count() == half
    before = table.blocks().count()
    table.optimize()
    assert table.blocks().count() < before and bag(table.scan()) == want
    last = json.loads((tmp_path / "t" / "_log" / f"{table.snapshot().version:020d}.json").read_text().splitlines()[-1])
    assert last["add"]["dataChange"] is False
    name = table.files()[0].path
    assert table.optimize(files=[name]) == 1 and bag(table.scan()) == want
    for bad in ({"fraction": 0.0}, {"files": ["x"]}, {"revision": 9}):
        with pytest.raises(AnalysisError):
            table.optimize(**bad)


def test_convert(spark, rows, tmp_path):
    path = str(tmp_path / "p")
    rows.select("a", "b").repartition(3).write.parquet(path)
    files = {p: p.stat().st_mtime for p in (tmp_path / "p").glob("*.parquet")}
    table = OTreeTable.convert(spark, f"parquet.`{path}`", "a,b", 900)
    assert bag(table.scan()) == bag(rows.select("a", "b")) and table.revision_ids() == [0]
    assert {p: p.stat().st_mtime for p in (tmp_path / "p").glob("*.parquet")} == files
    with pytest.raises(AnalysisError):
        table.scan(sample=0.1)
    table.optimize(0)
    assert table.indexed_columns() == ["a", "b"] and table.cube_size() == 900 and table.scan("a < 50").count() == rows.where("a < 50").count()
    rows.select("a", "b").limit(10).write.partitionBy("b").parquet(str(tmp_path / "q"))
    for bad in (f"parquet.`{tmp_path}/q`", f"orc.`{path}`", f"parquet.{path}", "x"):
        with pytest.raises(AnalysisError):
            OTreeTable.convert(spark, bad, "a")


def test_metrics(table):
    m = table.metrics()
    assert (m.elements, m.dimensions, m.max_fanout) == (20_000, 2, 4) and m.height >= metrics.least_height(20_000, 1000, 2)
    assert m.files["count"] == len(table.files()) and "Fan-out" in str(m)
    info = table.sampling_info(0.02).first()
    assert info["files_read"] == len(table.files(sample=0.02)) and info["rows"] == 20_000
    tree = json.loads(table.tree_json(0.02))
    assert len(tree["edges"]) == len(tree["nodes"]) - 1
    assert metrics.least_height(309_008, 3000, 2) == 5 and metrics.tabulate([("a", "bb"), ("ccc",)]) == "a    bb\nccc"
    assert 0 < table.tolerance("x", 0.5, "NOT isnan(x)", pilot=0.2) <= 1
    status = metrics.cube_status(table.blocks(), 1000)
    assert status.where("isLeaf AND normalizedWeight < 1 AND maxWeight = 2147483647").where("elementCount <= 1000").count() == 0


def test_roll_up():
    root = Cube(1)
    c0, c1 = root.children()
    c00, c01 = c0.children()
    c10, c11 = c1.children()
    got = index.roll_up({root: 1, c00: 1, c01: 2, c10: 2, c11: 3}, 3)
    assert got == {root: root, c00: c0, c01: c0, c10: root, c11: c11}
    assert index.roll_up({root: 5.0}, 3) == {root: root} and index.roll_up({}, 3) == {}


def test_blocks_reject_unknown_fields():
    good = {"cubeId": "", "minWeight": 1, "maxWeight": 2, "elementCount": 3}
    assert Block.parse(good | {"replicated": True}).json() == good
    with pytest.raises(AnalysisError):
        Block.parse(good | {"more": 1})


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    df = spark.range(100).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("n"), "id").alias("name"))
    c.create_as("t", df, columns="id", cube_size=30)
    with pytest.raises(AnalysisError):
        c.create_as("t", df, columns="id")
    with pytest.raises(AnalysisError):
        c.create_as("missing", df, "replace", columns="id")
    assert not OTreeTable.for_path(spark, str(tmp_path / "c" / "missing")).exists()
    assert c.sql("SELECT count(*) AS n FROM t x WHERE x.id < 10").first()["n"] == 10
    assert c.sql("SELECT t.id FROM t JOIN t u ON t.id = u.id WHERE t.id < 3").count() == 3
    assert c.sql("SELECT * FROM t TABLESAMPLE (30 PERCENT)").count() == df.where(F.hash("id") < from_fraction(0.3)).count()
    assert c.sql(f"SELECT * FROM otree.`{tmp_path}/c/t`").count() == 100
    c.insert_into("t", spark.createDataFrame([(1000.0, 5)], "a double, b int"))
    assert c.table("t").scan("id = 1000").first()["name"] == "5"
    with pytest.raises(AnalysisError):
        c.insert_into("t", df.select("id"))
    spark.conf.set("spark.sql.storeAssignmentPolicy", "STRICT")
    try:
        with pytest.raises(AnalysisError):
            c.insert_into("t", spark.createDataFrame([(1.5, "x")], "a double, b string"))
    finally:
        spark.conf.unset("spark.sql.storeAssignmentPolicy")
    with pytest.raises(AnalysisError):
        c.insert_into("t", spark.createDataFrame([("x", "y")], "a string, b string"))
    c.create("ext", location=str(tmp_path / "c" / "t"))
    with pytest.raises(AnalysisError):
        c.create("ext2", "other int", location=str(tmp_path / "c" / "t"))
    with pytest.raises(AnalysisError):
        c.create("p", "a int", partitioned_by=["a"])
    c.create("e", "a int, b struct<c:int>", {"columnsToIndex": "a"})
    assert c.table("e").scan().count() == 0 and c.table("e").scan().columns == ["a", "b"]
    c.insert_into("e", spark.sql("SELECT 1, named_struct('z', 2)"))
    assert c.table("e").scan().first()["b"]["c"] == 2
    c.drop("ext")
    assert c.table("t").exists() and c.tables() == ["e", "t"]
    c.rename("t", "u")
    assert c.table("u").scan().count() == 101
    c.drop("u")
    c.drop("u", if_exists=True)
    with pytest.raises(AnalysisError):
        c.table("u")


def test_upgrade(spark, tmp_path):
    df = spark.range(300).select(F.concat(F.substring(F.lit("abcdefghij"), (F.col("id") % 10 + 1).cast("int"), F.lit(1)), F.col("id")).alias("s"))
    table = write_table(df, str(tmp_path / "t"), columns="s:histogram", cube_size=50)
    want = bag(df.where("s < 'd'"))
    assert bag(table.scan("s < 'd'")) == want and len(table.files("s < 'd'")) < len(table.files())
    assert table.upgrade() and not table.upgrade()
    assert table.revision().transformers[0].policy == "quantiles" and bag(table.scan("s < 'd'")) == want
    table.append(df)
    assert table.revision_ids() == [0, 1] and table.scan().count() == 600


def test_columns_are_chosen_by_correlation(spark):
    df = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"), F.rand(3).alias("c"), F.lit("same").alias("s"), F.array("id").alias("no"))
    assert select_columns(df, 2) == ["c", "s"] and select_columns(df.limit(0), 2) == ["a", "b"] and select_columns(df, 9) == ["a", "b", "c", "s"]
    with pytest.raises(AnalysisError):
        select_columns(df.select("no"), 1)


def test_python_source(spark, table, rows):
    register(spark)
    df = spark.read.format("otree").load(table.path)
    assert df.where("a < 300").count() == rows.where("a < 300").count() and df.count() == 20_000


@pytest.mark.parametrize("stage", [False, True])
def test_streaming(spark, rows, tmp_path, stage):
    small = rows.select("a", "b")
    small.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds every batch done
        stream = spark.readStream.schema(small.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest(stream, str(tmp_path / "t"), "app", str(tmp_path / f"ck{_}"), columns="a,b", cube_size=5000, stage=stage).awaitTermination()
    assert bag(read_table(spark, str(tmp_path / "t"))) == bag(small)
