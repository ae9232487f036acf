from __future__ import annotations

import datetime as dt
import json
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import ParseException
from pyspark.sql import functions as F

import otreelake
from otreelake import AnalysisError, Catalog, OTreeTable, visualize
from otreelake.functions.weights import from_fraction
from otreelake.plans.catalyst import items
from otreelake.plans.statements import mentions, parsed
from otreelake.sources.log import Log
from otreelake.sources.relation import index_of


def files_read(df):
    """Files read and files there are, for each scan of our tables in df."""
    found = [i for leaf in items(df._jdf.queryExecution().analyzed().collectLeaves()) if (i := index_of(leaf)) is not None]
    for i in found:
        i.asked.clear()
    df.count()
    return [a for i in {id(i): i for i in found}.values() for a in i.asked]


TEXTS = ["plain", "it's", 'say "x"', "a\tb", "back\\slash", "-- no comment", "/* nor this */", "foo AND k = 5 AND bar", "100%", "", "ünï", "new\nline"]


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    texts = F.array(*map(F.lit, TEXTS))
    return spark.range(3000).select(
        n.alias("k"), (n + (1 << 60)).alias("far"), F.when(n % 9 != 0, F.element_at(texts, (n % len(TEXTS) + 1).cast("int"))).alias("s"), (n / 7).cast("decimal(20,6)").alias("m"),
        F.timestamp_seconds(n * 3600 + 0.25).alias("t"), F.date_add(F.lit(dt.date(2020, 1, 1)), (n % 400).cast("int")).alias("d"), F.when(n % 5 == 0, F.lit(float("nan"))).otherwise(n / 3).alias("x"),
    )


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    return otreelake.write_table(rows, str(tmp_path_factory.mktemp("t") / "one"), columns="k,s,far", cube_size=150)


def quoted(text):
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


COMPARE = st.sampled_from(["<", "<=", "=", ">", ">=", "<=>"])
ATOMS = st.one_of(
    st.builds(lambda o, v: f"k {o} {v}", COMPARE, st.integers(-10, 3100)),
    st.builds(lambda o, v: f"far {o} {v}", COMPARE, st.integers((1 << 60) - 5, (1 << 60) + 3100)),
    st.builds(lambda v: f"far IN ({', '.join(map(str, v))})", st.lists(st.integers(1 << 60, (1 << 60) + 3000), min_size=1, max_size=14)),
    st.builds(lambda o, v: f"s {o} {quoted(v)}", COMPARE, st.sampled_from(TEXTS)),
    st.builds(lambda v: 's = "' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"', st.sampled_from(TEXTS)),
    st.builds(lambda v: f"s IN ({', '.join(map(quoted, v))})", st.lists(st.sampled_from(TEXTS), min_size=1, max_size=3)),
    st.builds(lambda v: f"s LIKE {quoted(v)}", st.sampled_from(["p%", "it\\\\'s", "%", "a_b", "100\\\\%", "ü%"])),
    st.builds(lambda o, v: f"m {o} {v / 7:.4f}", COMPARE, st.integers(0, 3000)),
    st.builds(lambda o, v: f"t {o} timestamp'{dt.datetime(1970, 1, 1) + dt.timedelta(hours=v, microseconds=250000)}Z'", COMPARE, st.integers(0, 3000)),
    st.builds(lambda o, v: f"d {o} {v!r}", COMPARE, st.sampled_from(["2020-03-01", "2021-01-31", "2019-01-01"])),
    st.builds(lambda o, v: f"x {o} {v}D", COMPARE, st.integers(0, 1000)),
    st.sampled_from(["s IS NULL", "s IS NOT NULL", "isnan(x)", "k % 7 = 3", "length(s) > 4", "true", "null", "k BETWEEN 10 AND 40 /* AND k = 5 */", "k < 700 -- AND k = 5\n"]),
)
WHERE = st.recursive(ATOMS, lambda x: st.one_of(st.builds(lambda a, b: f"({a} AND {b})", x, x), st.builds(lambda a, b: f"({a} OR {b})", x, x), st.builds(lambda a: f"NOT ({a})", x)), max_leaves=4)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(where=WHERE)
def test_a_scan_is_a_filter(table, rows, where):
    got = table.scan(where)
    assert sorted(r["k"] for r in got.select("k").collect()) == sorted(r["k"] for r in rows.where(where).select("k").collect()), where
    assert {f.path for f in table.files(where)} <= {f.path for f in table.files()}


def test_filters_of_any_frame_choose_files(spark, table):
    whole = table.frame()
    everything = len(table.files())
    assert files_read(whole) == [(everything, everything)]
    assert files_read(whole.where("far < 1152921504606847000"))[0][0] < everything / 2
    assert files_read(whole.where((F.col("k") > 10) & (F.col("k") < 90)).select("d"))[0][0] < everything / 2
    assert files_read(whole.where("k > 50000")) == [(0, everything)] and whole.where("k > 50000").count() == 0
    whole.createOrReplaceTempView("whole_of_it")
    joined = spark.sql("SELECT a.k FROM whole_of_it a JOIN whole_of_it b ON a.k = b.k WHERE a.k < 40")
    assert all(read < total for read, total in files_read(joined)) and joined.count() == 40
    assert whole.select("k", F.col("_metadata.file_path")).where("k = 3").count() == 1


def test_a_frame_stays_at_its_version(spark, tmp_path):
    table = otreelake.write_table(spark.range(50).toDF("a"), str(tmp_path / "t"), columns="a")
    before = table.frame()
    table.append(spark.range(50).toDF("a"))
    assert before.count() == 50 and table.frame().count() == 100 and table.frame(0).count() == 50


def test_samples_of_frames(spark, table, rows):
    names = ["k", "s", "far"]
    want = rows.where(F.hash(*names) < from_fraction(0.1))
    found = otreelake.push_samples(table.frame().sample(0.1))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and files_read(found)[0][0] < len(table.files())
    deep = otreelake.push_samples(table.frame().where("k < 2000").select("d").sample(0.1).groupBy("d").count())
    assert deep.agg(F.sum("count")).first()[0] == want.where("k < 2000").count()
    parts = [otreelake.push_samples(p) for p in table.frame().randomSplit([0.2, 0.8], 3)]
    assert sum(p.count() for p in parts) == 3000
    plain = rows.sample(0.1, 4)
    assert otreelake.push_samples(plain) is plain
    again = table.frame().sample(True, 0.5, 4)
    assert otreelake.push_samples(again) is again


def test_mentions(spark):
    text = "WITH c AS (SELECT * FROM t), t AS (SELECT * FROM c) SELECT t, 'FROM t' FROM t JOIN u TABLESAMPLE (10 PERCENT) AS x ON true WHERE a IN (SELECT b FROM otree.`/p q`) -- FROM z"
    found = mentions(parsed(spark, text))
    assert [(text[m.start : m.end + 1], m.name, m.aliased) for m in found] == [("t", ("t",), False), ("u", ("u",), True), ("otree.`/p q`", ("otree", "/p q"), False)]
    assert found[1].sample == (0.0, 0.1) and text[found[1].sampled_at[0] : found[1].sampled_at[1] + 1] == "TABLESAMPLE (10 PERCENT)"


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "cat"))


def test_statements(spark, catalog):
    run = catalog.sql
    run("CREATE TABLE t (a BIGINT, s STRING) USING otree OPTIONS (columnsToIndex 'a', cubeSize '40') TBLPROPERTIES ('team' = 'me') COMMENT 'some'")
    with pytest.raises(AnalysisError):
        run("CREATE TABLE t (a BIGINT) USING otree")
    run("CREATE TABLE IF NOT EXISTS t (a BIGINT) USING otree")
    with pytest.raises(AnalysisError):
        run("CREATE TABLE p (a INT, b INT) USING otree PARTITIONED BY (b)")
    run("INSERT INTO t SELECT id, concat('t', id) FROM range(200)")
    run("INSERT INTO t (s) VALUES ('alone')")
    with pytest.raises(AnalysisError):
        run("INSERT INTO t (s, nothing) VALUES ('a', 'b')")
    assert run("SELECT count(*), max(a), count(a) FROM t").first()[:] == (201, 199, 200)
    assert run("SELECT t.a FROM t WHERE s = 't7'").collect()[0][0] == 7
    assert run("WITH t AS (SELECT * FROM t WHERE a < 5) SELECT count(*) FROM t").first()[0] == 5
    run("CREATE TABLE u USING otree OPTIONS (columnsToIndex 'a') AS SELECT a, s AS t FROM t WHERE a < 50")
    assert run("SELECT t FROM u WHERE t = 't3'").collect()[0][0] == "t3"
    run("INSERT OVERWRITE u BY NAME SELECT 'x' AS t, 1L AS a")
    assert run("SELECT * FROM u").collect()[0][:] == (1, "x") and run("SELECT count(*) FROM u VERSION AS OF 0").first()[0] == 50
    assert run(f"SELECT count(*) FROM u TIMESTAMP AS OF '{dt.datetime.now(dt.timezone.utc).isoformat()}'").first()[0] == 1
    with pytest.raises(AnalysisError):
        run("SELECT count(*) FROM u TIMESTAMP AS OF '2001-01-01'")
    run("REPLACE TABLE u USING otree OPTIONS (columnsToIndex 'b') AS SELECT a AS b FROM u")
    with pytest.raises(AnalysisError):
        run("REPLACE TABLE unknown USING otree AS SELECT 1 AS a")
    run("ALTER TABLE u ADD COLUMNS (z INT)")
    with pytest.raises(AnalysisError):
        run("ALTER TABLE u ADD COLUMNS (Z INT)")
    assert [r["col_name"] for r in run("DESCRIBE TABLE u").collect()] == ["b", "z"]
    assert run("SHOW TBLPROPERTIES t ('team')").first()["value"] == "me"
    run("TRUNCATE TABLE u")
    assert run("SELECT count(*) FROM u").first()[0] == 0
    run("DROP TABLE u")
    assert [r["tableName"] for r in run("SHOW TABLES").collect()] == ["t"]
    # what is not ours is Spark's
    name = f"plain_{uuid.uuid4().hex}"
    run(f"CREATE TABLE {name} USING parquet AS SELECT a FROM t WHERE a < 3")
    run(f"INSERT INTO {name} SELECT a FROM t WHERE a = 100")
    assert run(f"SELECT count(*) FROM {name} JOIN t USING (a)").first()[0] == 4
    run(f"DROP TABLE {name}")
    assert not [v for v in spark.catalog.listTables() if v.name.startswith("otree_")]


def test_an_enabled_session(spark, tmp_path, rows):
    otreelake.enable(spark, str(tmp_path / "cat"))
    try:
        path = str(tmp_path / "t")
        rows.write.format("otree").option("columnsToIndex", "k,far").options(cubeSize=200).save(path)
        with pytest.raises(AnalysisError):
            rows.write.format("otree").save(path)
        rows.where("k < 10").write.save(path, format="otree", mode="append")
        df = spark.read.format("otree").load(path)
        assert df.count() == 3010 and spark.read.load(path, format="otree", versionAsOf=0).count() == 3000
        assert df.sample(0.1).count() == df.where(F.hash("k", "far") < from_fraction(0.1)).count()
        df.createOrReplaceTempView("of_the_path")
        assert spark.sql("SELECT k FROM of_the_path TABLESAMPLE (10 PERCENT)").count() == df.sample(0.1).count()
        df.write.format("otree").option("columnsToIndex", "k").saveAsTable("named")
        spark.table("named").where("k < 5").write.insertInto("named")
        assert spark.sql("SELECT count(*) FROM named").first()[0] == 3020
        df.limit(5).write.format("otree").mode("overwrite").option("columnsToIndex", "far").saveAsTable("named")
        assert spark.table("named").count() == 5
        with pytest.raises(AnalysisError):
            df.write.format("otree").partitionBy("d").save(str(tmp_path / "p"))
        assert "named" in [r["tableName"] for r in spark.sql("SHOW TABLES").collect()] and spark.sql("SELECT 1 AS one").first()["one"] == 1
        with pytest.raises(ParseException):
            spark.sql("SELEC 1")
        plain = str(tmp_path / "plain")
        df.write.format("parquet").mode("overwrite").option("compression", "none").save(plain)
        df.write.mode("append").parquet(plain)
        assert spark.read.parquet(plain).count() == 6020 and spark.range(100).sample(0.5, 1).count() < 100
    finally:
        otreelake.disable(spark)


def test_vacuum(spark, tmp_path):
    table = otreelake.write_table(spark.range(300).toDF("a"), str(tmp_path / "t"), columns="a", cube_size=100)
    table.overwrite(spark.range(200).toDF("a"))
    table.stage(spark.range(10).toDF("a"))
    assert table.vacuum() == 0 and table.scan(version=0).count() == 300
    assert table.vacuum(retain_hours=0) > 0 and table.scan().count() == 210 and table.scan(version=2).count() == 210
    assert table.vacuum(retain_hours=0) == 0


def test_a_cut_off_checkpoint_is_passed_over(spark, tmp_path):
    spark.conf.set("spark.otreelake.log.checkpointInterval", "2")
    try:
        table = otreelake.write_table(spark.range(30).toDF("a"), str(tmp_path / "t"), columns="a")
        for k in range(4):
            table.append(spark.range(30).toDF("a"))
        log = Log(spark, table.path)
        names = [n for n, *_ in log.store.list("_log") if n.endswith(".checkpoint")]
        assert len(names) == 2
        lines = log.store.read(f"_log/{max(names)}").splitlines()
        log.store.create(f"_log/{max(names)}", "\n".join(lines[:-2]) + "\n", overwrite=True)
        assert OTreeTable(spark, table.path).scan().count() == 150
        log.store.create(f"_log/{max(names)}", "", overwrite=True)
        assert OTreeTable(spark, table.path).scan().count() == 150
    finally:
        spark.conf.unset("spark.otreelake.log.checkpointInterval")


def test_namespaces(spark, catalog):
    catalog.create_namespace("sales", {"owner": "a"})
    with pytest.raises(AnalysisError):
        catalog.create_namespace("sales")
    with pytest.raises(AnalysisError):
        catalog.sql("CREATE TABLE nowhere.t (a INT) USING otree")
    catalog.sql("CREATE TABLE sales.t USING otree OPTIONS (columnsToIndex 'a') AS SELECT id AS a FROM range(20)")
    catalog.sql("INSERT INTO sales.t SELECT id FROM range(5)")
    assert catalog.sql("SELECT count(*) FROM sales.t WHERE t.a < 5").first()[0] == 10 and catalog.tables("sales") == ["t"]
    catalog.sql("ALTER TABLE sales.t RENAME TO sales.u")
    catalog.alter_namespace("sales", {"x": 1}, ["owner"])
    assert catalog.namespace_properties("sales") == {"x": "1"} and catalog.tables() == ["sales.u"]
    with pytest.raises(AnalysisError):
        catalog.drop_namespace("sales")
    catalog.drop_namespace("sales", cascade=True)
    catalog.drop_namespace("sales", if_exists=True)
    assert catalog.namespaces() == [] == catalog.tables()


def test_parts_can_be_replaced(spark, tmp_path):
    class Selector:
        def select_columns(self, df, most):
            return ["b"]

    df = spark.range(50).selectExpr("id AS a", "id % 7 AS b")
    spark.conf.set("spark.otreelake.index.columnsToIndex.auto", "true")
    try:
        with otreelake.using(columns_selector=Selector()):
            assert otreelake.write_table(df, str(tmp_path / "t")).indexed_columns() == ["b"]
        assert otreelake.write_table(df, str(tmp_path / "u")).indexed_columns() == ["a", "b"]
    finally:
        spark.conf.unset("spark.otreelake.index.columnsToIndex.auto")
    for wrong in ({"index_manager": Selector()}, {"other": Selector()}):
        with pytest.raises(TypeError):
            otreelake.use(**wrong)


def test_visualizer(table, tmp_path, capsys):
    visualize.main([table.path, "-f", "0.1"])
    told = json.loads(capsys.readouterr().out)
    assert sum(n["elements"] for n in told["nodes"]) == 3000 and len(told["edges"]) == len(told["nodes"]) - 1
    info = table.sampling_info(0.1).first().asDict()
    assert {k: v for k, v in told["sample"].items() if k != "fraction"} == info
    page = tmp_path / "tree.html"
    visualize.main([table.path, "-r", "1", "-f", "0.1", "-o", str(page)])
    text = page.read_text()
    assert text.count("<circle") == len(told["nodes"]) and text.count('class="hit"') == sum(n["sampled"] for n in told["nodes"])
    with pytest.raises(SystemExit):
        visualize.main([str(tmp_path / "none")])
