"""Queries over indexed tables, one for each part of the library, and the SQL that must give the same rows.

A query indexes one of the given tables below a folder that driver and executors share, and reads it back. Tables that several queries read are
built once a session.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .errors import AnalysisError
from .functions import transforms as tf
from .functions.cubes import Cube
from .functions.weights import from_fraction, to_fraction, weight
from .operators.columns import select_columns
from .operators.index import cell_counts, next_revision
from .operators.metrics import size_stats
from .plans.catalyst import items
from .plans.samples import push_samples
from .session import disable, enable
from .sources.relation import index_of
from .streaming import ingest
from .table import OTreeTable

_ROOTS: dict[str, str] = {}
_TABLES: dict[tuple[str, str, str], OTreeTable] = {}


def root(spark: SparkSession) -> str:
    """A folder of this session's own in the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise AnalysisError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="otreelake-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        _ROOTS[app] = f"{shared}/tables-{uuid.uuid4().hex}"
    return _ROOTS[app]


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(spark: SparkSession) -> OTreeTable:
    return OTreeTable.for_path(spark, f"{root(spark)}/{uuid.uuid4().hex}")


def built(spark: SparkSession, sf_dir: str, name: str, columns: str, cube_size: int, **options) -> OTreeTable:
    key = spark.sparkContext.applicationId, sf_dir, f"{name}:{columns}:{cube_size}"
    if key not in _TABLES:
        table = fresh(spark)
        table.write(source(spark, sf_dir, name), "error", columns=columns, cube_size=cube_size, **options)
        _TABLES[key] = table
    return _TABLES[key]


def lineitem(spark: SparkSession, sf_dir: str) -> OTreeTable:
    return built(spark, sf_dir, "lineitem", "l_orderkey,l_partkey", 3000)


def events(spark: SparkSession, sf_dir: str) -> OTreeTable:
    return built(spark, sf_dir, "events", "ts,user_id", 500)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def murmur_sql(table: str, columns: list[str], keep: str, where: str) -> str:
    """Spark's hash of bigint columns as CTE steps over UBIGINT; `w` is the signed weight in where."""
    steps, n = [f"s0 AS (SELECT *, 42::UBIGINT AS h0 FROM {table})"], 0
    m = "4294967295::UBIGINT"

    def step(expression: str) -> str:
        nonlocal n
        n += 1
        steps.append(f"s{n} AS (SELECT *, {expression} AS h{n} FROM s{n - 1})")
        return f"h{n}"

    h = "h0"
    for c in columns:
        for word in (f"({c} & 4294967295)::UBIGINT", f"(({c} >> 32) & 4294967295)::UBIGINT"):
            k = step(f"({word} * 3432918353::UBIGINT) & {m}")
            k = step(f"((((({k} << 15) | ({k} >> 17)) & {m})) * 461845907::UBIGINT) & {m}")
            h = step(f"xor({h}, {k})")
            h = step(f"(((({h} << 13) | ({h} >> 19)) & {m}) * 5::UBIGINT + 3864292196::UBIGINT) & {m}")
        h = step(f"xor({h}, 8::UBIGINT)")
        h = step(f"(xor({h}, {h} >> 16) * 2246822507::UBIGINT) & {m}")
        h = step(f"(xor({h}, {h} >> 13) * 3266489909::UBIGINT) & {m}")
        h = step(f"xor({h}, {h} >> 16)")
    return f"WITH {', '.join(steps)}, weighed AS (SELECT *, CASE WHEN {h} >= 2147483648 THEN {h}::BIGINT - 4294967296 ELSE {h}::BIGINT END AS w FROM s{n}) SELECT {keep} FROM weighed WHERE {where}"


LINE_KEYS = ["l_orderkey", "l_partkey"]
_LINE = "l_orderkey, l_partkey, l_linenumber, l_quantity"


# -- scans, filters ---------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_orderkey BETWEEN 1000 AND 9000 GROUP BY 1, 2")
def otree_range_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).scan("l_orderkey BETWEEN 1000 AND 9000").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM lineitem")
def otree_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).scan()


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey < 500 AND l_partkey > 1000) OR l_partkey IN (7, 11, 1900)")
def otree_filter_or_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).scan("(l_orderkey < 500 AND l_partkey > 1000) OR l_partkey IN (7, 11, 1900)", columns=["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"])


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey >= 300) AND l_quantity * 2 > 60")
def otree_filter_not_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).scan("NOT (l_orderkey >= 300) AND l_quantity * 2 > 60", columns=["l_orderkey", "l_partkey", "l_linenumber"])


@query("SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-07 12:00:00'")
def otree_filter_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).scan("ts >= TIMESTAMP_NTZ'2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ'2024-01-07 12:00:00'", columns=["event_id", "user_id", "value"])


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def otree_filter_string_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "customer", "c_mktsegment,c_acctbal", 200).scan("c_mktsegment = 'BUILDING' AND c_acctbal > 0", columns=["c_custkey", "c_mktsegment", "c_acctbal"])


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand >= 'Brand#2' AND p_brand < 'Brand#4' AND p_name LIKE 'blue%'")
def otree_filter_string_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = source(spark, sf_dir, "part")
    table = built(spark, sf_dir, "part", "p_brand:quantiles,p_size", 200, column_stats={"p_brand_quantiles": tf.compute_quantiles(parts, "p_brand", 10)})
    return table.scan("p_brand >= 'Brand#2' AND p_brand < 'Brand#4' AND p_name LIKE 'blue%'", columns=["p_partkey", "p_brand", "p_size"])


@query("SELECT event_id, value FROM events WHERE value > 100.5 AND value <= 200")
def otree_filter_numeric_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "events")
    return built(spark, sf_dir, "events", "value:quantiles,event_id", 700, column_stats={"value_quantiles": tf.compute_quantiles(df, "value", 20, 0.01)}).scan("value > 100.5 AND value <= 200", columns=["event_id", "value"])


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS cust, o_orderkey AS key, o_totalprice AS price FROM orders WHERE o_orderkey % 5 = 0")
def otree_filter_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("cust"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    table = fresh(spark)
    table.write(df, columns="cust,key", cube_size=1000)
    return table.scan("cust IS NULL")


@query("SELECT n_nationkey, n_name, 7 AS one FROM nation WHERE n_nationkey < 10")
def otree_identity_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column with a single value is mapped to one point."""
    table = fresh(spark)
    table.write(source(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(7).alias("one")), columns="one,n_nationkey", cube_size=5)
    return table.scan("one = 7 AND n_nationkey < 10")


@query("SELECT vec_id, label, len(embedding)::INTEGER AS n FROM embeddings WHERE label <= 3")
def otree_nested_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "embeddings", "vec_id,label", 100).scan("label <= 3").select("vec_id", "label", F.size("embedding").alias("n"))


# -- samples ----------------------------------------------------------------------------------------------------------


@query(murmur_sql("lineitem", LINE_KEYS, _LINE, f"w < {from_fraction(0.1)}"))
def otree_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).scan(sample=0.1, columns=["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"])


@query(murmur_sql("lineitem", LINE_KEYS, _LINE, f"w >= {from_fraction(0.2)} AND w < {from_fraction(0.35)}"))
def otree_sample_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).scan(sample=(0.2, 0.35), columns=["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"])


@query(murmur_sql("lineitem", LINE_KEYS, _LINE, f"w < {from_fraction(0.3)} AND l_orderkey < 4000 AND l_quantity > 10"))
def otree_sample_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).scan("l_orderkey < 4000 AND l_quantity > 10", 0.3, ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"])


@query(murmur_sql("lineitem", LINE_KEYS, "count(*) AS n, sum(l_quantity) AS qty", f"w < {from_fraction(0.05)}"))
def otree_tablesample_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lineitem(spark, sf_dir).path
    return Catalog(spark, f"{root(spark)}/catalog").sql(f"SELECT count(*) AS n, sum(l_quantity) AS qty FROM otree.`{path}` TABLESAMPLE (5 PERCENT)")


@query(murmur_sql("lineitem", LINE_KEYS, "l_orderkey, l_partkey, l_linenumber, w::INTEGER AS weight, (w + 2147483648) / 4294967295.0::DOUBLE AS fraction", "true"))
def otree_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weight(*LINE_KEYS)
    return source(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", w.alias("weight"), ((w.cast("double") + 2147483648) / 4294967295.0).alias("fraction"))


@query(murmur_sql("events", ["epoch_us(ts)", "user_id"], "event_id, user_id", f"w < {from_fraction(0.25)}"))
def otree_sample_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).scan(sample=0.25, columns=["event_id", "user_id"])


@query(murmur_sql("lineitem", LINE_KEYS, "l_returnflag, count(*) AS n, avg(l_extendedprice) AS price", f"w < {from_fraction(0.2)} GROUP BY l_returnflag"))
def otree_sample_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).scan(sample=0.2).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("price"))


def weight_of(fraction: str) -> str:
    """The weight at a fraction, in SQL."""
    return f"greatest(-2147483648, least(2147483647, trunc({fraction} * 4294967295.0::DOUBLE - 2147483648)))"


_NEEDED = f"(SELECT least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow(1.96 * stddev(l_quantity) / (0.02 * abs(avg(l_quantity))), 2) / (count(*) / 0.05::DOUBLE))) FROM weighed WHERE w < {from_fraction(0.05)})"


@query(murmur_sql("lineitem", LINE_KEYS, f"{_NEEDED} AS fraction, avg(l_quantity) AS mean", f"w < {weight_of(_NEEDED)}"))
def otree_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    fraction = lineitem(spark, sf_dir).tolerance("l_quantity", 0.02, pilot=0.05)
    return lineitem(spark, sf_dir).scan(sample=fraction).agg(F.lit(fraction).alias("fraction"), F.avg("l_quantity").alias("mean"))


# -- predicates as Spark reads them -----------------------------------------------------------------------------------

#: Bigints that doubles do not tell apart.
_FAR = 1 << 60


def notes(spark: SparkSession, sf_dir: str) -> OTreeTable:
    """Customers with notes that hold quotes, escapes and words of SQL, and with numbers beyond 2^53."""
    key = F.col("c_custkey")
    note = F.when(key % 7 == 0, "foo AND c_custkey = 5 AND bar").when(key % 7 == 1, "a\tb").when(key % 7 == 2, "it's \"quoted\"").when(key % 7 == 3, "back\\slash").otherwise("plain")
    name = f"{sf_dir}:notes"
    if name not in _NOTES or _NOTES[name].spark is not spark:
        _NOTES[name] = fresh(spark)
        _NOTES[name].write(source(spark, sf_dir, "customer").select(key.cast("bigint").alias("c_custkey"), note.alias("note"), (key.cast("bigint") + F.lit(_FAR)).alias("far")), columns="note,c_custkey,far", cube_size=100)
    return _NOTES[name]


_NOTES: dict[str, OTreeTable] = {}
_NOTES_SQL = f"""WITH notes AS (SELECT c_custkey::BIGINT AS c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'foo AND c_custkey = 5 AND bar' WHEN 1 THEN 'a' || chr(9) || 'b' WHEN 2 THEN 'it''s "quoted"' WHEN 3 THEN 'back\\slash' ELSE 'plain' END AS note, c_custkey::BIGINT + {_FAR} AS far FROM customer) """


@query(_NOTES_SQL + "SELECT * FROM notes WHERE note = 'foo AND c_custkey = 5 AND bar' AND c_custkey > 3")
def otree_filter_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).scan('note = "foo AND c_custkey = 5 AND bar" AND c_custkey > 3')


@query(_NOTES_SQL + """SELECT * FROM notes WHERE note IN ('a' || chr(9) || 'b', 'it''s "quoted"', 'back\\slash')""")
def otree_filter_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).scan(r"""note = 'a\tb' OR note = 'it\'s "quoted"' OR note = 'back\\slash'""")


@query(_NOTES_SQL + "SELECT * FROM notes WHERE c_custkey < 900 AND note = 'plain'")
def otree_filter_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).scan("c_custkey < 900 -- AND c_custkey = 5\n AND note = 'plain' /* AND c_custkey = 6 */")


@query(_NOTES_SQL + f"SELECT * FROM notes WHERE far < {_FAR + 100} OR far > {_FAR + 950} AND far <= {_FAR + 990} OR far IN ({_FAR + 500}, {_FAR + 501})")
def otree_filter_bigint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).scan(f"far < {_FAR + 100} OR far > {_FAR + 950} AND far <= {_FAR + 990} OR far IN ({_FAR + 500}, {_FAR + 501})")


# -- pruning of ordinary queries --------------------------------------------------------------------------------------


def read_share(df: DataFrame, table: OTreeTable) -> bool:
    """Whether planning df read fewer files of the table than it has."""
    found = [index_of(leaf) for leaf in items(df._jdf.queryExecution().analyzed().collectLeaves())]
    df._jdf.queryExecution().executedPlan().toString()
    df.count()
    asked = [a for index in found if index is not None and index.root == table.log.store.root for a in index.asked]
    return bool(asked) and all(read < total for read, total in asked)


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty, true AS pruned FROM lineitem WHERE l_orderkey < 700 AND l_partkey > 100 GROUP BY 1")
def otree_sql_where_prunes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a view of the whole table; the files are chosen by the WHERE."""
    table = lineitem(spark, sf_dir)
    c = catalog(spark)
    c.create("lines", location=table.path)
    found = c.sql("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty FROM lines WHERE l_orderkey < 700 AND l_partkey > 100 GROUP BY l_returnflag")
    return found.withColumn("pruned", F.lit(read_share(found, table)))


@query(murmur_sql("lineitem", LINE_KEYS, "l_orderkey, l_partkey, l_linenumber, true AS pruned", f"w < {from_fraction(0.05)} AND l_quantity > 20"))
def otree_df_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """df.sample over a filtered and projected frame, as an enabled session takes it."""
    table = lineitem(spark, sf_dir)
    found = push_samples(table.frame().where("l_quantity > 20").select("l_orderkey", "l_partkey", "l_linenumber").sample(0.05))
    return found.withColumn("pruned", F.lit(read_share(found, table)))


@query("SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey BETWEEN 50 AND 900 AND l_partkey < 1500 GROUP BY 1")
def otree_sql_join_prunes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of one side's key reaches the other side's files, as Spark infers it over the join."""
    lines, orders = lineitem(spark, sf_dir), built(spark, sf_dir, "orders", "o_orderkey,o_custkey", 2000)
    c = catalog(spark)
    c.create("lines", location=lines.path)
    c.create("orders", location=orders.path)
    return c.sql("SELECT o_orderpriority, count(*) AS n FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey BETWEEN 50 AND 900 AND l_partkey < 1500 GROUP BY o_orderpriority")


# -- SQL statements ---------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey::BIGINT AS id, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def otree_sql_column_named_as_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark)
    rows = source(spark, sf_dir, "nation").join(source(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c.create_as("nat", rows.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("r_name").alias("region")), columns="id", cube_size=10)
    c.create_as("region", source(spark, sf_dir, "region"), columns="r_regionkey", cube_size=3)
    return c.sql("SELECT id, region FROM nat WHERE 'FROM region' <> region")


def given(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        source(spark, sf_dir, name).createOrReplaceTempView(f"given_{name}")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, NULL::DOUBLE AS score FROM nation UNION ALL SELECT n_regionkey, n_name, 0.5 FROM nation WHERE n_nationkey < 10")
def otree_sql_create_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    given(spark, sf_dir, "nation")
    c = catalog(spark)
    c.sql("CREATE TABLE IF NOT EXISTS student (id BIGINT, name STRING, score DOUBLE) USING otree OPTIONS (columnsToIndex 'id', cubeSize '10')")
    c.sql("INSERT INTO student (name, id) SELECT n_name, n_nationkey FROM given_nation")
    c.sql("INSERT INTO student SELECT n_regionkey, n_name, 0.5 FROM given_nation WHERE n_nationkey < 10")
    return c.sql("SELECT * FROM student")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 50000 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def otree_sql_ctas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE AS over a source, INSERT from the table itself, REPLACE over the outcome."""
    given(spark, sf_dir, "orders")
    c = catalog(spark)
    c.sql("CREATE TABLE dear USING otree OPTIONS (columnsToIndex 'o_orderkey,o_totalprice', cubeSize '2000') AS SELECT o_orderkey, o_totalprice FROM given_orders WHERE o_totalprice > 50000")
    c.sql("INSERT INTO dear SELECT * FROM dear WHERE o_totalprice > 200000")
    c.sql("CREATE OR REPLACE TABLE copied USING otree OPTIONS (columnsToIndex 'o_orderkey') AS SELECT * FROM dear")
    return c.sql("SELECT * FROM copied")


@query("SELECT r_regionkey, r_name, 5 AS before FROM region WHERE r_regionkey > 2")
def otree_sql_insert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT OVERWRITE BY NAME, and the version before it."""
    given(spark, sf_dir, "region")
    c = catalog(spark)
    c.sql("CREATE TABLE regions USING otree OPTIONS (columnsToIndex 'r_regionkey') AS SELECT r_regionkey, r_name FROM given_region")
    c.sql("INSERT OVERWRITE regions BY NAME SELECT r_name, r_regionkey FROM given_region WHERE r_regionkey > 2")
    return c.sql("SELECT r_regionkey, r_name, (SELECT CAST(count(*) AS INT) FROM regions VERSION AS OF 0) AS before FROM regions")


@query("SELECT * FROM (VALUES ('columns', 'a,b,c'), ('p', '2'), ('q', ''), ('tables', 'second')) v(what, value)")
def otree_sql_alter_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark)
    for text in ("CREATE TABLE first (a INT, b STRING) USING otree OPTIONS (columnsToIndex 'a')", "ALTER TABLE first SET TBLPROPERTIES ('p' = '1', 'q' = '1')", "ALTER TABLE first SET TBLPROPERTIES ('p' = '2')",
                 "ALTER TABLE first UNSET TBLPROPERTIES ('q')", "ALTER TABLE first ADD COLUMNS (c DOUBLE)", "CREATE TABLE gone (a INT) USING otree", "ALTER TABLE first RENAME TO second", "DROP TABLE gone", "DROP TABLE IF EXISTS gone"):
        c.sql(text)
    held = {r["key"]: r["value"] for r in c.sql("SHOW TBLPROPERTIES second").collect()}
    columns = ",".join(r["col_name"] for r in c.sql("DESCRIBE TABLE second").collect())
    tables = ",".join(r["tableName"] for r in c.sql("SHOW TABLES").collect())
    return spark.createDataFrame([("columns", columns), ("p", held["p"]), ("q", held.get("q", "")), ("tables", tables)], "what string, value string")


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'MACHINERY'")
def otree_write_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """df.write.format, spark.read.format and spark.table of an enabled session."""
    enable(spark, f"{root(spark)}/catalog-{uuid.uuid4().hex}")
    try:
        df, path = source(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), f"{root(spark)}/{uuid.uuid4().hex}"
        df.write.format("otree").option("columnsToIndex", "c_custkey,c_acctbal").option("cubeSize", 300).save(path)
        df.where("c_mktsegment = 'MACHINERY'").write.format("otree").mode("append").save(path)
        spark.read.format("otree").load(path).where("c_acctbal < 0").write.format("otree").option("columnsToIndex", "c_custkey").saveAsTable("poor")
        return spark.table("poor")
    finally:
        disable(spark)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0")
def otree_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of overwritten versions go; what is left reads as before."""
    df = source(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    table = fresh(spark)
    table.write(df, columns="o_orderkey", cube_size=3000)
    table.overwrite(df.where("o_orderkey % 2 = 0"))
    if not table.vacuum(retain_hours=0):
        raise AnalysisError("no file was removed")
    return table.scan()


# -- writes -----------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS k, l_partkey AS p, l_quantity AS q FROM lineitem UNION ALL SELECT l_orderkey + 10000000, l_partkey, l_quantity FROM lineitem WHERE l_orderkey < 3000")
def otree_append_new_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"))
    table = fresh(spark)
    table.write(df, columns="k,p", cube_size=4000)
    table.append(df.where("k < 3000").withColumn("k", F.col("k") + 10_000_000))
    return table.scan()


@query("SELECT 2 AS revisions, (SELECT count(*) FROM orders) + (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS n, 'o_orderkey,o_custkey' AS columns, 2000 AS cube_size")
def otree_append_same_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "orders")
    table = fresh(spark)
    table.write(df, columns="o_orderkey,o_custkey", cube_size=2000)
    table.append(df.where("o_orderkey % 3 = 0"))
    return table.scan().agg(F.lit(len(table.revision_ids())).alias("revisions"), F.count(F.lit(1)).alias("n"), F.lit(",".join(table.indexed_columns())).alias("columns"), F.lit(table.cube_size()).alias("cube_size"))


@query("SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def otree_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "orders")
    table = fresh(spark)
    table.write(df, columns="o_orderkey,o_custkey", cube_size=2000)
    table.overwrite(df.where("o_totalprice > 1000").select("o_custkey", "o_totalprice"), columns="o_custkey,o_totalprice", overwrite_schema=True)
    return table.scan()


@query("SELECT * FROM (VALUES ('append', true), ('error', false), ('ignore', false), ('overwrite', true)) v(mode, wrote)")
def otree_save_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = fresh(spark)
    df = source(spark, sf_dir, "region")
    table.write(df, "error", columns="r_regionkey", cube_size=3)
    done = []
    for mode in ("append", "error", "ignore", "overwrite"):
        try:
            done.append((mode, table.write(df, mode)))
        except AnalysisError:
            done.append((mode, False))
    return spark.createDataFrame(done, "mode string, wrote boolean")


@query("SELECT count(*) AS n, 2 AS versions FROM (SELECT * FROM region UNION ALL SELECT * FROM region)")
def otree_idempotent_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "region")
    table = fresh(spark)
    for version in (1, 1, 2, 1):
        table.append(df, columns="r_regionkey", cube_size=3, txn=("job", version))
    return table.scan().agg(F.count(F.lit(1)).alias("n"), F.lit(len(table.history())).alias("versions"))


@query("SELECT r_regionkey, r_name, NULL::INTEGER AS extra FROM region UNION ALL SELECT r_regionkey + 100, r_name, 1 FROM region")
def otree_merge_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "region").select("r_regionkey", "r_name")
    table = fresh(spark)
    table.write(df, columns="r_regionkey", cube_size=3)
    more = df.withColumns({"r_regionkey": (F.col("r_regionkey") + 100).cast(df.schema["r_regionkey"].dataType), "extra": F.lit(1)})
    table.append(more, merge_schema=True)
    return table.scan()


@query("SELECT * FROM (VALUES ('checked.rows', '25'), ('user', 'nightly')) v(tag, value)")
def otree_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = fresh(spark)
    count = lambda actions: {"rows": str(sum(a["add"]["stats"]["numRecords"] for a in actions if "add" in a))}
    table.write(source(spark, sf_dir, "nation"), columns="n_nationkey", cube_size=10, user_metadata="nightly", options={"preCommitHook.checked": count})
    (info,) = table.history()
    return spark.createDataFrame([*info["tags"].items(), ("user", info["userMetadata"])], "tag string, value string")


@query("SELECT count(*) AS n FROM orders")
def otree_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = fresh(spark)
    df = source(spark, sf_dir, "orders")
    table.write(df, columns="o_orderkey", cube_size=5000)
    table.append(df)
    return table.scan(version=0).agg(F.count(F.lit(1)).alias("n"))


# -- definition and insertion -----------------------------------------------------------------------------------------


def catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, f"{root(spark)}/catalog-{uuid.uuid4().hex}")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey * 1.0 AS score FROM nation UNION ALL SELECT n_regionkey, n_name, n_nationkey * 1.0 FROM nation")
def otree_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By position with casts, then by name in another order."""
    df = source(spark, sf_dir, "nation")
    c = catalog(spark)
    c.create("student", "id bigint, name string, score double", {"columnsToIndex": "id,score", "cubeSize": "10"})
    c.insert_into("student", df.select("n_nationkey", "n_name", "n_regionkey"))
    c.insert_into("student", df.select((F.col("n_nationkey") * 1.0).alias("score"), F.col("n_regionkey").alias("id"), F.col("n_name").alias("name")), by_name=True)
    return c.table("student").scan().withColumn("id", F.col("id").cast("int")).select("id", "name", "score")


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 2")
def otree_insert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark)
    df = source(spark, sf_dir, "region").select("r_regionkey", "r_name")
    c.create_as("regions", df, columns="r_regionkey", cube_size=3)
    c.insert_overwrite("regions", df.where("r_regionkey > 2"))
    return c.sql("SELECT * FROM regions")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def otree_catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark)
    c.create_as("nations", source(spark, sf_dir, "region"), columns="r_regionkey", cube_size=3)
    c.create_as("nations", source(spark, sf_dir, "nation"), "replace", columns="n_nationkey,n_regionkey", cube_size=10)
    c.create_as("regions", source(spark, sf_dir, "region"), "create_or_replace", columns="r_regionkey", cube_size=3)
    return c.sql("SELECT n.n_name, r.r_name FROM nations n JOIN regions r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA'")


@query("SELECT count(*) AS n, 'kept,renamed' AS tables, 'b' AS property FROM supplier")
def otree_external_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark)
    made = built(spark, sf_dir, "supplier", "s_suppkey", 50)
    c.create("outside", location=made.path)
    c.set_properties("outside", owner="a", other="x")
    c.set_properties("outside", owner="b")
    c.unset_properties("outside", "other")
    c.create("kept", "a int, b string", {"columnsToIndex": "a"})
    c.create("gone", "a int")
    c.drop("gone")
    c.rename("outside", "renamed")
    properties = c.table("renamed").snapshot().properties
    return c.table("renamed").scan().agg(F.count(F.lit(1)).alias("n"), F.lit(",".join(c.tables())).alias("tables"), F.lit(",".join(properties.values())).alias("property"))


# -- staging, conversion, optimisation --------------------------------------------------------------------------------


def staged_twice(spark: SparkSession, sf_dir: str) -> OTreeTable:
    df = source(spark, sf_dir, "lineitem")
    table = fresh(spark)
    table.write(df.where("l_orderkey % 2 = 0"), columns="l_orderkey,l_partkey", cube_size=3000)
    table.stage(df.where("l_orderkey % 4 = 1"))
    table.stage(df.where("l_orderkey % 4 = 3"))
    return table


@query(murmur_sql("lineitem", LINE_KEYS, _LINE, f"w < {from_fraction(0.15)}"))
def otree_hybrid_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_twice(spark, sf_dir).scan(sample=0.15, columns=["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"])


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem")
def otree_optimize_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = staged_twice(spark, sf_dir)
    table.optimize(0)
    return table.scan(columns=["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def otree_optimize_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    table = fresh(spark)
    table.write(df, columns="o_orderkey,o_custkey", cube_size=2000, column_stats={"o_orderkey_min": 0, "o_orderkey_max": 100_000_000})
    table.optimize(fraction=0.5)
    table.optimize()
    return table.scan()


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000")
def otree_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{root(spark)}/plain-{uuid.uuid4().hex}"
    source(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").repartitionByRange(4, "c_acctbal").write.parquet(path)
    table = OTreeTable.convert(spark, f"parquet.`{path}`", "c_custkey,c_acctbal", 300)
    OTreeTable.convert(spark, f"parquet.`{path}`", "c_custkey")
    return table.scan("c_acctbal > 5000")


@query("SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY event_type")
def otree_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "events")
    table, parts = fresh(spark), f"{root(spark)}/parts-{uuid.uuid4().hex}"
    df.repartition(4, "user_id").write.parquet(parts)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(parts)
    ingest(stream, table.path, "ingest", f"{parts}-checkpoint", columns="ts,user_id", cube_size=2000).awaitTermination()
    return table.scan().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# -- description ------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS elements, 2 AS dimensions, 3000 AS cube_size, 4 AS max_fanout FROM lineitem")
def otree_index_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lineitem(spark, sf_dir).metrics()
    return spark.createDataFrame([(m.elements, m.dimensions, m.desired_cube_size, m.max_fanout)], "elements bigint, dimensions int, cube_size int, max_fanout int")


#: The tree of orders on one column, computed in SQL: rows in each half, quarter and so on, shares of weights from the root down, each row's first cube that takes its weight.
_TREE = """, whole AS (SELECT *, (o_orderkey - min(o_orderkey) OVER ())::DOUBLE / (max(o_orderkey) OVER () - min(o_orderkey) OVER ()) AS x FROM weighed),
cells AS (SELECT o_orderkey, w, k, least(floor(x * pow(2, k)), pow(2, k) - 1)::BIGINT AS c FROM whole, range(12) t(k)),
dom AS (SELECT k, c, count(*) AS n FROM cells GROUP BY k, c),
tree(k, c, share) AS (SELECT k, c, CASE WHEN n <= 1000 THEN 1.0::DOUBLE ELSE 1000.0::DOUBLE / n END FROM dom WHERE k = 0
 UNION ALL SELECT d.k, d.c, CASE WHEN d.n * (1 - t.share) <= 1000 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, t.share + 1000.0::DOUBLE / d.n) END FROM tree t JOIN dom d ON d.k = t.k + 1 AND d.c // 2 = t.c WHERE t.share < 1),
greatest_of AS (SELECT k, c, CASE WHEN share >= 1 THEN 2147483647 ELSE trunc(share * 4294967295.0::DOUBLE - 2147483648)::BIGINT END AS most FROM tree),
placed AS (SELECT o_orderkey, min(r.k) AS k, arg_min(r.c, r.k) AS c FROM cells r JOIN greatest_of g ON g.k = r.k AND g.c = r.c AND r.w <= g.most GROUP BY o_orderkey),
cube AS (SELECT k, c, count(*) AS n FROM placed GROUP BY k, c),
kinds AS (SELECT *, EXISTS (SELECT 1 FROM cube b WHERE b.k > a.k AND b.c >> (b.k - a.k) = a.c) AS has_below FROM cube a) """
_LEVELS = "WITH RECURSIVE" + murmur_sql("orders", ["o_orderkey"], "KEEP", "true").split("WITH", 1)[1].split(" SELECT KEEP")[0] + _TREE


def orders_tree(spark: SparkSession, sf_dir: str) -> OTreeTable:
    return built(spark, sf_dir, "orders", "o_orderkey", 1000)


@query(_LEVELS + "SELECT CASE WHEN has_below THEN 'inner' ELSE 'leaf' END AS kind, k::INTEGER AS depth, count(*) AS cubes, avg(n) AS mean FROM kinds GROUP BY 1, 2")
def otree_index_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = orders_tree(spark, sf_dir).metrics()
    parts = [df.select(F.lit(kind).alias("kind"), "depth", F.col("cubeCount").alias("cubes"), F.col("avgElements").alias("mean")) for kind, df in (("inner", m.inner_levels), ("leaf", m.leaf_levels))]
    return parts[0].union(parts[1])


@query(_LEVELS + """SELECT sum(n)::BIGINT AS elements, count(*) AS cubes, max(k)::INTEGER + 1 AS height, CASE WHEN count(*) FILTER (has_below) = 0 THEN 0.0::DOUBLE ELSE trunc((count(*) - 1)::DOUBLE / count(*) FILTER (has_below) * 100) / 100 END AS fanout,
 trunc(avg(n))::BIGINT AS mean, trunc(stddev(n))::BIGINT AS spread, quantile_disc(n, 0.0)::BIGINT AS q0, quantile_disc(n, 0.25)::BIGINT AS q1, quantile_disc(n, 0.5)::BIGINT AS q2, quantile_disc(n, 0.75)::BIGINT AS q3, quantile_disc(n, 1.0)::BIGINT AS q4 FROM kinds""")
def otree_cube_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height, fan-out and sizes of the cubes, from the metrics of the stored index."""
    m = orders_tree(spark, sf_dir).metrics()
    row = (m.elements, m.cubes["count"], m.height, m.fanout, m.cubes["avg"], m.cubes["stddev"], *map(int, m.cubes["quartiles"]))
    return spark.createDataFrame([row], "elements bigint, cubes bigint, height int, fanout double, mean bigint, spread bigint, q0 bigint, q1 bigint, q2 bigint, q3 bigint, q4 bigint")


@query(_LEVELS + "SELECT k::INTEGER AS depth, c AS place, count(*) AS n, min(w)::INTEGER AS least, g.most::INTEGER AS greatest FROM placed JOIN cells USING (o_orderkey, k, c) JOIN greatest_of g USING (k, c) GROUP BY ALL")
def otree_stored_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored cube: its place at its depth, its rows, and its range of weights."""
    found = orders_tree(spark, sf_dir).blocks().groupBy("cubeId", "depth").agg(F.sum("blockElementCount").alias("n"), F.min("minWeight").alias("least"), F.min("maxWeight").alias("greatest"))
    place = F.coalesce(F.aggregate(F.transform(F.filter(F.split("cubeId", ""), lambda x: x != ""), lambda x: (x == "g").cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a * 2 + b), F.lit(0))
    return found.select("depth", place.cast("bigint").alias("place"), "n", "least", "greatest")


@query("SELECT count(*) AS n, true AS parents_stored FROM lineitem")
def otree_denormalized_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lineitem(spark, sf_dir).blocks()
    cubes = {r["cubeId"] for r in found.select("cubeId").distinct().collect()}
    return found.agg(F.sum("blockElementCount").alias("n"), F.lit(all(c[:-1] in cubes for c in cubes if c)).alias("parents_stored"))


@query()
def otree_sampling_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).sampling_info(0.02)


@query("WITH m AS (SELECT min(l_orderkey) AS a, max(l_orderkey) AS b, min(l_partkey) AS c, max(l_partkey) AS d FROM lineitem) SELECT least(floor((l_orderkey - a)::DOUBLE / (b - a) * 8), 7)::INTEGER AS x, least(floor((l_partkey - c)::DOUBLE / (d - c) * 8), 7)::INTEGER AS y, count(*) AS n FROM lineitem, m GROUP BY 1, 2")
def otree_cell_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the cells of depth 3, from the counts that the index build makes."""
    df = source(spark, sf_dir, "lineitem")
    revision, _, rows = next_revision(df, tf.parse_columns("l_orderkey,l_partkey", df.schema), max(1, df.count() // 4), {}, None)
    cells: dict[tuple[int, int], int] = {}
    for cube, n in cell_counts(df, revision, rows).items():
        x, y = cube.ancestor(3).cells()
        cells[x, y] = cells.get((x, y), 0) + n
    return spark.createDataFrame([(x, y, n) for (x, y), n in cells.items()], "x int, y int, n bigint")


@query("SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS p, unnest(quantile_disc(l_extendedprice, [0.0, 0.25, 0.5, 0.75, 1.0])) AS price FROM lineitem")
def otree_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tf.compute_quantiles(source(spark, sf_dir, "lineitem"), "l_extendedprice", 4, 0.0)
    return spark.createDataFrame([(k / 4, v) for k, v in enumerate(found)], "p double, price double")


@query()
def otree_string_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in tf.compute_quantiles(source(spark, sf_dir, "part"), "p_name", 10)], "name string")


def best_columns_sql(pairs: list[tuple[str, str]], most: int) -> str:
    """The columns with the lowest sums of absolute correlations."""
    each = " UNION ALL ".join(f"SELECT '{x}' AS c, r FROM (SELECT abs(corr({a}, {b})) AS r FROM numbers)" for a, b in pairs for x in (a, b))
    return f"SELECT c AS \"column\" FROM ({each}) GROUP BY c ORDER BY sum(CASE WHEN r IS NULL OR isnan(r) THEN 0 ELSE r END), c LIMIT {most}"


_MIXED = ["l_orderkey", "l_partkey", "mixed", "l_quantity", "l_extendedprice", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_MIXED) for b in _MIXED[:i]]


@query("WITH numbers AS (SELECT l_orderkey, l_partkey, l_linenumber * l_orderkey AS mixed, l_quantity, l_extendedprice, l_tax FROM lineitem) " + best_columns_sql(_PAIRS, 3))
def otree_select_number_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") * F.col("l_orderkey")).alias("mixed"), "l_quantity", "l_extendedprice", "l_tax")
    return spark.createDataFrame([(c,) for c in select_columns(df, 3)], "column string")


@query()
def otree_select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in select_columns(source(spark, sf_dir, "lineitem"), 3)], "column string")


@query("SELECT 0.1::DOUBLE AS fraction, -1717986918 AS weight, 3 AS depth, 'gAA'::VARCHAR AS text UNION ALL SELECT 0.3, -858993459, 0, ''")
def otree_known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of fractions, and string forms of cubes."""
    rows = [(0.1, from_fraction(0.1), 3, Cube.parse(2, "gAA").string()), (0.3, from_fraction(0.3), 0, Cube(2).string())]
    assert abs(to_fraction(rows[0][1]) - 0.1) < 1e-9
    return spark.createDataFrame(rows, "fraction double, weight int, depth int, text string")


@query("SELECT l_returnflag AS flag, count(*) AS n FROM (SELECT l_returnflag FROM lineitem WHERE l_orderkey < 1000 UNION ALL SELECT l_returnflag FROM lineitem WHERE l_orderkey > 5000) GROUP BY 1")
def otree_union_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lineitem(spark, sf_dir)
    return table.scan("l_orderkey < 1000").union(table.scan("l_orderkey > 5000")).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey BETWEEN 100 AND 4000 GROUP BY 1")
def otree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = built(spark, sf_dir, "orders", "o_orderkey,o_custkey", 2000)
    where = "{} BETWEEN 100 AND 4000"
    joined = lineitem(spark, sf_dir).scan(where.format("l_orderkey")).join(orders.scan(where.format("o_orderkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


# -- what is Spark's own, over indexed tables -------------------------------------------------------------------------


def lines_and_orders(spark: SparkSession, sf_dir: str) -> Catalog:
    c = catalog(spark)
    c.create("lines", location=lineitem(spark, sf_dir).path)
    c.create("orders", location=built(spark, sf_dir, "orders", "o_orderkey,o_custkey", 2000).path)
    return c


_OUTER = "SELECT count(*) AS n, count(l_orderkey) AS lines, count(o_orderkey) AS orders FROM (SELECT * FROM {lines} WHERE l_orderkey < 2000) {kind} JOIN (SELECT * FROM orders WHERE o_orderkey BETWEEN 1000 AND 3000) ON l_orderkey = o_orderkey"
_SEMI = "SELECT count(*) AS n, count(*) AS lines, 0 AS orders FROM {lines} {kind} JOIN (SELECT * FROM orders WHERE o_orderkey BETWEEN 1000 AND 3000) ON l_orderkey = o_orderkey"


def all_joins(lines: str, semi: str, anti: str, number: str) -> str:
    parts = [f"SELECT '{k}' AS kind, n, lines, orders FROM ({_OUTER.format(lines=lines, kind=k)})" for k in ("LEFT", "RIGHT", "FULL")]
    parts += [f"SELECT '{k}' AS kind, n, lines, CAST(orders AS {number}) AS orders FROM ({_SEMI.format(lines=lines, kind=k)})" for k in (semi, anti)]
    return " UNION ALL ".join(parts)


@query(all_joins("lineitem", "SEMI", "ANTI", "BIGINT"))
def otree_other_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines_and_orders(spark, sf_dir).sql(all_joins("lines", "LEFT SEMI", "LEFT ANTI", "BIGINT"))
    return found.withColumn("kind", F.regexp_replace("kind", "^LEFT (SEMI|ANTI)$", "$1"))


_SETS = "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM {} WHERE l_partkey < 1000 GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"


@query(_SETS.format("lineitem"))
def otree_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_and_orders(spark, sf_dir).sql(_SETS.format("lines"))


_WINDOWS = "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER w AS BIGINT) AS place, sum(l_quantity) OVER w AS upto, lag(l_partkey) OVER w AS before FROM {} WHERE l_orderkey BETWEEN 500 AND 1500 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"


@query(_WINDOWS.format("lineitem"))
def otree_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_and_orders(spark, sf_dir).sql(_WINDOWS.format("lines"))


_SCALAR = "SELECT c_custkey, upper(substring(c_name, 1, 8)) AS name, CAST(length(c_mktsegment) AS INTEGER) AS n, round(c_acctbal / 7, 2) AS part, abs(c_acctbal) AS size, concat(c_mktsegment, '-', CAST(c_nationkey AS VARCHAR(20))) AS place, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'has' END AS state FROM {} WHERE c_custkey < 800"


@query(_SCALAR.format("customer"))
def otree_scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark)
    c.create("people", location=built(spark, sf_dir, "customer", "c_custkey,c_acctbal", 200).path)
    return c.sql(_SCALAR.format("people"))


@query("SELECT * FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_orderkey < 3000 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_orderkey > 9000) EXCEPT SELECT l_suppkey FROM lineitem WHERE l_partkey BETWEEN 100 AND 101")
def otree_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lineitem(spark, sf_dir)
    keys = lambda where: table.scan(where).select("l_suppkey")
    return keys("l_orderkey < 3000").intersect(keys("l_orderkey > 9000")).subtract(keys("l_partkey BETWEEN 100 AND 101"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey < 5000 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def otree_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).frame().where("l_orderkey < 5000").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT corr(l_quantity, l_extendedprice) AS r, covar_pop(l_quantity, l_discount) AS c FROM lineitem WHERE l_partkey > 500")
def otree_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).scan("l_partkey > 500").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.covar_pop("l_quantity", "l_discount").alias("c"))


@query("SELECT count(l_quantity) AS n, trunc(avg(l_quantity))::BIGINT AS mean, trunc(stddev(l_quantity))::BIGINT AS spread, unnest([0, 1, 2, 3, 4]) AS k, unnest(quantile_disc(l_quantity, [0.0, 0.25, 0.5, 0.75, 1.0])) AS quartile FROM lineitem")
def otree_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, means, standard deviations and approximate percentiles as the index metrics take them of blocks, here of a column that SQL knows."""
    found = size_stats(lineitem(spark, sf_dir).scan(), "l_quantity")
    return spark.createDataFrame([(found["count"], found["avg"], found["stddev"], k, float(q)) for k, q in enumerate(found["quartiles"])], "n bigint, mean bigint, spread bigint, k int, quartile double")


@query("SELECT p_partkey, p_name FROM part WHERE p_name >= 'm' AND p_name < 'q' AND p_size > 10")
def otree_filter_string_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram policy of earlier tables, with its bins of letters; then renamed as an upgrade does."""
    table = fresh(spark)
    table.write(source(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), columns="p_name:histogram,p_size", cube_size=200)
    if not table.upgrade():
        raise AnalysisError("nothing was upgraded")
    return table.scan("p_name >= 'm' AND p_name < 'q' AND p_size > 10", columns=["p_partkey", "p_name"])


@query("SELECT (SELECT count(*) FROM region) AS rows_after, 0 AS rows_before, 2 AS versions, (SELECT count(*) FROM region WHERE r_regionkey < 2) AS found")
def otree_empty_then_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A created table without files, then with them; read by name, by path and by the short form."""
    df, table = source(spark, sf_dir, "region"), fresh(spark)
    table.create(df.schema, {"columnsToIndex": "r_regionkey", "cubeSize": "3"})
    before = table.frame().where("r_regionkey < 2").count()
    table.append(df)
    found = table.scan("r_regionkey < 2").count()
    return table.frame().agg(F.count(F.lit(1)).alias("rows_after"), F.lit(before).alias("rows_before"), F.lit(len(table.history())).alias("versions"), F.lit(found).cast("bigint").alias("found"))


@query("SELECT count(*) * 3 AS n, 3 AS versions FROM nation")
def otree_conflict_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A writer that finds its version taken tries again on the newest state; no rows are lost and none come twice."""
    df, table = source(spark, sf_dir, "nation"), fresh(spark)
    table.write(df, columns="n_nationkey", cube_size=10)
    inner, raced = table._written, []

    def late(*arguments):
        made = inner(*arguments)
        if not raced:
            raced.append(OTreeTable(spark, table.path).append(df))
        return made

    table._written = late
    table.append(df)
    return OTreeTable(spark, table.path).scan().agg(F.count(F.lit(1)).alias("n"), F.lit(len(table.history())).alias("versions"))


@query("SELECT -5::BIGINT AS d, 12345678901.25::DOUBLE AS e, 1 AS same UNION ALL SELECT n_nationkey::BIGINT, n_nationkey * 0.5, 1 FROM nation WHERE n_nationkey > 20")
def otree_store_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT under ANSI, STRICT (which takes what widens and refuses what narrows) and LEGACY (where what cannot be cast is null)."""
    table, before = fresh(spark), spark.conf.get("spark.sql.storeAssignmentPolicy", "ANSI")
    table.create("d bigint, e double", {"columnsToIndex": "d"})
    nations = source(spark, sf_dir, "nation")
    refused = 0
    try:
        spark.conf.set("spark.sql.storeAssignmentPolicy", "ANSI")
        table.insert(nations.where("n_nationkey > 20").select("n_nationkey", F.col("n_nationkey") * 0.5))
        spark.conf.set("spark.sql.storeAssignmentPolicy", "STRICT")
        table.insert(spark.range(1).select(F.lit(-5).cast("int"), F.lit(12345678901.25)))
        try:
            table.insert(spark.range(1).select(F.lit(2.5), F.lit(1.0)))
        except AnalysisError:
            refused += 1
    finally:
        spark.conf.set("spark.sql.storeAssignmentPolicy", before)
    return table.scan().withColumn("same", F.lit(refused))
