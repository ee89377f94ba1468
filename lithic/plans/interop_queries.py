"""Queries on sources, sinks, statistics and dialect functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.functions import dialect
from lithic.operators import statistics
from lithic.operators.table import Table
from lithic.session import load, workspace
from lithic.sources import interop

PART = T.StructType([T.StructField(n, k) for n, k in (("a", T.LongType()), ("b", T.StringType()), ("c", T.StringType()), ("d", T.StringType()), ("e", T.LongType()), ("f", T.DoubleType()))])


def read_parquet(spark, d):
    return interop.read_parquet(spark, f"{d}/part.parquet", PART)


def read_parquet_field_ids(spark, d):
    ids = {"n_nationkey": 7, "n_name": 3, "n_regionkey": 12}
    rows = load(spark, d, "nation")
    tagged = rows.select(*[F.col(c).alias(c, metadata={"parquet.field.id": i}) for c, i in ids.items()])
    where = workspace(spark, "ids")
    tagged.write.option("spark.sql.parquet.fieldId.write.enabled", "true").parquet(where)
    want = T.StructType([T.StructField("region", T.IntegerType()), T.StructField("name", T.StringType())])
    return interop.read_parquet_field_ids(spark, where, want, [12, 3])


def parquet_schema(spark, d):
    return interop.parquet_schema(spark, f"{d}/orders.parquet").select("name", "type")


def fdw_parquet(spark, d):
    """A folder of files as an external table, filtered and projected by the reader."""
    where = workspace(spark, "ext")
    load(spark, d, "customer").repartition(3).write.parquet(where)
    return spark.read.parquet(where).where("c_nationkey = 4").select("c_custkey", "c_nationkey")


def _hive(spark, d):
    where = workspace(spark, "hive")
    interop.write_hive(load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), where, ["c_mktsegment", "c_nationkey"])
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_mktsegment", T.StringType()), T.StructField("c_nationkey", T.IntegerType())])
    return interop.read_hive(spark, where, schema, ["c_mktsegment", "c_nationkey"])


def hive_partitions(spark, d):
    return _hive(spark, d)


def hive_partition_prune(spark, d):
    return _hive(spark, d).where("c_mktsegment = 'BUILDING' AND c_nationkey < 5")


def parquet_dir_glob(spark, d):
    where = workspace(spark, "tree")
    for k in range(3):
        load(spark, d, "nation").where(F.col("n_nationkey") % 3 == k).write.parquet(f"{where}/x{k}/y")
    return interop.read_tree(spark, where)


def export_parquet(spark, d):
    where = workspace(spark, "out")
    interop.export_parquet(load(spark, d, "supplier"), where)
    return spark.read.parquet(where)


def parallel_export_parquet(spark, d):
    where = workspace(spark, "out")
    interop.parallel_export_parquet(load(spark, d, "orders"), where, 4)
    return spark.read.parquet(where)


def export_arrow(spark, d):
    where, rows = workspace(spark, "arrow"), load(spark, d, "orders")
    interop.export_arrow(rows, where, 4)
    return interop.import_arrow(spark, where, rows.schema)


def import_arrow(spark, d):
    where, rows = workspace(spark, "arrow"), load(spark, d, "supplier")
    interop.export_arrow(rows, where, 2)
    return Table.create_as(spark, workspace(spark, "sup"), interop.import_arrow(spark, where, rows.schema)).scan()


def import_parquet(spark, d):
    t = Table.create(spark, workspace(spark, "imp"), load(spark, d, "part").schema)
    interop.import_parquet(t, f"{d}/part.parquet")
    return t.scan()


def parallel_copy(spark, d):
    where, rows = workspace(spark, "copy"), load(spark, d, "orders")
    interop.write_copy_text(rows.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 9 == 0, None).otherwise(F.concat("o_orderpriority", F.lit("\t\\x\n")))), where)
    t = Table.create_as(spark, workspace(spark, "ord"), interop.read_copy_text(spark, where, rows.schema))
    return t.scan(columns=["o_orderkey", "o_totalprice", "o_orderpriority"])


def copy_from(spark, d):
    where, rows = workspace(spark, "csv"), load(spark, d, "supplier")
    rows.write.option("header", "true").csv(where)
    return spark.read.schema(rows.schema).option("header", "true").csv(where)


def analyze_exact(spark, d):
    got = statistics.summary(load(spark, d, "events"), ["user_id", "event_type", "event_id"])
    return got.select("attname", F.round("null_frac", 6).alias("null_frac"), F.round("n_distinct", 6).alias("n_distinct"))


def analyze_mcv(spark, d):
    return statistics.most_common(load(spark, d, "orders"), "o_custkey", 20).select("value", F.round("freq", 9).alias("freq"))


def analyze_histogram(spark, d):
    return statistics.histogram(load(spark, d, "part"), "p_partkey", 10)


def percentile_disc(spark, d):
    return dialect.percentile_disc_any(load(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", 0.4, "status")


def groupby_cap(spark, d):
    rows = dialect.group_cap(load(spark, d, "orders"), ["o_orderpriority"], 100)
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def fn_date_trunc_long(spark, d):
    o = load(spark, d, "orders")
    return o.select("o_orderkey", *[dialect.date_trunc(u, F.col("o_orderdate")).alias(u) for u in ("decade", "century", "millennium")])


def agg_sum_exact(spark, d):
    return load(spark, d, "lineitem").agg((dialect.sum_exact(F.col("l_orderkey"))).cast("long").alias("s"))


def approx_distinct(spark, d):
    """Within 10 percent of the exact number of values."""
    keys = load(spark, d, "orders").select("o_custkey")
    # In one aggregation each value of the exact count would carry the registers of an estimate, 3 KB.
    exact = keys.distinct().agg(F.count("o_custkey").alias("e"))
    got = keys.agg(F.approx_count_distinct("o_custkey", 0.02).alias("a")).crossJoin(exact)
    return got.select((F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e")).alias("close"))


NAMES = [read_parquet, read_parquet_field_ids, parquet_schema, fdw_parquet, hive_partitions, hive_partition_prune, parquet_dir_glob, export_parquet, parallel_export_parquet, export_arrow, import_arrow, import_parquet, parallel_copy, copy_from, analyze_exact, analyze_mcv, analyze_histogram, percentile_disc, groupby_cap, fn_date_trunc_long, agg_sum_exact, approx_distinct]

_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS attname, ROUND(CAST(1 - COUNT({c}) / COUNT(*) AS DOUBLE), 6) AS null_frac, ROUND(CASE WHEN COUNT(DISTINCT {c}) > 0.1 * COUNT(*) THEN -COUNT(DISTINCT {c}) / COUNT(*) ELSE COUNT(DISTINCT {c}) END, 6) AS n_distinct FROM events"
    for c in ("user_id", "event_type", "event_id")
)
_YEAR = "MAKE_TIMESTAMP(CAST({} AS BIGINT), 1, 1, 0, 0, 0.0)"
ORACLE = {
    "groupby_cap": "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority",
    "read_parquet": "SELECT p_partkey AS a, p_name AS b, p_brand AS c, p_type AS d, CAST(p_size AS BIGINT) AS e, p_retailprice AS f FROM part",
    "read_parquet_field_ids": "SELECT n_regionkey AS region, n_name AS name FROM nation",
    "parquet_schema": "SELECT * FROM (VALUES ('o_orderkey', 'int8'), ('o_custkey', 'int8'), ('o_orderstatus', 'text'), ('o_totalprice', 'float8'), ('o_orderdate', 'timestamp'), ('o_orderpriority', 'text')) t(name, type)",
    "fdw_parquet": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 4",
    "hive_partitions": "SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer",
    "hive_partition_prune": "SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 5",
    "parquet_dir_glob": "SELECT * FROM nation",
    "export_parquet": "SELECT * FROM supplier",
    "parallel_export_parquet": "SELECT * FROM orders",
    "export_arrow": "SELECT * FROM orders",
    "import_arrow": "SELECT * FROM supplier",
    "import_parquet": "SELECT * FROM part",
    "parallel_copy": "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority || chr(9) || chr(92) || 'x' || chr(10) END AS o_orderpriority FROM orders",
    "copy_from": "SELECT * FROM supplier",
    "analyze_exact": _STATS,
    "analyze_mcv": "SELECT o_custkey AS value, ROUND(COUNT(*) / (SELECT COUNT(*) FROM orders), 9) AS freq FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1 ORDER BY COUNT(*) DESC, o_custkey LIMIT 20",
    "analyze_histogram": "SELECT CAST(k AS INT) AS nth, p_partkey AS value FROM (SELECT p_partkey, ROW_NUMBER() OVER (ORDER BY p_partkey) AS r, COUNT(*) OVER () AS n FROM part) t, (SELECT UNNEST(GENERATE_SERIES(0, 10)) AS k) s WHERE r = 1 + k * (n - 1) // 10",
    "percentile_disc": "SELECT o_orderpriority, PERCENTILE_DISC(0.4) WITHIN GROUP (ORDER BY o_orderstatus) AS status FROM orders GROUP BY o_orderpriority",
    "fn_date_trunc_long": f"SELECT o_orderkey, {_YEAR.format('YEAR(o_orderdate) // 10 * 10')} AS decade, {_YEAR.format('(YEAR(o_orderdate) - 1) // 100 * 100 + 1')} AS century, {_YEAR.format('(YEAR(o_orderdate) - 1) // 1000 * 1000 + 1')} AS millennium FROM orders",
    "agg_sum_exact": "SELECT CAST(SUM(l_orderkey) AS BIGINT) AS s FROM lineitem",
    "approx_distinct": "SELECT true AS close",
}


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
