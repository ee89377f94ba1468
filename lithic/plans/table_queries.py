"""Queries on managed tables: each builds a table from the test data, works on it, and returns what it holds."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.operators.predicate import Compare, Prefix, between
from lithic.operators.table import ROWS_A_TASK, Table
from lithic.session import load, workspace


def make(spark: SparkSession, sf_dir: str, name: str, parts: int = 6, sort: str | None = None, **options) -> Table:
    """A table of several segments, in key order by default, as a bulk load would leave it; at least ``parts``, and more where a task would sort too many rows."""
    rows = load(spark, sf_dir, name)
    parts = max(parts, -(-rows.count() // ROWS_A_TASK))
    rows = rows.repartitionByRange(parts, sort or rows.columns[0]).sortWithinPartitions(sort or rows.columns[0])
    return Table.create_as(spark, workspace(spark, name), rows, **options)


def scan_filter_pruned(spark, d):
    t = make(spark, d, "lineitem")
    return t.scan(between("l_orderkey", 2000, 4000) & Compare("l_quantity", ">", 20.0), ["l_orderkey", "l_linenumber", "l_quantity"])


def scan_zonemap_skip(spark, d):
    return make(spark, d, "orders").scan(Compare("o_orderkey", "<", 500))


def scan_bloom_eq(spark, d):
    """Equality by Parquet bloom filters, sized by the column's distinct count."""
    rows = load(spark, d, "orders")
    distinct = rows.agg(F.approx_count_distinct("o_custkey")).first()[0]
    where = workspace(spark, "bloom")
    rows.repartition(6).write.option("parquet.bloom.filter.enabled#o_custkey", "true").option("parquet.bloom.filter.expected.ndv#o_custkey", str(max(1, distinct))).parquet(where)
    return spark.read.parquet(where).where("o_custkey = 77").select("o_orderkey", "o_custkey")


def scan_projection_copy(spark, d):
    t = make(spark, d, "lineitem", sort="l_shipdate")
    t.add_projection("by_supplier", ["l_suppkey", "l_quantity"], ["l_suppkey"])
    t.delete(F.col("l_linenumber") == 3)
    return t.select(["l_suppkey", "l_quantity"], Compare("l_suppkey", "=", 5), sort_hint="l_suppkey")


def point_lookup(spark, d):
    return make(spark, d, "orders").point_lookup("o_orderkey", 4321)


def missing_value(spark, d):
    t = make(spark, d, "customer")
    t.add_column("grade", T.StringType(), "none")
    t.insert(load(spark, d, "customer").where("c_custkey <= 50").withColumn("c_custkey", F.col("c_custkey") + 1_000_000).withColumn("grade", F.lit("new")))
    return t.scan(columns=["c_custkey", "grade"])


def insert_select(spark, d):
    t = Table.create(spark, workspace(spark, "ins"), load(spark, d, "orders").schema)
    t.insert(load(spark, d, "orders").where("o_orderstatus = 'O'"))
    t.insert(load(spark, d, "orders").where("o_orderstatus = 'F'"))
    return t.scan()


def ctas(spark, d):
    top = load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return Table.create_as(spark, workspace(spark, "ctas"), top).scan()


def delete_rows(spark, d):
    t = make(spark, d, "lineitem")
    t.delete(F.col("l_orderkey") % 7 == 0)
    t.delete(Compare("l_quantity", ">", 45.0))
    return t.scan(columns=["l_orderkey", "l_linenumber"])


def update_rows(spark, d):
    t = make(spark, d, "orders")
    t.update({"o_orderstatus": F.lit("X"), "o_custkey": F.col("o_custkey") + 1}, Compare("o_orderkey", "<", 1000))
    return t.scan(columns=["o_orderkey", "o_custkey", "o_orderstatus"])


def merge_into(spark, d):
    t = make(spark, d, "customer")
    source = load(spark, d, "customer").where("c_custkey % 5 = 0").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") + 1_000_000).otherwise(F.col("c_custkey")).alias("c_custkey"), F.lit("merged").alias("c_name"))
    t.merge(source, ["c_custkey"], {"c_name": F.col("s.c_name")})
    return t.scan(columns=["c_custkey", "c_name", "c_mktsegment"])


def insert_on_conflict_nothing(spark, d):
    t = make(spark, d, "supplier")
    more = load(spark, d, "supplier").withColumn("s_suppkey", F.col("s_suppkey") * 2).withColumn("s_name", F.lit("other"))
    t.insert_ignoring_conflicts(more, ["s_suppkey"])
    return t.scan(columns=["s_suppkey", "s_name"])


def add_column(spark, d):
    t = make(spark, d, "nation", 2)
    t.add_column("note", T.IntegerType(), 7)
    return t.scan()


def alter_type(spark, d):
    t = make(spark, d, "nation", 2)
    t.alter_type("n_regionkey", T.LongType())
    return t.scan()


def generated_columns(spark, d):
    nation = load(spark, d, "nation")
    schema = T.StructType([*nation.schema.fields, T.StructField("twice", T.LongType())])
    t = Table.create(spark, workspace(spark, "gen"), schema, stored={"twice": "n_nationkey * 2"}, virtual={"label": "concat('r', n_nationkey)"})
    t.insert(nation)
    return t.scan()


def row_trigger_cdc(spark, d):
    t = make(spark, d, "nation", 2)
    t.update({"n_name": F.upper("n_name")}, F.col("n_regionkey") == 1)
    return t.change_feed().select("n_nationkey", "n_name", "_change")


def _dirty(spark, d) -> Table:
    t = make(spark, d, "lineitem")
    t.delete(Compare("l_orderkey", "<", 300))
    return t


def count_star_meta(spark, d):
    return _dirty(spark, d).aggregate(n=("count", "*"))


def agg_meta_minmax(spark, d):
    return _dirty(spark, d).aggregate(lo=("min", "l_quantity"), hi=("max", "l_shipdate"), first_key=("min", "l_orderkey"))


def agg_meta_count_col(spark, d):
    return _dirty(spark, d).aggregate(n=("count", "l_returnflag"))


def agg_meta_sum_avg(spark, d):
    return _dirty(spark, d).aggregate(s=("sum", "l_linenumber"), a=("avg", "l_linenumber"))


def vacuum(spark, d):
    t = _dirty(spark, d)
    t.vacuum()
    return t.scan(columns=["l_orderkey", "l_linenumber"])


def vacuum_sorted(spark, d):
    t = make(spark, d, "orders", row_group_rows=2000)
    t.vacuum_sorted("o_totalprice")
    return t.scan(between("o_totalprice", 1000.0, 50000.0), ["o_orderkey", "o_totalprice"])


def zorder_cluster(spark, d):
    t = make(spark, d, "lineitem", row_group_rows=5000)
    t.cluster("l_partkey", "l_quantity")
    return t.scan(Compare("l_partkey", "<", 40) & Compare("l_quantity", "<", 10.0), ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])


def recluster(spark, d):
    t = make(spark, d, "orders", row_group_rows=2000)
    t.cluster("o_custkey", "o_totalprice")
    again = t.recluster("o_custkey", "o_totalprice")
    return t.scan(columns=["o_orderkey"]).withColumn("written_again", F.lit(again))


def compact(spark, d):
    t = make(spark, d, "orders")
    t.delete(Compare("o_orderkey", "<=", 4000))
    t.compact()
    return t.scan(columns=["o_orderkey"])


def compact_rewrite(spark, d):
    t = make(spark, d, "orders")
    t.delete((F.col("o_orderkey") < 6000) & (F.col("o_orderkey") % 3 == 0))
    t.compact_rewrite(0.2)
    return t.scan(columns=["o_orderkey", "o_custkey"])


def stats(spark, d):
    return _dirty(spark, d).stats().agg(F.sum("rows").alias("all_rows"), F.sum("deleted").alias("deleted"), F.max("chunks").alias("chunks"))


def sort_status(spark, d):
    t = make(spark, d, "supplier", 2)
    t.vacuum_sorted("s_acctbal")
    t.insert(load(spark, d, "supplier").where("s_suppkey <= 10").withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000))
    return t.sort_status().select("sort_key", "total_rows", "sorted_rows", "appended_rows")


def maintenance_due(spark, d):
    t = make(spark, d, "supplier", 2)
    t.delete(F.col("s_suppkey") % 2 == 0)
    return t.maintenance_due().select(F.round("deleted_fraction", 6).alias("deleted_fraction"), "recommendation")


def read_projection(spark, d):
    t = make(spark, d, "part")
    t.add_projection("by_size", ["p_size", "p_partkey"], ["p_size"])
    t.delete(F.col("p_partkey") % 10 == 0)
    return t.read_projection("by_size").select("p_size", "p_partkey")


def reconstruct_via_projection(spark, d):
    t = make(spark, d, "part")
    t.add_projection("by_size", ["p_size", "p_partkey"], ["p_size"])
    return t.reconstruct_via_projection("by_size", Compare("p_size", ">=", 48))


def scan_prefix_pruned(spark, d):
    t = make(spark, d, "part", sort="p_type")
    return t.scan(Prefix("p_type", "PROMO"), ["p_partkey", "p_type"])


def temporal_read(spark, d):
    """An older version is still readable after later commits."""
    t = make(spark, d, "nation", 1)
    t.delete(F.col("n_nationkey") > 10)
    return Table.open(spark, t.path, version=t.version - 1).scan()


NAMES = [scan_filter_pruned, scan_zonemap_skip, scan_bloom_eq, scan_projection_copy, scan_prefix_pruned, point_lookup, missing_value, insert_select, ctas, delete_rows, update_rows, merge_into, insert_on_conflict_nothing, add_column, alter_type, generated_columns, row_trigger_cdc, count_star_meta, agg_meta_minmax, agg_meta_count_col, agg_meta_sum_avg, vacuum, vacuum_sorted, zorder_cluster, recluster, compact, compact_rewrite, stats, sort_status, maintenance_due, read_projection, reconstruct_via_projection, temporal_read]

ORACLE = {
    "scan_filter_pruned": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 2000 AND 4000 AND l_quantity > 20",
    "scan_zonemap_skip": "SELECT * FROM orders WHERE o_orderkey < 500",
    "scan_bloom_eq": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 77",
    "scan_projection_copy": "SELECT l_suppkey, l_quantity FROM lineitem WHERE l_suppkey = 5 AND l_linenumber <> 3",
    "scan_prefix_pruned": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'PROMO%'",
    "point_lookup": "SELECT * FROM orders WHERE o_orderkey = 4321",
    "missing_value": "SELECT c_custkey, 'none' AS grade FROM customer UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey <= 50",
    "insert_select": "SELECT * FROM orders WHERE o_orderstatus IN ('O', 'F')",
    "ctas": "SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey",
    "delete_rows": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_quantity <= 45",
    "update_rows": "SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey < 1000 THEN 1 ELSE 0 END AS o_custkey, CASE WHEN o_orderkey < 1000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "merge_into": "SELECT c_custkey, CASE WHEN c_custkey % 10 = 5 THEN 'merged' ELSE c_name END AS c_name, c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000, 'merged', NULL FROM customer WHERE c_custkey % 10 = 0",
    "insert_on_conflict_nothing": "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey * 2, 'other' FROM supplier WHERE s_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier)",
    "add_column": "SELECT *, 7 AS note FROM nation",
    "alter_type": "SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
    "generated_columns": "SELECT *, CAST(n_nationkey * 2 AS BIGINT) AS twice, 'r' || n_nationkey AS label FROM nation",
    "row_trigger_cdc": "SELECT n_nationkey, n_name, 'delete' AS _change FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, UPPER(n_name), 'insert' FROM nation WHERE n_regionkey = 1",
    "count_star_meta": "SELECT COUNT(*) AS n FROM lineitem WHERE l_orderkey >= 300",
    "agg_meta_minmax": "SELECT MIN(l_quantity) AS lo, MAX(l_shipdate) AS hi, MIN(l_orderkey) AS first_key FROM lineitem WHERE l_orderkey >= 300",
    "agg_meta_count_col": "SELECT COUNT(l_returnflag) AS n FROM lineitem WHERE l_orderkey >= 300",
    "agg_meta_sum_avg": "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS s, AVG(l_linenumber) AS a FROM lineitem WHERE l_orderkey >= 300",
    "vacuum": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey >= 300",
    "vacuum_sorted": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000",
    "zorder_cluster": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_partkey < 40 AND l_quantity < 10",
    "recluster": "SELECT o_orderkey, 0 AS written_again FROM orders",
    "compact": "SELECT o_orderkey FROM orders WHERE o_orderkey > 4000",
    "compact_rewrite": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_orderkey < 6000 AND o_orderkey % 3 = 0)",
    "stats": "SELECT COUNT(*) AS all_rows, COUNT(*) FILTER (WHERE l_orderkey < 300) AS deleted, 11 AS chunks FROM lineitem",
    "sort_status": "SELECT 's_acctbal' AS sort_key, COUNT(*) + COUNT(*) FILTER (WHERE s_suppkey <= 10) AS total_rows, COUNT(*) AS sorted_rows, COUNT(*) FILTER (WHERE s_suppkey <= 10) AS appended_rows FROM supplier",
    "maintenance_due": "SELECT ROUND(COUNT(*) FILTER (WHERE s_suppkey % 2 = 0) / COUNT(*), 6) AS deleted_fraction, 'compact_rewrite' AS recommendation FROM supplier",
    "read_projection": "SELECT p_size, p_partkey FROM part WHERE p_partkey % 10 <> 0",
    "reconstruct_via_projection": "SELECT * FROM part WHERE p_size >= 48",
    "temporal_read": "SELECT * FROM nation",
}


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
