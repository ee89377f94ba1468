"""Queries on tables in the public Iceberg format, written by the query itself."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lithic.operators.predicate import Compare, between
from lithic.operators.table import ROWS_A_TASK
from lithic.session import load, workspace
from lithic.sources import avro
from lithic.sources.snapshot_writer import SnapshotWriter
from lithic.sources.snapshots import _bytes


def _orders(spark, d, **options) -> SnapshotWriter:
    """Orders in two appends, partitioned by status, each cut into ranges of the key: three, or more where a task would write too many rows."""
    rows = load(spark, d, "orders")
    parts = max(3, -(-rows.count() // (2 * ROWS_A_TASK)))
    w = SnapshotWriter(spark, workspace(spark, "lake"), rows.schema, ["o_orderstatus"], **options)
    for half in (0, 1):
        w.append(rows.where(F.col("o_orderkey") % 2 == half).repartitionByRange(parts, "o_orderkey"))
    return w


def iceberg_scan(spark, d):
    """Position deletes, then equality deletes, then rows that come back after them."""
    w = _orders(spark, d)
    w.delete_positions(F.col("o_orderkey") % 7 == 0)
    w.delete_equal(load(spark, d, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", "o_custkey"))
    w.append(load(spark, d, "orders").where("o_orderkey = 35"))
    return w.table().scan()


def iceberg_deletion_vectors(spark, d):
    w = _orders(spark, d, version=3)
    w.delete_vectors((F.col("o_orderkey") % 3 == 0) | F.col("o_orderkey").between(100, 300))
    return w.table().scan(columns=["o_orderkey", "o_totalprice"])


def iceberg_name_mapping(spark, d):
    """Files with field ids beside files that have none and name columns otherwise."""
    rows = load(spark, d, "supplier")
    names = [{"field-id": k + 1, "names": [n, f"old_{n}"]} for k, n in enumerate(rows.columns)]
    w = SnapshotWriter(spark, workspace(spark, "lake"), rows.schema, properties={"schema.name-mapping.default": json.dumps(names)})
    w.append(rows.where("s_suppkey % 2 = 0"))
    w.append(rows.where("s_suppkey % 2 = 1"), {n: f"old_{n}" for n in rows.columns})
    return w.table().scan()


def iceberg_fdw_prune(spark, d):
    t = _orders(spark, d).table()
    rows = t.scan(between("o_orderkey", 200, 500) & Compare("o_orderstatus", "=", "F"), ["o_orderkey", "o_orderstatus"])
    total, read = t.last_report
    return rows.withColumn("pruned", F.lit(0 < read < total // 2))


def iceberg_current_snapshot(spark, d):
    w = _orders(spark, d)
    w.delete_positions(F.col("o_orderkey") == 1)
    return w.table().current_snapshot().select("snapshot_id", "sequence_number", "timestamp_ms", "operation")


def iceberg_data_files(spark, d):
    """Rows by the records of the data files; a table with deletes refuses."""
    w = _orders(spark, d)
    total = w.table().data_files().agg(F.sum("record_count").alias("n"), F.max("content").alias("content"))
    w.delete_positions(F.col("o_orderkey") < 10)
    try:
        w.table().data_files()
        refused = False
    except ValueError:
        refused = True
    return total.withColumn("refused", F.lit(refused))


def read_avro_manifest(spark, d):
    """Rows a partition value, from the entries of the manifests."""
    t = _orders(spark, d).table()
    entries = [e["data_file"] for raw in _bytes(spark, [m["manifest_path"] for m in t.manifests()]) for e in avro.read_records(raw)[0]]
    rows = spark.createDataFrame([(e["partition"]["o_orderstatus"], e["record_count"]) for e in entries], "status string, n long")
    return rows.groupBy("status").agg(F.sum("n").alias("n"))


def read_manifest_list(spark, d):
    t = _orders(spark, d).table()
    return spark.createDataFrame([(m["sequence_number"], m["added_rows_count"]) for m in t.manifests()], "sequence_number long, added_rows long")


NAMES = [iceberg_scan, iceberg_deletion_vectors, iceberg_name_mapping, iceberg_fdw_prune, iceberg_current_snapshot, iceberg_data_files, read_avro_manifest, read_manifest_list]

ORACLE = {
    "iceberg_scan": "SELECT * FROM orders WHERE o_orderkey = 35 OR (o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0)",
    "iceberg_deletion_vectors": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 AND NOT o_orderkey BETWEEN 100 AND 300",
    "iceberg_name_mapping": "SELECT * FROM supplier",
    "iceberg_fdw_prune": "SELECT o_orderkey, o_orderstatus, true AS pruned FROM orders WHERE o_orderkey BETWEEN 200 AND 500 AND o_orderstatus = 'F'",
    "iceberg_current_snapshot": "SELECT CAST(3 AS BIGINT) AS snapshot_id, CAST(3 AS BIGINT) AS sequence_number, CAST(3000 AS BIGINT) AS timestamp_ms, 'delete' AS operation",
    "iceberg_data_files": "SELECT CAST(COUNT(*) AS BIGINT) AS n, 0 AS content, true AS refused FROM orders",
    "read_avro_manifest": "SELECT o_orderstatus AS status, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY 1",
    "read_manifest_list": "SELECT CAST(1 + o_orderkey % 2 AS BIGINT) AS sequence_number, CAST(COUNT(*) AS BIGINT) AS added_rows FROM orders GROUP BY 1",
}


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
