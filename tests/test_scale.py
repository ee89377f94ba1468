"""What a task gets is bounded: it doesn't grow with the table."""

import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from lithic.functions import zorder
from lithic.operators.table import Table
from lithic.plans import interop_queries, lifecycle_queries, table_queries
from lithic.sources import deletion_vectors as dv
from lithic.sources.snapshot_writer import SnapshotWriter


def test_counters_of_six_segments_hold_over_a_large_table(spark, tmp_path):
    spark.range(1_200_000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    rows = lifecycle_queries.explain_counters(spark, str(tmp_path)).collect()
    assert sorted(r.o_orderkey for r in rows) == list(range(400))
    assert {(r.total, r.adds_up, r.pruned) for r in rows} == {(6, True, True)}


def test_parts_of_a_load_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(table_queries, "ROWS_A_TASK", 500, raising=False)
    spark.range(6000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("s")).write.parquet(f"{tmp_path}/t.parquet")
    t = table_queries.make(spark, str(tmp_path), "t", 3)
    sizes = [r.rows for r in t.manifest().select("rows").collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1000 and t.scan().count() == 6000


def test_statistics_of_texts_need_no_sort_of_rows(spark, tmp_path, monkeypatch):
    """Plans of all that a load runs, without a sort by segment."""
    rows = spark.range(100).select("id", F.concat(F.lit("x"), F.col("id")).alias("s"), (F.lit((1 << 62) - 1) - F.col("id")).alias("big"), F.col("id").cast("int").alias("i"))
    t = Table.create(spark, f"file://{tmp_path}/t", rows.schema)
    seen = []
    monkeypatch.setattr(DataFrame, "withColumn", lambda df, *a, _old=DataFrame.withColumn: (seen.append(df._jdf.queryExecution().sparkPlan().toString()), _old(df, *a))[1])
    t.insert(rows.coalesce(1))
    monkeypatch.undo()
    plans = [p for p in seen if "Aggregate" in p]
    assert plans and not any("SortAggregate" in p for p in plans)
    m = t.manifest().first()
    assert (m["s.min"], m["s.max"], m["s.values"], int(m["big.sum"]), int(m["i.sum"])) == ("x0", "x99", 100, 100 * ((1 << 62) - 1) - 4950, 4950)
    assert m["bytes"] > 0


def test_small_segments_are_rewritten_by_few_tasks(spark, tmp_path):
    rows = spark.range(40_000).select("id", ((F.col("id") * 7919) % 211).alias("k"))
    t = Table.create_as(spark, f"file://{tmp_path}/t", rows, row_group_rows=1000)
    assert t._parts() == 1
    t.cluster("id", "k")
    assert t.manifest().count() == 40 and t.scan().count() == 40_000
    segments = [r.segment for r in t.manifest().select("segment").collect()]
    assert t._paths(segments) == [segments[0].rsplit("/", 1)[0]]  # one listing, not one a segment
    assert sorted(t._paths(segments[1:])) == sorted(segments[1:])
    assert t.scan((F.col("id") >= 0) & (F.col("k") < 5)).count() == rows.where("k < 5").count()


def test_keys_interleave_bits_in_order(spark):
    def plain(values):
        return "".join(format(v, f"0{zorder.BITS}b")[i] for i in range(zorder.BITS) for v in values)

    top, random_ = (1 << zorder.BITS) - 1, random.Random(5)
    for n in (1, 2, 3, 5):
        rows = [tuple(random_.choice((0, 1, top, random_.randrange(top), random_.randrange(9))) for _ in range(n)) for _ in range(200)]
        df = spark.createDataFrame(rows, [f"c{k}" for k in range(n)])
        got = df.select("*", zorder.interleaved([F.col(f"c{k}").cast("long") for k in range(n)]).alias("z")).orderBy("z").collect()
        words = [plain(r[:n]) for r in got]
        assert words == sorted(words) and len({r.z for r in got}) == len(set(rows))
    few = spark.createDataFrame([(None, 1.0), (3, 1.0), (9, 1.0)], "a long, b double")
    z = {r.a: r.z for r in few.select("a", zorder.zorder_key(few, ["a", "b"]).alias("z")).collect()}
    assert z[None] < z[3] < z[9]


def test_estimate_and_exact_count_are_aggregated_apart(spark, sf):
    df = interop_queries.approx_distinct(spark, sf)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    grouped = [line for line in plan.splitlines() if "HashAggregate(keys=[o_custkey" in line]
    assert grouped and not any("approx_count_distinct" in line for line in grouped)
    assert [r.close for r in df.collect()] == [True]


def test_vectors_are_packed_by_container(spark, tmp_path, monkeypatch):
    """No group and no batch holds a file's positions at once, and no group its name."""
    groups, encode = [], DataFrame.groupBy
    monkeypatch.setattr(DataFrame, "groupBy", lambda df, *c: (groups.append((df.columns, len(c))), encode(df, *c))[1])
    rows = spark.range(200_000).select("id", (F.col("id") * 2).alias("v"))
    w = SnapshotWriter(spark, f"file://{tmp_path}/t", rows.schema, version=3)
    w.append(rows.coalesce(1))
    groups.clear()
    w.delete_vectors((F.col("id") % 3 == 0) | (F.col("id") > 150_000) & (F.col("id") < 199_990))
    assert groups == [(["__nth", "__pos"], 2)]
    monkeypatch.undo()
    want = {k for k in range(200_000) if k % 3 and not 150_000 < k < 199_990}
    assert {r.id for r in w.table().scan().collect()} == want


def test_assembled_vectors_are_those_of_all_positions():
    at = np.array([0, 5, 65_535, 65_536, *range(131_072, 190_000), 1 << 33, (1 << 33) + 70_000], np.int64)
    parts = {int(k): (int((at >> 16 == k).sum()), dv.container(at[at >> 16 == k] & 0xFFFF)) for k in np.unique(at >> 16)}
    assert dv.assemble(parts) == dv.encode(at) and (dv.decode(dv.encode(at)) == at).all()
