"""Pruning changes what is read, never what is returned; commits are all or nothing."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.operators.predicate import Compare, Prefix, between
from lithic.operators.table import ConcurrentModification, ConstraintViolation, Table
from lithic.plans.table_queries import make
from lithic.session import workspace

ROWS = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("s", T.StringType())])


def fresh(spark, **options):
    return Table.create(spark, workspace(spark, "test"), ROWS, **options)


def ids(table, *args):
    return sorted(r.id for r in table.scan(*args).collect())


@pytest.fixture(scope="module")
def ten(spark):
    """Ten segments of 100 rows; v is null in the last, NaN once; s has prefixes."""
    t = fresh(spark)
    for k in range(10):
        df = spark.range(k * 100, k * 100 + 100).select("id", F.when(F.col("id") >= 900, None).when(F.col("id") == 555, float("nan")).otherwise(F.col("id") * 1.5).alias("v"), F.concat(F.lit(chr(97 + k)), F.col("id")).alias("s"))
        t.insert(df.coalesce(1))
    return t


PREDICATES = [
    (Compare("id", "=", 250), 1), (Compare("id", "<", 100), 1), (Compare("id", "<=", 100), 2), (Compare("id", ">", 899), 1), (Compare("id", ">=", 899), 2),
    (between("id", 150, 349), 3), (Prefix("s", "c2"), 1), (Compare("v", ">", 1e9), 1), (Compare("v", "<", 30.0), 1), (Compare("id", ">", 300) & Compare("s", "=", "f501"), 1), (Compare("id", "=", 5000), 0),
]


@pytest.mark.parametrize("predicate,most", PREDICATES)
def test_pruned_equals_unpruned(ten, predicate, most):
    pruned = sorted(map(str, ten.scan(predicate).collect()))
    assert ten.last_report.total == 10 and ten.last_report.read == most
    assert pruned == sorted(map(str, ten.scan(predicate, prune=False).collect()))


def test_statistics_answer_without_rows(ten):
    got = ten.aggregate(n=("count", "*"), k=("count", "v"), lo=("min", "id"), hi=("max", "s"), s=("sum", "id"), a=("avg", "id")).first()
    assert tuple(got) == (1000, 900, 0, "j999", 499500, 499.5)
    plan = ten.aggregate(n=("count", "*"))._jdf.queryExecution().toString()
    assert "_manifest" in plan and "/data/" not in plan


def test_sum_of_doubles_reads_rows(ten):
    assert ten.aggregate(m=("max", "v")).first().m != ten.aggregate(s=("sum", "id")).first().s


def test_empty_table(spark):
    t = fresh(spark)
    assert t.scan().count() == 0 and t.aggregate(n=("count", "*"), m=("min", "id"), s=("sum", "id")).first() == (0, None, None)
    assert t.delete() == 0 and t.compact() == 0 and t.compact_rewrite() == 0
    t.vacuum()
    assert t.sort_status().first().total_groups == 0


def test_dml_and_maintenance(spark):
    t = fresh(spark)
    t.insert(spark.range(1000).select("id", (F.col("id") * 1.0).alias("v"), F.lit("x").alias("s")).repartitionByRange(4, "id"))
    assert t.delete(F.col("id") < 300) == 300
    assert t.aggregate(n=("count", "*"), lo=("min", "id"), s=("sum", "id")).first() == (700, 300, sum(range(300, 1000)))
    assert t.maintenance_due().first().recommendation == "compact_rewrite"
    assert t.compact() == 1 and t.compact_rewrite(0.1) == 1 and ids(t) == list(range(300, 1000))
    assert t.update({"s": F.lit("y")}, Compare("id", ">=", 990)) == 10
    assert t.scan(Compare("s", "=", "y")).count() == 10
    t.vacuum_sorted("id")
    assert t.sort_status().first().sorted_rows == 700 and t.aggregate(n=("count", "*")).first().n == 700
    assert t.vacuum_files() > 0 and ids(t) == list(range(300, 1000))
    t.truncate()
    assert t.scan().count() == 0


def test_transactions_and_conflicts(spark):
    t = fresh(spark)
    t.insert(spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], ROWS))
    with pytest.raises(RuntimeError), t.transaction():
        t.delete(F.col("id") == 1)
        assert ids(t) == [2]
        raise RuntimeError
    assert ids(t) == [1, 2]
    with t.transaction():
        t.insert(spark.createDataFrame([(3, 3.0, "c")], ROWS))
        with pytest.raises(RuntimeError), t.transaction():
            t.delete()
            raise RuntimeError
    assert ids(t) == ids(Table.open(spark, t.path)) == [1, 2, 3]
    other = Table.open(spark, t.path)
    t.delete(F.col("id") == 1)
    with pytest.raises(ConcurrentModification):
        other.update({"s": F.lit("z")}, F.col("id") == 1)
    late = Table.open(spark, t.path, version=t.version - 1)
    late.insert(spark.createDataFrame([(9, 9.0, "i")], ROWS))  # appends come after whatever came first
    assert ids(Table.open(spark, t.path)) == [2, 3, 9]


def test_constraints(spark):
    t = fresh(spark, not_null=["id"], unique=[["id"]], checks=["v >= 0"])
    t.insert(spark.createDataFrame([(1, 1.0, "a")], ROWS))
    for bad in [(None, 1.0, "a"), (2, -1.0, "a"), (1, 1.0, "b")]:
        with pytest.raises(ConstraintViolation):
            t.insert(spark.createDataFrame([bad], ROWS))
    with pytest.raises(ConstraintViolation):
        t.merge(spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "b")], ROWS), ["id"], {"v": F.col("s.v")})
    assert ids(t) == [1]


def test_options_and_projections_are_validated(spark):
    t = fresh(spark)
    for bad in ({"row_group_rows": 10}, {"vector_rows": 1}, {"compression_level": 99}, {"compression": "zip"}, {"sort_by": ["nope"]}, {"what": 1}):
        with pytest.raises(ValueError):
            t.set_options(**bad)
    t.set_options(compression="lz4", sort_by=["v"])
    t.insert(spark.createDataFrame([(n, float(-n), str(n)) for n in range(50)], ROWS))
    t.vacuum_sorted()
    assert t.state["sort"]["columns"] == ["v"]
    t.add_projection("p", ["v", "id"], ["v"])
    for bad in (("p", ["v"], None), ("q", [], None), ("q", ["v", "v"], None), ("q", ["zz"], None), ("q", ["v"], ["id"])):
        with pytest.raises(ValueError):
            t.add_projection(*bad)
    t.delete(F.col("id") == 7)
    assert sorted(r.id for r in t.read_projection("p").collect()) == [n for n in range(50) if n != 7]
    assert t.select(["id"], Compare("v", "<", -40.0), sort_hint="v").count() == 9 and t.last_report.source == "p"
    t.insert(spark.createDataFrame([(99, 0.5, "n")], ROWS))
    assert t.read_projection("p").count() == 50
    with pytest.raises(ValueError):
        t.vacuum(1)


def test_zorder_reads_fewer_segments(spark):
    t = fresh(spark, row_group_rows=1000)
    t.insert(spark.range(20_000).select("id", ((F.col("id") * 7919) % 200).cast("double").alias("v"), F.lit("x").alias("s")).repartition(20))
    t.scan(Compare("id", "<", 2000)).count()
    before = t.last_report.read
    t.cluster("id", "v")
    assert t.scan(Compare("id", "<", 2000)).count() == 2000 and t.last_report.read < before
    assert t.recluster("id", "v") == 0


def test_sorted_range_prunes(spark, sf):
    t = make(spark, sf, "orders", row_group_rows=1000)
    t.vacuum_sorted("o_totalprice")
    assert t.manifest().count() >= 1


def test_raced_appends_have_row_ids_of_their_own(spark, tmp_path):
    t = Table.create_as(spark, f"file://{tmp_path}/t", spark.range(10))
    one, two = Table.open(spark, t.path), Table.open(spark, t.path)
    one.insert(spark.range(10, 20))
    two.insert(spark.range(20, 30))
    t = Table.open(spark, t.path)
    assert t.scan(meta=True).select("__row_id").distinct().count() == 30
    t.add_projection("p", ["id"])
    t.delete(F.col("id") % 3 == 0)
    t.insert(spark.range(30, 36))
    assert sorted(r.id for r in t.read_projection("p").collect()) == sorted(r.id for r in t.scan().collect()) == [n for n in range(36) if n % 3 or n >= 30]
    assert t.reconstruct_via_projection("p").count() == t.scan().count()


def test_projections_follow_every_rewrite(spark, tmp_path):
    t = Table.create_as(spark, f"file://{tmp_path}/t", spark.range(1000).select("id", (F.col("id") % 7).alias("k")), row_group_rows=1000)
    t.add_projection("p", ["k"], ["k"])

    def same():
        want = sorted((r.id, r.k) for r in t.scan().collect())
        assert sorted((r.id, r.k) for r in t.reconstruct_via_projection("p").collect()) == want and want

    t.delete(F.col("id") % 3 == 0)
    same()
    t.compact_rewrite(0.1)
    same()
    t.update({"k": F.col("k") + 100}, F.col("id") < 50)
    same()
    t.cluster("id", "k")
    t.insert(spark.range(2000, 2010).select("id", F.lit(1).cast("long").alias("k")))
    same()
    t.delete(F.col("id") >= 2000)
    t.compact()
    same()


def test_many_commits_are_folded(spark, tmp_path, monkeypatch):
    import lithic.operators.table as module

    monkeypatch.setattr(module, "FOLD", 3)
    t = Table.create(spark, f"file://{tmp_path}/t", spark.range(1).schema)
    for n in range(6):
        t.insert(spark.range(n * 10, n * 10 + 10))
        if n % 2:
            t.delete(F.col("id") == n * 10)
            t.delete(F.col("id") == n * 10 + 1)
    t = Table.open(spark, t.path)
    assert len(t.state["manifests"]) <= 4
    assert sorted(r.id for r in t.scan().collect()) == [n for n in range(60) if n not in (10, 11, 30, 31, 50, 51)]
    assert t.scan(meta=True).select("__row_id").distinct().count() == 54
    assert t.aggregate(n=("count", "*"), top=("max", "id")).first() == (54, 59)


def test_update_evaluates_its_rows_once(spark, tmp_path):
    t = Table.create_as(spark, f"file://{tmp_path}/t", spark.range(500).select("id", F.lit(0.0).alias("x")))
    n = t.update({"x": F.rand() + 1}, F.rand() < 0.5)
    assert t.scan().count() == 500 == t.scan().select("id").distinct().count()
    assert t.scan().where("x > 0").count() == n
    source = spark.range(1000).where(F.rand() < 0.5).select("id", F.lit(5.0).alias("x"))
    t.merge(source, ["id"], {"x": F.col("s.x")})
    assert t.scan().count() == t.scan().select("id").distinct().count() and t.scan().where("id < 500").count() == 500


def test_statistics_answer_again_after_add_column(spark, tmp_path):
    from pyspark.sql import types as T

    t = Table.create_as(spark, f"file://{tmp_path}/t", spark.range(100))
    t.add_column("note", T.StringType())
    t.add_column("n", T.LongType(), 7)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "/data/" not in plan(t.aggregate(n=("count", "*"), top=("max", "id")))
    assert t.aggregate(s=("sum", "n")).first().s == 700
    t.vacuum()
    df = t.aggregate(s=("sum", "n"), k=("count", "note"))
    assert "/data/" not in plan(df) and df.first() == (700, 0)
    t.insert(spark.range(1))
    assert t.scan().where("n = 7").count() == 101


def test_options_reach_the_files(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.range(20_000).select(F.col("id"), F.hash("id").alias("h"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    sizes = {}
    for level in (1, 19):
        t = Table.create_as(spark, f"file://{tmp_path}/t{level}", rows.coalesce(1), compression_level=level, vector_rows=500, sort_by=["h"], bloom=["id"], row_group_rows=20_000)
        sizes[level] = t.manifest().agg(F.sum("bytes")).first()[0]
        segment = t.manifest().first().segment.removeprefix("file://")
        got = pq.read_table(segment).column("h").to_pylist()
        assert got == sorted(got)
        assert pq.ParquetFile(segment).metadata.row_group(0).column(0).has_offset_index
    assert sizes[19] != sizes[1]


def test_stream_survives_commits_of_others(spark, tmp_path, monkeypatch):
    from lithic.streaming.ingest import append_stream

    spark.range(5).write.parquet(f"file://{tmp_path}/in")
    t = Table.create(spark, f"file://{tmp_path}/t", spark.range(1).schema)
    plain, first = Table._write_segments, []

    def raced(self, rows, folder, statistics=True):
        out = plain(self, rows, folder, statistics)
        if not first:
            first.append(1)
            Table.open(spark, t.path).insert(spark.range(100, 103))
        return out

    monkeypatch.setattr(Table, "_write_segments", raced)
    append_stream(spark.readStream.schema("id long").parquet(f"file://{tmp_path}/in"), t, f"file://{tmp_path}/c").awaitTermination()
    t = Table.open(spark, t.path)
    assert sorted(r.id for r in t.scan().collect()) == [0, 1, 2, 3, 4, 100, 101, 102] and list(t.state["stream"].values()) == [0]


def test_ranges_without_overlaps_and_portions(spark, tmp_path):
    kinds = "room string, since long, till long, price long"
    rows = lambda *r: spark.createDataFrame(list(r), kinds)
    t = Table.create(spark, f"file://{tmp_path}/t", rows(("a", 0, 1, 1)).schema, without_overlaps=[(["room"], "since", "till")])
    t.insert(rows(("a", 0, 10, 1), ("a", 10, 20, 2), ("b", 5, 15, 3)))
    for bad in (("a", 9, 11, 0), ("b", 0, 6, 0), ("a", 3, 4, 0), ("c", 5, 5, 0), ("c", None, 5, 0)):
        with pytest.raises(ConstraintViolation):
            t.insert(rows(bad))
    with pytest.raises(ConstraintViolation):
        t.insert(rows(("d", 0, 5, 0), ("d", 4, 6, 0)))
    assert t.change_portion("since", "till", 8, 12, {"price": F.col("price") + 100}, F.col("room") == "a") == 2
    assert sorted(tuple(r) for r in t.scan().collect()) == [("a", 0, 8, 1), ("a", 8, 10, 101), ("a", 10, 12, 102), ("a", 12, 20, 2), ("b", 5, 15, 3)]
    assert t.change_portion("since", "till", 7, 9, None) == 3
    assert sorted(tuple(r) for r in t.scan().collect()) == [("a", 0, 7, 1), ("a", 9, 10, 101), ("a", 10, 12, 102), ("a", 12, 20, 2), ("b", 5, 7, 3), ("b", 9, 15, 3)]


def test_conversion_and_vacuum_of_a_folder(spark, tmp_path):
    from lithic.operators.table import vacuum_full

    spark.range(30).write.parquet(f"file://{tmp_path}/plain")
    t = Table.convert(spark, f"file://{tmp_path}/plain", f"file://{tmp_path}/all/one")
    t.delete(F.col("id") < 10)
    t.unmanage(f"file://{tmp_path}/back")
    assert spark.read.parquet(f"file://{tmp_path}/back").count() == 20
    Table.create_as(spark, f"file://{tmp_path}/all/two", spark.range(3)).insert(spark.range(3))
    assert vacuum_full(spark, f"file://{tmp_path}/all") == 2
    again = Table.open(spark, t.path)
    assert again.scan().count() == 20 and not again.state["deletes"] and again.storage_id == t.storage_id
    t.drop()
    with pytest.raises(FileNotFoundError):
        Table.open(spark, t.path)


def test_imports_keep_constraints(spark, tmp_path):
    from lithic.sources import interop

    t = Table.create(spark, f"file://{tmp_path}/t", spark.range(1).schema, unique=[["id"]])
    spark.range(5).write.parquet(f"file://{tmp_path}/p")
    assert interop.import_parquet(t, f"file://{tmp_path}/p") == 5
    interop.export_arrow(spark.range(5, 8), f"file://{tmp_path}/a", 2)
    assert interop.import_arrow_into(t, f"file://{tmp_path}/a") == 3
    with pytest.raises(ConstraintViolation):
        interop.import_parquet(t, f"file://{tmp_path}/p")
    assert t.scan().count() == 8


def test_group_cap_and_sampled_statistics(spark):
    from lithic.functions.dialect import TooManyGroups, group_cap
    from lithic.operators.statistics import sampled_summary

    rows = spark.range(20_000).select((F.col("id") % 50).alias("few"), "id", F.when(F.col("id") % 4 == 0, F.col("id")).alias("some"))
    assert group_cap(rows, ["few"], 50).count() == 20_000 and group_cap(rows, ["id"], 0).count() == 20_000
    with pytest.raises(TooManyGroups):
        group_cap(rows, ["few"], 49)
    got = {r.attname: r for r in sampled_summary(rows, ["few", "id", "some"], sample=5000).collect()}
    assert got["few"].n_distinct == 50 and got["few"].null_frac == 0
    assert got["id"].n_distinct < -0.9 and abs(got["some"].null_frac - 0.75) < 0.03


def test_rows_are_fetched_by_number(spark, tmp_path):
    t = Table.create_as(spark, f"file://{tmp_path}/t", spark.range(40).repartitionByRange(4, "id"))
    t.delete(F.col("id") == 3)
    of = {r.id: r["__row_id"] for r in t.scan(meta=True).collect()}
    numbers = lambda *n: spark.createDataFrame([(x,) for x in n], "n long")
    assert sorted(r.id for r in t.fetch_rows(numbers(of[2], of[4], of[4], 999)).collect()) == [2, 4]
    assert t.fetch_rows(numbers(of[35])).count() == 1 and t.last_report.read == 1
    assert t.fetch_rows(numbers()).count() == 0 and t.last_report.read == 0
