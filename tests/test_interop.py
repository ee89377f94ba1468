import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.functions.zorder import bits, float_ordinal
from lithic.session import workspace
from lithic.sources import files, interop


def test_positional_read_needs_every_column(spark, sf):
    with pytest.raises(ValueError):
        interop.read_parquet(spark, f"{sf}/nation.parquet", T.StructType([T.StructField("a", T.IntegerType())]))


def test_missing_field_id(spark, sf):
    with pytest.raises(ValueError):
        interop.read_parquet_field_ids(spark, f"{sf}/nation.parquet", T.StructType([T.StructField("a", T.IntegerType())]), [99])


def test_copy_text_round_trip(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    rows = [(1, "tab\there"), (2, None), (None, ""), (3, "line\nbreak \\ \\n \r"), (4, "\\N"), (5, "|bar|")]
    for delimiter in ("\t", "|"):
        where = workspace(spark, "copy")
        interop.write_copy_text(spark.createDataFrame(rows, schema), where, delimiter)
        assert sorted(map(str, interop.read_copy_text(spark, where, schema, delimiter).collect())) == sorted(map(str, spark.createDataFrame(rows, schema).collect()))


def test_split_offsets(spark, tmp_path):
    for raw in (b"".join(b"%d line\n" % n for n in range(100)), b"x" * 200_000 + b"\nshort", b"", b"no end"):
        (tmp_path / "lines.txt").write_bytes(raw)
        for workers in (1, 3, 7, 200):
            at = interop.file_split_offsets(spark, str(tmp_path / "lines.txt"), workers)
            assert len(at) == workers + 1 and at[0] == 0 and at[-1] == len(raw) and at == sorted(at)
            assert all(a in (0, len(raw)) or raw[a - 1 : a] == b"\n" for a in at)


def test_arrow_files_are_plain_streams(spark, tmp_path):
    import pyarrow as pa

    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"), F.array("id").alias("a"))
    assert interop.export_arrow(rows, f"{tmp_path}/out", 3) == 1000
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if p.name[0] not in "._")
    assert names == [f"part-0000{k}.arrows" for k in range(3)] and (tmp_path / "out" / "_SUCCESS").exists()
    assert sum(pa.ipc.open_stream((tmp_path / "out" / n).read_bytes()).read_all().num_rows for n in names) == 1000
    assert sorted(map(str, interop.import_arrow(spark, f"{tmp_path}/out", rows.schema).collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(FileExistsError):
        interop.export_arrow(rows, f"{tmp_path}/out")
    assert interop.export_arrow(rows.where("id < 0"), f"{tmp_path}/none") == 0
    assert interop.import_arrow(spark, f"{tmp_path}/none", rows.schema).count() == 0
    with pytest.raises(Exception, match="stop"):
        interop.export_arrow(rows.withColumn("x", F.when(F.col("id") == 500, F.raise_error(F.lit("stop")))), f"{tmp_path}/broken")
    assert not (tmp_path / "broken").exists()


def test_arrow_of_others_is_cast(spark, tmp_path):
    import pyarrow as pa

    table = pa.table({"more": [1, 2, 3], "s": pa.array(["a", "b", "a"]).dictionary_encode(), "n": pa.array([1, None, 3], pa.int16())})
    (tmp_path / "in").mkdir()
    with pa.ipc.new_stream(str(tmp_path / "in" / "x.arrows"), table.schema) as out:
        out.write_table(table)
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.StringType())])
    got = interop.import_arrow(spark, f"{tmp_path}/in", schema).collect()
    assert [(r.n, r.s) for r in got] == [(1, "a"), (None, "b"), (3, "a")]


def test_hive_paths_must_name_the_partitions(spark, sf):
    with pytest.raises(ValueError):
        interop.read_hive(spark, f"{sf}/nation.parquet", T.StructType([]), ["region"])


def test_create_is_exclusive(spark):
    where = workspace(spark, "log") + "/x.json"
    files.create_text(spark, where, "é")
    assert files.read_text(spark, where) == "é"
    with pytest.raises(files.Exists):
        files.create_text(spark, where, "b")


def test_ordinals_keep_order(spark):
    values = [float("-inf"), -1e300, -2.5, -1e-3, 0.0, 1e-3, 2.5, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v double").select("n", float_ordinal(F.col("v")).alias("o"))
    got = [r.o for r in df.orderBy("n").collect()]
    assert got == sorted(got)
    ints = [None, -(1 << 63), -5, 0, 7, (1 << 63) - 1]
    keys = [r.k for r in spark.createDataFrame([(n, v) for n, v in enumerate(ints)], "n int, v long").select("n", bits(F.col("v")).alias("k")).orderBy("n").collect()]
    assert keys[0] == "0" * 64 and keys[1:] == sorted(keys[1:])


def test_schema_is_of_the_first_of_many_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"first": [1]}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"other": ["x" * 500], "more": [2]}), tmp_path / "b0.parquet")
    whole = (tmp_path / "b0.parquet").read_bytes()
    for n in range(1, 1100):
        (tmp_path / f"b{n}.parquet").write_bytes(whole)
    assert [r.name for r in interop.parquet_schema(spark, str(tmp_path)).collect()] == ["first"]
