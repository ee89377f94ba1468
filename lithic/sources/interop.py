"""Reading and writing Parquet, Arrow and delimited text."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lithic.sources import files

#: Backslash escapes of the text format of COPY.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def _first_file(spark: SparkSession, path: str) -> str:
    """A file of the set: the first in order of names, with hidden ones left out."""
    first = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).agg(F.min("path")).first()[0]
    if first is None:
        raise FileNotFoundError(path)
    return first


def _footer(spark: SparkSession, path: str) -> pa.Schema:
    """Schema of the set's first file; only its footer is read where the file is local, else the file."""
    first = _first_file(spark, path)
    if first.startswith("file:"):
        return pq.read_schema("/" + first.removeprefix("file:").lstrip("/"))
    content = spark.read.format("binaryFile").load(first).select("content").first()[0]
    return pq.read_schema(pa.BufferReader(content))


def read_parquet(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """A file, folder or glob with its columns named by position and cast to the declared types.

    The number of columns must be the file's.  Dictionaries and statistics
    prune as ever, since names are mapped, not values.
    """
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    if len(rows.columns) != len(columns):
        raise ValueError(f"{len(columns)} columns declared, the file has {len(rows.columns)}")
    return rows.select(*[F.col(f"`{a}`").cast(f.dataType).alias(f.name) for a, f in zip(rows.columns, columns, strict=True)])


def read_parquet_field_ids(spark: SparkSession, path: str, columns: T.StructType, ids: list[int]) -> DataFrame:
    """Columns bound by Parquet field id, in any order; an id that the file lacks is an error."""
    have = {}
    for f in _footer(spark, path):
        if f.metadata and b"PARQUET:field_id" in f.metadata:
            have[int(f.metadata[b"PARQUET:field_id"])] = f.name
    if missing := [i for i in ids if i not in have]:
        raise ValueError(f"no columns with field ids {missing}")
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return rows.select(*[F.col(f"`{have[i]}`").cast(f.dataType).alias(f.name) for i, f in zip(ids, columns, strict=True)])


def sql_type(kind: pa.DataType) -> str:
    if pa.types.is_decimal(kind):
        return f"numeric({kind.precision},{kind.scale})"
    if pa.types.is_timestamp(kind):
        return "bigint" if kind.unit == "ns" else "timestamptz" if kind.tz else "timestamp"
    if pa.types.is_time(kind):
        return "time"
    if pa.types.is_fixed_size_binary(kind):
        return "uuid" if kind.byte_width == 16 else "bytea"
    plain = {pa.int8(): "int2", pa.int16(): "int2", pa.int32(): "int4", pa.int64(): "int8", pa.float32(): "float4", pa.float64(): "float8", pa.bool_(): "bool", pa.string(): "text", pa.large_string(): "text", pa.binary(): "bytea", pa.date32(): "date"}
    return plain.get(kind, "bytea" if pa.types.is_binary(kind) else str(kind))


def parquet_schema(spark: SparkSession, path: str) -> DataFrame:
    """name, type, nullable and field_id of each leaf of the set's first file."""
    rows: list[tuple] = []

    def walk(prefix: str, f: pa.Field) -> None:
        name = f"{prefix}{f.name}"
        if pa.types.is_struct(f.type):
            for k in range(f.type.num_fields):
                walk(f"{name}.", f.type.field(k))
        elif pa.types.is_list(f.type) or pa.types.is_large_list(f.type):
            walk(f"{name}.", f.type.value_field)
        else:
            at = (f.metadata or {}).get(b"PARQUET:field_id")
            rows.append((name, sql_type(f.type), f.nullable, int(at) if at else None))

    for f in _footer(spark, path):
        walk("", f)
    return spark.createDataFrame(rows, "name string, type string, nullable boolean, field_id int")


def read_hive(spark: SparkSession, path: str, schema: T.StructType, partitions: list[str]) -> DataFrame:
    """Files under col=value folders; the declared partition columns must all be in the paths."""
    probe = spark.read.parquet(path)
    if missing := [c for c in partitions if c not in probe.columns]:
        raise ValueError(f"the paths lack {missing}")
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def write_hive(rows: DataFrame, path: str, partitions: list[str]) -> None:
    rows.write.partitionBy(*partitions).parquet(path)


def read_tree(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """All files below a folder whose name fits the pattern; names that begin with _ or . are left out."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(path)


def export_parquet(rows: DataFrame, path: str) -> int:
    """One file in a folder.  For an interchange partner that wants just that; use parallel_export_parquet for large tables."""
    rows.coalesce(1).write.mode("errorifexists").option("compression", "uncompressed").parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def parallel_export_parquet(rows: DataFrame, path: str, workers: int) -> int:
    """A folder of files, written at once; the folder must be new; the success marker comes last."""
    rows.repartition(workers).write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.parquet(path).count()


#: Stores that Arrow opens by itself, with the scheme that it knows each by.
ARROW_STORES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}


def _arrow_uri(uri: str) -> str | None:
    scheme, rest = uri.split(":", 1)
    known = ARROW_STORES.get(scheme)
    return known and f"{known}://{'/' if known == 'file' else ''}{rest.lstrip('/')}"


def export_arrow(rows: DataFrame, path: str, workers: int | None = None) -> int:
    """A new folder of Arrow IPC streams, part-00000.arrows and so on, one a partition; returns the number of rows.

    Tasks write straight to the store, batch by batch, under names of their
    own; what the tasks that counted wrote is then moved into place, so a task
    that runs twice leaves nothing behind, and the success marker comes last.
    Any reader of Arrow streams opens the files.  Empty partitions leave no
    file; an empty table leaves one without batches.
    """
    import uuid

    spark = rows.sparkSession
    where = files.qualified(spark, path)
    uri = _arrow_uri(where)
    if uri is None:
        raise ValueError(f"Arrow knows no store for {where}")
    if files.exists(spark, where):
        raise FileExistsError(where)
    draft = f"_draft-{uuid.uuid4().hex}"

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(f"{uri}/{draft}")
        store.create_dir(folder, recursive=True)
        part, name = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.arrows"
        writer, n = None, 0
        with store.open_output_stream(f"{folder}/{name}") as sink:
            for b in batches:
                writer = writer or pa.ipc.new_stream(sink, b.schema)
                writer.write_batch(b)
                n += b.num_rows
            if writer:
                writer.close()
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n": pa.array([n], pa.int64())})

    source = rows.repartition(workers) if workers else rows
    try:
        done = source.mapInArrow(write, "part int, name string, n long").orderBy("part").collect()
        for k, r in enumerate(done):
            files.move(spark, f"{where}/{draft}/{r.name}", f"{where}/part-{k:05d}.arrows")
        if not done:
            sink = pa.BufferOutputStream()
            pa.ipc.new_stream(sink, to_arrow_schema(rows.schema)).close()
            files.create_bytes(spark, f"{where}/part-00000.arrows", sink.getvalue().to_pybytes())
        files.remove(spark, f"{where}/{draft}")
    except BaseException:
        files.remove(spark, where)
        raise
    files.create_text(spark, f"{where}/_SUCCESS", "")
    return sum(r.n for r in done)


def import_arrow(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a folder's .arrows files, which are Arrow IPC streams, each read by one task, batch by batch.

    Columns are taken by name and cast to ``schema``, dictionaries unpacked; a
    column that a file lacks is an error.  In stores that Arrow doesn't know
    Spark reads the files, each as a whole.
    """
    import re

    target = pa.schema([f.with_nullable(True) for f in to_arrow_schema(schema)])
    direct = _arrow_uri(files.qualified(spark, path)) is not None

    def unpack(batches):
        from pyarrow import fs

        for b in batches:
            for at in b.column(0).to_pylist():
                if direct:
                    store, name = fs.FileSystem.from_uri(_arrow_uri(re.sub("^file:/+", "file:///", at)))
                    stream = store.open_input_stream(name)
                else:
                    stream = pa.BufferReader(at)
                with stream, pa.ipc.open_stream(stream) as got:
                    for batch in got:
                        yield from pa.Table.from_batches([batch]).select(target.names).cast(target).to_batches()

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrows").load(path)
    return found.select("path" if direct else "content").mapInArrow(unpack, schema)


def import_parquet(table, path: str) -> int:
    """Insert the rows of Parquet files into a managed table, by column name, under its constraints; returns how many."""
    rows = table.spark.read.parquet(path)
    if unknown := [c for c in rows.columns if c not in table.schema.names]:
        raise ValueError(f"the table has no columns {unknown}")
    table.insert(rows)
    return rows.count()


def import_arrow_into(table, path: str) -> int:
    """Insert the rows of Arrow streams into a managed table, under its constraints; returns how many."""
    rows = import_arrow(table.spark, path, table.schema)
    table.insert(rows)
    return rows.count()


def read_copy_text(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = "\t", null: str = "\\N") -> DataFrame:
    """COPY's text format, split by Spark at line ends: fields by a delimiter, backslash escapes, a marker for null."""
    # A line holds no line break, so marks that begin with one can stand for escaped characters.
    slash, escaped = "\n1", "\n2"
    safe = F.replace(F.replace(F.col("value"), F.lit("\\\\"), F.lit(slash)), F.lit("\\" + delimiter), F.lit(escaped))
    fields = F.split(safe, f"\\Q{delimiter}\\E", -1)
    rows = spark.read.text(path).where(F.col("value") != "\\.").select(fields.alias("f"))
    wrong = F.raise_error(F.concat(F.lit("a line has "), F.size("f").cast("string"), F.lit(f" fields, not {len(schema)}")))
    rows = rows.where(F.when(F.size("f") == len(schema), F.lit(True)).otherwise(wrong.cast("boolean")))

    def plain(c):
        for k, v in ESCAPES.items():
            c = F.replace(c, F.lit("\\" + k), F.lit("\n3" if v == "\n" else v))
        c = F.regexp_replace(c, r"\\(.)", "$1")
        for mark, v in ((slash, "\\"), (escaped, delimiter), ("\n3", "\n")):
            c = F.replace(c, F.lit(mark), F.lit(v))
        return c

    return rows.select(*[F.when(F.col("f")[k] != null, plain(F.col("f")[k])).cast(f.dataType).alias(f.name) for k, f in enumerate(schema)])


def write_copy_text(rows: DataFrame, path: str, delimiter: str = "\t", null: str = "\\N") -> None:
    def quoted(name: str):
        c = F.replace(F.col(f"`{name}`").cast("string"), F.lit("\\"), F.lit("\\\\"))
        for k, v in ESCAPES.items():
            c = F.replace(c, F.lit(v), F.lit("\\" + k))
        if delimiter != "\t":
            c = F.replace(c, F.lit(delimiter), F.lit("\\" + delimiter))
        return F.coalesce(c, F.lit(null))

    rows.select(F.concat_ws(delimiter, *[quoted(c) for c in rows.columns]).alias("value")).write.text(path)


def file_split_offsets(spark: SparkSession, path: str, workers: int) -> list[int]:
    """Offsets at which ``workers`` readers of a text file can start on whole lines, and its end; only what surrounds them is read."""
    with files.opened(spark, path) as (read_at, size):
        out = [0]
        for k in range(1, workers):
            at = max(out[-1], k * size // workers - 1)
            while at < size:
                piece = read_at(at, 1 << 16)
                if (end := piece.find(b"\n")) >= 0:
                    at += end + 1
                    break
                at += len(piece)
            out.append(min(at, size))
    return [*out, size]
