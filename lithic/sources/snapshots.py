"""Reads the current snapshot of tables in the public Iceberg format.

The driver reads the metadata, leaves out data files that the predicate can't
match (by partition values and column bounds), and hands Spark plain Parquet
paths; deletes are anti-joins by file and position, or by values.  Deletion
vectors are unpacked by executors.  Files without field ids are bound by the
table's name mapping.
"""

from __future__ import annotations

import datetime
import json
import re
import struct
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.operators.predicate import Both, Compare, Predicate
from lithic.sources import avro, files

#: Positions of a deletion vector that become rows at once.
SLICE = 65_536
EPOCH = datetime.date(1970, 1, 1)
_PLAIN = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "string": T.StringType(), "binary": T.BinaryType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "uuid": T.StringType()}


@dataclass
class DataFile:
    path: str
    records: int
    content: int  # 0 data, 1 position deletes, 2 equality deletes
    sequence: int
    spec: int
    partition: dict[str, Any]
    lower: dict[int, bytes] = field(default_factory=dict)
    upper: dict[int, bytes] = field(default_factory=dict)
    equality_ids: list[int] = field(default_factory=list)
    vector: tuple[str, int, int] | None = None  # data file, offset and size of a deletion vector's blob


def spark_type(kind: Any) -> T.DataType:
    if isinstance(kind, str):
        if m := re.match(r"decimal\((\d+), *(\d+)\)", kind):
            return T.DecimalType(int(m[1]), int(m[2]))
        return _PLAIN[kind]
    if kind["type"] == "struct":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in kind["fields"]])
    if kind["type"] == "list":
        return T.ArrayType(spark_type(kind["element"]))
    return T.MapType(spark_type(kind["key"]), spark_type(kind["value"]))


def _bare(path: str) -> str:
    return re.sub("^[a-z0-9]+:/+", "/", path)


def _bare_column(c) -> Column:
    return F.regexp_replace(c, "^[a-z0-9]+:/+", "/")


def _bytes(spark: SparkSession, paths: list[str]) -> list[bytes]:
    """The files' contents, in one job."""
    if not paths:
        return []
    got = {_bare(r.path): bytes(r.content) for r in spark.read.format("binaryFile").load(paths).select("path", "content").collect()}
    return [got[_bare(p)] for p in paths]


def bucket(value: Any, kind: str, n: int) -> int:
    """The bucket transform: 32-bit Murmur3 of the value's bytes, without the sign, modulo n."""
    raw = value.encode() if kind == "string" else struct.pack("<q", int(value)) if kind in ("int", "long") else struct.pack("<q", (value - EPOCH).days) if kind == "date" else bytes(value)
    return (murmur3(raw) & 0x7FFFFFFF) % n


def murmur3(raw: bytes) -> int:
    mask, h = 0xFFFFFFFF, 0
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    for at in range(0, len(raw), 4):
        k = int.from_bytes(raw[at : at + 4], "little")
        k = (turn((k * 0xCC9E2D51) & mask, 15) * 0x1B873593) & mask
        h ^= k
        if at + 4 <= len(raw):
            h = (turn(h, 13) * 5 + 0xE6546B64) & mask
    h ^= len(raw)
    for r, m in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = ((h ^ (h >> r)) * m) & mask
    return h ^ (h >> 16)


def transform(name: str, kind: str, value: Any) -> Any:
    """A partition transform of a value; None where it isn't known here."""
    if value is None:
        return None
    if name == "identity":
        return value
    if m := re.match(r"(bucket|truncate)\[(\d+)\]", name):
        n = int(m[2])
        if m[1] == "bucket":
            return bucket(value, kind, n) if kind in ("int", "long", "string", "date") else None
        return value[:n] if kind == "string" else value - value % n if kind in ("int", "long") else None
    if kind not in ("date", "timestamp", "timestamptz"):
        return None
    at = value if isinstance(value, datetime.datetime) else datetime.datetime.combine(value, datetime.time())
    days = (at.date() - EPOCH).days
    return {"year": at.year - 1970, "month": (at.year - 1970) * 12 + at.month - 1, "day": days, "hour": days * 24 + at.hour}.get(name)


def bound(raw: bytes, kind: str) -> Any:
    """A column bound as a value; None for types whose bounds aren't used."""
    if kind == "string":
        return raw.decode(errors="replace") if raw.isascii() else None
    form = {"int": "<i", "long": "<q", "boolean": "<?", "float": "<f", "double": "<d", "date": "<i"}.get(kind)
    if not form or len(raw) != struct.calcsize(form):
        return None
    value = struct.unpack(form, raw)[0]
    return EPOCH + datetime.timedelta(days=value) if kind == "date" else value


def comparable(value: Any, kind: str) -> bool:
    """Is the value of the kind that bounds of the column are compared with?"""
    if kind == "date":
        return isinstance(value, datetime.date) and not isinstance(value, datetime.datetime)
    if kind == "string":
        return isinstance(value, str) and value.isascii()
    return isinstance(value, (int, float)) and value == value


def _terms(p: Predicate | None) -> list[Compare]:
    return _terms(p.left) + _terms(p.right) if isinstance(p, Both) else [p] if isinstance(p, Compare) else []


class SnapshotTable:
    def __init__(self, spark: SparkSession, metadata_path: str):
        self.spark = spark
        self.meta = json.loads(files.read_text(spark, metadata_path))
        if self.meta["format-version"] not in (1, 2, 3):
            raise ValueError(f"format version {self.meta['format-version']} is unknown")
        schemas = self.meta.get("schemas") or [self.meta["schema"]]
        self.fields = next(s for s in schemas if s.get("schema-id", 0) == self.meta.get("current-schema-id", 0))["fields"]
        self.by_name = {f["name"]: f for f in self.fields}
        if late := [f["name"] for f in self.fields if f.get("initial-default") is not None]:
            raise ValueError(f"columns with an initial default aren't known here: {late}")
        mapped = self.meta.get("properties", {}).get("schema.name-mapping.default")
        self.mapping = {m["field-id"]: m["names"] for m in json.loads(mapped) if "field-id" in m} if mapped else None
        self.specs = {s["spec-id"]: s["fields"] for s in self.meta.get("partition-specs", [])}
        now = self.meta.get("current-snapshot-id")
        self.snapshot = next((s for s in self.meta.get("snapshots", []) if s["snapshot-id"] == now), None)
        self.last_report = (0, 0)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f["name"], spark_type(f["type"]), True, {"parquet.field.id": f["id"]}) for f in self.fields])

    def current_snapshot(self) -> DataFrame:
        s = self.snapshot or {}
        row = (s.get("snapshot-id"), s.get("sequence-number", 0), s.get("timestamp-ms"), s.get("summary", {}).get("operation"), s.get("manifest-list"))
        return self.spark.createDataFrame([row] if s else [], "snapshot_id long, sequence_number long, timestamp_ms long, operation string, manifest_list string")

    def manifests(self) -> list[dict]:
        return avro.read_records(_bytes(self.spark, [self.snapshot["manifest-list"]])[0])[0] if self.snapshot else []

    def live_files(self) -> list[DataFile]:
        out = []
        listed = self.manifests()
        for m, raw in zip(listed, _bytes(self.spark, [m["manifest_path"] for m in listed]), strict=True):
            for e in avro.read_records(raw)[0]:
                if e["status"] == 2:
                    continue
                d, pairs = e["data_file"], lambda x: {p["key"]: p["value"] for p in x or []}
                sequence = e.get("sequence_number")
                if sequence is None:  # inherited from the manifest, for added files only
                    sequence = m.get("sequence_number", 0)
                out.append(DataFile(d["file_path"], d["record_count"], d.get("content", 0) or 0, sequence, m.get("partition_spec_id", 0), d.get("partition") or {}, pairs(d.get("lower_bounds")), pairs(d.get("upper_bounds")), d.get("equality_ids") or [], (d["referenced_data_file"], d["content_offset"], d["content_size_in_bytes"]) if d.get("content_offset") is not None else None))
        return out

    def data_files(self) -> DataFrame:
        """The data files of the snapshot; an error if it has deletes, which a plain read of the files would ignore."""
        found = self.live_files()
        if any(f.content for f in found):
            raise ValueError("the snapshot has delete files; its data files alone aren't its rows")
        return self.spark.createDataFrame([(f.path, f.records, f.content) for f in found], "file_path string, record_count long, content int")

    def _possible(self, f: DataFile, term: Compare) -> bool:
        """Can a row of the file fit the term?  Only what is known excludes."""
        col = self.by_name.get(term.name)
        if col is None or not isinstance(col["type"], str):
            return True
        low, high = (bound(b[col["id"]], col["type"]) if col["id"] in b and comparable(term.value, col["type"]) else None for b in (f.lower, f.upper))
        if col["type"] in ("float", "double") and term.op in (">", ">="):
            high = None  # NaN is above everything, and no bound tells of it
        ends = {"<": lambda: low is None or low < term.value, "<=": lambda: low is None or low <= term.value, ">": lambda: high is None or high > term.value, ">=": lambda: high is None or high >= term.value, "=": lambda: (low is None or low <= term.value) and (high is None or high >= term.value)}
        if not ends[term.op]():
            return False
        for p in self.specs.get(f.spec, []):
            if p["source-id"] != col["id"] or p["name"] not in f.partition:
                continue
            have, want = f.partition[p["name"]], transform(p["transform"], col["type"], term.value)
            if have is None:
                return False  # null compares with nothing
            if want is None:
                continue
            if col["type"] == "date" and p["transform"] == "identity":
                have = EPOCH + datetime.timedelta(days=have) if isinstance(have, int) else have
            monotone = not p["transform"].startswith("bucket")
            # A transform that never decreases keeps <= and >=; strict orders become these.
            if term.op == "=" and have != want or monotone and (term.op in ("<", "<=") and have > want or term.op in (">", ">=") and have < want):
                return False
        return True

    def scan(self, predicate: Predicate | None = None, columns: list[str] | None = None) -> DataFrame:
        found = self.live_files()
        data = [f for f in found if f.content == 0]
        kept = [f for f in data if all(self._possible(f, t) for t in _terms(predicate))]
        self.last_report = (len(data), len(kept))
        positions = [f.path for f in found if f.content == 1 and not f.vector]
        vectors = [f for f in found if f.vector]
        equality = [f for f in found if f.content == 2]
        if not kept:
            rows = self.spark.createDataFrame([], self.schema)
        else:
            rows = self._read([f.path for f in kept])
            if positions:
                gone = self.spark.read.schema("file_path string, pos long").parquet(*positions).select(_bare_column("file_path").alias("__file"), F.col("pos").alias("__pos"))
                rows = rows.join(gone, ["__file", "__pos"], "left_anti")
            numbers = {_bare(f.path): k for k, f in enumerate(kept)}
            if vectors := [f for f in vectors if _bare(f.vector[0]) in numbers]:
                # Joined by the files' numbers: their names would be most of a row.
                whole = self.spark.createDataFrame(list(numbers.items()), "__file string, __nth int")
                rows = rows.join(F.broadcast(whole), "__file").join(self._unpacked(vectors, numbers), ["__nth", "__pos"], "left_anti")
            if equality:
                rows = self._without(rows, kept, equality)
        if predicate is not None:
            rows = rows.where(predicate.column())
        return rows.select(*(columns or [f["name"] for f in self.fields]))

    def _read(self, paths: list[str]) -> DataFrame:
        """The files' rows with __file and __pos; columns are bound by field id, or by name in files without ids."""
        # Plans read this setting when they run, so it stays on; it touches only reads whose schema carries ids.
        self.spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
        place = [_bare_column(F.col("_metadata.file_path")).alias("__file"), F.col("_metadata.row_index").alias("__pos")]
        groups: dict[tuple[str | None, ...] | None, list[str]] = {}
        for path, names in zip(paths, self._names_without_ids(paths), strict=True):
            groups.setdefault(names, []).append(path)
        parts = []
        for names, group in groups.items():
            if names is None:
                parts.append(self.spark.read.schema(self.schema).parquet(*group).select("*", *place))
                continue
            kinds = [spark_type(f["type"]) for f in self.fields]
            there = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True) if n])
            columns = [(F.col(f"`{n}`") if n else F.lit(None).cast(k)).alias(f["name"]) for n, k, f in zip(names, kinds, self.fields, strict=True)]
            parts.append(self.spark.read.schema(there).parquet(*group).select(*columns, *place))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.union(p)
        return rows

    def _names_without_ids(self, paths: list[str]) -> list[tuple[str | None, ...] | None]:
        """For each file None, or where it has no field ids the names of the table's columns in it.

        Only a table with a name mapping is asked; then the driver reads the
        files' footers, several at a time.
        """
        if self.mapping is None:
            return [None] * len(paths)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()

        def names(path: str) -> tuple[str | None, ...] | None:
            source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
            try:
                fields = list(reader.getFileMetaData().getSchema().getFields())
            finally:
                reader.close()
            if any(f.getId() is not None for f in fields):
                return None
            have = {f.getName() for f in fields}
            return tuple(next((n for n in self.mapping.get(f["id"], []) if n in have), None) for f in self.fields)

        with ThreadPoolExecutor(16) as pool:
            return list(pool.map(names, paths))

    def _unpacked(self, vectors: list[DataFile], numbers: dict[str, int]) -> DataFrame:
        """__nth, a data file's number, and __pos of rows that deletion vectors name; executors read the blobs."""
        from lithic.sources import deletion_vectors

        listed = self.spark.createDataFrame([(_bare(f.path), numbers[_bare(f.vector[0])], f.vector[1], f.vector[2]) for f in vectors], "at string, __nth int, start long, size long")
        blobs = self.spark.read.format("binaryFile").load(sorted({f.path for f in vectors})).select(_bare_column("path").alias("at"), "content")
        blobs = blobs.join(F.broadcast(listed), "at").select("__nth", F.expr("substring(content, CAST(start AS INT) + 1, CAST(size AS INT))").alias("blob"))

        def unpack(batches):
            for b in batches:
                for nth, blob in zip(b.column("__nth").to_pylist(), b.column("blob").to_pylist(), strict=True):
                    whole = deletion_vectors.decode(blob)
                    for k in range(0, len(whole), SLICE):
                        at = whole[k : k + SLICE]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), nth, np.int32)), pa.array(at, pa.int64())], ["__nth", "__pos"])

        # One task reads a Puffin file; the vectors, which are small, are dealt out before they become rows.
        return blobs.repartition(min(len(vectors), 1000), "__nth").mapInArrow(unpack, "__nth int, __pos long")

    def _scope(self, f: DataFile) -> str | None:
        """What a file's equality deletes reach: its own partition, or everything where its spec has no fields."""
        return json.dumps([f.spec, sorted(f.partition.items())], default=str) if self.specs.get(f.spec) else None

    def _without(self, rows: DataFrame, kept: list[DataFile], equality: list[DataFile]) -> DataFrame:
        """``rows`` less those that an equality delete of a later sequence, in its reach, names; one join for each set of columns."""
        order = self.spark.createDataFrame([(_bare(f.path), f.sequence, self._scope(f)) for f in kept], "__file string, __seq long, __scope string")
        rows = rows.join(order, "__file")
        by_ids: dict[tuple[int, ...], list[DataFile]] = {}
        for f in equality:
            by_ids.setdefault(tuple(sorted(f.equality_ids)), []).append(f)
        for ids, group in sorted(by_ids.items()):
            kinds = T.StructType([k for k, c in zip(self.schema, self.fields, strict=True) if c["id"] in ids])
            reach = self.spark.createDataFrame([(_bare(f.path), f.sequence, self._scope(f)) for f in group], "__d_file string, __d_seq long, __d_scope string")
            dead = self.spark.read.schema(kinds).parquet(*[f.path for f in group])
            dead = dead.select(*[F.col(c).alias(f"__d_{c}") for c in kinds.names], F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9]+:/+", "/").alias("__d_file")).join(reach, "__d_file")
            # The latest of equal deletes is enough.
            dead = dead.groupBy(*[f"__d_{c}" for c in kinds.names], "__d_scope").agg(F.max("__d_seq").alias("__d_seq"))
            same = (F.col("__seq") < F.col("__d_seq")) & (F.col("__d_scope").isNull() | (F.col("__d_scope") == F.col("__scope")))
            for c in kinds.names:
                same = same & F.col(c).eqNullSafe(F.col(f"__d_{c}"))
            rows = rows.join(dead, same, "left_anti")
        return rows
