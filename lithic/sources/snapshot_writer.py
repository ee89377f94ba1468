"""Writes tables in the public Iceberg format that ``snapshots`` reads: appends, and deletes in each of the three ways.

Executors write data and delete files; the driver writes metadata, which
grows with the number of files, and deletion vectors, which grow with the
number of deleted rows, a few bits to two bytes each.
"""

from __future__ import annotations

import json
import re
import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.sources import avro, deletion_vectors, files
from lithic.sources.snapshots import SnapshotTable

_NAMES = {T.BooleanType: "boolean", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.DateType: "date", T.TimestampType: "timestamptz", T.TimestampNTZType: "timestamp", T.BinaryType: "binary"}
_BOUNDS = {T.IntegerType: "<i", T.LongType: "<q", T.DoubleType: "<d"}


def _field(name: str, kind, at: int) -> dict:
    return {"name": name, "type": kind, "field-id": at}


def _optional(name: str, kind, at: int) -> dict:
    return {"name": name, "type": ["null", kind], "default": None, "field-id": at}


def _bounds(name: str, at: int) -> dict:
    pair = {"type": "record", "name": f"k{at + 1}_v{at + 2}", "fields": [_field("key", "int", at + 1), _field("value", "bytes", at + 2)]}
    return _optional(name, {"type": "array", "logicalType": "map", "items": pair}, at)


def entry_schema(partition: list[tuple[str, str]]) -> dict:
    """Schema of a manifest's entries.  Names and field ids are fixed values of the format."""
    place = {"type": "record", "name": "r102", "fields": [_optional(n, k, 1000 + at) for at, (n, k) in enumerate(partition)]}
    file = [
        _field("content", "int", 134), _field("file_path", "string", 100), _field("file_format", "string", 101), _field("partition", place, 102),
        _field("record_count", "long", 103), _field("file_size_in_bytes", "long", 104), _bounds("lower_bounds", 125), _bounds("upper_bounds", 128),
        _optional("equality_ids", {"type": "array", "items": "int", "element-id": 136}, 135), _optional("referenced_data_file", "string", 143),
        _optional("content_offset", "long", 144), _optional("content_size_in_bytes", "long", 145),
    ]
    inner = {"type": "record", "name": "r2", "fields": file}
    return {"type": "record", "name": "manifest_entry", "fields": [_field("status", "int", 0), _optional("snapshot_id", "long", 1), _optional("sequence_number", "long", 3), _optional("file_sequence_number", "long", 4), _field("data_file", inner, 2)]}


#: Schema of a manifest list.  Names and field ids are fixed values of the format.
LIST_SCHEMA = {
    "type": "record", "name": "manifest_file",
    "fields": [
        _field("manifest_path", "string", 500), _field("manifest_length", "long", 501), _field("partition_spec_id", "int", 502), _field("content", "int", 517),
        _field("sequence_number", "long", 515), _field("min_sequence_number", "long", 516), _field("added_snapshot_id", "long", 503),
        _field("added_files_count", "int", 504), _field("existing_files_count", "int", 505), _field("deleted_files_count", "int", 506),
        _field("added_rows_count", "long", 512), _field("existing_rows_count", "long", 513), _field("deleted_rows_count", "long", 514),
    ],
}


class SnapshotWriter:
    """A new table in a folder.  Spec 0 is by the identity of ``partition`` (columns of text or whole numbers); spec 1 has no fields, for deletes that reach everything."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, partition: list[str] = (), version: int = 2, properties: dict[str, str] | None = None):
        self.spark, self.folder, self.schema, self.partition, self.version = spark, files.qualified(spark, folder), schema, list(partition), version
        self.ids = {f.name: k + 1 for k, f in enumerate(schema)}
        self.properties = properties or {}
        self.listed: list[dict] = []
        self.snapshots: list[dict] = []

    def _tagged(self, names: list[str], with_ids: bool = True) -> list[Column]:
        return [F.col(f"`{n}`").alias(n, metadata={"parquet.field.id": self.ids[n]} if with_ids else {}) for n in names]

    def append(self, rows: DataFrame, rename: dict[str, str] | None = None) -> None:
        """Add the rows as Parquet files with field ids; with ``rename``, as files without ids whose columns have other names."""
        where = f"{self.folder}/data/{uuid.uuid4().hex}"
        out = rows.select(*self._tagged(self.schema.names, rename is None))
        for old, new in (rename or {}).items():
            out = out.withColumnRenamed(old, new)
        shown = {n: (rename or {}).get(n, n) for n in self.schema.names}
        for k, n in enumerate(self.partition):
            out = out.withColumn(f"__part{k}", F.col(f"`{shown[n]}`"))
        write = out.write.option("spark.sql.parquet.fieldId.write.enabled", "true")
        (write.partitionBy(*[f"__part{k}" for k in range(len(self.partition))]) if self.partition else write).parquet(where)
        bounded = [f.name for f in self.schema if type(f.dataType) in _BOUNDS]
        ends = [x for k, n in enumerate(bounded) for x in (F.min(f"`{shown[n]}`").alias(f"lo{k}"), F.max(f"`{shown[n]}`").alias(f"hi{k}"))]
        back = self.spark.read.option("recursiveFileLookup", "true").schema(T.StructType([T.StructField(shown[f.name], f.dataType) for f in self.schema])).parquet(where)
        meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")]
        # A file's rows have one value of each partition column: as a key it needs no sort, as a first value a text would.
        place = [F.col(f"`{shown[n]}`").alias(f"p{k}") for k, n in enumerate(self.partition)]
        stats = back.select("*", *meta).groupBy("file", "bytes", *place).agg(F.count(F.lit(1)).alias("n"), *ends)
        found = []
        for r in stats.orderBy("file").collect():
            sides = [[{"key": self.ids[n], "value": struct.pack(_BOUNDS[type(self.schema[n].dataType)], r[f"{side}{k}"])} for k, n in enumerate(bounded) if r[f"{side}{k}"] is not None] for side in ("lo", "hi")]
            found.append(self._file(0, r.file, r.n, r.bytes, {n: r[f"p{k}"] for k, n in enumerate(self.partition)}) | {"lower_bounds": sides[0], "upper_bounds": sides[1]})
        self._commit("append", 0, found)

    def delete_positions(self, predicate: Column) -> None:
        """Delete matching rows by position-delete files."""
        paths, places = self._places(predicate)
        names = self.spark.createDataFrame(list(enumerate(paths)), "__nth int, file_path string")
        gone = places.join(F.broadcast(names), "__nth").select("file_path", F.col("__pos").alias("pos"))
        self._commit("delete", 1, self._delete_files(1, gone.sort("file_path", "pos")))

    def delete_equal(self, values: DataFrame) -> None:
        """Delete rows of earlier snapshots that equal one of ``values`` in its columns, in all partitions."""
        names = values.columns
        self._commit("delete", 1, self._delete_files(2, values.select(*self._tagged(names)), [self.ids[n] for n in names]))

    def delete_vectors(self, predicate: Column) -> None:
        """Delete matching rows by deletion vectors in one Puffin file; format 3 only."""
        if self.version < 3:
            raise ValueError("deletion vectors need format 3")

        def pack(g: pd.DataFrame) -> pd.DataFrame:
            low = np.unique(g["__pos"].to_numpy() & 0xFFFF)
            return pd.DataFrame({"nth": [g["__nth"].iloc[0]], "part": [g["__pos"].iloc[0] >> 16], "n": [len(low)], "raw": [deletion_vectors.container(low)]})

        # Python sees one container at a time, at most 65,536 positions, and numbers in the place of files' names.
        paths, places = self._places(predicate)
        by: dict[int, dict[int, tuple[int, bytes]]] = {}
        for r in places.groupBy("__nth", F.shiftright("__pos", 16).alias("__part")).applyInPandas(pack, "nth int, part long, n long, raw binary").collect():
            by.setdefault(r.nth, {})[r.part] = (r.n, bytes(r.raw))
        where, body, footer, found = f"{self.folder}/data/{uuid.uuid4().hex}.puffin", bytearray(deletion_vectors.PUFFIN), [], []
        for nth in sorted(by, key=lambda k: paths[k]):
            file, n, blob = paths[nth], sum(c[0] for c in by[nth].values()), deletion_vectors.assemble(by[nth])
            footer.append({"type": "deletion-vector-v1", "fields": [], "snapshot-id": -1, "sequence-number": -1, "offset": len(body), "length": len(blob), "properties": {"referenced-data-file": file, "cardinality": str(n)}})
            found.append(self._file(1, where, n, 0, {}) | {"file_format": "PUFFIN", "referenced_data_file": file, "content_offset": len(body), "content_size_in_bytes": len(blob)})
            body += blob
        note = json.dumps({"blobs": footer}).encode()
        body += deletion_vectors.PUFFIN + note + struct.pack("<ii", len(note), 0) + deletion_vectors.PUFFIN
        files.create_bytes(self.spark, where, bytes(body))
        self._commit("delete", 1, [f | {"file_size_in_bytes": len(body)} for f in found])

    def _places(self, predicate: Column) -> tuple[list[str], DataFrame]:
        """The data files, and __nth (a place in that list) and __pos of the matching rows."""
        table = self.table()
        paths = [f.path for f in table.live_files() if f.content == 0]
        whole = self.spark.createDataFrame([(re.sub("^[a-z0-9]+:/+", "/", p), k) for k, p in enumerate(paths)], "__file string, __nth int")
        return paths, table._read(paths).where(predicate).select("__file", "__pos").join(F.broadcast(whole), "__file").select("__nth", "__pos")

    def _delete_files(self, content: int, rows: DataFrame, ids: list[int] | None = None) -> list[dict]:
        where = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.option("spark.sql.parquet.fieldId.write.enabled", "true").parquet(where)
        meta = self.spark.read.parquet(where).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        return [self._file(content, r.file, r["count"], r.bytes, {}) | {"equality_ids": ids} for r in meta.groupBy("file", "bytes").count().orderBy("file").collect()]

    def _file(self, content: int, path: str, rows: int, size: int, place: dict) -> dict:
        return {"content": content, "file_path": path, "file_format": "PARQUET", "partition": place, "record_count": rows, "file_size_in_bytes": size}

    def _commit(self, operation: str, content: int, found: list[dict]) -> None:
        """One snapshot: a manifest of ``found``, the list of all manifests so far, and the table's metadata."""
        number, spec = len(self.snapshots) + 1, 1 if content else 0
        kinds = [(n, _NAMES[type(self.schema[n].dataType)]) for n in self.partition] if spec == 0 else []
        raw = avro.write_records(entry_schema(kinds), [{"status": 1, "snapshot_id": number, "sequence_number": number, "file_sequence_number": number, "data_file": f} for f in found], {"format-version": str(self.version)})
        where = f"{self.folder}/metadata/{uuid.uuid4().hex}.avro"
        files.create_bytes(self.spark, where, raw)
        self.listed.append({
            "manifest_path": where, "manifest_length": len(raw), "partition_spec_id": spec, "content": content, "sequence_number": number, "min_sequence_number": number, "added_snapshot_id": number,
            "added_files_count": len(found), "existing_files_count": 0, "deleted_files_count": 0, "added_rows_count": sum(f["record_count"] for f in found), "existing_rows_count": 0, "deleted_rows_count": 0,
        })
        listed = f"{self.folder}/metadata/snap-{number}.avro"
        files.create_bytes(self.spark, listed, avro.write_records(LIST_SCHEMA, self.listed))
        self.snapshots.append({"snapshot-id": number, "sequence-number": number, "timestamp-ms": 1000 * number, "manifest-list": listed, "summary": {"operation": operation}, "schema-id": 0})
        fields = [{"id": self.ids[f.name], "name": f.name, "required": False, "type": _NAMES[type(f.dataType)]} for f in self.schema]
        by = [{"source-id": self.ids[n], "field-id": 1000 + k, "name": n, "transform": "identity"} for k, n in enumerate(self.partition)]
        meta = {
            "format-version": self.version, "table-uuid": str(uuid.uuid4()), "location": self.folder, "last-sequence-number": number, "last-column-id": len(fields), "properties": self.properties,
            "current-schema-id": 0, "schemas": [{"type": "struct", "schema-id": 0, "fields": fields}], "default-spec-id": 0, "partition-specs": [{"spec-id": 0, "fields": by}, {"spec-id": 1, "fields": []}],
            "current-snapshot-id": number, "snapshots": self.snapshots,
        }
        files.create_text(self.spark, self.metadata_path, json.dumps(meta))

    @property
    def metadata_path(self) -> str:
        return f"{self.folder}/metadata/v{len(self.snapshots)}.metadata.json"

    def table(self) -> SnapshotTable:
        return SnapshotTable(self.spark, self.metadata_path)
