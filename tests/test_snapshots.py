"""The snapshot reader on tables made here, with an encoder of our own."""

import datetime
import json
import struct
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lithic.operators.predicate import Compare, between
from lithic.sources import avro
from lithic.sources.snapshots import SnapshotTable, murmur3, transform


def long(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def put(v, kind):
    if isinstance(kind, list):
        k = 0 if v is None else 1
        return long(k) + put(v, kind[k])
    if kind == "null":
        return b""
    if kind in ("int", "long"):
        return long(v)
    if kind == "string":
        return long(len(v.encode())) + v.encode()
    if kind == "bytes":
        return long(len(v)) + v
    if kind["type"] == "record":
        return b"".join(put(v[f["name"]], f["type"]) for f in kind["fields"])
    return (long(len(v)) + b"".join(put(x, kind["items"]) for x in v) if v else b"") + long(0)


def container(records, kind, codec="null"):
    body = b"".join(put(r, kind) for r in records)
    if codec == "deflate":
        squeeze = zlib.compressobj(wbits=-15)
        body = squeeze.compress(body) + squeeze.flush()
    head = {"avro.schema": json.dumps(kind).encode(), "avro.codec": codec.encode()}
    sync = b"0123456789abcdef"
    return b"Obj\x01" + long(len(head)) + b"".join(put(k, "string") + put(v, "bytes") for k, v in head.items()) + long(0) + sync + long(len(records)) + long(len(body)) + body + sync


BOUND = {"type": "array", "items": {"type": "record", "name": "kv", "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": "bytes"}]}}


def entry(partition):
    bounds = ["null", BOUND]
    file = [("content", "int"), ("file_path", "string"), ("record_count", "long"), ("partition", {"type": "record", "name": "p", "fields": partition}), ("lower_bounds", bounds), ("upper_bounds", bounds), ("equality_ids", {"type": "array", "items": "int"})]
    inner = {"type": "record", "name": "r2", "fields": [{"name": k, "type": v} for k, v in file]}
    return {"type": "record", "name": "entry", "fields": [{"name": "status", "type": "int"}, {"name": "sequence_number", "type": ["null", "long"]}, {"name": "data_file", "type": inner}]}


LIST = {"type": "record", "name": "m", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "partition_spec_id", "type": "int"}, {"name": "content", "type": "int"}, {"name": "sequence_number", "type": "long"}]}
#: Shipments: parcel number, depot, weight and day.
FIELDS = [("parcel", "long", pa.int64()), ("depot", "string", pa.string()), ("weight", "double", pa.float64()), ("day", "date", pa.date32())]
MONDAY = datetime.date(2031, 3, 3)


def table(names, columns):
    """A table of some of FIELDS; the names in files differ from the schema's, only ids tell."""
    kinds = {n: (k + 1, t) for k, (n, _, t) in enumerate(FIELDS)}
    schema = pa.schema([pa.field(f"file_{n}", kinds[n][1], metadata={"PARQUET:field_id": str(kinds[n][0])}) for n in names])
    return pa.table([pa.array(c, kinds[n][1]) for n, c in zip(names, columns, strict=True)], schema=schema)


def parcels(numbers, depot):
    return table([f[0] for f in FIELDS], [numbers, [depot] * len(numbers), [n / 4 for n in numbers], [MONDAY + datetime.timedelta(days=n % 7) for n in numbers]])


class Lake:
    """Writes manifests, one after another, each of one spec."""

    def __init__(self, folder, specs, codec="null"):
        self.folder, self.specs, self.codec, self.listed, self.n = folder, specs, codec, [], 0

    def add(self, spec, sequence, *entries, partition_kind="string"):
        """entries: (pyarrow table, partition values, content, equality ids, bounds); returns their paths."""
        fields, records, paths = self.specs[spec], [], []
        for t, part, content, ids, bounds in entries:
            self.n += 1
            path = str(self.folder / f"f{self.n}.parquet")
            pq.write_table(t, path)
            paths.append(path)
            sides = [[{"key": k, "value": v} for k, v in side.items()] or None for side in bounds or ({}, {})]
            records.append({"status": 1, "sequence_number": None if content == 0 else sequence, "data_file": {"content": content, "file_path": path, "record_count": t.num_rows, "partition": part, "lower_bounds": sides[0], "upper_bounds": sides[1], "equality_ids": ids}})
        where = self.folder / f"m{len(self.listed)}.avro"
        where.write_bytes(container(records, entry([{"name": f["name"], "type": ["null", partition_kind]} for f in fields]), self.codec))
        self.listed.append({"manifest_path": str(where), "partition_spec_id": spec, "content": int(any(e[2] for e in entries)), "sequence_number": sequence})
        return paths

    def open(self, spark):
        (self.folder / "list.avro").write_bytes(container(self.listed, LIST, self.codec))
        fields = [{"id": k + 1, "name": n, "type": t} for k, (n, t, _) in enumerate(FIELDS)]
        last = {"snapshot-id": 77, "sequence-number": len(self.listed), "timestamp-ms": 9, "manifest-list": str(self.folder / "list.avro"), "summary": {"operation": "overwrite"}}
        meta = {"format-version": 2, "current-schema-id": 0, "schemas": [{"schema-id": 0, "fields": fields}], "partition-specs": [{"spec-id": k, "fields": f} for k, f in enumerate(self.specs)], "current-snapshot-id": 77, "snapshots": [last]}
        (self.folder / "meta.json").write_text(json.dumps(meta))
        return SnapshotTable(spark, str(self.folder / "meta.json"))


DEPOT = [{"source-id": 2, "field-id": 1000, "name": "depot", "transform": "identity"}]


def data(numbers, depot, part=None, bounds=None):
    return (parcels(numbers, depot), {} if part is None else {"depot": part}, 0, [], bounds)


def numbers(t, *args):
    return sorted(r.parcel for r in t.scan(*args).collect())


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_partitions_of_several_manifests(spark, tmp_path, codec):
    lake = Lake(tmp_path, [DEPOT, []], codec)
    lake.add(0, 1, data([11, 12], "kiel", "kiel"), data([21], "ulm", "ulm"))
    lake.add(1, 2, data([13, 22], "ulm"))
    t = lake.open(spark)
    assert numbers(t) == [11, 12, 13, 21, 22]
    assert numbers(t, Compare("depot", "=", "ulm")) == [13, 21, 22] and t.last_report == (3, 2)
    assert t.scan(Compare("weight", ">", 3.0)).count() == 3
    assert t.current_snapshot().first().snapshot_id == 77 and t.data_files().count() == 3


def test_bounds_prune_by_every_kind(spark, tmp_path):
    low = lambda n, depot: {1: struct.pack("<q", n), 2: depot.encode(), 3: struct.pack("<d", n / 4), 4: struct.pack("<i", (MONDAY - datetime.date(1970, 1, 1)).days)}
    high = lambda n, depot: low(n, depot) | {4: struct.pack("<i", (MONDAY - datetime.date(1970, 1, 1)).days + 6)}
    lake = Lake(tmp_path, [[]])
    lake.add(0, 1, *(data(list(range(a, a + 10)), d, None, (low(a, d), high(a + 9, d))) for a, d in ((0, "aal"), (10, "bonn"), (20, "celle"))))
    t = lake.open(spark)
    for term, files in ((Compare("parcel", "=", 12), 1), (Compare("depot", ">=", "bonn"), 2), (Compare("weight", "<", 1.0), 1), (Compare("weight", ">", 5.5), 3), (Compare("day", "<", MONDAY), 0), (Compare("day", ">=", MONDAY), 3)):
        want = [n for n in numbers(t) if {"<": lambda x: x < term.value, ">": lambda x: x > term.value, ">=": lambda x: x >= term.value, "=": lambda x: x == term.value}[term.op]({"parcel": n, "depot": ("aal", "bonn", "celle")[n // 10], "weight": n / 4, "day": MONDAY + datetime.timedelta(days=n % 7)}[term.name])]
        assert numbers(t, term) == want and t.last_report == (3, files), term


def test_equality_deletes_keep_to_their_partition_and_sequence(spark, tmp_path):
    lake = Lake(tmp_path, [DEPOT, []])
    lake.add(0, 1, data([1, 2, 3], "kiel", "kiel"), data([1, 2, 4], "ulm", "ulm"))
    one = table(["parcel"], [[1, 4]])
    lake.add(0, 2, (one, {"depot": "kiel"}, 2, [1], None))  # parcel 1 of kiel; ulm keeps 1 and 4
    lake.add(0, 3, data([1], "kiel", "kiel"))  # came after the delete
    lake.add(1, 4, (table(["parcel", "depot"], [[2, 9], ["ulm", None]]), {}, 2, [1, 2], None))  # no partition: reaches all
    t = lake.open(spark)
    got = sorted((r.parcel, r.depot) for r in t.scan().collect())
    assert got == [(1, "kiel"), (1, "ulm"), (2, "kiel"), (3, "kiel"), (4, "ulm")]
    with pytest.raises(ValueError):
        t.data_files()


def test_position_deletes(spark, tmp_path):
    lake = Lake(tmp_path, [[]])
    paths = lake.add(0, 1, data([5, 6, 7], "kiel"), data([8, 9], "ulm"))
    lake.add(0, 2, (pa.table({"file_path": [paths[0], paths[1], paths[0]], "pos": pa.array([2, 0, 0], pa.int64())}), {}, 1, [], None))
    assert numbers(lake.open(spark)) == [6, 9]


def test_bucket_prunes(spark, tmp_path):
    lake = Lake(tmp_path, [[{"source-id": 1, "field-id": 1000, "name": "part", "transform": "bucket[4]"}]])
    groups = {}
    for n in range(40, 64):
        groups.setdefault(transform("bucket[4]", "long", n), []).append(n)
    lake.add(0, 1, *((parcels(ns, "x"), {"part": b}, 0, [], None) for b, ns in groups.items()), partition_kind="int")
    t = lake.open(spark)
    assert numbers(t, Compare("parcel", "=", 47)) == [47] and t.last_report[1] == 1
    assert t.scan(between("parcel", 43, 46)).count() == 4 and t.last_report[1] == len(groups)


def test_transforms():
    # Published examples of the hash and the transforms.
    assert murmur3(struct.pack("<q", 34)) == 2017239379 and murmur3(b"iceberg") == 1210000089
    day = datetime.date(2017, 11, 16)
    assert [transform(u, "date", day) for u in ("year", "month", "day")] == [47, 574, 17486]
    assert transform("truncate[10]", "int", -1) == -10 and transform("truncate[3]", "string", "iceberg") == "ice"


def test_broken_files():
    for raw in (b"", b"Obj\x01", b"nope" * 9):
        with pytest.raises(ValueError):
            avro.read_records(raw)


def test_deletion_vectors_round_trip():
    import numpy as np

    from lithic.sources import deletion_vectors as dv

    draw = np.random.default_rng(5)
    for positions in ([], [0], [65535, 65536], range(5000), draw.integers(0, 1 << 34, 300), draw.integers(0, 1 << 17, 60_000)):
        want = np.unique(np.array(list(positions), np.int64))
        blob = dv.encode(want)
        assert dv.decode(blob).tolist() == want.tolist()
    broken = dv.encode(np.arange(10))
    for raw in (b"", broken[:-1], broken[:9] + b"\1" + broken[10:], b"\0" * 40):
        with pytest.raises(ValueError):
            dv.decode(raw)


def test_deletion_vector_with_runs():
    from lithic.sources import deletion_vectors as dv

    # One container of key 2 with the runs 3..5 and 9..9, as other writers pack them.
    body = struct.pack("<QI", 1, 0) + struct.pack("<I", dv.WITH_RUNS) + b"\1" + struct.pack("<HH", 2, 3) + struct.pack("<HHHHH", 2, 3, 2, 9, 0)
    inner = dv.MAGIC + body
    blob = struct.pack(">I", len(inner)) + inner + struct.pack(">I", zlib.crc32(inner))
    assert dv.decode(blob).tolist() == [2 * 65536 + n for n in (3, 4, 5, 9)]


def test_written_table_prunes_and_deletes(spark, tmp_path):
    from lithic.sources.snapshot_writer import SnapshotWriter

    rows = spark.range(60).selectExpr("id", "CONCAT('p', id % 3) AS part", "id / 4 AS x")
    w = SnapshotWriter(spark, str(tmp_path / "t"), rows.schema, ["part"], version=3)
    w.append(rows.repartitionByRange(2, "id"))
    with pytest.raises(ValueError):
        SnapshotWriter(spark, str(tmp_path / "u"), rows.schema).delete_vectors(F.col("id") > 3)
    w.delete_equal(spark.createDataFrame([(4,), (700,)], "id long"))
    w.append(rows.where("id = 4"))
    w.delete_vectors(F.col("id").between(10, 30))
    t = w.table()
    assert sorted(r.id for r in t.scan().collect()) == [n for n in range(60) if not 10 <= n <= 30]
    assert t.scan(Compare("part", "=", "p1") & Compare("id", ">", 40)).count() == 6 and t.last_report[1] < t.last_report[0]
