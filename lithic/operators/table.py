"""Managed tables: immutable Parquet segments, a manifest of statistics, delete vectors and a snapshot log.

A table is a folder.  ``_log`` has one JSON file per version, created
exclusively, which is what commits (the store must refuse to create a file that
is there: HDFS and local disks do, an object store needs a connector that does);
it names the manifests (one row a segment, with bounds, sums and counts by
column) with the first row id of each, the segments dropped from them, and the
delete vectors (segment, row index, row id).  Reading takes the segments whose
statistics allow a match, filters every row again, and leaves out deleted rows
by an anti-join.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lithic.operators.predicate import Other, Predicate
from lithic.sources import files

FORMAT = 1
ROWS_A_GROUP = 150_000
#: Rows that a task which sorts or writes is given, unless a segment holds more.
ROWS_A_TASK = 300_000
#: Manifests that may stand side by side before they are folded into one.
FOLD = 16
OPTIONS = {"row_group_rows": ROWS_A_GROUP, "vector_rows": 10_000, "compression": "zstd", "compression_level": 3, "sort_by": None, "bloom": None}
CODECS = ("none", "pglz", "lz4", "zstd")
_NO_BOUNDS = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
SEGMENT, INDEX, ROW_ID = "__segment", "__index", "__row_id"


class ConcurrentModification(Exception):
    """Another commit came first; the operation can be tried again."""


class ConstraintViolation(Exception):
    pass


@dataclass
class ScanReport:
    """What pruning did: segments there are, read, and left out."""

    total: int
    read: int
    source: str = "base"

    @property
    def removed(self) -> int:
        return self.total - self.read


class Table:
    def __init__(self, spark: SparkSession, path: str, state: dict, version: int):
        self.spark, self.path, self.state, self.version = spark, files.qualified(spark, path), state, version
        self.last_report: ScanReport | None = None
        self._open: list[dict] = []

    # ---- life

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, *, not_null: Iterable[str] = (), unique: Iterable[Iterable[str]] = (), checks: Iterable[str] = (), without_overlaps: Iterable[tuple[Iterable[str], str, str]] = (), stored: dict[str, str] | None = None, virtual: dict[str, str] | None = None, **options) -> Table:
        """A new, empty table.  ``without_overlaps`` has (key columns, begin, end): rows of one key may not overlap in [begin, end).  ``stored`` and ``virtual`` are generated columns: name to SQL expression; stored ones must be in the schema."""
        state = {
            "format": FORMAT, "id": uuid.uuid4().hex, "schema": json.loads(schema.json()), "options": dict(OPTIONS), "manifests": [], "dropped": [], "deletes": [], "next_row": 1,
            "not_null": list(not_null), "unique": [list(u) for u in unique], "checks": list(checks), "exclusions": [[list(k), a, b] for k, a, b in without_overlaps], "stored": stored or {}, "virtual": virtual or {},
            "sort": None, "projections": {}, "defaults": {}, "feed": None,
        }
        table = cls(spark, path, state, -1)
        table._check_options(options)
        state["options"].update({k: v for k, v in options.items() if v is not None})
        table._commit(state)
        return table

    @classmethod
    def create_as(cls, spark: SparkSession, path: str, df: DataFrame, **options) -> Table:
        table = cls.create(spark, path, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]), **options)
        table.insert(df)
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> Table:
        found = [int(n[:-5]) for n in files.names(spark, f"{path}/_log") if n.endswith(".json") and not n.startswith(".")]
        if not found:
            raise FileNotFoundError(f"no table at {path}")
        at = max(found) if version is None else version
        state = json.loads(files.read_text(spark, f"{path}/_log/{at:020d}.json"))
        if state["format"] != FORMAT:
            raise ValueError(f"format {state['format']} is unknown")
        return cls(spark, path, state, at)

    @classmethod
    def convert(cls, spark: SparkSession, source: str, path: str, kind: str = "parquet", **options) -> Table:
        """A managed table of the rows of plain files; ``unmanage`` is the way back."""
        return cls.create_as(spark, path, spark.read.format(kind).load(source), **options)

    def unmanage(self, path: str, kind: str = "parquet") -> None:
        """Write the live rows as plain files; the table stays as it is."""
        self.scan(columns=self.schema.names).write.mode("errorifexists").format(kind).save(path)

    @property
    def storage_id(self) -> str:
        """What names the table for as long as it lives, whatever its path."""
        return self.state["id"]

    def drop(self) -> None:
        files.remove(self.spark, self.path)

    def _commit(self, state: dict, rebase=None) -> None:
        if self._open:
            self.state = state
            return
        while True:
            try:
                files.create_text(self.spark, f"{self.path}/_log/{self.version + 1:020d}.json", json.dumps(state))
            except files.Exists as e:
                if rebase is None:
                    raise ConcurrentModification(f"version {self.version + 1} is there already") from e
                latest = Table.open(self.spark, self.path)
                state, self.version = rebase(latest.state), latest.version
                continue
            self.state, self.version = state, self.version + 1
            return

    @contextmanager
    def transaction(self):
        """Operations inside commit together; nested ones are savepoints.  An error takes back what was done since."""
        self._open.append(copy.deepcopy(self.state))
        try:
            yield self
        except BaseException:
            self.state = self._open.pop()
            raise
        self._open.pop()
        if not self._open:
            self._commit(self.state)

    # ---- schema and options

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.state["schema"])

    def _with(self, **changes) -> dict:
        return copy.deepcopy(self.state) | changes

    def _check_options(self, options: dict) -> None:
        for k, v in options.items():
            if k not in OPTIONS:
                raise ValueError(f"unknown option {k}")
            if v is None:
                continue
            if k == "row_group_rows" and v < 1000 or k == "vector_rows" and v < 100 or k == "compression_level" and not 1 <= v <= 22 or k == "compression" and v not in CODECS:
                raise ValueError(f"{k} is out of bounds: {v}")
            if k in ("sort_by", "bloom") and (missing := [c for c in v if c not in self.schema.names]):
                raise ValueError(f"{k} has unknown columns {missing}")

    def set_options(self, **options) -> None:
        self._check_options(options)
        self._commit(self._with(options=self.state["options"] | {k: v for k, v in options.items() if v is not None}))

    def reset_options(self, *names: str) -> None:
        self._commit(self._with(options=self.state["options"] | {k: OPTIONS[k] for k in names or OPTIONS}))

    def add_column(self, name: str, kind: T.DataType, default=None) -> None:
        """No segment is rewritten: rows from before give the default."""
        schema = self.schema.add(name, kind, True)
        late = [*self.state.get("late", []), *([name] if default is not None and self.state["manifests"] else [])]
        self._commit(self._with(schema=json.loads(schema.json()), defaults=self.state["defaults"] | {name: default}, late=late))

    def alter_type(self, name: str, kind: T.DataType) -> None:
        """Rewrites all segments with a cast; fails, changing nothing, if a value doesn't fit."""
        rows = self.scan().withColumn(name, F.col(f"`{name}`").cast(kind))
        schema = T.StructType([T.StructField(f.name, kind if f.name == name else f.dataType, True) for f in self.schema])
        self._commit(self._replaced(rows, schema=json.loads(schema.json())))

    # ---- manifest

    def manifest(self, live: bool = True) -> DataFrame:
        """One row a segment: segment, rows, bytes, base, part, deleted, and column.min, .max, .sum, .values, .nulls."""
        out = self._listed(self.state)
        gone = self._deletes()
        if gone is None:
            return out.withColumn("deleted", F.lit(0).cast("long"))
        counts = gone.groupBy(F.col(SEGMENT).alias("segment")).agg(F.count(F.lit(1)).alias("deleted"))
        return out.join(counts, "segment", "left").withColumn("deleted", F.coalesce("deleted", F.lit(0)))

    def _listed(self, state: dict) -> DataFrame:
        """The segments of a state; a manifest's rows count from its own first row, which the state holds."""
        if not state["manifests"]:
            return self.spark.createDataFrame([], "segment string, rows long, bytes long, base long, part int")
        out = None
        for m in state["manifests"]:
            one = self.spark.read.parquet(m["path"]).withColumn("base", F.col("base") + F.lit(m["start"]))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        for p in state["dropped"]:
            out = out.join(self.spark.read.parquet(p), "segment", "left_anti")
        return out

    def _folded(self, state: dict) -> dict:
        """``state`` with its manifests in one, where there are many: a scan then reads a bounded number of them."""
        if len(state["manifests"]) + len(state["dropped"]) <= FOLD:
            return state
        path = f"{self.path}/_manifest/{uuid.uuid4().hex}"
        self._listed(state).coalesce(1).write.parquet(path)
        return state | {"manifests": [{"path": path, "start": 0}], "dropped": []}

    def _deletes(self) -> DataFrame | None:
        """Segment, index and row id of every deleted row.  Each delete takes live rows only, so none is there twice."""
        d = self.state["deletes"]
        return self.spark.read.parquet(*d) if d else None

    def _stats_columns(self, schema: T.StructType) -> list[Column]:
        out = []
        for f in schema:
            c = F.col(f"`{f.name}`")
            out += [F.count(c).alias(f"{f.name}.values"), (F.count(F.lit(1)) - F.count(c)).alias(f"{f.name}.nulls")]
            if not isinstance(f.dataType, _NO_BOUNDS):
                out += [F.min(c).alias(f"{f.name}.min"), F.max(c).alias(f"{f.name}.max")]
            if isinstance(f.dataType, T.LongType):
                # Upper and lower halves add up in longs, without a decimal object for each row.
                high, low = F.sum(F.shiftright(c, 32)), F.sum(c.bitwiseAND(F.lit((1 << 32) - 1)))
                out.append((high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low.cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"{f.name}.sum"))
            elif isinstance(f.dataType, (*_EXACT, T.DecimalType)):
                out.append((F.sum(c).cast("decimal(38,0)") if isinstance(f.dataType, _EXACT) else F.sum(c)).alias(f"{f.name}.sum"))
        return out

    def _write_segments(self, rows: DataFrame, folder: str, statistics: bool = True) -> tuple[str, int]:
        """Write rows as segments and their manifest, which counts rows from 0; returns its path and the number of rows.

        Segments are files of at most ``row_group_rows`` rows, with pages of at
        most ``vector_rows``.
        """
        options = OPTIONS | self.state["options"]
        codec = {"pglz": "lz4_raw", "lz4": "lz4_raw", "none": "uncompressed"}.get(options["compression"], options["compression"])
        where = f"{self.path}/{folder}/{uuid.uuid4().hex}"
        writer = rows.write.option("maxRecordsPerFile", options["row_group_rows"]).option("compression", codec)
        writer = writer.option("parquet.page.row.count.limit", options["vector_rows"]).option("parquet.compression.codec.zstd.level", options["compression_level"])
        for c in options["bloom"] or []:
            if c in rows.columns:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(where)
        back = self.spark.read.schema(rows.schema).parquet(where)
        # Least and greatest texts alone would be found by sorting all rows by segment; with a collected list, here of nothing, Spark aggregates by hash.
        nothing = F.size(F.collect_list(F.lit(None).cast("boolean")))
        got = back.groupBy(F.concat(F.lit(where + "/"), F.col("_metadata.file_name")).alias("segment")).agg((F.count(F.lit(1)) + nothing).alias("rows"), F.max("_metadata.file_size").alias("bytes"), *(self._stats_columns(rows.schema) if statistics else []))
        before = F.coalesce(F.sum("rows").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        named = got.withColumn("base", before.cast("long")).withColumn("part", F.lit(len(self.state["manifests"])))
        path = f"{self.path}/_manifest/{uuid.uuid4().hex}"
        named.coalesce(1).write.parquet(path)
        return path, self.spark.read.parquet(path).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    # ---- reading

    def scan(self, predicate: Predicate | Column | None = None, columns: list[str] | None = None, *, meta: bool = False, prune: bool = True) -> DataFrame:
        """Live rows that match.  ``meta`` adds the segment, index and row id of each."""
        if isinstance(predicate, Column):
            predicate = Other(predicate)
        m = self.manifest()
        total = m.count()
        known = {c[:-4] for c in m.columns if c.endswith(".min")}
        kept = m.where(predicate.possible(known)) if predicate is not None and prune else m
        found = kept.select("segment", "base").collect()
        self.last_report = ScanReport(total, len(found))
        out = self._rows([r.segment for r in found])
        if meta:
            out = self._numbered(out, kept, len(found))
        if predicate is not None:
            out = out.where(predicate.column())
        names = columns or [*self.schema.names, *self.state["virtual"]]
        return out.select(*[F.col(f"`{c}`") for c in names], *([SEGMENT, INDEX, ROW_ID] if meta else []))

    def _rows(self, segments: list[str]) -> DataFrame:
        if not segments:
            empty = T.StructType([*self.schema.fields, T.StructField(SEGMENT, T.StringType()), T.StructField(INDEX, T.LongType())])
            out = self.spark.createDataFrame([], empty)
        else:
            kinds = {f.name: f for f in self.schema}
            read = self.spark.read.schema(self.schema).parquet(*self._paths(segments))
            path = F.col("_metadata.file_path")
            # Files may be named by another spelling of the same scheme (file:/ for file:///).
            out = read.select(*[F.col(f"`{f.name}`") for f in self.schema], F.regexp_replace(path, "^file:/+", "file:///").alias(SEGMENT), F.col("_metadata.row_index").alias(INDEX))
            late = {c: self.state["defaults"][c] for c in self.state.get("late", [])}
            if late:
                have = self.manifest()
                for c, v in late.items():
                    key = f"{c}.values"
                    old = have.where(F.col(f"`{key}`").isNull()) if key in have.columns else have
                    names = old.select(F.col("segment").alias(SEGMENT), F.lit(True).alias("__old"))
                    out = out.join(F.broadcast(names), SEGMENT, "left").withColumn(c, F.when(F.col("__old"), F.lit(v).cast(kinds[c].dataType)).otherwise(F.col(f"`{c}`"))).drop("__old")
            gone = self._deletes()
            if gone is not None:
                out = out.join(gone.select(SEGMENT, INDEX), [SEGMENT, INDEX], "left_anti")
        for c, text in self.state["virtual"].items():
            out = out.withColumn(c, F.expr(text))
        return out

    def _paths(self, segments: list[str]) -> list[str]:
        """What to read for these segments: a folder where all of its files are wanted, which is one listing however many they are."""
        by: dict[str, list[str]] = {}
        for s in segments:
            by.setdefault(s.rsplit("/", 1)[0], []).append(s)
        return [p for folder, own in by.items() for p in ([folder] if len(own) > 1 and files.count(self.spark, f"{folder}/*.parquet") == len(own) else own)]

    def point_lookup(self, name: str, value) -> DataFrame:
        from lithic.operators.predicate import Compare

        return self.scan(Compare(name, "=", value))

    # ---- aggregates from statistics

    def fetch_rows(self, numbers: DataFrame) -> DataFrame:
        """The live rows whose row ids are in the first column of ``numbers``.

        Segments outside the least and greatest wanted id aren't read; the
        rest is an ordinary join, however many ids there are.
        """
        wanted = numbers.select(F.col(numbers.columns[0]).cast("long").alias(ROW_ID)).distinct()
        low, high = wanted.agg(F.min(ROW_ID), F.max(ROW_ID)).first()
        m = self.manifest()
        kept = m.where((F.col("base") <= F.lit(high)) & (F.col("base") + F.col("rows") > F.lit(low)))
        found = kept.select("segment").collect()
        self.last_report = ScanReport(m.count(), len(found))
        out = self._numbered(self._rows([r.segment for r in found]), kept, len(found))
        return out.join(wanted, ROW_ID, "left_semi").select(*self.schema.names, *self.state["virtual"])

    def _numbered(self, rows: DataFrame, kept: DataFrame, n: int) -> DataFrame:
        """``rows`` with row ids: a join with the manifest by segment, which is small against the rows."""
        first = kept.select(F.col("segment").alias(SEGMENT), "base")
        return rows.join(F.broadcast(first) if n < 100_000 else first, SEGMENT).withColumn(ROW_ID, F.col("base") + F.col(INDEX)).drop("base")

    def aggregate(self, **wanted: tuple[str, str]) -> DataFrame:
        """One row of name = (function, column), for count, count(column), min, max, sum and avg without a filter.

        Segments without deletes answer from the manifest, exactly; others are
        read.  What the manifest can't answer exactly (sums of doubles, bounds of
        nested columns) is computed from rows.
        """
        m = self.manifest()
        kinds = {f.name: f.dataType for f in self.schema}

        def exact(f: str, c: str) -> bool:
            have = f"{c}.values" in m.columns
            return f == "count" and (c == "*" or have) or f in ("min", "max") and f"{c}.{f}" in m.columns or f in ("sum", "avg") and f"{c}.sum" in m.columns

        late = {*self.state.get("late", [])} & {c for _, c in wanted.values()}
        if late or not all(exact(f, c) for f, c in wanted.values()):
            rows = self.scan()
            one = {"count": lambda c: F.count(F.lit(1) if c == "*" else F.col(c)), "min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg}
            return rows.agg(*[one[f](c).alias(k) for k, (f, c) in wanted.items()])
        clean, dirty = m.where("deleted = 0"), m.where("deleted > 0")
        need = {(p, c) for f, c in wanted.values() for p in {"count": ["values"], "avg": ["sum", "values"]}.get(f, [f])}
        name = lambda p, c: f"{p}|{c}"
        wide = lambda c: F.col(c).cast("decimal(38,0)") if isinstance(kinds[c], _EXACT) else F.col(c)
        from_stats = [F.sum("rows").alias(name(p, c)) if c == "*" else (F.sum if p in ("sum", "values") else getattr(F, p))(F.col(f"`{c}.{p}`")).alias(name(p, c)) for p, c in need]
        parts = clean.agg(*from_stats)
        segments = [r.segment for r in dirty.select("segment").collect()]
        if segments:
            by = {"values": lambda c: F.count(F.lit(1) if c == "*" else F.col(c)), "sum": lambda c: F.sum(wide(c)), "min": F.min, "max": F.max}
            parts = parts.unionByName(self._rows(segments).agg(*[by[p](c).alias(name(p, c)) for p, c in need]))
        both = parts.agg(*[(F.sum if p in ("sum", "values") else getattr(F, p))(F.col(f"`{name(p, c)}`")).alias(name(p, c)) for p, c in need])
        got = lambda p, c: F.col(f"`{name(p, c)}`")
        out = []
        for k, (f, c) in wanted.items():
            if f == "count":
                out.append(F.coalesce(got("values", c), F.lit(0)).cast("long").alias(k))
            elif f == "avg":
                out.append(F.when(got("values", c) > 0, got("sum", c).cast("double") / got("values", c)).alias(k))
            elif f == "sum":
                out.append((got("sum", c).cast("long") if isinstance(kinds[c], _EXACT) else got("sum", c)).alias(k))
            else:
                out.append(got(f, c).alias(k))
        return both.select(*out)

    # ---- writing

    def _prepared(self, rows: DataFrame) -> DataFrame:
        """Rows in the table's schema, with stored columns computed and constraints checked."""
        for c, text in self.state["stored"].items():
            rows = rows.withColumn(c, F.expr(text))
        for f in self.schema:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(self.state["defaults"].get(f.name)).cast(f.dataType))
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])
        bad = [(f"{c} is null", F.col(f"`{c}`").isNull()) for c in self.state["not_null"]] + [(f"check ({x}) fails", ~F.coalesce(F.expr(x), F.lit(True))) for x in self.state["checks"]]
        if bad:
            hits = rows.agg(*[F.max(F.when(cond, 1)).alias(str(k)) for k, (_, cond) in enumerate(bad)]).first()
            if any(hits):
                raise ConstraintViolation(next(text for (text, _), hit in zip(bad, hits, strict=True) if hit))
        return rows

    def _check_unique(self, rows: DataFrame, against: DataFrame) -> None:
        self._check_overlaps(rows, against)
        for key in self.state["unique"]:
            whole = F.lit(True)
            for c in key:
                whole = whole & F.col(f"`{c}`").isNotNull()
            new = rows.where(whole).select(*key)
            if new.groupBy(*key).count().where("count > 1").limit(1).count() or new.join(against, key, "left_semi").limit(1).count():
                raise ConstraintViolation(f"key {key} is there already")

    def _check_overlaps(self, rows: DataFrame, against: DataFrame) -> None:
        """In order of its begin, no range of a key may start before all earlier ones end: one window, no join of ranges."""
        for key, begin, end in self.state.get("exclusions", []):
            names = [*key, begin, end]
            both = rows.select(*names).unionByName(against.join(rows.select(*key).distinct(), key, "left_semi").select(*names)).where(F.col(begin) < F.col(end))
            before = Window.partitionBy(*key).orderBy(begin, end).rowsBetween(Window.unboundedPreceding, -1)
            if both.withColumn("__upto", F.max(end).over(before)).where(F.col("__upto") > F.col(begin)).limit(1).count():
                raise ConstraintViolation(f"ranges of {key} overlap")
            if rows.where(F.col(begin).isNull() | F.col(end).isNull() | (F.col(begin) >= F.col(end))).limit(1).count():
                raise ConstraintViolation(f"{begin} must be before {end}")

    def change_portion(self, begin: str, end: str, low, high, assignments: dict[str, Column] | None = None, predicate: Predicate | Column | None = None) -> int:
        """Change only [low, high) of the ranges [begin, end) that overlap it, or delete it without ``assignments``; what is left of a range on either side stays as a row of its own."""
        hits = self.scan(predicate, meta=True).where((F.col(begin) < F.lit(high)) & (F.col(end) > F.lit(low)))
        names, place = self.schema.names, [SEGMENT, INDEX, ROW_ID]
        kinds = {f.name: f.dataType for f in self.schema}
        inner = {begin: F.greatest(F.col(begin), F.lit(low).cast(kinds[begin])), end: F.least(F.col(end), F.lit(high).cast(kinds[end]))} | (assignments or {})
        nowhere = [F.lit(None).cast(k).alias(c) for c, k in zip(place, ("string", "long", "long"), strict=True)]
        changed = hits.select(*[inner[c].alias(c) if c in inner else F.col(f"`{c}`") for c in names], *place, F.lit(assignments is not None).alias("__keep"))
        for side, cut, value in ((F.col(begin) < F.lit(low), end, low), (F.col(end) > F.lit(high), begin, high)):
            left = hits.where(side).select(*[F.lit(value).cast(kinds[c]).alias(c) if c == cut else F.col(f"`{c}`") for c in names], *nowhere, F.lit(True).alias("__keep"))
            changed = changed.unionByName(left)
        return self._swap(changed)

    def insert(self, rows: DataFrame, note: Callable[[dict], dict] | None = None) -> None:
        """Append rows, sorted within segments where ``sort_by`` is set.  ``note`` gives what else the new state holds, from the state it follows."""
        rows = self._prepared(rows)
        if self.state["unique"] or self.state.get("exclusions"):
            self._check_unique(rows, self.scan())
        if names := self.state["options"].get("sort_by"):
            rows = rows.sortWithinPartitions(*[F.col(f"`{c}`").asc_nulls_last() for c in names])
        path, n = self._write_segments(rows, "data")

        def extend(s: dict) -> dict:
            more = copy.deepcopy(s) | {"manifests": [*s["manifests"], {"path": path, "start": s["next_row"]}], "next_row": s["next_row"] + n, "feed": {"inserted": [path], "deleted": []}}
            return more | (note(s) if note else {})

        # Appends conflict with nothing, unless a key must stay unique or a projection must follow.
        alone = self.state["unique"] or self.state.get("exclusions") or self.state["projections"]
        self._commit(self._projected(self._folded(extend(self.state)), added=path), None if alone else extend)

    def _staged(self, df: DataFrame) -> DataFrame:
        """``df`` written once and read back, so that everything made of it sees the same rows."""
        where = f"{self.path}/_staging/{uuid.uuid4().hex}"
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def _delete_rows(self, hits: DataFrame) -> tuple[list[str], int]:
        where = f"{self.path}/_deletes/{uuid.uuid4().hex}"
        hits.select(SEGMENT, INDEX, ROW_ID).write.parquet(where)
        n = self.spark.read.parquet(where).count()
        return ([where] if n else []), n

    def delete(self, predicate: Predicate | Column | None = None) -> int:
        """Mark matching rows deleted; returns how many."""
        dv, n = self._delete_rows(self.scan(predicate, meta=True))
        if n:
            self._commit(self._with(deletes=self.state["deletes"] + dv, feed={"inserted": [], "deleted": dv}))
        return n

    def update(self, assignments: dict[str, Column], predicate: Predicate | Column | None = None) -> int:
        """Old rows are deleted and new ones inserted, in one commit."""
        hits = self.scan(predicate, meta=True)
        return self._swap(hits.select(*[assignments[c].alias(c) if c in assignments else F.col(f"`{c}`") for c in self.schema.names], SEGMENT, INDEX, ROW_ID))

    def _swap(self, changed: DataFrame) -> int:
        """Put rows in the place of those that their segment and index name; rows without are new."""
        changed = self._staged(changed)
        dv, n = self._delete_rows(changed.where(F.col(SEGMENT).isNotNull()))
        rows = self._prepared((changed.where("__keep") if "__keep" in changed.columns else changed).select(*self.schema.names))
        if self.state["unique"] or self.state.get("exclusions"):
            left = self.scan(meta=True)
            self._check_unique(rows, left.join(self.spark.read.parquet(*dv), [SEGMENT, INDEX], "left_anti") if dv else left)
        path, added = self._write_segments(rows, "data")
        if n or added:
            state = self._with(deletes=self.state["deletes"] + dv, manifests=[*self.state["manifests"], {"path": path, "start": self.state["next_row"]}], next_row=self.state["next_row"] + added, feed={"inserted": [path], "deleted": dv})
            self._commit(self._projected(self._folded(state), added=path))
        files.remove(self.spark, f"{self.path}/_staging")
        return n

    def merge(self, source: DataFrame, on: list[str], update: dict[str, Column] | None = None, insert: bool = True) -> None:
        """Matched rows get ``update`` (columns of the source as ``s.name``), others are inserted.  A row matched twice is an error."""
        target, s = self.scan(meta=True).alias("t"), self._staged(source).alias("s")
        cond = F.lit(True)
        for c in on:
            cond = cond & (F.col(f"t.{c}") == F.col(f"s.{c}"))
        matched = target.join(s, cond)
        if matched.groupBy(SEGMENT, INDEX).count().where("count > 1").limit(1).count():
            raise ConstraintViolation("a row matches several source rows")
        place = T.StructType([T.StructField(SEGMENT, T.StringType()), T.StructField(INDEX, T.LongType()), T.StructField(ROW_ID, T.LongType())])
        changed = matched.select(*[update[c].alias(c) if c in (update or {}) else F.col(f"t.{c}") for c in self.schema.names], *place.names)
        if insert:
            fresh = s.join(target, cond, "left_anti").select("s.*")
            for f in self.schema:
                if f.name not in fresh.columns:
                    fresh = fresh.withColumn(f.name, F.lit(None).cast(f.dataType))
            new = fresh.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema], *[F.lit(None).cast(f.dataType).alias(f.name) for f in place])
            changed = changed.unionByName(new)
        self._swap(changed)

    def insert_ignoring_conflicts(self, rows: DataFrame, key: list[str]) -> None:
        """Rows whose key is there already, or came earlier in the same rows, are left out."""
        first = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(f"`{c}`") for c in rows.columns]))).where("__nth = 1").drop("__nth")
        self.insert(first.join(self.scan(columns=key), key, "left_anti").select(*rows.columns))

    def truncate(self) -> None:
        self._commit(self._with(manifests=[], dropped=[], deletes=[], sort=None, late=[], projections={k: v | {"manifests": []} for k, v in self.state["projections"].items()}))

    def change_feed(self) -> DataFrame:
        """Rows the last commit inserted and deleted, with _change."""
        feed = self.state["feed"] or {"inserted": [], "deleted": []}
        out = self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("_change", T.StringType())]))
        base = self.spark.read.schema(self.schema)
        if feed["inserted"]:
            segments = [r.segment for p in feed["inserted"] for r in self.spark.read.parquet(p).select("segment").collect()]
            if segments:
                out = out.unionByName(base.parquet(*segments).withColumn("_change", F.lit("insert")))
        if feed["deleted"]:
            gone = self.spark.read.parquet(*feed["deleted"])
            segments = [r[0] for r in gone.select(SEGMENT).distinct().collect()]
            old = base.parquet(*segments).select("*", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///").alias(SEGMENT), F.col("_metadata.row_index").alias(INDEX))
            out = out.unionByName(old.join(gone, [SEGMENT, INDEX], "left_semi").drop(SEGMENT, INDEX).withColumn("_change", F.lit("delete")))
        return out

    # ---- layout

    def _replaced(self, rows: DataFrame, sort: dict | None = None, **changes) -> dict:
        first = self.state["next_row"]
        path, n = self._write_segments(rows, "data")
        if sort is not None:
            sort = sort | {"from": first, "through": first + n - 1}
        return self._projected(self._with(manifests=[{"path": path, "start": first}], dropped=[], deletes=[], late=[], next_row=first + n, sort=sort, feed=None, **changes))

    def vacuum(self, stripe_count: int = 0) -> None:
        """Rewrite live rows into full segments."""
        if stripe_count:
            raise ValueError("stripe_count must be 0")
        self._commit(self._replaced(self.scan(columns=self.schema.names).repartition(self._parts())))

    def _parts(self) -> int:
        """How many tasks rewrite the table: each writes whole segments, several where they are small, so that the shuffle's blocks don't grow with their number."""
        n = self.aggregate(n=("count", "*")).first().n
        size = self.state["options"]["row_group_rows"]
        return max(1, -(-n // (size * max(1, ROWS_A_TASK // size))))

    def vacuum_sorted(self, *columns: str) -> None:
        """Rewrite in ascending order, nulls last, so that segments hardly overlap."""
        names = list(columns) or self.state["options"]["sort_by"]
        if not names:
            raise ValueError("no columns given, and no sort_by declared")
        order = [F.col(f"`{c}`").asc_nulls_last() for c in names]
        rows = self.scan(columns=self.schema.names).repartitionByRange(self._parts(), *order).sortWithinPartitions(*order)
        self._commit(self._replaced(rows, {"kind": "sorted", "columns": names}))

    def cluster(self, *columns: str) -> None:
        """Rewrite in Z-order of the columns."""
        from lithic.functions.zorder import ordinal, zorder_key

        rows, kinds = self.scan(columns=self.schema.names), {f.name: f.dataType for f in self.schema}
        # Ordinals keep the order of values, so the ends are those of the statistics.
        ends = self.aggregate(**{f"{f}{k}": (f, c) for k, c in enumerate(columns) for f in ("min", "max")})
        ends = ends.select(*[ordinal(f"{f}{k}", kinds[c]) for k, c in enumerate(columns) for f in ("min", "max")]).first()
        rows = rows.withColumn("__z", zorder_key(rows, columns, ends))
        rows = rows.repartitionByRange(self._parts(), "__z").sortWithinPartitions("__z").drop("__z")
        self._commit(self._replaced(rows, {"kind": "zorder", "columns": list(columns)}))

    def recluster(self, *columns: str) -> int:
        """Z-order again unless all rows are in that order already; returns the segments written."""
        status = self.sort_status().first()
        sort = self.state["sort"]
        if sort and sort["kind"] == "zorder" and sort["columns"] == list(columns) and status.appended_rows == 0 and not self.state["deletes"]:
            return 0
        self.cluster(*columns)
        return self.manifest().count()

    def compact(self) -> int:
        """Retire segments of deleted rows only; returns how many."""
        dead = self.manifest().where("deleted >= rows").select("segment")
        return self._retire(dead)

    def _retire(self, dead: DataFrame, **changes) -> int:
        where = f"{self.path}/_dropped/{uuid.uuid4().hex}"
        dead.coalesce(1).write.parquet(where)
        n = self.spark.read.parquet(where).count()
        if n or changes:
            self._commit(self._with(dropped=[*self.state["dropped"], *([where] if n else [])], **changes))
        return n

    def compact_rewrite(self, fraction: float = 0.2, max_groups: int | None = None) -> int:
        """Rewrite segments with at least this part of their rows deleted, most deleted first; returns how many."""
        worst = self.manifest().where(F.col("deleted") >= F.lit(fraction) * F.col("rows")).where("deleted > 0").orderBy((F.col("deleted") / F.col("rows")).desc(), "segment").select("segment")
        names = [r.segment for r in (worst.limit(max_groups) if max_groups else worst).collect()]
        if not names:
            return 0
        rows = self._rows(names).select(*self.schema.names)
        path, n = self._write_segments(rows, "data")
        with self.transaction():
            self._retire(self.spark.createDataFrame([(x,) for x in names], "segment string"))
            state = self._with(manifests=[*self.state["manifests"], {"path": path, "start": self.state["next_row"]}], next_row=self.state["next_row"] + n)
            # Rewritten rows have new ids, so projections are written anew in the same commit.
            self.state = self._projected(self._folded(state))
        return len(names)

    def vacuum_files(self) -> int:
        """Remove data files that the current version doesn't name; older versions can't be read after that."""
        used = {r.segment for r in self.manifest().select("segment").collect()}
        for p in self.state["projections"].values():
            if p["manifests"]:
                used |= {r.segment for r in self.spark.read.parquet(*p["manifests"]).select("segment").collect()}
        n = 0
        for folder in ("data", "projections"):
            for d in files.names(self.spark, f"{self.path}/{folder}"):
                for f in files.names(self.spark, f"{self.path}/{folder}/{d}"):
                    where = f"{self.path}/{folder}/{d}/{f}"
                    if f.endswith(".parquet") and where not in used:
                        files.remove(self.spark, where)
                        n += 1
        return n

    # ---- status

    def stats(self) -> DataFrame:
        columns = len(self.schema)
        return self.manifest().select("segment", F.col("base").alias("first_row"), "rows", "deleted", F.lit(columns).alias("chunks"), "bytes")

    def sort_status(self) -> DataFrame:
        """sort_key, and groups and rows in all, in the sorted run and behind it."""
        sort = self.state["sort"] or {"columns": [], "from": 1, "through": 0}
        run = F.col("base").between(sort["from"], sort["through"])
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        return self.manifest().agg(
            F.lit(",".join(sort["columns"])).alias("sort_key"), F.count(F.lit(1)).alias("total_groups"), F.count_if(run).alias("sorted_groups"), F.count_if(~run).alias("appended_groups"),
            zero(F.sum("rows")).alias("total_rows"), zero(F.sum(F.when(run, F.col("rows")))).alias("sorted_rows"), zero(F.sum(F.when(~run, F.col("rows")))).alias("appended_rows"),
        )

    def maintenance_due(self, deleted: float = 0.2, appended: float = 0.05) -> DataFrame:
        """deleted_fraction, appended_fraction and what to do about them."""
        sort = self.state["sort"]
        run = F.col("base").between(sort["from"], sort["through"]) if sort else F.lit(True)
        part = lambda c: F.coalesce(F.sum(c) / F.sum("rows"), F.lit(0.0)).cast("double")
        gone, late = part(F.col("deleted")), part(F.when(~run, F.col("rows")).otherwise(0))
        got = self.manifest().agg(gone.alias("deleted_fraction"), late.alias("appended_fraction"))
        return got.withColumn("recommendation", F.when(F.col("deleted_fraction") >= deleted, "compact_rewrite").when(F.col("appended_fraction") >= appended, "recluster").otherwise("none"))

    def maintain_once(self) -> str:
        """Do what is due."""
        due = self.maintenance_due().first().recommendation
        if due == "compact_rewrite":
            self.compact_rewrite()
        elif due == "recluster":
            (self.recluster if self.state["sort"]["kind"] == "zorder" else self.vacuum_sorted)(*self.state["sort"]["columns"])
        return due

    # ---- projections

    def add_projection(self, name: str, columns: list[str], sort: list[str] | None = None) -> None:
        sort = sort or columns[:1]
        if name in self.state["projections"]:
            raise ValueError(f"projection {name} exists")
        if not columns or len(set(columns)) != len(columns) or not set(columns) <= set(self.schema.names) or not set(sort) <= set(columns):
            raise ValueError("a projection needs different, known columns, and sorts by some of them")
        self._commit(self._projected(self._with(projections=self.state["projections"] | {name: {"columns": columns, "sort": sort, "manifests": []}}), {name}))

    def drop_projection(self, name: str) -> None:
        self._commit(self._with(projections={k: v for k, v in self.state["projections"].items() if k != name}))

    def rebuild_projections(self) -> None:
        self._commit(self._projected(self._with()))

    def _projected(self, state: dict, only: set[str] | None = None, added: str | None = None) -> dict:
        """``state`` with its projections written from its rows; with ``added`` only that manifest's rows, as a sorted run of their own."""
        if not state["projections"]:
            return state
        view = Table(self.spark, self.path, state, self.version)
        for name, p in state["projections"].items():
            if only is None or name in only:
                order = [F.col(f"`{c}`").asc_nulls_last() for c in p["sort"]]
                source, parts = view, None
                if added and p["manifests"] and len(p["manifests"]) < FOLD:
                    start = state["next_row"] - self.spark.read.parquet(added).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
                    source = Table(self.spark, self.path, state | {"manifests": [{"path": added, "start": start}], "dropped": []}, self.version)
                    parts = p["manifests"]
                rows = source.scan(columns=p["columns"], meta=True).select(*p["columns"], ROW_ID)
                rows = rows.repartitionByRange(source._parts(), *order).sortWithinPartitions(*order)
                p["manifests"] = [*(parts or []), view._write_segments(rows, "projections")[0]]
        return state

    def read_projection(self, name: str, predicate: Predicate | None = None) -> DataFrame:
        """Rows of the projection that are live in the table, with their row ids."""
        p = self.state["projections"][name]
        kinds = [f for f in self.schema if f.name in p["columns"]]
        schema = T.StructType([*sorted(kinds, key=lambda f: p["columns"].index(f.name)), T.StructField(ROW_ID, T.LongType())])
        if not p["manifests"]:
            self.last_report = ScanReport(0, 0, name)
            return self.spark.createDataFrame([], schema)
        m = self.spark.read.parquet(*p["manifests"])
        known = {c[:-4] for c in m.columns if c.endswith(".min")}
        segments = [r.segment for r in (m.where(predicate.possible(known)) if predicate is not None else m).select("segment").collect()]
        self.last_report = ScanReport(m.count(), len(segments), name)
        out = self.spark.read.schema(schema).parquet(*segments) if segments else self.spark.createDataFrame([], schema)
        if predicate is not None:
            out = out.where(predicate.column())
        gone = self._deletes()
        if gone is not None:
            out = out.join(gone.select(ROW_ID), ROW_ID, "left_anti").select(*schema.names)
        return out

    def reconstruct_via_projection(self, name: str, predicate: Predicate | None = None) -> DataFrame:
        """Whole rows, found by the projection."""
        ids = self.read_projection(name, predicate).select(ROW_ID)
        return self.scan(meta=True).join(ids, ROW_ID, "left_semi").select(*self.schema.names)

    def select(self, columns: list[str], predicate: Predicate | None = None, sort_hint: str | None = None) -> DataFrame:
        """Columns of matching rows, from the projection that covers them and sorts by what is filtered, if there is one."""
        names = set(columns) | ({sort_hint} if sort_hint else set())
        for name, p in self.state["projections"].items():
            if p["manifests"] and names <= set(p["columns"]) and sort_hint == p["sort"][0]:
                return self.read_projection(name, predicate).select(*columns)
        return self.scan(predicate).select(*columns)


def vacuum_full(spark: SparkSession, folder: str) -> int:
    """Vacuum every table directly below a folder; returns how many there are."""
    tables = [n for n in files.names(spark, folder) if files.exists(spark, f"{folder}/{n}/_log")]
    for n in tables:
        Table.open(spark, f"{folder}/{n}").vacuum()
    return len(tables)
