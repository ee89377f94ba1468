"""Helpers that several operators use: shared scratch tables, reading, Arrow text access."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Folders of scratch tables that are still there, and which frame reads which.
_made: dict[str, SparkSession] = {}
_read_from: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package through Spark's own file server, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent.parent
    where = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(where, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(where))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``.  Where that is
    unset, a local session uses a folder under /tmp, any other the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return "file:///tmp/checkpoints/lithic"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-run.  A
    table goes when ``discard`` names it, else when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_clean)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    _read_from[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables whose every reader has been written: nothing may be computed from them any more."""
    for df in tables:
        if path := _read_from.pop(df, None):
            _remove(_made.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for path, spark in _made.items():
        try:
            _remove(spark, path)
        except Exception:  # the JVM is gone already; the folder stays for whoever owns it
            return


#: Ids up to this number are broadcast (8 bytes each, some 50 MB as a hash table); more take a shuffle.
BROADCAST_IDS = 1_000_000


def join_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents with (left_semi) or without (left_anti) the ids of ``ids`` (columns of ``docs``), which is counted first.

    A list of checked size is broadcast, so that whole texts aren't shuffled
    only to be left out; a longer one takes the ordinary join.
    """
    ids = materialize(ids, "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ids.columns, how)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores in front until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def release() -> None:
    """Give freed memory of this worker back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def released(batches):
    """``batches``, giving back freed memory after each and at the end."""
    for batch in batches:
        yield batch
        del batch
        release()
    release()


def whole_groups(batches, keys: list[str]):
    """Record batches cut and joined so that none parts a group: rows, sorted by ``keys``, that agree in them."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rest = batch if rest is None else pa.concat_batches([rest, batch])
        same = np.ones(rest.num_rows, bool)
        for key in keys:
            values = rest.column(key).to_numpy(zero_copy_only=False)
            same &= values == values[-1]
        begin = rest.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if begin:
            yield rest.slice(0, begin)
            rest = rest.slice(begin)
    if rest is not None:
        yield rest


def slices(batch: pa.RecordBatch, column: str | int = "text", most: int = 1 << 18, rows: int = 128):
    """Yield (first row, rows) of ``batch`` so that each slice holds about ``most`` bytes of text and at most ``rows`` rows."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < len(lengths):
        base = ends[at - 1] if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + most, side="right"))))
        yield at, stop - at
        at = stop


def joined_utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array with a line break after each, and where each begins (one more entry than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    if not len(lengths):
        return np.zeros(0, np.uint8), starts
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(texts)], pa.int64()), texts)
    raw = pc.binary_join(whole, pa.scalar("\n", pa.large_string()))[0].as_buffer()
    out = np.empty(int(starts[-1]), np.uint8)
    out[:-1] = np.frombuffer(raw, np.uint8)
    out[-1] = 10
    return out, starts


def gram_counts(buf: np.ndarray, starts: np.ndarray, order: int, dims: int) -> np.ndarray:
    """Counts of hashed byte n-grams, one row per text of ``joined_utf8``; none crosses from one text to the next."""
    n = len(starts) - 1
    last = len(buf) - order + 1
    if n <= 0 or last <= 0:
        return np.zeros((max(n, 0), dims), np.float32)
    code = np.zeros(last, np.uint32)
    for k in range(order):
        code = code * np.uint32(257) + buf[k : k + last]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - int(dims).bit_length() + 1)
    owner = np.repeat(np.arange(n, dtype=np.int64) * dims, np.diff(starts))[:last]
    inside = np.ones(last, bool)
    for k in range(order - 1):
        at = starts[1:] - 1 - k
        inside[at[(at >= 0) & (at < last)]] = False
    return np.bincount((owner + code)[inside], minlength=n * dims).reshape(n, dims).astype(np.float32)
