"""Small files in any store that Spark reads, through Hadoop's file systems."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Exists(Exception):
    """The file that was to be created is there already."""


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as Spark names files that it reads."""
    fs, where = _at(spark, path)
    return re.sub("^file:/+", "file:///", fs.makeQualified(where).toString()).rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def sizes(spark: SparkSession, path: str) -> dict[str, int]:
    fs, where = _at(spark, path)
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(where) if s.isFile()} if fs.exists(where) else {}


def count(spark: SparkSession, pattern: str) -> int:
    """How many files a pattern of names finds."""
    fs, where = _at(spark, pattern)
    return len(fs.globStatus(where))


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file; raises Exists where there is one, which makes it the point of commit."""
    create_bytes(spark, path, text.encode())


def create_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    fs, where = _at(spark, path)
    try:
        stream = fs.create(where, False)
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            raise Exists(path) from e
        raise
    try:
        stream.write(bytearray(raw))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, where = _at(spark, source)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{source} can't be moved to {target}")


@contextmanager
def opened(spark: SparkSession, path: str):
    """A function (offset, length) that reads bytes, fewer at the end, and the file's size."""
    fs, where = _at(spark, path)
    stream = fs.open(where)

    def read_at(offset: int, length: int) -> bytes:
        stream.seek(offset)
        return bytes(stream.readNBytes(length))

    try:
        yield read_at, fs.getFileStatus(where).getLen()
    finally:
        stream.close()
