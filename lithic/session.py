"""Sessions and the shared workspace."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lithic", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results depend on: UTC, ANSI arithmetic, adaptive execution."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, for tables that live as long as a session.

    Under what the cluster names in ``spark.checkpoint.dir``; where that is
    unset, a local session uses a folder under /tmp, any other the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        root = "file:///tmp/checkpoints/lithic" if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
