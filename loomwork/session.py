"""A Spark session with the settings the library expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "loomwork", master: str | None = None, **conf) -> SparkSession:
    """UTC, adaptive execution, Arrow transfer; other settings by keyword with `__` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which all executors share; on a local master without that setting, under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", base := tempfile.mkdtemp(prefix="loomwork-"))
    return f"{base.rstrip('/')}/loomwork-{name}-{uuid.uuid4().hex}"
