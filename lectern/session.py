"""The engine's session settings."""

from __future__ import annotations

import atexit
import logging
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI mode and adaptive execution; ``conf`` adds or overrides settings (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder ``spark.checkpoint.dir``, which driver and executors share. Where that is unset, a local master
    gets a folder of its own and a cluster an error. What is written there is deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/lectern-written"
        logging.getLogger(__name__).warning("spark.checkpoint.dir is not set: tables go to %s, which only this machine sees", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to a shared path and read back: its lineage ends there, and it survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing that is still to be computed reads them."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
