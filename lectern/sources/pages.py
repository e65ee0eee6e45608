"""List pages as a source: a listing is cut into pages of a fixed length once, and readers take the pages they ask for.

A page is a folder of its own, so Spark's partition pruning leaves the others unread, and each row knows the listing's
total. This does for stored listings what paged requests with a total in their header do for a server.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import running


def write_pages(df: DataFrame, order: list[str], path: str, limit: int = 100) -> None:
    """Rows in the order of the named columns (its last one unique) as pages 0, 1, ... of ``limit`` rows, with ``place`` and ``total``."""
    placed = running(df, order).withColumnRenamed("before", "place")
    total = placed.agg(F.count("*").alias("total"))
    rows = placed.crossJoin(F.broadcast(total))  # one row
    rows = rows.withColumn("page", F.floor(F.col("place") / limit).cast("int")).repartition("page").sortWithinPartitions("page", "place")
    rows.write.mode("overwrite").partitionBy("page").parquet(path)


def read_pages(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """Rows of the pages asked for (both ends count), with page, place and total; an empty listing gives none."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("page") >= first) if last is None else rows.where(F.col("page").between(first, last))
