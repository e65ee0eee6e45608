"""Running sums over a whole table in an order, in two passes and without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def running(df: DataFrame, order: list[str], size: Column | int = 1) -> DataFrame:
    """``df`` with ``before``: the sum of ``size`` over all rows that come before in the order of the named columns.

    Rows are dealt to ranges of the order and written, so that both passes see the same ranges; the ranges' sums (a row a
    range) are added up, and each row adds what its own range holds before it. Rows that are equal in ``order`` meet in one
    range: end it with a column that tells them apart.
    """
    name = "__size"
    ranges = df.withColumn(name, F.lit(size) if isinstance(size, int) else size).repartitionByRange(*(F.col(c) for c in order)).withColumn("__range", F.spark_partition_id())
    own = written(ranges, "ranges")
    sums = own.groupBy("__range").agg(F.sum(name).alias("__sum"))
    base = sums.select("__range", (F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")).alias("__base"))
    mine = F.sum(name).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(name)
    # a row a range: as many as the session has shuffle partitions
    out = own.join(F.broadcast(base), "__range").withColumn("before", (F.col("__base") + mine).cast("long"))
    return out.select(*df.columns, "before")
