"""Work that is done once for each key, whatever is stopped and started again.

A table of marks says what was done: key, status. Each batch writes its marks to a folder of its own, named after the query
and the batch, in place of what a stopped run of that batch had left there; keys that any other folder holds are not worked
on again. Marks stay for good: unlike a watermark's state they do not forget old keys. A refusal (nothing to gain) is a mark
like any other. ``force`` works on all keys and marks them anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MARKS = "key string, status string, query string, batch long"


def marks(spark: SparkSession, path: str) -> DataFrame:
    """key, status, query, batch of all marks; a folder that is not there yet has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], MARKS)
    return spark.read.schema(MARKS).parquet(path)


def work_batch(batch: DataFrame, number: int, path: str, query: str, work: Callable[[DataFrame], DataFrame], force: bool = False) -> None:
    """Work on a batch's keys that have no mark (of other batches) and mark them. ``work`` takes the rows, one a key, and
    returns key and status."""
    spark = batch.sparkSession
    known = marks(spark, path).where(~((F.col("query") == query) & (F.col("batch") == number)))
    once = batch.dropDuplicates(["key"])
    todo = once if force else once.join(known.select("key"), "key", "left_anti")
    work(todo).select("key", "status").write.mode("overwrite").parquet(f"{path}/query={query}/batch={number}")


def work_once(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], force: bool = False) -> StreamingQuery:
    """Start the stream's query: all that has come so far, batch by batch. Started again with the same ``checkpoint`` after
    a stop it repeats at most the batch that was under way."""
    query = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    step = lambda batch, number: work_batch(batch, number, path, query, work, force)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_done(targets: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Targets that have no mark yet; all of them with ``force``."""
    return targets if force else targets.join(done.select("key"), "key", "left_anti")
