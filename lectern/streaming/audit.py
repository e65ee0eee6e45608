"""The audit log as a stream: an append-only log of calls, counted by label and window. (An extra: batch counts give the same rows.)"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.ordered import running

#: Bytes after which a log's part is closed.
PART = 5 * 1024 * 1024
HEAD, ERROR = 120, 200
RECORD = ["ts", "label", "codeSHA256", "codeBytes", "codeHead", "ok", "error", "dryRunWrites"]
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def counts(audit: DataFrame) -> DataFrame:
    """label, n, errors, bytes of a batch log."""
    return audit.groupBy("label").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors"), F.round(F.sum("code_bytes"), 2).alias("bytes"))


def hourly(audit: DataFrame) -> DataFrame:
    """hour, label, n, errors of a log, batch or stream."""
    hour = F.window("ts", "1 hour").getField("start")
    return audit.groupBy(hour.alias("hour"), "label").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors"))


def stream(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """The log of a folder of Parquet files as a stream with a watermark."""
    rows = spark.readStream.schema(SCHEMA).parquet(path)
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("label"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("code_bytes"), "event_id").withWatermark("ts", late)


def once(events: DataFrame) -> DataFrame:
    """Each event once: of a stream within the watermark, of a batch at all."""
    return events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def records(calls: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The log's records (RECORD) of calls (ts, label, code, ok, error, would_write): the code's hash, length and first line in
    place of the code, an error's beginning of a failed call, and how many writes a dry run held back. Columns to ``keep`` come
    through; they are no part of a record."""
    code = F.coalesce("code", F.lit(""))
    ok = F.coalesce("ok", F.lit(False))
    return calls.select(
        *(keep or []), "ts", "label", F.substring(F.sha2(code, 256), 1, 16).alias("codeSHA256"), F.length(code).cast("long").alias("codeBytes"),
        F.substring(F.element_at(F.split(T.strip(code), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"), 1), 1, HEAD).alias("codeHead"), ok.alias("ok"),
        F.when(~ok, F.substring(F.coalesce("error", F.lit("")), 1, ERROR)).alias("error"), F.col("would_write").cast("long").alias("dryRunWrites"),
    )


def rotated(log: DataFrame, order: list[str], first: int = 0, filled: int = 0, most: int = PART) -> DataFrame:
    """part, at (bytes of the log before it), value: the rows as JSON lines in the order of the named columns (the last one
    unique), cut into parts of ``most`` bytes; a line lies in the part in which it begins. ``first`` is the first part's number,
    ``filled`` what it holds already."""
    lines = log.select(*order, F.to_json(F.struct(*RECORD)).alias("value"))
    placed = running(lines, order, F.octet_length("value") + 1).withColumn("at", F.col("before") + filled)
    return placed.select((F.floor(F.col("at") / most) + first).cast("int").alias("part"), "at", "value")


def append_audit(log: DataFrame, path: str, order: list[str], most: int = PART) -> bool:
    """Append records to a log of parts, each one file of lines in order. The log must not break what it tells of: a write
    that fails is reported to the logger and gives False."""
    spark = log.sparkSession
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        first = filled = 0
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            old = spark.read.text(path)
            first = old.agg(F.max("part")).first()[0] or 0
            filled = old.where(F.col("part") == first).agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
        parts = rotated(log, order, first, filled, most)
        parts.repartition("part").sortWithinPartitions("part", "at").select("part", "value").write.mode("append").partitionBy("part").text(path)
    except Exception:
        logging.getLogger(__name__).exception("the audit log at %s was not written", path)
        return False
    return True
