"""Shared pieces of the training-data operators: bounded Arrow batches, word hashing, sizing and durable cuts.

Words are the runs of ``[^\\x20\\x09-\\x0D]``; a null text counts as an empty one. Hashes are 64 bit, equal on
every machine, and never depend on Python's own string hash.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the rolling hash.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: A null doc_id takes part in orders and ties as this value.
NULL_ID = -(1 << 63)
#: log2 of the bits of a bitmap: 2 MiB, whatever the corpus.
BITMAP_BITS = 24


def configure(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: rows first, bytes for long texts. Python workers keep a few such batches. A session's
    own smaller bounds stay."""
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Cuts:
    """Tables written to the shared checkpoint folder and read back: lineage ends there and survives lost executors.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset, a local master gets a folder of its own and
    a cluster an error. An operator cuts what it returns last: all of its other tables are deleted then. What a returned
    DataFrame reads from is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        atexit.register(delete, self.spark, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """Cut ``df`` and delete every table cut before."""
        before, self.paths = self.paths, []
        out = self(df, name)
        self.paths, mine = before, self.paths
        self.drop()
        self.paths = mine
        return out

    def drop(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []
        gc.collect()
        self.spark._jvm.System.gc()  # shuffle files of finished steps go once the driver's garbage is collected


def delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file:///tmp/lectern-checkpoints-{os.getpid()}"
    return found.rstrip("/")


def buckets_for(df: DataFrame, column: str, per_bucket: int, least: int = 16, most: int = 1 << 20) -> int:
    """A power of two: so many buckets that each gets about ``per_bucket`` bytes of ``column``."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    n = least
    while n * per_bucket < total and n < most:
        n *= 2
    return n


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece has about ``limit`` bytes of ``column``, or one row. At the end a worker gives free memory back:
    it waits idle beside the JVM until the next stage."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), dtype=np.int64)
        group = np.cumsum(size) // limit
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for s, e in zip(starts, np.r_[starts[1:], b.num_rows], strict=True):
            yield b.slice(int(s), int(e - s))
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array]:
    """Offsets (rows + 1) and the words of all rows, end to end."""
    a = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(a) if lower else a)
    words = lists.flatten()
    lens = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    offs = np.r_[0, np.cumsum(lens)]
    keep = pc.not_equal(pc.binary_length(words), 0)
    if not pc.all(keep).as_py() and len(words):
        offs = np.r_[0, np.cumsum(np.asarray(keep, dtype=np.int64))][offs]
        words = words.filter(keep)
    return offs, words


def hash_words(words: pa.Array) -> np.ndarray:
    """xxh3 of every word; each distinct word is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    enc = words.dictionary_encode()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, enc.dictionary.to_pylist()), np.uint64, len(enc.dictionary))
    return own[np.asarray(enc.indices)]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of each run of ``width`` words of the flat array; built by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, size = None, 0, h, 1
    bits = width
    at = 0
    while bits:
        if bits & 1:
            part = power[at : at + n]
            out = part.copy() if out is None else out * np.uint64(pow(BASE, size, 1 << 64)) + part
            at += size
            have += size
        bits >>= 1
        if bits:
            power = power[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + power[size:]
            size *= 2
    return mix(out)


def ids(column: pa.Array) -> np.ndarray:
    """doc_id as int64; null is NULL_ID."""
    return np.asarray(pc.fill_null(pc.cast(column, pa.int64()), NULL_ID), dtype=np.int64)


def bitmap_of(hashes: DataFrame, column: str) -> DataFrame:
    """Pages (at most 2**BITMAP_BITS / 32768 rows of 512 longs) of a bitmap in which each hash of the column sets a bit."""
    slot = F.col(column).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    page, bit = F.shiftright(slot, 15).cast("int"), slot.bitwiseAND(F.lit(32767))
    filled = hashes.select(page.alias("page"), bit.alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return filled.select("page", F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long")).alias("bits"))


def with_bitmap(df: DataFrame, hashes: DataFrame, column: str, tested: list[str], flags: bool = False) -> DataFrame:
    """Rows of ``df`` of which one of the ``tested`` hash columns may be in ``hashes.column``; the pages are broadcast, 2 MiB
    at most. With ``flags`` a boolean stands in each tested column's place."""
    pages = bitmap_of(hashes, column)
    hit, out = F.lit(False), df
    for c in tested:
        slot = F.col(c).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
        own = F.broadcast(pages.select(F.col("page").alias(f"__page_{c}"), F.col("bits").alias(f"__bits_{c}")))
        out = out.join(own, F.shiftright(slot, 15).cast("int") == F.col(f"__page_{c}"), "left")
        word = F.get(f"__bits_{c}", F.shiftright(slot, 6).bitwiseAND(F.lit(511)).cast("int"))
        # a page's bytes are read as big-endian longs: the byte's place in its long is mirrored
        own_hit = F.coalesce(F.getbit(word, slot.bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56)).cast("int")), F.lit(0)) == 1
        hit = hit | own_hit
        out = out.withColumn(f"__hit_{c}", own_hit)
    return out.where(hit).select(*((F.col(f"__hit_{c}").alias(c) if flags and c in tested else c) for c in df.columns))
