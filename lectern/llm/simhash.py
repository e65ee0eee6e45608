"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius.

A document's terms are its distinct lower-cased words; a term's weight is (1 + ln count) * min(bytes, 12): long words
are rarer, so the weight needs no pass over the corpus. Each of BITS hash bits of a term votes with that weight.

``within_radius`` indexes blocks: the bits are cut into BLOCKS blocks; two fingerprints within the radius differ in at most
radius // BLOCKS bits of some block. Every row is a key for each block, a query also looks under each change of so many bits
(Norouzi et al. 2012). The search is exact at any radius.

RADIUS is measured: of the pairs of differing texts with a Jaccard of 0.8 or more on five-word shingles (sf0.1, 48 pairs)
0.94 lie within it; within 3 bits 0.08.

Defined cases: a null or empty text has the fingerprint of all zeros; equal texts have equal fingerprints; a null
doc_id sorts last; rows with one doc_id are ordered by a hash of the text, then by text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 128
LONGEST = 12
#: Blocks of 25 or 26 bits; a radius of 14 allows two changed bits in one.
BLOCKS = 5
RADIUS = 14
#: Bytes of text in a part, and how many parts there are at most; parts are sorted and streamed, so they may grow.
RANGE_BYTES, MOST_PARTS = 8 << 20, 4096
STEP = 64


def fingerprints(texts: pa.Array) -> np.ndarray:
    """(rows, BITS // 8) bytes."""
    offs, words = common.split_words(texts, lower=True)
    h = common.hash_words(words)
    size = np.minimum(np.asarray(pc.binary_length(words), dtype=np.float32), LONGEST)
    out = np.zeros((len(offs) - 1, BITS // 8), np.uint8)
    for i, (s, e) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
        if e > s:
            term, at, count = np.unique(h[s:e], return_index=True, return_counts=True)
            weight = (1 + np.log(count)).astype(np.float32) * size[s:e][at]
            both = np.stack([common.mix(term), common.mix(term ^ np.uint64(common.BASE))], axis=1)
            votes = np.zeros(BITS, np.float32)
            for k in range(0, len(term), 65536):  # a very long text votes in pieces
                bits = np.unpackbits(both[k : k + 65536].view(np.uint8), axis=1)
                votes += weight[k : k + 65536] @ bits
            out[i] = np.packbits(votes * 2 > weight.sum())
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def listed(values: list[int]) -> Column:
    """Whole numbers as one constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>") if values else F.array().cast("array<long>")


def part_of(key: Column, turn: Column, quantiles: list[int]) -> Column:
    """The place of a row's range in descending key. A key that is several quantiles has that many ranges, of equal spans of
    ``turn`` (any long, spread evenly), descending too. Two steps of 64 values, as there may be thousands of ranges."""
    times = Counter(quantiles)
    bounds = sorted(times, reverse=True)
    if not bounds:
        return F.lit(0)
    groups = [bounds[i : i + STEP] for i in range(0, len(bounds), STEP)]
    most = listed([times[x] for x in bounds])
    before = listed([0, *np.cumsum([times[x] for x in bounds]).tolist()])
    coarse = F.size(F.filter(listed([g[-1] for g in groups]), lambda x: x >= key))
    passed = F.least(F.lit(len(bounds)), coarse * STEP + F.size(F.filter(F.slice(listed(bounds), coarse * STEP + 1, STEP), lambda x: x >= key)))
    own = F.greatest(passed - 1, F.lit(0)).cast("int")
    upper = F.shiftright(F.bitwise_not(turn), 32) + F.lit(1 << 31)  # from 0 to 2**32, the greatest turn first
    within = F.get(before, own) + 1 + F.shiftright(upper * F.get(most, own), 32)
    return F.when((passed > 0) & (F.get(listed(bounds), own) == key), within).otherwise(F.get(before, passed.cast("int"))).cast("int")


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (part, own, key, turn, doc_id, text), to be read by part, own, key, turn (all three descending), text: after a
    part's own rows comes a copy of the row that follows its last in that order; after the last of all, the first. And
    how many parts there may be.

    Parts are ranges of doc_id of about RANGE_BYTES of text, an id that very many rows have is cut by ``turn``, a hash of
    the text. The driver sees two numbers for each part.
    """
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)).alias("key"), F.xxhash64("text").alias("turn"))
    n = common.buckets_for(docs, "text", RANGE_BYTES, least=4, most=MOST_PARTS)
    quantiles = [int(x) for x in keyed.select("key").approxQuantile("key", [i / n for i in range(1, n)], 0.25 / n)]
    placed = keyed.withColumn("part", part_of(F.col("key"), F.col("turn"), quantiles))
    heads = placed.groupBy("part").agg(F.max(F.struct("key", "turn")).alias("head")).orderBy("part").collect()
    if not heads:
        return placed.withColumn("own", F.lit(1)), n
    parts = [part for part, _ in heads]
    # a part's head also goes to the part before, the first one's to the last
    into, keys, turns = [-1] * (parts[-1] + 1), [0] * (parts[-1] + 1), [0] * (parts[-1] + 1)
    for i, (part, head) in enumerate(heads):
        into[part], keys[part], turns[part] = parts[i - 1], head[0], head[1]
    first = (F.get(listed(keys), F.col("part")) == F.col("key")) & (F.get(listed(turns), F.col("part")) == F.col("turn"))
    copy = F.when(first, F.get(listed(into), F.col("part")).cast("int"))
    rows = F.array(F.struct("part", F.lit(1).alias("own")), F.struct(copy.alias("part"), F.lit(0).alias("own")))
    return placed.withColumn("to", F.explode(F.filter(rows, lambda x: x["part"].isNotNull()))).select("to.part", "to.own", "key", "turn", "doc_id", "text"), n


def edited(text: str, following: str) -> str:
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs``
    (doc_id, text; other columns are ignored). The edited text takes its last third from the next document."""
    common.configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # part, own, doc_id, text, fingerprint of the row before
        for b in common.slices(batches, "text", 2 << 20):
            prints = fingerprints(b.column("text"))
            rows = list(zip(b.column("part").to_pylist(), b.column("own").to_pylist(), b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()], prints, strict=True))
            rows = [last, *rows] if last else rows
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if x[1] and x[0] == y[0]]
            last = rows[-1]
            if not pairs:
                continue
            texts = [edited(x[3], y[3]) for x, y in pairs]
            own, following = np.stack([x[4] for x, _ in pairs]), np.stack([y[4] for _, y in pairs])
            changed = fingerprints(pa.array(texts, pa.string()))
            columns = {
                "doc_id": pa.array([x[2] for x, _ in pairs], pa.int64()),
                "n_chars": pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                "fingerprint": pa.array([x.tobytes().hex() for x in own], pa.string()),
                "edited_fingerprint": pa.array([x.tobytes().hex() for x in changed], pa.string()),
                "near_edited": pa.array(likeness(own, changed), pa.float64()),
                "near_next": pa.array(likeness(own, following), pa.float64()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    rows, parts = with_next(docs.select("doc_id", "text"))
    rows = rows.repartitionById(parts, "part").sortWithinPartitions("part", F.desc("own"), F.desc("key"), F.desc("turn"), "text")
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def block(high: Column, low: Column, start: int, end: int) -> Column:
    """Bits [start, end) of a fingerprint, as a number."""
    if end <= 64:
        value = F.shiftrightunsigned(high, 64 - end)
    elif start >= 64:
        value = F.shiftrightunsigned(low, BITS - end)
    else:
        value = F.shiftleft(high, end - 64).bitwiseOR(F.shiftrightunsigned(low, BITS - end))
    return value.bitwiseAND(F.lit((1 << (end - start)) - 1))


def within_radius(queries: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """query, found, distance: for each distinct ``fingerprint`` (hex) of ``queries``, all distinct ones of ``prints`` within the radius.

    Equal fingerprints count once on either side; a pair comes from the first block that holds it only.
    """
    edge = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    spans, most = list(zip(edge[:-1], edge[1:], strict=True)), radius // BLOCKS

    def halves(df: DataFrame, name: str) -> DataFrame:
        own = df.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct()
        return own.select(*(F.conv(F.substring("fingerprint", at, 16), 16, -10).cast("long").alias(f"{name}_{part}") for part, at in (("high", 1), ("low", 17))))

    def keyed(df: DataFrame, name: str, flips: int) -> DataFrame:
        """A row for each block and each way to change at most ``flips`` of its bits."""
        keys = []
        for k, (s, e) in enumerate(spans):
            changes = [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(e - s), n)]
            listed = F.split(F.lit(",".join(map(str, changes))), ",").cast("array<long>")
            own = block(F.col(f"{name}_high"), F.col(f"{name}_low"), s, e)
            looked_up = F.transform(listed, lambda x: F.xxhash64(F.lit(k), own.bitwiseXOR(x)))  # noqa: B023
            keys.append(F.struct(F.lit(k).alias("table"), looked_up.alias("keys")))
        each = df.select("*", F.explode(F.array(*keys)).alias("x"))
        return each.select(*df.columns, F.col("x.table").alias(f"{name}_table"), F.explode("x.keys").alias("key"))

    high, low = F.col("query_high").bitwiseXOR(F.col("found_high")), F.col("query_low").bitwiseXOR(F.col("found_low"))
    distance = F.bit_count(high) + F.bit_count(low)
    first = F.array_position(F.array(*(F.bit_count(block(high, low, s, e)) <= most for s, e in spans)), True) - 1
    near = keyed(halves(prints, "found"), "found", 0)
    spread = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: a few small rows become very many
    asked = common.with_bitmap(keyed(halves(queries, "query").repartition(spread, "query_high", "query_low"), "query", most), near, "key", ["key"])  # keys that no row has are not moved
    both = asked.join(near, "key").where((F.col("query_table") == F.col("found_table")) & (distance <= radius) & (first == F.col("query_table")))
    text = lambda name: F.concat(*(F.lower(F.lpad(F.hex(f"{name}_{part}"), 16, "0")) for part in ("high", "low")))
    return both.select(text("query").alias("query"), text("found").alias("found"), distance.cast("int").alias("distance"))


def with_neighbours(prints: DataFrame, is_query: Column, radius: int) -> DataFrame:
    """All columns of ``prints`` and, for query rows (null for others), n_within: how many other rows' fingerprints lie within
    the radius; and near: these fingerprints with their distances, least first, on the rows of the least doc_id among the
    queries of one fingerprint. Rows of equal fingerprints are one class: ``fingerprint`` says which rows a found one stands for."""
    cut = common.Cuts(prints.sparkSession)
    rows = cut(prints, "prints")
    size = rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min(F.when(is_query, F.col("doc_id"))).alias("least"))
    found = within_radius(rows.where(is_query), rows, radius)
    pairs = found.join(size.select(F.col("fingerprint").alias("found"), "n"), "found")
    near = pairs.groupBy("query").agg((F.sum("n") - 1).alias("n_within"), F.sort_array(F.collect_list(F.struct("distance", F.col("found").alias("fingerprint")))).alias("near"))
    # a table of its own, so that the join with the rows can split a fingerprint that very many share
    near = cut(near.join(size.select(F.col("fingerprint").alias("query"), "least"), "query"), "near")
    out = rows.join(near, rows.fingerprint == near["query"], "left")
    return out.select(*rows.columns, F.when(is_query, F.col("n_within")).alias("n_within"), F.when(is_query & F.col("doc_id").eqNullSafe(F.col("least")), F.col("near")).alias("near"))
