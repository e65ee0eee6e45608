"""Phrase collocations: word sequences that occur together more than their parts do, by pivot partitioning.

Texts are cut into pieces at punctuation and line ends, and those into words (A-Z lower-cased). A candidate is a phrase of
2 to 4 words with at least ``least`` occurrences in its language; its score is its weakest cut's floor(2000000 a / (l + r)).
A candidate that lies in a longer one with four fifths of its occurrences goes.

Plan, as in MG-FSM:

1. Words are counted by language. A sketch of the frequent ones (CELLS bytes, whatever the corpus) gives each word a level
   that never understates its count; (level, hash) orders all words, rarest first.
2. Every occurrence of a word is the pivot of a fragment: the words around it, three each side at most, as long as they are
   in one piece, frequent and not rarer (on the left: not equal either). So each occurrence of a phrase lies in just one
   fragment around its rarest word, the leftmost of equals. Equal fragments of a batch go as one with a count, packed, to
   the bucket of their pivot; a pivot of many occurrences has several buckets.
3. A bucket counts the phrases that hold the pivot, no others. Counts of a pivot that has one bucket are whole, and only
   frequent ones leave it; others are added up by Spark.
4. Cuts and containing phrases are joins of the frequent phrases with themselves; words are looked up for those in reach of
   the first ``best`` only.

Words are known by 64-bit hashes (of language and word) until then; equal hashes of two frequent words raise an error.

Defined cases: null text is empty; null lang is ``und``; a repeated row counts as often as it stands there; a language
without candidates gives no rows, nor do no documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .byte_terms import Terms, gathered, runs, table_of

LONGEST, LEAST, BEST, CONTAINED = 4, 30, 2000, 80
#: Bytes of text that are cut at once; words that one bucket stands for; occurrences of a pivot that one bucket takes.
BATCH, BUCKET, PIVOT = 4 << 20, 3 << 19, 1 << 20
#: Bytes of the sketch (a power of two), and parts in which a language's best are first looked for.
CELLS, PARTS = 1 << 22, 64
#: 1: bytes of words; 2: ends of pieces; 0: blanks.
KIND = table_of([(0, 255, 1), (0x20, 0x20, 0), (0x09, 0x09, 0), (0x0A, 0x0D, 2), *((ord(c), ord(c), 2) for c in ".,;:!?")])
#: Offsets from the pivot of phrases that hold it: (first, last).
SPANS = [(a, a + n - 1) for n in range(2, LONGEST + 1) for a in range(1 - n, 1)]
REACH = LONGEST - 1
KEYS = [f"w{k}" for k in range(1, LONGEST + 1)]


def terms_of(t: pa.Table) -> tuple[Terms, list[str], np.ndarray]:
    """The words of a batch (equal ones of different languages apart), the languages, and each row's language."""
    langs = t.column("lang").combine_chunks().dictionary_encode()
    names = langs.dictionary.to_pylist()
    of_row = np.asarray(langs.indices, np.int64)
    seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)
    return Terms(t.column("text"), KIND, seeds[of_row]), names, of_row


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, hash, n, added up within batches only; a row with no word has a language's total."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches, "text", BATCH):
            terms, names, of_row = terms_of(t)
            if not len(terms.row):
                continue
            lang, n = of_row[terms.row], np.bincount(terms.group, minlength=len(terms.first))
            total = np.bincount(lang, minlength=len(names))
            langs = pa.array(names).take(pa.array(np.r_[lang[terms.first], np.arange(len(names))]))
            words = pa.concat_arrays([terms.words(), pa.nulls(len(names), pa.string())])
            hashes = np.r_[terms.hash[terms.first].view(np.int64), np.zeros(len(names), np.int64)]
            yield pa.RecordBatch.from_arrays([langs, words, pa.array(hashes), pa.array(np.r_[n, total].astype(np.int64))], ["lang", "word", "hash", "n"])

    return docs.mapInArrow(count, "lang string, word string, hash long, n long")


def level_of(n: Column) -> Column:
    """1 to 253: four levels for each doubling."""
    return (1 + F.floor(4 * F.log2(n))).cast("int")


def sketch_of(words: DataFrame) -> np.ndarray:
    """The highest level of the words of each cell; cells without one are 0."""
    cell = F.col("hash").bitwiseAND(F.lit(CELLS - 1)).cast("int")
    found = words.groupBy(cell.alias("cell")).agg(F.max(level_of(F.col("n"))).alias("level")).toArrow()
    out = np.zeros(CELLS, np.uint8)
    out[np.asarray(found.column("cell"))] = np.asarray(found.column("level"))
    return out


def fragments(docs: DataFrame, sketch: np.ndarray, buckets: int) -> DataFrame:
    """lang, bucket, payload: packed fragments with counts and whether their pivot has several buckets."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch.tobytes())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(shared.value, np.uint8)
        for t in gathered(batches, "text", BATCH):
            terms, names, of_row = terms_of(t)
            if not len(terms.row):
                continue
            own = terms.hash[terms.first]
            level = levels[own & np.uint64(CELLS - 1)].astype(np.uint64)
            order = np.where(level > 0, level << np.uint64(56) | own >> np.uint64(8), np.uint64(0))[terms.group]
            ends = np.cumsum(KIND[terms.bytes] == 2)
            linked = (terms.row[1:] == terms.row[:-1]) & (ends[terms.start[1:]] == ends[terms.end[:-1] - 1]) & (order[1:] > 0) & (order[:-1] > 0)
            size = len(order)
            columns = np.full((2 * REACH + 1, size), -1, np.int32)
            columns[REACH] = terms.group
            for side in (-1, 1):
                going = order > 0
                for k in range(1, REACH + 1):
                    to, frm = (slice(k, None), slice(None, -k)) if side < 0 else (slice(None, -k), slice(k, None))
                    step = np.zeros(size, bool)
                    if k < size:
                        edge = linked[: size - k] if side < 0 else linked[k - 1 :]
                        step[to] = going[to] & edge & ((order[frm] > order[to]) if side < 0 else (order[frm] >= order[to]))
                        columns[REACH + side * k][to] = np.where(step[to], terms.group[frm], -1)
                    going = step
            columns = columns[:, (columns[REACH - 1] >= 0) | (columns[REACH + 1] >= 0)]
            if not columns.shape[1]:
                continue
            pivot = columns[REACH]
            # of a pivot with many occurrences, equal fragments go to one bucket of several
            ways = np.maximum(np.exp2((level.astype(np.float64) - 1) / 4) / PIVOT, 1).astype(np.uint64)[pivot]
            mark = np.zeros(columns.shape[1], np.uint64)
            for c in columns:
                mark = common.mix(mark * np.uint64(common.BASE) + np.where(c >= 0, own[c], np.uint64(0)))
            bucket = common.mix(own[pivot] + mark % ways * np.uint64(common.BASE)) % np.uint64(buckets)
            lang = of_row[terms.row[terms.first]][pivot]
            key = (lang.astype(np.uint64) * np.uint64(buckets) + bucket) << np.uint64(32) | mark >> np.uint64(32)
            by = np.argsort(key, kind="stable")
            columns, key, ways = columns[:, by], key[by], ways[by]
            new = np.r_[True, (columns[:, 1:] != columns[:, :-1]).any(axis=0) | (key[1:] != key[:-1])]
            at = np.flatnonzero(new)
            n = np.diff(np.r_[at, len(key)])
            columns, dealt, ways = columns[:, at], key[at] >> np.uint64(32), ways[at]
            for s, size in zip(*runs(dealt), strict=True):
                part = slice(s, s + size)
                code = int(dealt[s])
                data = packed(columns[:, part], own, n[part], ways[part] > 1)
                yield pa.RecordBatch.from_arrays([pa.array([names[code // buckets]]), pa.array([code % buckets], pa.int32()), pa.array([data], pa.binary())], ["lang", "bucket", "payload"])

    return docs.mapInArrow(cut, "lang string, bucket int, payload binary")


def packed(columns: np.ndarray, hashes: np.ndarray, n: np.ndarray, spread: np.ndarray) -> bytes:
    used, at = np.unique(columns, return_inverse=True)
    words = np.where(used >= 0, hashes[used], np.uint64(0))
    raw = [np.array([len(words), len(n)], "<u4"), words.astype("<u8"), at.astype("<u4").reshape(columns.shape), n.astype("<u4"), spread.astype("u1")]
    return zstandard.compress(b"".join(x.tobytes() for x in raw), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes (0: no word), columns of places in them, counts, and whether the pivot has several buckets."""
    raw = zstandard.decompress(data)
    words, size = (int(x) for x in np.frombuffer(raw, "<u4", 2))
    width = 2 * REACH + 1
    at = 8 + 8 * words
    return (
        np.frombuffer(raw, "<u8", words, 8), np.frombuffer(raw, "<u4", width * size, at).reshape(width, size),
        np.frombuffer(raw, "<u4", size, at + 4 * width * size).astype(np.int64), np.frombuffer(raw, "u1", size, at + 4 * (width + 1) * size).astype(bool),
    )


def summed(parts: list[np.ndarray], n: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal columns of ``parts`` (numbers under ``kinds``) the first's place, and the sum of ``n``."""
    bits = np.uint64(max(kinds - 1, 1).bit_length())
    keys: list[np.ndarray] = []
    room = 0
    for p in parts:
        if room < int(bits):
            keys.append(p.astype(np.uint64))
            room = 64
        else:
            keys[-1] = keys[-1] << bits | p.astype(np.uint64)
        room -= int(bits)
    by = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys)
    new = np.zeros(max(len(by) - 1, 0), bool)
    for k in keys:
        new |= k[by][1:] != k[by][:-1]
    at = np.flatnonzero(np.r_[True, new])
    return by[at], np.add.reduceat(n[by], at)


def mine(payloads: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (a row a phrase, 0 where it has no more words) and counts of the phrases that hold their fragment's pivot."""
    parts = [unpacked(p) for p in payloads]
    words = np.unique(np.concatenate([p[0] for p in parts] + [np.zeros(1, np.uint64)]))  # place 0 is no word
    columns = np.concatenate([np.searchsorted(words, p[0])[p[1]].astype(np.uint32) for p in parts], axis=1)
    n, spread = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    found, counts = [], []
    for first, last in SPANS:
        held = np.flatnonzero((columns[REACH + first] > 0) & (columns[REACH + last] > 0))
        if len(held):
            own = [columns[k][held] for k in range(REACH + first, REACH + last + 1)]
            at, total = summed(own, n[held], len(words))
            keep = (total >= least) | spread[held[at]]  # a phrase has its pivot in one place: this sum is whole, or its pivot is spread
            rows = np.zeros((keep.sum(), LONGEST), np.uint64)
            for k, c in enumerate(own):
                rows[:, k] = words[c[at[keep]]]
            found.append(rows)
            counts.append(total[keep])
    if not found:
        return np.zeros((0, LONGEST), np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(counts)


def frequent_phrases(docs: DataFrame, sketch: np.ndarray, buckets: int, least: int) -> DataFrame:
    """lang, w1 to w4 (hashes, 0 for no word), a: phrases of 2 to 4 words with at least ``least`` occurrences."""

    def count(group: pa.Table) -> pa.Table:
        rows, n = mine(group.column("payload").to_pylist(), least)
        lang = pa.array([group.column("lang")[0].as_py()] * len(n), pa.string())
        return pa.Table.from_arrays([lang, *(pa.array(np.ascontiguousarray(rows[:, k]).view(np.int64)) for k in range(LONGEST)), pa.array(n)], ["lang", *KEYS, "a"])

    parts = fragments(docs, sketch, buckets).groupBy("lang", "bucket").applyInArrow(count, "lang string, " + ", ".join(f"{k} long" for k in KEYS) + ", a long")
    return parts.groupBy("lang", *KEYS).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def part_of(first: int, last: int) -> list[Column]:
    """The words of a phrase from one place to another, as the key of a phrase."""
    return [F.col(KEYS[first + k]) if first + k <= last else F.lit(0).cast("long") for k in range(LONGEST)]


def parts_by(length: Column, spans: dict[int, list[tuple[int, int, int, int]]]) -> Column:
    """Of a phrase of ``length`` words the parts (k, side, first, last) listed for it, as structs."""
    out = F.lit(None)
    for n, listed in spans.items():
        made = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), *(c.alias(f"p{j + 1}") for j, c in enumerate(part_of(first, last)))) for k, side, first, last in listed))
        out = F.when(length == n, made).otherwise(out)
    return out


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, contained: int = CONTAINED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``best`` phrases by score, count, and bytes.

    ``docs`` needs text and lang; other columns are ignored.
    """
    spark = docs.sparkSession
    common.configure(spark)
    cut = common.Cuts(spark)
    docs = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    counted = count_words(docs).groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))
    counted = cut(counted.where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    totals = counted.where("word is null").select("lang", F.col("n").alias("total"))
    alike = F.raise_error(F.concat(F.lit("two words share a hash: "), F.min("word"), F.lit(" "), F.max("word"))).cast("string")
    words = counted.where("word is not null").groupBy("lang", "hash").agg(F.when(F.count("*") > 1, alike).otherwise(F.min("word")).alias("word"), F.sum("n").alias("n"))
    most, buckets = totals.agg(F.max("total")).first()[0] or 0, 1
    while buckets * BUCKET < most:
        buckets *= 2
    found = cut(frequent_phrases(docs, sketch_of(words), buckets, least), "phrases")
    length = reduce_sum([(F.col(k) != 0).cast("int") for k in KEYS])
    found = found.withColumn("length", length)
    zero = F.lit(0).cast("long")
    known = words.select("lang", F.col("hash").alias("p1"), *(zero.alias(f"p{k}") for k in range(2, LONGEST + 1)), F.col("n").alias("f"))
    known = known.unionByName(found.select("lang", *(F.col(c).alias(f"p{k + 1}") for k, c in enumerate(KEYS)), F.col("a").alias("f")))
    names = ["lang", *(f"p{k + 1}" for k in range(LONGEST))]
    cuts = {n: [x for k in range(1, n) for x in ((k, 0, 0, k - 1), (k, 1, k, n - 1))] for n in range(2, LONGEST + 1)}
    sides = found.select("lang", *KEYS, "a", "length", F.explode(parts_by(F.col("length"), cuts)).alias("x")).select("lang", *KEYS, "a", "length", "x.*")
    sides = sides.join(known, names).groupBy("lang", *KEYS, "a", "length", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    score = F.expr("cast((cast(2000000 as decimal(38,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    weakest = sides.withColumn("score", score).groupBy("lang", *KEYS, "a", "length").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", *KEYS, "a", "x.l", "x.r", "x.score")
    inside = {n: [(0, 0, s, e) for size in range(2, n) for s in range(n - size + 1) for e in [s + size - 1]] for n in range(3, LONGEST + 1)}
    longer = found.where("length > 2").select("lang", "a", F.explode(parts_by(F.col("length"), inside)).alias("x")).select("lang", "a", "x.*")
    longer = longer.groupBy(*names).agg(F.max("a").alias("most")).select("lang", *(F.col(f"p{k + 1}").alias(c) for k, c in enumerate(KEYS)), "most")
    good = weakest.join(longer, ["lang", *KEYS], "left").where(F.col("most").isNull() | (wide("most") * 100 < wide("a") * contained)).drop("most")
    # what cannot be among the first goes by parts; ties stay
    dealt = good.withColumn("part", F.pmod(F.xxhash64(*KEYS), F.lit(PARTS)))
    near = dealt.withColumn("place", F.rank().over(Window.partitionBy("lang", "part").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= best).drop("place")
    near = cut(near, "near")
    places = near.select("lang", "part", *KEYS, F.posexplode(F.array(*KEYS)).alias("at", "hash")).where("hash <> 0")
    texts = places.join(words.select("lang", "hash", "word"), ["lang", "hash"]).groupBy("lang", "part", *KEYS).agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("t"))
    named = near.join(texts, ["lang", "part", *KEYS]).withColumn("phrase", F.array_join(F.transform("t", lambda x: x["word"]), " "))
    ordered = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = named.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*ordered))).where(F.col("place") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*ordered)).cast("long")).where(F.col("rank") <= best)
    out = ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
    return cut.last(out, "collocations")


def reduce_sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out
