"""N-gram Jaccard self join by vertical partitioning.

The global n-gram order is the order of the n-grams' 64-bit hashes. It is cut into fragments twice:

* Candidates. Two sets that link differ in at most ``d = floor((a + b) * (1 - t) / (1 + t))`` n-grams, hence in at most d
  fragments. A set with n-grams in more than d fragments so agrees with any partner in one of them entirely: it emits
  one hash for each fragment that it has n-grams in, never for an empty one. A set that meets fewer fragments emits the
  hashes of a finer cut as well, and so on until it meets more than d; both ends of a pair that a cut cannot promise to
  find go on to the next, so the search is exact. How many fragments there are depends on the size class, and a set
  takes part in each class that a partner may come from (1.7 on average). The order is that of hashes, not of
  frequencies, as it need not be counted first; a fragment is shared only when all its n-grams are.
* Overlaps. Of the candidates that pass the exact bitmap bound, the n-grams are cut into ``FRAGMENTS`` ranges of the
  order; overlaps are counted in each range separately and summed per pair.

Hot groups. Equal sets collapse to one node before anything else. Of a fragment's group, first only the links to its
smallest node are verified, then those to random nodes of it; after that, only pairs whose ends are still in different
components are. So the pairs within one large group of near copies are not listed.

Defined cases: a null text counts as empty; an empty set links with nothing; a null doc_id is ignored when the
smallest id of a component is taken (all null: null); repeated rows are equal sets, hence one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RATIO = 1.4
FRAGMENTS = 4
#: A group's nodes are compared with one random node of it in a further round at least, and in more while the pairs still
#: apart are over CROWDED times the rows they come from and a round has halved them; then all pairs still apart are compared.
CROWDED = 4
LEAST_BITS = 256
#: A finer cut has so many times the fragments.
FINER = 1.25

SKETCH = "doc_id long, row_text long, n_shingles long, set_id binary, bitmap array<long>"


def size_classes(n: int, threshold: float) -> list[int]:
    """k for each class [RATIO**k, RATIO**(k+1) / threshold) that holds n."""
    top = int(np.floor(np.log(n) / np.log(RATIO) + 1e-9))
    return [k for k in range(top, -1, -1) if RATIO**k <= n * (1 + 1e-9) and n < RATIO ** (k + 1) / threshold + 1e-6]


@lru_cache(None)
def class_fragments(k: int, threshold: float) -> tuple[int, int]:
    """The differences d that the smaller set's class allows, and the first cut's fragments: so many that the class's least
    sets (RATIO**k n-grams) are expected to meet more than d of them, one standard error included."""
    least = RATIO**k
    d = int(np.floor(least * RATIO * (1 + 1 / threshold) * (1 - threshold) / (1 + threshold) + 1e-6))
    for n in range(d + 1, 3 * d + 11):
        empty = n * np.exp(-least / n)
        if n - empty - np.sqrt(empty) >= d + 1:
            return d, n
    return d, 3 * d + 11


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes; fewer words than asked: the whole sequence as one."""
    offs, tokens = common.split_words(texts, lower=True)
    h = common.hash_words(tokens)
    rolled = common.rolling(h, words)
    out = []
    for s, e in zip(offs[:-1], offs[1:], strict=True):
        if e - s >= words:
            out.append(np.unique(rolled[s : e - words + 1]))
        elif e > s:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[s:e].tobytes(), seed=int(e - s))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def segment_hashes(grams: np.ndarray, threshold: float) -> np.ndarray:
    """One hash for each non-empty fragment of each cut that the set takes part in."""
    out, mixed = [], common.mix(grams * np.uint64(common.BASE))
    for k in size_classes(len(grams), threshold):
        d, n = class_fragments(k, threshold)
        if d >= RATIO**k:  # so low a threshold that no cut is sure to do: each n-gram is a fragment
            out.append(common.mix(mixed + np.uint64(k << 48)))
            continue
        cut = 0
        while True:
            fragment = (grams >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)  # ranges of the order
            starts = np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]])
            have = np.add.reduceat(mixed, starts)
            out.append(common.mix(have + fragment[starts] * np.uint64(common.BASE) + np.uint64((k << 48) + (cut << 40))))
            if len(starts) > d or n >= 1 << 31:
                break
            cut, n = cut + 1, int(n * FINER) + 1
    return np.concatenate(out)


def parity_bitmap(grams: np.ndarray) -> np.ndarray:
    """Parity bits, two to four for each element, LEAST_BITS at least: the bitmaps of two sets, the wider one folded to the
    other's width, differ in at most as many bits as the sets in elements."""
    width = max(LEAST_BITS, 1 << (2 * len(grams) - 1).bit_length())
    bits = np.bincount((grams % np.uint64(width)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """One row for each of docs (doc_id, text, row_text); row_text tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            sets = shingle_sets(b.column("text"), words)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()),
                    b.column("row_text"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                    pa.array([parity_bitmap(x) if len(x) else None for x in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "row_text", "n_shingles", "set_id", "bitmap"],
            )

    return docs.mapInArrow(run, SKETCH)


def node_of(set_id: bytes) -> int:
    return int.from_bytes(set_id[:8], "big", signed=True)


def segments(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """node (64 bits of the set_id) and segment of every fragment of each set; of equal sets a task gives one, so that a
    group of copies leaves at most one a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in common.slices(batches, "text"):
            nodes, found = [], []
            for x in shingle_sets(b.column("text"), words):
                if len(x) and (node := node_of(xxhash.xxh3_128_digest(x.tobytes()))) not in met:
                    met.add(node)
                    nodes.append(node)
                    found.append(segment_hashes(x, threshold).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "segments"])

    return docs.select("text").mapInArrow(run, "node long, segments array<long>").select("node", F.explode("segments").alias("segment"))


def fragment_sets(docs: DataFrame, words: int) -> DataFrame:
    """set_id, fragment, grams: the n-grams of each distinct set, cut into ranges of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text", 1 << 20):
            set_ids, parts, grams = [], [], []
            for x in shingle_sets(b.column("text"), words):
                if len(x):
                    own = xxhash.xxh3_128_digest(x.tobytes())
                    ends = np.searchsorted(x >> np.uint64(62), np.arange(FRAGMENTS + 1))
                    set_ids += [own] * FRAGMENTS
                    parts += range(FRAGMENTS)
                    grams += [x[s:e].view(np.int64) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(set_ids, pa.binary()), pa.array(parts, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], names=["set_id", "fragment", "grams"])

    return docs.select("text").mapInArrow(run, "set_id binary, fragment int, grams array<long>")


def node(set_id: str) -> Column:
    """``node_of`` as a column."""
    return F.conv(F.hex(F.substring(set_id, 1, 8)), 16, -10).cast("long")


def may_link(a: str, b: str, percent: int) -> Column:
    """Exact bounds on two nodes with n and bitmap: sizes, and differing bits against allowed differences."""
    na, nb, ba, bb = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.bitmap"), F.col(f"{b}.bitmap")
    half = lambda x: F.floor(F.size(x) / 2).cast("int")
    fold = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda p, q: p.bitwiseXOR(q))
    own, other = F.when(F.size(ba) > F.size(bb), fold(ba)).otherwise(ba), F.when(F.size(bb) > F.size(ba), fold(bb)).otherwise(bb)
    bits = F.aggregate(F.zip_with(own, other, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, n: t + n)
    # sizes come first: partners' bitmaps differ by one fold at most
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (bits * (100 + percent) <= (na + nb) * (100 - percent))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those that link. Partial overlaps are counted per fragment and summed per pair."""
    cut = common.Cuts(pairs.sparkSession)
    needed = pairs.select(F.col("a").alias("set_id")).union(pairs.select(F.col("b"))).distinct()
    ids = cut(nodes.join(needed, "set_id", "left_semi").select(F.col("rep").alias("doc_id"), "row_text"), "needed")
    some = common.with_bitmap(docs.select("doc_id", "text", F.xxhash64("text").alias("row_text")), ids, "row_text", ["row_text"])  # other texts are not moved
    wanted = some.join(ids, some.doc_id.eqNullSafe(ids.doc_id) & (some.row_text == ids.row_text), "left_semi")
    sets = cut(fragment_sets(wanted, words).dropDuplicates(["set_id", "fragment"]), "fragments")
    left = sets.select(F.col("set_id").alias("a"), "fragment", F.col("grams").alias("grams_a"))
    right = sets.select(F.col("set_id").alias("b"), "fragment", F.col("grams").alias("grams_b"))
    overlap = (
        pairs.join(left, "a").join(right, ["b", "fragment"])
        .groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("grams_a", "grams_b"))).alias("common"))
    )
    size = nodes.select("set_id", "n")
    both = overlap.join(size.select(F.col("set_id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("set_id").alias("b"), F.col("n").alias("nb")), "b")
    return cut.last(both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of (a, b): alternating large-star and small-star until nothing changes."""
    cut = common.Cuts(edges.sparkSession)
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = cut.last(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return cut.last(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct()), "components")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, row_text, n_shingles, set_id, component, component_id of every row of ``docs`` (doc_id, text; other columns are
    ignored). ``component`` (its smallest set_id) tells components apart; ``component_id`` (its least doc_id) need not."""
    common.configure(docs.sparkSession)
    cut = common.Cuts(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    withtext = docs.withColumn("row_text", F.xxhash64("text"))
    raw = cut(sketch(withtext, words), "sketch")
    own = F.struct("doc_id", "row_text", "n_shingles", "bitmap")
    nodes = cut(
        raw.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min(own).alias("x"), F.min("doc_id").alias("least_id"))
        .select("set_id", node("set_id").alias("node"), F.col("x.doc_id").alias("rep"), F.col("x.row_text").alias("row_text"), "least_id", F.col("x.n_shingles").alias("n"), F.col("x.bitmap").alias("bitmap")),
        "nodes",
    )
    rows = cut(segments(docs, words, percent / 100), "segments")
    # summed before the shuffle; the join back has one row a segment on one side, so a segment that very many hold can be split
    ends = rows.groupBy("segment").agg(F.min("node").alias("hub_node"), F.max("node").alias("hi")).where("hub_node < hi").select("segment", "hub_node")
    shared = cut(rows.join(ends, "segment").select("node", "segment", "hub_node").distinct(), "shared")
    hubs = nodes.select(F.col("node").alias("hub_node"), F.col("set_id").alias("hub"))
    members = cut(shared.join(nodes.select("node", "set_id"), "node").join(hubs, "hub_node").select("segment", "set_id", "hub"), "members")
    facts = nodes.select("set_id", "n", "bitmap")

    def close(pairs: DataFrame) -> DataFrame:
        x, y = facts.select(F.col("set_id").alias("a"), "n", "bitmap").alias("x"), facts.select(F.col("set_id").alias("b"), "n", "bitmap").alias("y")
        return pairs.join(x, "a").join(y, "b").where(may_link("x", "y", percent)).select("a", "b")

    tried = cut(close(members.where("set_id != hub").select(F.col("hub").alias("a"), F.col("set_id").alias("b")).distinct()), "pairs")
    links = verified(tried, nodes, docs, words, percent)
    found = components(links)

    def still_apart(found: DataFrame) -> DataFrame:
        """Members of the segments whose nodes are in several components by now."""
        placed = members.select("segment", "set_id").join(found, F.col("set_id") == F.col("node"), "left").select("segment", "set_id", F.coalesce("component", "set_id").alias("component"))
        mixed = placed.groupBy("segment").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("segment")
        return placed.join(mixed, "segment")

    def crowd(apart: DataFrame) -> tuple[int, float]:
        """Rows of segments, and the pairs within segments that they make."""
        each = apart.groupBy("segment").agg(F.count("*").cast("double").alias("n"))
        rows, pairs = each.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
        return int(rows or 0), pairs or 0.0

    apart = cut(still_apart(found), "apart")
    n_rows, n_pairs = crowd(apart)
    for salt in count():
        if not n_rows:
            break
        order = F.xxhash64("set_id", "segment", F.lit(salt))
        chosen = apart.groupBy("segment").agg(F.min_by(F.struct("set_id", "component"), order).alias("hub"))
        pairs = apart.join(chosen, "segment").where("component != hub.component").select(F.least("set_id", "hub.set_id").alias("a"), F.greatest("set_id", "hub.set_id").alias("b")).distinct()
        fresh = cut(close(pairs.join(tried, ["a", "b"], "left_anti")), "pairs")
        if fresh.isEmpty():
            break
        tried = tried.union(fresh)
        links = cut(links.union(verified(fresh, nodes, docs, words, percent)), "links")
        found = components(links)
        apart, before = cut(still_apart(found), "apart"), n_pairs
        n_rows, n_pairs = crowd(apart)
        if n_pairs <= CROWDED * n_rows or 2 * n_pairs > before:
            break

    if n_rows:
        rest = cut(apart.join(facts, "set_id"), "rest")
        x, y = rest.alias("x"), rest.alias("y")
        across = x.join(
            y,
            (F.col("x.segment") == F.col("y.segment")) & (F.col("x.set_id") < F.col("y.set_id")) & (F.col("x.component") != F.col("y.component")) & may_link("x", "y", percent),
        ).select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")).distinct()
        last = cut(across.join(tried, ["a", "b"], "left_anti"), "pairs")
        if not last.isEmpty():
            found = components(links.union(verified(last, nodes, docs, words, percent)))
    label = nodes.join(found, nodes.set_id == found.node, "left").select("set_id", "least_id", F.coalesce("component", "set_id").alias("component"))
    smallest = label.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = label.join(smallest, "component").select("set_id", "component", "component_id")
    out = raw.select("doc_id", "row_text", "n_shingles", "set_id").join(named, "set_id", "left").select(
        "doc_id", "row_text", "n_shingles", "set_id", "component", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return cut.last(out, "components")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (all columns) but one of each component: the least doc_id (null last), of equal ids the least text hash, of repeated rows one.

    Empty documents all stay, as they link with nothing; of repeated empty rows (one doc_id and text) one.
    """
    found = jaccard_components(docs, words, percent)
    bare = F.col("set_id").isNull()
    own = found.groupBy("component", F.when(bare, F.col("doc_id")).alias("bare_id"), F.when(bare, F.col("row_text")).alias("bare_text"))
    best = own.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_text")).alias("x")).select("x.doc_id", "x.row_text")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("row"))
    kept = rows.join(best, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("row") == F.col("row_text")))
    return kept.dropDuplicates(["id", "row"]).select(*(F.col(f"own.`{c}`") for c in docs.columns))
