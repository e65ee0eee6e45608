"""Source divergence audit: how far the word use of each source is from that of the other sources of its language.

Terms are runs of letters (any byte of 0x80 and more counts as one); A-Z is lower-cased. A language keeps the terms that
stand in at least ``least_docs`` of its documents. A group (language, source) gives a kept term the share
p = 1 + floor(SCALE * (count + 5) / (N + 5 V)), N being its occurrences of kept terms and V how many there are; the language
gives q likewise. Everything is whole numbers.

Plan: tasks cut texts with the byte tokenizer and count terms by batch; Spark adds them up by group and term, gathers each
term's sources (a row a term, as long as the language has sources) and writes the kept ones. Buckets of kept terms, dealt
by hash, meet their language's totals in a cogroup; each is one CSR matrix (a row a source), whose distances come from
reduceat over its entries and need no dense matrix. Sums of buckets are added up by Spark; a bucket hands on only its own
best terms of a group, so that no group's terms meet in one task.

Defined cases: null text, lang and source count as ''; a repeated row counts as often as it stands there; a group without
terms takes part with N = 0; a language without kept terms has distance 0 between its sources and no terms; no documents
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .byte_terms import Terms, gathered, runs, table_of

SCALE, PRIOR, LEAST_DOCS, BEST = 1_000_000_000, 5, 30, 50
#: Bytes of text that are counted at once, and kept terms of one matrix.
BATCH, BUCKET = 8 << 20, 1 << 13
#: Term bytes: letters, and every byte of a longer character.
LETTERS = table_of([(0x41, 0x5A, 1), (0x61, 0x7A, 1), (0x80, 0xFF, 1)])


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), added up within each batch only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches, "text", BATCH):
            terms = Terms(t.column("text"), LETTERS)
            pairs = pa.Table.from_arrays([t.column("lang"), t.column("source")], ["lang", "source"]).combine_chunks()
            both = pa.StructArray.from_arrays([c.combine_chunks() for c in pairs.columns], names=["lang", "source"]) if len(pairs) else None
            if both is None or not len(terms.row):
                continue
            codes: dict[tuple[str, str], int] = {}
            of_row = np.fromiter((codes.setdefault((x["lang"], x["source"]), len(codes)) for x in both.to_pylist()), np.int64, len(both))
            width = len(terms.first)
            by_row = np.sort(terms.row * width + terms.group)
            at, n = runs(by_row)
            row, term = np.divmod(by_row[at], width)
            key = of_row[row] * width + term
            order = np.argsort(key, kind="stable")
            at, d = runs(key[order])
            group, term = np.divmod(key[order][at], width)
            names = list(codes)
            own = pa.array(group)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in names]).take(own), pa.array([x[1] for x in names]).take(own), terms.words().take(pa.array(term)), pa.array(np.add.reduceat(n[order], at)), pa.array(d.astype(np.int64))],
                ["lang", "source", "term", "n", "d"],
            )

    return docs.mapInArrow(count, "lang string, source string, term string, n long, d long")


def share(count: np.ndarray, total: np.ndarray | int, kinds: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kinds)), exact: long division, three digits at a time."""
    below = total + PRIOR * kinds
    whole, rest = np.divmod(count.astype(np.int64) + PRIOR, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digit
    return whole + 1


def distances(first: np.ndarray, place: np.ndarray, p: np.ndarray, none: np.ndarray, width: int) -> np.ndarray:
    """Sums over ``width`` terms of abs(p of a - p of b) for all rows a, b of a CSR matrix: ``first`` (rows + 1) says where a
    row's entries begin, ``place`` has their terms, ``p`` their values; ``none`` is a row's value of every other term."""
    rows = len(none)
    size = np.diff(first)
    out = np.zeros((rows, rows), np.int64)
    full = np.flatnonzero(size)
    starts = first[:-1][full]

    def by_row(x: np.ndarray) -> np.ndarray:
        got = np.zeros(rows, np.int64)
        if len(starts):
            got[full] = np.add.reduceat(x, starts)
        return got

    others = np.repeat(none, size)
    for a in range(rows):
        dense = np.full(width, none[a])
        dense[place[first[a] : first[a + 1]]] = p[first[a] : first[a + 1]]
        mine = dense[place]
        # terms that b has, and all terms as if b had none, less those that it has
        own, base = np.sort(dense), np.r_[0, np.cumsum(np.sort(dense))]
        k = np.searchsorted(own, none)
        as_if = none * k - base[k] + (base[-1] - base[k]) - none * (width - k)
        out[a] = by_row(np.abs(mine - p)) + as_if - by_row(np.abs(mine - others))
    return out


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, best: int = BEST) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows with every other source of the language, ``term`` rows with the
    ``best`` terms that a group uses more than its language does.

    ``docs`` needs text, lang and source; other columns are ignored.
    """
    spark = docs.sparkSession
    common.configure(spark)
    cut = common.Cuts(spark)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    groups = docs.select("lang", "source").distinct()
    n = count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    terms = n.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("by"))
    kept = cut(terms.where(F.col("d") >= least_docs).select("lang", "term", "by"), "kept-terms")
    found = kept.select("lang", F.explode("by").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
    kinds = kept.groupBy("lang").agg(F.count("*").alias("kinds"))
    totals = groups.join(found, ["lang", "source"], "left").join(kinds, "lang", "left").fillna(0, ["n", "kinds"])
    totals = cut(totals.select("lang", "source", "n", "kinds"), "totals")
    buckets = 1
    while buckets * BUCKET < (kinds.agg(F.max("kinds")).first()[0] or 0):
        buckets *= 2

    schema = "lang string, source string, part string, item string, value long"

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(np.array(right.column("source").to_pylist(), object)) if len(right) else []
        right = right.take(pa.array(order, pa.int64()))
        names, total = right.column("source").to_pylist(), np.asarray(right.column("n"), np.int64)
        out: dict[str, list] = {"lang": [], "source": [], "part": [], "item": [], "value": []}
        words, width = left.column("term").to_pylist(), len(left)
        lang = right.column("lang")[0].as_py() if len(right) else None
        if width and names:
            kinds = right.column("kinds")[0].as_py()
            by = left.column("by").combine_chunks()
            place = np.repeat(np.arange(width), np.diff(np.asarray(by.offsets)))
            number = {s: k for k, s in enumerate(names)}
            row = np.fromiter((number[s] for s in by.flatten().field("source").to_pylist()), np.int64, len(place))
            count = np.asarray(by.flatten().field("n"), np.int64)
            of_term = np.add.reduceat(count, np.asarray(by.offsets)[:-1] - by.offsets[0].as_py())
            q = share(of_term, int(total.sum()), kinds)
            order = np.argsort(row, kind="stable")
            row, place, count = row[order], place[order], count[order]
            first = np.searchsorted(row, np.arange(len(names) + 1))
            p = share(count, total[row], kinds)
            far = distances(first, place, p, share(np.zeros(len(names), np.int64), total, kinds), width)
            in_order = np.empty(width, np.int64)  # a term's place by its bytes: code points sort alike
            in_order[sorted(range(width), key=words.__getitem__)] = np.arange(width)
            for a, name in enumerate(names):
                others = [b for b in range(len(names)) if b != a]
                out["source"] += [name] * len(others)
                out["part"] += ["pair"] * len(others)
                out["item"] += [names[b] for b in others]
                out["value"] += far[a, others].tolist()
                at = place[first[a] : first[a + 1]]
                more = p[first[a] : first[a + 1]] - q[at]
                at, more = at[more > 0], more[more > 0]
                top = np.lexsort((in_order[at], -more))[:best]
                out["source"] += [name] * len(top)
                out["part"] += ["term"] * len(top)
                out["item"] += [words[k] for k in at[top]]
                out["value"] += more[top].tolist()
        out["lang"] = [lang] * len(out["item"])
        return pa.table({c: pa.array(v, pa.int64() if c == "value" else pa.string()) for c, v in out.items()})

    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    met = totals.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    parts = cut(dealt.groupBy("lang", "bucket").cogroup(met.groupBy("lang", "bucket")).applyInArrow(measure, schema), "parts")
    pairs = totals.alias("a").join(totals.alias("b"), F.col("a.lang") == F.col("b.lang")).where("a.source <> b.source")
    pairs = pairs.select("a.lang", "a.source", F.lit("pair").alias("part"), F.col("b.source").alias("item"), F.lit(0).cast("long").alias("value"))  # those of languages without terms
    summed = parts.where("part = 'pair'").unionByName(pairs).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.unionByName(parts.where("part = 'term'")).withColumn("rank", F.row_number().over(w))
    return cut.last(ranked.where((F.col("part") == "pair") | (F.col("rank") <= best)).select("lang", "source", "part", "item", "value", "rank"), "divergence")
