"""Duplicates: groups, how sure a merge is, merge plans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import COUNTED, LETTERS, first_near, near_pairs
from ..session import discard, written

BLOCK = 6
THRESHOLD = 0.9
#: Rows of a block's part.
CROWDED = 2000
#: Pairs that one task can read in order.
FEW = 4_000_000
# Item types that are cited in their own right.
FORMAL = ["book", "bookSection", "journalArticle", "conferencePaper", "thesis", "report", "dataset", "preprint", "manuscript", "encyclopediaArticle"]


def with_key(items: DataFrame, by: str = "title") -> DataFrame:
    """Items with their duplicate key ``k``; items without one are left out."""
    k = T.dedupe_key("title") if by == "title" else F.lower(F.trim("doi"))
    return items.withColumn("k", k).where("k <> ''")


def exact_groups(items: DataFrame, by: str = "title") -> DataFrame:
    """k, n, first (earliest key) of keys that several items have."""
    return with_key(items, by).groupBy("k").agg(F.count("*").alias("n"), F.min_by("key", "scan_order").alias("first")).where("n > 1")


def exact_members(items: DataFrame, by: str = "title") -> DataFrame:
    """k, key, first of every item in an exact group; no group is gathered into an array."""
    own = with_key(items, by)
    return own.join(exact_groups(items, by).select("k", "first"), "k").select("k", "key", "first")


def singletons(items: DataFrame) -> DataFrame:
    """k, key, scan_order, block of items that share their title key with none."""
    own = with_key(items).groupBy("k").agg(F.count("*").alias("n"), F.first("key").alias("key"), F.min("scan_order").alias("scan_order")).where("n = 1")
    return own.select("k", "key", "scan_order", F.substring("k", 1, BLOCK).alias("block"))


def gram_bits(c: str) -> Column:
    """Longs g0, g1, ... in which each letter of LETTERS has as many bits set as the key ``c`` holds it, COUNTED at most."""
    held = lambda x: F.least(F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit(""))), F.lit(COUNTED))
    bits = lambda x, at: F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), held(x)) - 1, F.lit(at * COUNTED))
    words = [LETTERS[k : k + 64 // COUNTED] for k in range(0, len(LETTERS), 64 // COUNTED)]
    return F.struct(*(reduce(lambda x, y: x.bitwiseOR(y), (bits(x, at) for at, x in enumerate(word))).alias(f"g{w}") for w, word in enumerate(words)))


def may_be_alike(a: str, b: str, n_a: Column, n_b: Column, threshold: float) -> Column:
    """False only for keys that are not alike: a letter that is put in or left out turns one bit of ``gram_bits`` (fields or columns
    of ``a`` and ``b``) at most, one in place of another two, and a difference in length takes as many edits of the first kind.
    A comparison of some longs, where a distance is a thousand steps."""
    d, apart = F.floor(F.greatest(n_a, n_b) * (1 - threshold) + 1e-9), F.abs(n_a - n_b)
    turned = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.g{w}").bitwiseXOR(F.col(f"{b}.g{w}"))) for w in range(-(-len(LETTERS) * COUNTED // 64))))
    return (apart <= d) & (turned <= 2 * d - apart)


def block_pairs(items: DataFrame, threshold: float, crowded: int) -> DataFrame:
    """block, order_a, key_a, key_b, similarity: singletons of a block whose title keys are alike. Counts of letters tell most that are not alike before
    a distance is computed, both in matrices over Arrow batches. A block of more than ``crowded`` rows is cut into parts of about
    so many, and each two parts are a group of their own."""
    own = written(singletons(items).where("scan_order is not null"), "titles")
    parts = own.groupBy("block").agg(F.count("*").alias("rows")).where("rows > 1").select("block", F.ceil(F.col("rows") / max(crowded, 1)).cast("int").alias("parts"))
    placed = own.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = placed.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: a number of tasks that adaptive execution keeps
    return near_pairs(cells.repartition(tasks, "block", "i", "j").sortWithinPartitions("block", "i", "j"), threshold)


def fuzzy_pairs(items: DataFrame, threshold: float = THRESHOLD, crowded: int = CROWDED) -> DataFrame:
    """key_a, key_b, similarity (six places) of singletons of a block whose title keys are alike."""
    return block_pairs(items, threshold, crowded).select("key_a", "key_b", F.round("similarity", 6).alias("similarity"))


def greedy(pairs: DataFrame) -> DataFrame:
    """seed, key of the greedy clusters of pairs (block, order_a, key_a, key_b), which are read once in their order; of a block
    only the keys that are taken are kept."""
    kind = dict(pairs.dtypes)["key_a"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, taken, seed = None, set(), None
        for batch in batches:
            out = []
            for own, a, b in zip(*(batch.column(c).to_pylist() for c in ("block", "key_a", "key_b")), strict=True):
                if own != block:
                    block, taken, seed = own, set(), None
                if a not in taken and b not in taken:
                    out += [(a, b)] if a == seed else [(a, a), (a, b)]
                    taken.add(b)
                    seed = a
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], batch.schema.field("key_a").type) for k in (0, 1)], ["seed", "key"])

    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select("block", "order_a", "key_a", "key_b").repartition(tasks, "block").sortWithinPartitions("block", "order_a", "key_a").mapInArrow(of, f"seed {kind}, key {kind}")


def fuzzy_clusters(items: DataFrame, threshold: float = THRESHOLD, few: int = FEW) -> DataFrame:
    """seed, key of greedy clusters: in scan order, an item that no earlier seed takes is a seed; an item is the earliest
    seed's that is alike.

    Worked out on the pairs. While more than ``few`` are undecided, in rounds: items without an earlier undecided partner are
    seeds, their partners are taken, and both leave. A round is a few joins; nothing is gathered. The others are read
    once, block by block.
    """
    order = items.select("key", "scan_order")
    pairs = written(block_pairs(items, threshold, CROWDED).drop("similarity"), "pairs")
    left, taken = pairs, pairs.select(F.col("key_b").alias("key")).limit(0)
    while left.count() > few:
        later = left.select(F.col("key_b").alias("key_a")).distinct()
        seeds = written(left.select("key_a").distinct().join(later, "key_a", "left_anti"), "seeds")
        gone = written(left.join(seeds, "key_a", "left_semi").select(F.col("key_b").alias("key")).distinct(), "taken")
        taken = taken.unionByName(gone)
        decided = seeds.select(F.col("key_a").alias("key")).unionByName(gone)
        before, left = left, written(left.join(decided.withColumnRenamed("key", "key_a"), "key_a", "left_anti").join(decided.withColumnRenamed("key", "key_b"), "key_b", "left_anti"), "left")
        discard(seeds, *([before] if before is not pairs else []))
    if left is pairs:
        return greedy(pairs)
    taken = taken.unionByName(greedy(left).where("seed <> key").select("key"))
    by = pairs.join(taken.withColumnRenamed("key", "key_a"), "key_a", "left_anti").join(taken.withColumnRenamed("key", "key_b"), "key_b", "left_semi")
    seed = by.join(order, by.key_a == order.key).groupBy("key_b").agg(F.min_by("key_a", "scan_order").alias("seed"))
    members = seed.select("seed", F.col("key_b").alias("key"))
    return members.unionByName(members.select("seed", F.col("seed").alias("key")).distinct())


def merge_confidence(group: Column) -> Column:
    """struct(confident, reason) of an array of struct(title, year: string, first_author, edition, type).

    What is absent never speaks against a merge.
    """
    some = lambda f: F.array_distinct(F.filter(F.transform(group, f), lambda x: x != ""))
    authors, editions = some(lambda g: T.norm_title(F.coalesce(g["first_author"], F.lit("")))), some(lambda g: T.norm_title(F.coalesce(g["edition"], F.lit(""))))
    alike = F.forall(authors, lambda a: F.forall(authors, lambda b: F.contains(a, b) | F.contains(b, a)))
    years = F.filter(F.transform(group, lambda g: T.year_of(F.coalesce(g["year"], F.lit("")))), lambda y: y.isNotNull())
    low, high = F.array_min(years), F.array_max(years)
    types = F.array_sort(F.filter(some(lambda g: F.coalesce(g["type"], F.lit(""))), lambda t: t.isin(FORMAL)))
    reason = (
        F.when(~alike, "different authors")
        .when(F.size(editions) > 1, "different editions")
        .when(F.coalesce(high - low, F.lit(0)) > 1, F.concat(F.lit("years "), low.cast("string"), F.lit("-"), high.cast("string")))
        .when(F.size(types) > 1, F.concat(F.lit("different item types ("), F.array_join(types, ", "), F.lit(")")))
        .otherwise("")
    )
    return F.struct((reason == "").alias("confident"), reason.alias("reason"))


def group_verdicts(items: DataFrame, by: str = "title") -> DataFrame:
    """k, n, confident, reason for each exact group; an ``edition`` column is judged if there is one.

    Names are alike when each contains the other or is contained. Containment is transitive, so a group's distinct names
    need only be compared with the next longer one, in order: nothing of a group is gathered.
    """
    own = with_key(items, by)
    edition = T.norm_title(F.coalesce(F.col("edition").cast("string"), F.lit(""))) if "edition" in items.columns else F.lit("")
    year = T.year_of(F.coalesce("date", F.lit("")))
    sums = own.groupBy("k").agg(
        F.count("*").alias("n"), F.min(year).alias("low"), F.max(year).alias("high"), F.min(F.nullif(edition, F.lit(""))).alias("one"), F.max(F.nullif(edition, F.lit(""))).alias("other"),
        F.sort_array(F.collect_set(F.when(F.col("type").isin(FORMAL), F.col("type")))).alias("types"),  # of ten at most
    ).where("n > 1")
    names = own.select("k", T.norm_title(F.coalesce("last_name", F.lit(""))).alias("name")).where("name <> ''").distinct()
    longer = F.lead("name").over(Window.partitionBy("k").orderBy(F.length("name"), "name"))
    apart = names.select("k", (~F.contains(longer, F.col("name"))).alias("apart")).where("apart").select("k").distinct().withColumn("apart", F.lit(True))
    reason = (
        F.when(F.col("apart"), "different authors")
        .when(F.col("one") != F.col("other"), "different editions")
        .when(F.coalesce(F.col("high") - F.col("low"), F.lit(0)) > 1, F.concat(F.lit("years "), F.col("low").cast("string"), F.lit("-"), F.col("high").cast("string")))
        .when(F.size("types") > 1, F.concat(F.lit("different item types ("), F.array_join("types", ", "), F.lit(")")))
        .otherwise("")
    )
    return sums.join(apart, "k", "left").select("k", "n", (reason == "").alias("confident"), reason.alias("reason"))


def merge_plan(items: DataFrame, by: str = "title") -> DataFrame:
    """master, other, confident, reason: one row for each item that the oldest of its group (date as text, then scan order) absorbs."""
    own = with_key(items, by)
    age = F.struct(F.coalesce("date", F.lit("")), "scan_order")
    masters = own.groupBy("k").agg(F.min_by("key", age).alias("master"))
    verdict = group_verdicts(items, by)
    return own.select("k", F.col("key").alias("other")).join(masters, "k").where("other <> master").join(verdict, "k").select("master", "other", "confident", "reason")


def merge_log(items: DataFrame, plan: DataFrame) -> DataFrame:
    """master, other, status of a plan's rows: ``merged``, or what keeps one from it. Others take the master's type."""
    m, o = items.select(F.col("key").alias("master"), F.col("type").alias("master_type")), items.select(F.col("key").alias("other"), F.col("type").alias("other_type"))
    both = plan.join(m, "master", "left").join(o, "other", "left")
    status = F.when(F.col("master_type").isNull(), "no master").when(F.col("other_type").isNull(), "not found").when(F.col("other_type") != F.col("master_type"), "merged, type changed").otherwise("merged")
    return both.select("master", "other", status.alias("status"))


def remap_children(children: DataFrame, plan: DataFrame, column: str = "item_key") -> DataFrame:
    """Children of merged items under their master."""
    to = plan.select(F.col("other").alias(column), "master")
    return children.join(to, column, "left").withColumn(column, F.coalesce("master", column)).drop("master").select(*children.columns).distinct()


def duplicate_probe(items: DataFrame, probes: DataFrame, threshold: float = THRESHOLD, crowded: int = CROWDED) -> DataFrame:
    """probe_id, key, similarity: for a new record (probe_id, title, last_name) the first item that it may repeat. The item's
    title, in any case, holds the phrase of the probe's first four words longer than two characters, the whole titles are
    alike, and so is the name (if the probe has one). Accents are not folded.

    Equal items and equal probes meet once. Rows meet on a phrase and a length band, not on frequent words: the second and third
    word of a phrase of four stand whole and side by side in any title that holds it, between a word that ends as the first
    and one that begins as the fourth. Shorter phrases meet on three letters that a hash picks. Items that no probe meets go
    before titles are shuffled; what more than ``crowded`` items or probes meet on is cut into parts, and each part of one side
    meets each of the other, in matrices as in ``fuzzy_pairs``.
    """
    step, meeting = 8, ["meet", "pair", "band"]
    session = items.sparkSession
    named = T.dedupe_key(F.coalesce("last_name", F.lit("")))
    asked = written(probes.select("probe_id", T.dedupe_key("title").alias("p"), named.alias("p_name")), "asked")
    words = F.slice(F.filter(F.split("p", " "), lambda w: F.length(w) > 2), 1, 4)
    p = asked.select("p", "p_name").distinct().withColumn("words", words).where(F.size("words") > 0).withColumn("phrase", F.array_join("words", " "))
    low, high = F.floor(F.ceil(F.length("p") * threshold - 1e-9) / step), F.floor(F.floor(F.length("p") / threshold + 1e-9) / step)
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))
    picked = F.array_min(F.transform(grams(F.col("phrase")), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"]
    four = F.size("words") == 4
    word = lambda k: F.get("words", F.lit(k))
    middle = F.concat_ws(" ", F.right(word(0), F.lit(3)), word(1), word(2), F.left(word(3), F.lit(3)))  # words have three letters at least
    meet = lambda c: F.xxhash64(c).alias("meet")  # noqa: E731  # what has one hash by chance meets in vain
    p = written(p.select("p", "p_name", "phrase", meet(F.when(four, middle).otherwise(picked)), four.alias("pair"), F.explode(F.sequence(low, high)).alias("band")), "probes")
    i = items.groupBy(F.lower("title").alias("raw"), T.dedupe_key("title").alias("t"), named.alias("t_name")).agg(F.min(F.struct(F.isnull("scan_order").alias("unordered"), "scan_order", "key")).alias("first"))
    i = written(i.select(F.monotonically_increasing_id().alias("id"), "raw", "t", "t_name", "first.scan_order", "first.key", F.floor(F.length("t") / step).alias("band")), "titles")
    at = F.sequence(F.lit(0), F.greatest(F.size("tokens") - 4, F.lit(0)))
    fours = F.transform(at, lambda k: F.concat_ws(" ", F.right(F.get("tokens", k), F.lit(3)), F.get("tokens", k + 1), F.get("tokens", k + 2), F.left(F.get("tokens", k + 3), F.lit(3))))
    by_pair = i.withColumn("tokens", F.split("raw", " ")).where(F.size("tokens") >= 4).select("id", "band", F.explode(F.array_distinct(fours)).alias("m")).select("id", "band", meet("m"), F.lit(True).alias("pair"))
    wanted = F.broadcast(p.where("not pair").select("meet").distinct())  # letters a to z, 0 to 9 and space, three of them: 50,653 at most
    by_gram = i.where("length(raw) > 2").select("id", "band", F.explode(F.array_distinct(grams(F.col("raw")))).alias("m")).select("id", "band", meet("m"), F.lit(False).alias("pair")).join(wanted, "meet", "left_semi")
    met = by_pair.unionByName(by_gram)
    many = lambda rows, name: rows.groupBy(*meeting).agg(F.ceil(F.count("*") / max(crowded, 1)).cast("int").alias(name))
    parts = written(many(p, "p_parts").join(many(met, "i_parts"), meeting), "parts")
    mine = lambda h, c: F.array(F.pmod(h, F.col(c)).cast("int"))
    each = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    kind, cell = dict(i.dtypes), [*meeting, "i", "j"]
    asking = p.join(parts, meeting).withColumn("i", F.explode(mine(F.xxhash64("p", "p_name"), "p_parts"))).withColumn("j", F.explode(each("i_parts")))
    asking = asking.select(*cell, F.lit(True).alias("asks"), F.col("p").alias("text"), F.col("p_name").alias("name"), F.col("phrase").alias("held"), F.lit(None).cast(kind["scan_order"]).alias("scan_order"), F.lit(None).cast(kind["key"]).alias("key"))
    there = met.join(parts, meeting).withColumn("i", F.explode(each("p_parts"))).withColumn("j", F.explode(mine(F.xxhash64("id"), "i_parts"))).select("id", *cell)  # numbers only, titles come after
    there = there.join(i.drop("band"), "id").select(*cell, F.lit(False).alias("asks"), F.col("t").alias("text"), F.col("t_name").alias("name"), F.col("raw").alias("held"), "scan_order", "key")
    rows = asking.unionByName(there).repartition(int(session.conf.get("spark.sql.shuffle.partitions")), *cell).sortWithinPartitions(*cell)
    best = first_near(rows, cell, threshold).groupBy("p", "p_name").agg(F.min(F.struct("unordered", "scan_order", "key", "t", "similarity")).alias("x"))
    return asked.join(best, ["p", "p_name"]).select("probe_id", "x.key", F.round("x.similarity", 6).alias("similarity"))
