"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are cut at ``\\n``; words of a line are what single spaces part in the trimmed line. A line goes when an earlier line
(smaller doc_id, then smaller place) is equal, or when both have at least LEAST_WORDS words and are one word edit apart:
one word changed, added or left out. (One edit makes any two lines of one word equal.) Lines are judged on the input.
Blank lines always stay; ``least_exact`` keeps equal lines of fewer words as well.

Plan:

0. Texts are cut into lines once: a narrow table of places, line hashes and hashes of halves. All steps read its columns.
1. Two lines of m and m or m + 1 words within one edit have their first or their last floor(m / 2) words in common. So
   each line gives hashes of those halves (as the shorter and as the longer line of a pair). Halves that only one
   distinct line has are out of the search; those that several have are set in a bitmap of fixed size, the only thing
   sent to every task. A full bitmap lets more lines through, never fewer.
2. Distinct lines that may have a partner emit their deletion neighbourhood as hashed keys: themselves (``base``), and
   themselves without each word outside a shared half. A variant's key with the place of the word left out joins changed
   words; without it, added words. Keys of one line only are dropped first; equal keys meet in groups that are only
   aggregated (earliest place, earliest base), so a group of any size costs its rows, not its pairs.
3. Of each surviving key the words are compared, not only their hash, before a line goes: the kept text is right even
   if 64-bit hashes collide.
4. Lines that go are joined back by line hash and place, and texts are put together without them.

Defined cases: a null text stays null and has no lines; an empty text has one empty line; a null doc_id sorts first;
rows with one doc_id are one document (equal places are equally early); other columns stay as they are, but that
``line_dedup`` puts its own n_lines and n_removed in the place of such columns. A very long text costs its lines, not
their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST_WORDS = 5
BLANKS = " \t\n\x0b\f\r"
HALVES = ["p0", "s0", "p1", "s1"]


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text, tells rows of one doc_id apart), place, line (trimmed), words, h and salt (hashes of the
    line), and HALVES of the lines that are not blank: of lines of at least LEAST_WORDS words the hashes of the first and last
    floor(m / 2) words, for m the line's words (p0, s0) and one less (p1, s1)."""
    whole = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("row"), F.split("text", "\n", -1).alias("lines"))
    cut = whole.select("doc_id", "row", F.posexplode("lines").alias("place", "raw")).select("doc_id", "row", "place", F.trim("raw").alias("line"))
    some = cut.where(F.trim("line", F.lit(BLANKS)) != "")
    words = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    counted = some.select("*", words.alias("words"), F.xxhash64("line").alias("h"), F.hash("line").alias("salt"))
    half = lambda m, sign: F.expr(f"substring_index(line, ' ', cast({sign} * floor(({m}) / 2) as int))")
    halves = {f"{side}{k}": F.xxhash64(F.lit(side), F.expr(m), half(m, sign)) for side, sign in (("p", 1), ("s", -1)) for k, m in enumerate(("words", "words - 1"))}
    return counted.select("*", *(F.when(F.col("words") >= LEAST_WORDS, x).alias(c) for c, x in halves.items()))


def variants_of(lines: DataFrame) -> DataFrame:
    """h, changed, added: the deletion neighbourhood of lines (h, place of the first, line, words, and which halves are shared).

    Only words outside a shared half are left out. A word's hash holds its place. Of a line without word i, later words
    stand one place earlier; running xors give the hash of each variant without building it, so a very long line costs its
    words, not their square. Lines are dealt by h before they are cut into words, so the windows need no further shuffle.
    """
    n = F.col("words")
    m0, m1 = F.floor(n / 2), F.floor((n - 1) / 2)
    i = F.col("i")
    use = (F.col("p0") & (i >= m0)) | (F.col("p1") & (i >= m1)) | (F.col("s0") & (i < n - m0)) | (F.col("s1") & (i < n - m1))
    each = lines.repartition("h").select("h", "words", *HALVES, F.posexplode(F.split("line", " ", -1)).alias("i", "word"))
    each = each.select("h", "words", "i", use.alias("use"), F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("moved"))
    line = Window.partitionBy("h")
    upto = line.orderBy("i")
    before = F.coalesce(F.bit_xor("here").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.bit_xor("moved").over(line).bitwiseXOR(F.bit_xor("moved").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rest = each.withColumn("rest", before.bitwiseXOR(after)).where("use")
    return rest.select("h", F.xxhash64("words", "i", "rest").alias("changed"), F.xxhash64(F.col("words") - 1, "rest").alias("added"))


def near_repeats(every: DataFrame, cut: common.Cuts) -> DataFrame:
    """line, h of the distinct lines (of ``lines_of``) that an earlier line is one word edit away from (not equal to)."""
    every = every.where(F.col("words") >= LEAST_WORDS)
    halves = every.select("h", F.explode(F.array(*HALVES)).alias("half"))
    shared = cut(halves.groupBy("half").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("half"), "halves")
    some = common.with_bitmap(every.select("h", "line", "words", *HALVES, "doc_id", "place"), shared, "half", HALVES, flags=True)
    lines = cut(some.groupBy("h").agg(F.first("line").alias("line"), F.first("words").alias("words"), *(F.max(c).alias(c) for c in HALVES), F.min(F.struct("doc_id", "place")).alias("first")), "candidates")
    first = lines.select("h", "first")
    variants = variants_of(lines)

    # one word changed: the same rest, the same place left out; all of a group are one edit apart
    groups = cut(variants.groupBy("changed").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("changed"), "changed")
    members = cut(common.with_bitmap(variants.select("h", "changed"), groups, "changed", ["changed"]).join(groups, "changed", "left_semi").join(first, "h"), "changed")
    least = members.groupBy("changed").agg(F.min("first").alias("least"))
    by_change = members.join(least, "changed").where("least < first").select("h", "least")
    # one word added: a base equals a variant of a longer line; a base is one edit from each, they are from it alone
    words = F.transform(F.split("line", " ", -1), lambda w, i: F.xxhash64(w, i))
    whole = F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    bases = cut(lines.select(F.xxhash64("words", whole).alias("added"), F.col("h").alias("base"), F.col("first").alias("base_first")), "bases")
    longer = cut(common.with_bitmap(variants.select("h", "added"), bases, "added", ["added"]).join(bases.select("added"), "added", "left_semi").join(first, "h").distinct(), "longer")
    by_loss = longer.groupBy("added").agg(F.min("first").alias("least")).join(bases, "added").where("least < base_first").select(F.col("base").alias("h"), "least")
    by_gain = longer.join(bases, "added").where("base_first < first").select("h", F.col("base_first").alias("least"))
    found = by_change.union(by_loss).union(by_gain).groupBy("h").agg(F.collect_set("least").alias("near"))
    # verify on the words: some partner among the places found is really within one edit
    rows = lines.join(found, "h").select("h", "line", F.explode("near").alias("other"))
    partner = lines.select(F.col("first").alias("other"), F.col("line").alias("earlier"))
    near = rows.join(partner, "other").where(one_edit(F.split("line", " ", -1), F.split("earlier", " ", -1))).select("h", "line").distinct()
    return cut(near, "near")


def one_edit(a: Column, b: Column) -> Column:
    """Word arrays at most one edit apart: common beginning and common end leave at most one word of the longer."""
    na, nb = F.size(a), F.size(b)
    short, long = F.least(na, nb), F.greatest(na, nb)
    same = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, e: F.struct((s["n"] + F.when(s["go"] & e, 1).otherwise(0)).alias("n"), (s["go"] & e).alias("go")))["n"]
    return (long - short <= 1) & (F.least(same(a, b), short) + F.least(same(F.reverse(a), F.reverse(b)), short) >= long - 1)


def removed_lines(docs: DataFrame, least_exact: int = LEAST_WORDS) -> DataFrame:
    """doc_id, row, places: the places of the lines that go, for each row of ``docs`` that loses some."""
    cut = common.Cuts(docs.sparkSession)
    every = cut(lines_of(docs), "lines")
    near = near_repeats(every, cut)
    lines = every.where(F.col("words") >= least_exact).select("doc_id", "row", "place", "h", "salt")
    at = F.struct("doc_id", "place")
    first = lines.groupBy("h", "salt").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    gone = near.select("h", F.hash("line").alias("salt"), F.lit(True).alias("near"))
    judged = cut(first.join(gone, ["h", "salt"], "left").where("first < last OR near").select("h", "salt", "first", F.coalesce("near", F.lit(False)).alias("near")), "judged")
    some = common.with_bitmap(lines, judged, "h", ["h"])
    out = some.join(judged, ["h", "salt"]).where(F.col("near") | (F.col("first") < at)).select("doc_id", "row", "place")
    return cut.last(out.groupBy("doc_id", "row").agg(F.collect_set("place").alias("places")), "removed")


def kept_texts(docs: DataFrame, least_exact: int = LEAST_WORDS) -> DataFrame:
    """own (a struct of all columns of ``docs``), text without its repeated lines, n_lines, n_removed."""
    gone = removed_lines(docs.select("doc_id", "text"), least_exact)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("row_text"), "text")
    both = own.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("row_text") == F.col("row")), "left").select("own", "text", "places")
    cut = both.select("own", "text", "places", F.split("text", "\n", -1).alias("lines"))
    n = F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0))
    # the places that stay by a hash set, so that a long text costs its lines
    stay = F.when(F.size("places") > 0, F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places"))
    counted = cut.select("own", "text", "lines", n.alias("n"), stay.alias("stay"))
    text = F.when(F.col("stay").isNull(), F.col("text")).otherwise(F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n"))
    return counted.select("own", text.alias("text"), F.col("n").cast("long").alias("n_lines"), F.when(F.col("stay").isNull(), 0).otherwise(F.col("n") - F.size("stay")).cast("long").alias("n_removed"))


def line_dedup(docs: DataFrame, least_exact: int = LEAST_WORDS) -> DataFrame:
    """All columns of ``docs`` (with doc_id and text), the text without its repeated lines, and n_lines, n_removed."""
    found = kept_texts(docs, least_exact)
    return found.select(*("text" if c == "text" else F.col(f"own.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")
