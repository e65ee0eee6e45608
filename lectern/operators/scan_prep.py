"""Scanned books: where two-up pages are cut, and what is done with a file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BAND, CONTRAST, QUIET = 0.18, 0.01, 0.25
MIN_INK, AGREE, TWO_UP, CONFIDENT, OVERLAP, BLIND = 0.03, 0.02, 1.25, 0.6, 0.008, 0.5
LEAST_WIDTH, TEXT_LAYER = 8, 80


def smooth(profile: DataFrame, window: int) -> DataFrame:
    """doc_id, i, ink: moving average, clipped at the edges; the profile itself for a window of one or one wider than it."""
    w = Window.partitionBy("doc_id")
    half = window // 2
    mean = F.avg("ink").over(w.orderBy("i").rowsBetween(-half, half))
    short = F.count("*").over(w) < window
    return profile.select("doc_id", "i", (F.col("ink") if window <= 1 else F.when(short, F.col("ink")).otherwise(mean)).alias("ink"))


def quiet_runs(profile: DataFrame, band: float = BAND) -> DataFrame:
    """doc_id, start, length, width of each run of quiet columns near the centre: ink at most the least plus a quarter of the
    contrast there. A profile with too little contrast, or too narrow, has none."""
    w = Window.partitionBy("doc_id")
    own = profile.withColumn("width", F.count("*").over(w))
    mid = own.where((F.col("width") >= LEAST_WIDTH) & (F.col("i") >= F.floor(F.col("width") * (0.5 - band))) & (F.col("i") < F.ceil(F.col("width") * (0.5 + band))))
    level = mid.withColumns({"low": F.min("ink").over(w), "high": F.max("ink").over(w)})
    quiet = level.where((F.col("high") - F.col("low") >= CONTRAST) & (F.col("ink") <= F.col("low") + QUIET * (F.col("high") - F.col("low"))))
    island = F.col("i") - F.row_number().over(w.orderBy("i"))
    return quiet.withColumn("island", island).groupBy("doc_id", "width", "island").agg(F.min("i").alias("start"), F.count("*").alias("length")).drop("island")


def gutter(profile: DataFrame, band: float = BAND) -> DataFrame:
    """doc_id, start, length, cut: the longest quiet run (of equal ones the first) and its centre as a share of the width."""
    best = quiet_runs(profile, band).groupBy("doc_id", "width").agg(F.max(F.struct("length", -F.col("start"))).alias("x"))
    start, length = -F.col("x.col2"), F.col("x.length")
    return best.select("doc_id", start.alias("start"), length.alias("length"), F.round((start + length / 2) / F.col("width"), 6).alias("cut"))


def choose_gutter(samples: DataFrame) -> DataFrame:
    """doc_id, cut, confidence: the median cut of pages with a cut and enough ink, and the share of them near it."""
    usable = F.when(F.col("ink") >= MIN_INK, F.col("cut"))
    each = samples.groupBy("doc_id", usable.alias("cut")).agg(F.count("*").alias("n"))  # a document's pages are few cuts
    own = each.groupBy("doc_id").agg(F.percentile("cut", 0.5, F.col("n")).alias("cut"), F.collect_list(F.when(F.col("cut").isNotNull(), F.struct("cut", "n"))).alias("cuts"))
    pages = lambda near: F.aggregate("cuts", F.lit(0).cast("long"), lambda a, x: a + F.when(near(x["cut"]), x["n"]).otherwise(0))
    confidence = F.try_divide(pages(lambda c: F.abs(c - F.col("cut")) <= AGREE + 1e-12), pages(lambda c: F.lit(True)))
    return own.select("doc_id", F.round("cut", 6).alias("cut"), F.round(F.coalesce(confidence, F.lit(0.0)), 6).alias("confidence"))


def page_sizes(pages: DataFrame, sampled: int = 12) -> DataFrame:
    """doc_id, width, height (most common of the first sampled pages; ties: first seen), has_text (80 characters a page on average)."""
    own = pages.where(F.col("page") <= sampled)
    size = own.groupBy("doc_id", "width", "height").agg(F.count("*").alias("n"), F.min("page").alias("first"))
    common = size.groupBy("doc_id").agg(F.max_by(F.struct("width", "height"), F.struct("n", -F.col("first"))).alias("s"))
    text = pages.groupBy("doc_id").agg((F.avg("chars") >= TEXT_LAYER).alias("has_text"))
    return common.join(text, "doc_id").select("doc_id", "s.width", "s.height", "has_text")


def decide(facts: DataFrame, mode: str = "auto") -> DataFrame:
    """doc_id, decision, cut of facts (width, height, cut, confidence, processed): split, no-gutter, whole or already-processed."""
    wide = F.col("width") / F.col("height") >= TWO_UP
    sure = F.col("cut").isNotNull() & (F.col("confidence") >= CONFIDENT)
    if mode == "always":
        decision, cut = F.lit("split"), F.coalesce("cut", F.lit(BLIND))
    elif mode == "never":
        decision, cut = F.lit("whole"), F.lit(None).cast("double")
    else:
        decision, cut = F.when(~wide, "whole").when(sure, "split").otherwise("no-gutter"), F.when(wide & sure, F.col("cut"))
    done = F.coalesce("processed", F.lit(False))
    return facts.select("doc_id", F.when(done, "already-processed").otherwise(decision).alias("decision"), F.when(~done, cut).alias("cut"))


def split_plan(pages: DataFrame, rtl: bool = False, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, out (from 0), page, x0, x1: each page of a split document as two halves that overlap a little, a single page whole."""
    halves = F.when(F.col("single") | F.col("cut").isNull(), F.array(F.struct(F.lit(0).alias("half"), F.lit(0.0).alias("x0"), F.lit(1.0).alias("x1")))).otherwise(
        F.array(F.struct(F.lit(1 if rtl else 0).alias("half"), F.lit(0.0).alias("x0"), F.least(F.col("cut") + overlap, F.lit(1.0)).alias("x1")), F.struct(F.lit(0 if rtl else 1).alias("half"), F.greatest(F.col("cut") - overlap, F.lit(0.0)).alias("x0"), F.lit(1.0).alias("x1")))
    )
    each = pages.select("doc_id", "page", F.explode(halves).alias("h"))
    return each.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "h.half")) - 1).alias("out"), "page", F.round("h.x0", 6).alias("x0"), F.round("h.x1", 6).alias("x1"))


def page_set(spec: Column, total: Column) -> Column:
    """Sorted pages of ``1,4-6``; reversed ranges count, pages are clamped to the document, another token raises."""
    form = r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$"

    def pages(token: Column) -> Column:
        a = F.regexp_extract(token, form, 1).try_cast("int")
        b = F.coalesce(F.nullif(F.regexp_extract(token, form, 2), F.lit("")).try_cast("int"), a)
        low, high = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), total)
        some = F.when(low <= high, F.sequence(low, F.greatest(high, low))).otherwise(F.array().cast("array<int>"))
        return F.when(token.rlike(form), some).otherwise(F.raise_error(F.concat(F.lit("bad page range: "), token)).cast("array<int>"))

    tokens = F.filter(F.split(spec, ","), lambda t: F.trim(t) != "")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, pages))))


def sample_pages(count: Column, wanted: int) -> Column:
    """Page places (from 0): all of a short document, else spread over its middle eight tenths."""
    low, high = F.floor(count * 0.1).cast("int"), F.floor(count * 0.9).cast("int")
    step = (high - low) / wanted
    spread = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: (low + F.floor(i * step)).cast("int"))
    return F.when(count <= 0, F.array().cast("array<int>")).when(count <= wanted, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array_distinct(spread))


# Beginnings of how a language is written in an item, and the recognition pack that each stands for.
LANGUAGES = {
    "spanish": "spa", "español": "spa", "espanol": "spa", "castellano": "spa", "english": "eng", "inglés": "eng", "ingles": "eng", "portuguese": "por", "português": "por", "portugues": "por",
    "french": "fra", "français": "fra", "francés": "fra", "frances": "fra", "german": "deu", "deutsch": "deu", "alemán": "deu", "aleman": "deu", "italian": "ita", "italiano": "ita", "catalan": "cat", "català": "cat",
    "latin": "lat", "latín": "lat", "quechua": "que", "aymara": "aym", "spa": "spa", "eng": "eng", "por": "por", "fra": "fra", "deu": "deu", "ita": "ita", "cat": "cat", "lat": "lat", "que": "que", "aym": "aym",
    "es": "spa", "en": "eng", "pt": "por", "fr": "fra", "de": "deu", "it": "ita", "ca": "cat", "la": "lat", "qu": "que", "ay": "aym",
}


def pick_language(requests: DataFrame, packs: DataFrame | None = None, default: str = "eng") -> DataFrame:
    """id, pack: the pack asked for, else the one with the longest prefix of the item's language, else the default. Without
    ``packs`` (prefix, pack) LANGUAGES hold. Beginnings of the language meet prefixes as equal keys."""
    if packs is None:
        packs = requests.sparkSession.createDataFrame(list(LANGUAGES.items()), "prefix string, pack string")
    language = F.lower(F.coalesce("language", F.lit("")))
    longest = packs.agg(F.coalesce(F.max(F.length("prefix")), F.lit(0))).first()[0]
    starts = F.transform(F.sequence(F.lit(0), F.least(F.length(language), F.lit(longest))), lambda n: F.substring(language, F.lit(1), n))
    each = requests.select("id", "requested", F.explode(starts).alias("prefix"))
    best = each.join(packs, "prefix", "left").groupBy("id", "requested").agg(F.max_by("pack", F.when(F.col("pack").isNotNull(), F.length("prefix"))).alias("pack"))
    return best.select("id", F.coalesce(F.nullif("requested", F.lit("")), "pack", F.lit(default)).alias("pack"))


def image_dpi(pages: DataFrame, sampled: int = 4) -> DataFrame:
    """doc_id, dpi of the first image among the first sampled pages (width in pixels over inches)."""
    own = pages.where((F.col("page") <= sampled) & (F.col("image_px") > 0) & (F.col("width") > 0))
    return own.groupBy("doc_id").agg(F.min_by(F.round(F.col("image_px") / F.col("width") * 72).cast("int"), "page").alias("dpi"))


def column_ink(rasters: DataFrame, step: int = 2, threshold: int | None = None) -> DataFrame:
    """doc_id, page, profile: the share of dark pixels of each column of a page (doc_id, page, width, height, samples: a byte a
    pixel, row by row), from every ``step``-th row.

    Pixels below the threshold are dark; without one it is the page's own, halfway between its darkest and lightest. Rows that
    the bytes do not fill are left out; a page without rows has an empty profile. Null bytes count as none.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            profiles = []
            for width, height, data in zip(*(b.column(c).to_pylist() for c in ("width", "height", "samples")), strict=True):
                pixels = np.frombuffer(data or b"", np.uint8)
                rows = min(height or 0, len(pixels) // width) if width and width > 0 else 0
                if rows <= 0:
                    profiles.append([])
                    continue
                level = (int(pixels.min()) + int(pixels.max())) // 2 if threshold is None else threshold
                profiles.append((pixels[: rows * width].reshape(rows, width)[::step] < level).mean(axis=0).tolist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("page"), pa.array(profiles, pa.list_(pa.float64()))], ["doc_id", "page", "profile"])

    kinds = ", ".join(f"{c} {rasters.schema[c].dataType.simpleString()}" for c in ("doc_id", "page"))
    return rasters.select("doc_id", "page", "width", "height", "samples").mapInArrow(measure, f"{kinds}, profile array<double>")


def measured(rasters: DataFrame, window: int = 5, band: float = BAND) -> DataFrame:
    """doc_id, page, cut, ink of sampled pages from their pixels: the gutter of the smoothed profile, and the page's share of ink."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    ink = F.when(F.size("profile") > 0, total(F.col("profile")) / F.size("profile")).otherwise(0.0)
    return column_ink(rasters).select("doc_id", "page", page_gutter(F.col("profile"), window, band).alias("cut"), ink.alias("ink"))


def page_gutter(profile: Column, window: int, band: float = BAND) -> Column:
    """The cut of a page's profile (an array), as ``gutter`` of ``smooth`` gives it; null when there is none. It is worked out
    beside the page: pages need not be taken apart into columns that are shuffled and sorted."""
    half, total = window // 2, lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def mean(p: Column, i: Column) -> Column:
        at = F.greatest(i - half, F.lit(0))
        return T.let(F.slice(p, at + 1, F.least(i + half, F.size(p) - 1) - at + 1), lambda a: total(a) / F.size(a))

    def cut(p: Column) -> Column:
        width = F.size(p)
        first = F.floor(width * (0.5 - band)).cast("int")
        places = F.slice(F.sequence(F.lit(0), width - 1), first + 1, F.ceil(width * (0.5 + band)).cast("int") - first)
        middle = F.transform(places, lambda i: F.get(p, i) if window <= 1 else F.when(width < window, F.get(p, i)).otherwise(mean(p, i)))
        return T.let(F.struct(middle.alias("m"), F.array_min(middle).alias("low"), F.array_max(middle).alias("high")), lambda x: longest(x, first, width))

    def longest(x: Column, first: Column, width: Column) -> Column:
        # the run so far, and the longest one that ended before it or with it (of equal ones the first)
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit(0).alias("length"), F.lit(0).alias("start"))

        def step(a: Column, ink: Column) -> Column:
            n = F.when(ink <= x["low"] + QUIET * (x["high"] - x["low"]), a["n"] + 1).otherwise(0)
            more = n > a["length"]
            return F.struct(n.alias("n"), (a["i"] + 1).alias("i"), F.when(more, n).otherwise(a["length"]).alias("length"), F.when(more, a["i"] + 1 - n).otherwise(a["start"]).alias("start"))

        return T.let(F.aggregate(x["m"], none, step), lambda r: F.when((x["high"] - x["low"] >= CONTRAST) & (r["length"] > 0), F.round((first + r["start"] + r["length"] / 2) / width, 6)))

    return F.when(F.size(profile) >= LEAST_WIDTH, T.let(profile, cut))
