"""Document structure: contents lines, printed to physical pages, headings by typography, outlines.

Sequential rules (a level depends on the one before) are folds over one document's ordered rows; a document's outline or
heading list is bounded by the document, so it is gathered per document only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written

# Words that open a chapter or label an exhibit; such a line with a number is no contents entry.
STRUCTURAL = [
    "capítulo", "capitulo", "chapter", "parte", "part", "sección", "seccion", "section", "tomo", "volumen", "volume", "book", "libro", "anexo", "apéndice", "apendice", "appendix", "unidad", "unit", "tema",
    "lección", "leccion", "lesson", "cap", "ch", "tabla", "table", "cuadro", "mapa", "map", "gráfico", "grafico", "graph", "chart", "figura", "figure", "fig", "ilustración", "ilustracion", "illustration",
    "plate", "imagen", "image", "foto", "fotografía", "fotografia", "ecuación", "ecuacion", "equation", "recuadro", "box",
]
# Characters that lead from a title to its page number.
LEADERS = ".·•․‥…‧_-–—"
# What a pattern's white space is.
WHITE = " \t\n\x0b\f\r"
# Patterns of a caption, a numbered heading, a sentence bound, the heading of a contents page, the heading of
# a list of exhibits, and a row of such a list.
CAPTION = r"(?iu)^(figura|figure|fig\.?|tabla|table|cuadro|gr[aá]fico|graph|chart|ilustraci[oó]n|plate|map|mapa|ecuaci[oó]n|equation)\s*\d"
NUMBERED = (
    r"(?iu)^\s*(?:(?:cap[ií]tulo|chapter|parte|part|secci[oó]n|section|anexo|ap[eé]ndice|appendix|tomo|libro|book|unidad|unit|tema)\s+(?:\d{1,3}|[ivxlcdm]{1,7})\b"
    r"|\d{1,2}(?:\.\d{1,2}){0,3}\.?\s+\S|[IVXLCDM]{1,7}\.\s+\S)"
)
PROSE = r"""[.;:!?]\s+[a-záéíóúüñ¿¡“"'(\[]"""
CONTENTS = (
    r"(?iu)\b(contents?|table\s+of\s+contents|[ií]ndice(?:\s+general)?|contenidos?|tabla\s+de\s+contenidos?|sumario|inhalt(?:sverzeichnis)?|sommaire|"
    r"table\s+des\s+mati[eè]res|conte[uú]do|indice)\b"
)
EXHIBIT_LIST = (
    r"(?iu)\b(?:[ií]ndice|lista|listado|tabla|table|list|relaci[oó]n)\s+(?:de\s+|of\s+|des\s+)?(?:las\s+|los\s+|the\s+)?"
    r"(tablas?|cuadros?|mapas?|gr[aá]ficos?|figuras?|ilustraciones|im[aá]genes|fotograf[ií]as?|recuadros?|anexos?|siglas|abreviaturas|acr[oó]nimos|"
    r"tables?|figures?|maps?|charts?|illustrations?|plates?|boxes|abbreviations|acronyms)\b"
)
EXHIBIT_ROW = r"(?iu)^(?:tablas?|cuadros?|mapas?|gr[aá]ficos?|figuras?|fig\.?|ilustraci[oó]n|recuadros?|fotos?|im[aá]genes?|tables?|charts?|maps?|plates?|boxes?)\s*\d"
EXHIBIT_SHARE, EXHIBIT_ROWS, HEAD, LEAST_ROWS, DENSE, FRONT = 0.3, 4, 400, 4, 0.4, 0.2
ROMAN_CEILING, MAX_LEVEL, TOLERANCE = 200, 6, 4.0
NEEDLE, LEAST_NEEDLE, RADIUS = 40, 8, 2
CAP, THRESHOLD, REPEATED = 400, 5, 3
WRAPPED, LINE_GAP = 3, 1.8


def contents_line(c: Column | str) -> Column:
    """struct(title, printed, roman) of a printed contents line, null when it is none.

    Either leaders (two or more, spaces count) and an arabic or roman number, or a space and an arabic number. The number is
    looked for at the line's end, the leaders are cut off as a set of characters. Only lines that end in something like a number
    are squeezed and looked at further.
    """
    edge = F.lit(" " + LEADERS)
    form = rf"[\s{LEADERS}](\d{{1,4}}|(?i:[ivxlcdm]{{1,15}}))\z".replace("-–", r"\-–")
    ending = rf"[\s\x{{A0}}{LEADERS}](?:\d{{1,4}}|(?i:[ivxlcdm]{{1,15}}))\z".replace("-–", r"\-–")
    squeezed = F.trim(F.regexp_replace(F.replace(T.col(c), F.lit("\u00a0"), F.lit(" ")), r"\s+", " "))

    def cut(x: Column) -> Column:
        page = F.regexp_extract(F.right(x, F.lit(16)), form, 1)
        return T.let(page, lambda p: F.when(p != "", F.struct(F.substring(x, F.lit(1), F.length(x) - F.length(p)).alias("head"), p.alias("page"))))

    def number(x: Column) -> Column:
        arabic = x["page"].rlike(r"^\d+$")
        led = F.length(x["head"]) - F.length(F.rtrim(x["head"], edge)) >= 2
        n = F.when(arabic, x["page"].try_cast("int")).otherwise(T.roman_value(x["page"]))
        entry = F.struct(F.btrim(x["head"], edge).alias("title"), n.alias("printed"), (~arabic).alias("roman"))
        return F.when(led | (arabic & F.endswith(x["head"], F.lit(" "))), entry)

    def judged(x: Column) -> Column:
        title = x["title"]
        good = (F.length(title) >= 2) & title.rlike(r"\p{L}") & ~F.lower(title).isin(STRUCTURAL) & (x["printed"] > 0) & (~x["roman"] | (x["printed"] <= ROMAN_CEILING))
        return F.when(good, x)

    parts = T.let(squeezed, cut)
    return F.when(F.substring(F.rtrim(T.col(c), F.lit(WHITE + "\u00a0")), -16, 16).rlike(ending), T.let(parts, lambda x: F.when(x.isNotNull(), T.let(number(x), judged))))


def indent_levels(indents: Column, tolerance: float = TOLERANCE, most: int = MAX_LEVEL) -> Column:
    """Levels of an array of indents: an indent more than the tolerance right of a cluster's first starts a new one."""
    bases = F.aggregate(F.array_sort(F.array_distinct(indents)), F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, F.when(F.size(a) == 0, F.lit(1)).otherwise(F.size(a))) > tolerance), F.concat(a, F.array(x))).otherwise(a))
    return F.transform(indents, lambda x: F.least(F.greatest(F.size(F.filter(bases, lambda b: x >= b - tolerance)), F.lit(1)), F.lit(most)))


def offset_votes(rows: DataFrame) -> DataFrame:
    """doc_id, offset: the most frequent physical - printed; of equal counts the first met (ord)."""
    n = rows.groupBy("doc_id", (F.col("physical") - F.col("printed")).alias("delta")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return n.groupBy("doc_id").agg(F.max_by("delta", F.struct("n", -F.col("first"))).alias("offset"))


def resolve_pages(entries: DataFrame, labels: DataFrame, folios: DataFrame, page_count: DataFrame, offset: int | None = None) -> DataFrame:
    """doc_id, ord, page, confidence of contents entries (doc_id, ord, printed, roman): by page label, else by printed
    folio of the same series, else by the given offset, else by the vote of the entries found so far, else none. Pages are
    clamped to the document. A vote is for arabic numbers only, as the offset is."""
    e = entries.withColumns({"label": F.when(F.col("roman"), T.roman_text("printed")).otherwise(F.col("printed").cast("string")), "series": F.when(F.col("roman"), "r").otherwise("d")})
    found = e.join(labels.select("doc_id", "label", F.col("page").alias("by_label")), ["doc_id", "label"], "left")
    found = found.join(folios.select("doc_id", "series", F.col("n").alias("printed"), F.col("page").alias("by_folio")), ["doc_id", "series", "printed"], "left")
    known = F.coalesce("by_label", "by_folio")
    if offset is None:
        votes = offset_votes(found.where(known.isNotNull() & ~F.col("roman")).select("doc_id", "ord", "printed", known.alias("physical")))
        found = found.join(votes.withColumnRenamed("offset", "__shift"), "doc_id", "left")
        name = "voted"
    else:
        found, name = found.withColumn("__shift", F.lit(offset)), "offset"
    shifted = F.when(~F.col("roman"), F.col("printed") + F.col("__shift"))
    confidence = F.when(F.col("by_label").isNotNull(), "labels").when(F.col("by_folio").isNotNull(), "folio").when(shifted.isNotNull(), name).otherwise("none")
    page = F.coalesce("by_label", "by_folio", shifted)
    found = found.join(page_count, "doc_id", "left")
    clamped = F.when(page.isNotNull(), F.least(F.greatest(page, F.lit(1)), F.coalesce("page_count", page)))
    return found.select("doc_id", "ord", clamped.cast("int").alias("page"), confidence.alias("confidence"))


def page_labels(ranges: DataFrame, page_count: DataFrame) -> DataFrame:
    """doc_id, label, page of documents whose labels are given by ranges (doc_id, start, style, prefix, first): from page
    ``start`` (from 0) to the next range's, numbers from ``first`` in a style (D arabic, R and r roman, A and a letters, which
    are doubled after z; none: the prefix alone). A label belongs to the first page that has it; empty ones to none."""
    own = ranges.join(page_count, "doc_id").where(F.col("start") < F.col("page_count"))
    end = F.coalesce(F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")), F.col("page_count"))
    each = own.withColumn("end", end).where(F.col("end") > F.col("start")).withColumn("at", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    n = (F.coalesce("first", F.lit(1)) + F.col("at") - F.col("start")).cast("int")
    letter = F.repeat(F.char(F.pmod(n - 1, F.lit(26)) + 97), F.floor((n - 1) / 26).cast("int") + 1)
    style = F.col("style")
    number = F.when(style == "D", n.cast("string")).when(style == "r", T.roman_text(n)).when(style == "R", F.upper(T.roman_text(n))).when(style == "a", letter).when(style == "A", F.upper(letter)).otherwise("")
    label = F.concat(F.coalesce("prefix", F.lit("")), number)
    return each.select("doc_id", label.alias("label"), (F.col("at") + 1).cast("int").alias("page")).where("label <> ''").groupBy("doc_id", "label").agg(F.min("page").alias("page"))


def folios(lines: DataFrame, band: float = 0.09) -> DataFrame:
    """doc_id, series (d, r), n, page: numbers that stand in a page's top or bottom band; the first page of each counts."""
    edge = lines.where((F.col("y") < F.col("page_height") * band) | (F.col("y1") > F.col("page_height") * (1 - band)))
    token = edge.select("doc_id", "page", F.explode(F.split(F.trim("text"), r"\s+")).alias("t")).where(F.col("t").rlike(r"^(?:\d{1,4}|(?i:[ivxlcdm]{1,5}))$"))
    arabic, roman = F.col("t").rlike(r"^\d{1,4}$"), T.roman_value("t")
    n = F.when(arabic, F.try_to_number(F.when(arabic, F.col("t")), F.lit("9999")).cast("int")).when((roman > 0) & (roman <= ROMAN_CEILING), roman)
    return token.select("doc_id", "page", F.when(arabic, "d").otherwise("r").alias("series"), n.alias("n")).where("n > 0").groupBy("doc_id", "series", "n").agg(F.min("page").alias("page"))


def needle(title: Column) -> Column:
    """The first NEEDLE characters of a folded title, null if it has under LEAST_NEEDLE. A long title's beginning is folded alone
    if it gives more than these."""
    start = T.norm_title(F.substring(title, 1, 2 * NEEDLE))
    folded = T.let(start, lambda s: F.when((F.length(s) > NEEDLE) | (F.length(title) <= 2 * NEEDLE), s).otherwise(T.norm_title(title)))
    return T.let(F.substring(folded, 1, NEEDLE), lambda s: F.when(F.length(s) >= LEAST_NEEDLE, s))


def verify_pages(entries: DataFrame, page_text: DataFrame) -> DataFrame:
    """doc_id, ord, page, confidence: an entry whose folded title stands on its page is ``verified``; on one within RADIUS,
    nearest first (after before before), moved there (``verified-shifted``); else as it was."""
    e = entries.select("doc_id", "ord", "page", needle(F.col("title")).alias("needle")).withColumn("try", F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), F.lit(d).alias("d")) for k, d in enumerate((0, 1, -1, 2, -2)) if abs(d) <= RADIUS))))
    e = e.withColumn("__page", F.col("page") + F.col("try.d"))
    asked = entries.select("doc_id", F.explode(F.array(*(F.col("page") + d for d in range(-RADIUS, RADIUS + 1)))).alias("__page")).distinct()
    pages = page_text.select("doc_id", F.col("page").alias("__page"), "text").join(asked, ["doc_id", "__page"], "left_semi").select("doc_id", "__page", T.norm_title("text").alias("__text"))
    # the condition is never null: else texts and titles would be folded once more, to drop null ones
    hit = e.join(pages, ["doc_id", "__page"]).where(F.coalesce(F.contains(F.col("__text"), F.col("needle")), F.lit(False)))
    best = hit.groupBy("doc_id", "ord").agg(F.min(F.struct("try.turn", "__page")).alias("x"))
    out = entries.join(best, ["doc_id", "ord"], "left")
    confidence = F.when(F.col("x").isNull(), F.col("confidence")).when(F.col("x.turn") == 0, "verified").otherwise("verified-shifted")
    return out.select("doc_id", "ord", "title", "printed", "roman", F.coalesce("x.__page", "page").alias("page"), confidence.alias("confidence"))


def repair_pages(verified: DataFrame, page_text: DataFrame) -> DataFrame:
    """Unverified entries moved by the median (toward zero) of their series' verified differences, if three or more are and
    the document has such a page; what is moved (``consensus``) is looked for again around its new page."""
    ok = F.col("confidence").startswith("verified")
    median = verified.where(ok).groupBy("doc_id", "roman").agg(F.count("*").alias("n"), F.median(F.col("page") - F.col("printed")).cast("int").alias("delta")).where("n >= 3").drop("n")
    ends = page_text.groupBy("doc_id").agg(F.max("page").alias("last"))
    own = verified.join(median, ["doc_id", "roman"], "left").join(ends, "doc_id", "left").withColumn("to", (F.col("printed") + F.col("delta")).cast("int"))
    move = ~ok & F.col("to").between(1, F.col("last")) & (F.col("to") != F.col("page"))
    own = own.withColumn("move", F.coalesce(move, F.lit(False)))
    names = ["doc_id", "ord", "title", "printed", "roman"]
    moved = verify_pages(own.where("move").select(*names, F.col("to").alias("page"), F.lit("consensus").alias("confidence")), page_text)
    return own.where("not move").select(*names, "page", "confidence").unionByName(moved)


def glued_numbers(rows: DataFrame, least: int = 3) -> DataFrame:
    """``rows`` in which titles that had swallowed their page number are freed of it.

    ``rows`` (doc_id, ord, title, printed, roman, link_page) are of two kinds. Those with an arabic printed number vote for
    link_page - printed (the commonest, of equals the first met; ``least`` must agree). Those without one are judged: up to
    four digits that follow a letter go if they, moved by that difference, give the row's own link page.
    """
    voter = F.col("printed").isNotNull() & ~F.coalesce(F.col("roman"), F.lit(False))
    own = rows.withColumn("__delta", F.when(voter, F.col("link_page") - F.col("printed")))
    same, doc = Window.partitionBy("doc_id", "__delta"), Window.partitionBy("doc_id")
    vote = F.when(voter, F.struct(F.count_if(voter).over(same).alias("n"), (-F.min(F.when(voter, F.col("ord"))).over(same)).alias("first"), F.col("__delta").alias("delta")))
    own = own.withColumn("__vote", vote).withColumn("__most", F.max("__vote").over(doc))
    delta = F.when(F.col("__most.n") >= least, F.col("__most.delta"))
    form = r"(?s)^(.*?[\p{L}\p{Nl}\p{No}])\s*(\d{1,4})$"
    able = F.col("printed").isNull() & F.right("title", F.lit(3)).rlike(r"\d\R?\z")
    own = own.withColumn("__tail", F.when(able & delta.isNotNull(), F.regexp_extract("title", form, 2).try_cast("int")))
    glued = F.coalesce(F.col("__tail") + delta == F.col("link_page"), F.lit(False))
    out = own.withColumns({"title": F.when(glued, F.trim(F.regexp_extract("title", form, 1))).otherwise(F.col("title")), "printed": F.when(glued, F.col("__tail")).otherwise(F.col("printed"))})
    return out.select(*rows.columns)


def untitled(lines: DataFrame) -> DataFrame:
    """Lines with empty texts but for bare numbers, for pairs of which only the places are asked."""
    return lines.withColumn("text", F.when(T.is_page_number("text"), F.col("text")).when(F.col("text").isNotNull(), ""))


def pair_columns(lines: DataFrame, slack: float = 2.0, band: float = 16.0) -> DataFrame:
    """doc_id, page, ord, title, number_ord, printed: titles with the bare number in the column right of them.

    Numbers choose in reading order: of the titles not yet taken that end left of the number (``slack`` over at most) and
    whose box holds the number's middle (one unit over at most), the one that ends furthest right, of equals the first.
    Numbers and titles meet on bands of the page; the choice is a fold over one page's numbers.
    """
    number = T.is_page_number("text")
    at = lambda c: F.floor(c / band)
    middle = (F.col("y") + F.col("y1")) / 2
    n = lines.where(number).select("doc_id", "page", F.col("ord").alias("number_ord"), F.trim("text").alias("printed"), F.col("x0").alias("nx"), middle.alias("middle"), at(middle).alias("slot"))
    t = lines.where(~number).select("doc_id", "page", "ord", "text", "x1", "y", "y1", F.explode(F.sequence(at(F.col("y") - 1), F.greatest(at(F.col("y") - 1), at(F.col("y1") + 1)))).alias("slot"))
    both = n.join(t, ["doc_id", "page", "slot"]).where((F.col("x1") <= F.col("nx") + slack) & F.col("middle").between(F.col("y") - 1, F.col("y1") + 1))
    mine = both.groupBy("doc_id", "page", "number_ord", "printed").agg(F.sort_array(F.collect_list(F.struct((-F.col("x1")).alias("left"), "ord", "text"))).alias("titles"))
    page = mine.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("number_ord", "printed", "titles"))).alias("numbers"))
    state = "array<struct<ord:bigint,title:string,number_ord:bigint,printed:string>>"

    def choose(taken: Column, x: Column) -> Column:
        free = F.get(F.filter(x["titles"], lambda t: ~F.exists(taken, lambda y: y["ord"] == t["ord"])), F.lit(0))
        own = F.struct(free["ord"].cast("bigint").alias("ord"), free["text"].alias("title"), x["number_ord"].cast("bigint").alias("number_ord"), x["printed"].alias("printed"))
        return F.when(free.isNull(), taken).otherwise(F.concat(taken, F.array(own)))

    chosen = F.aggregate("numbers", F.array().cast(state), choose)
    return page.select("doc_id", "page", F.explode(chosen).alias("x")).select("doc_id", "page", "x.ord", "x.title", "x.number_ord", "x.printed")


def link_titles(links: DataFrame, lines: DataFrame, least: float = 0.3, band: float = 32.0) -> DataFrame:
    """doc_id, page, ord, text (if lines have one), target: text lines of which a link's rectangle covers more than a share; the
    first link wins. Links and lines meet on bands of the page that both reach into."""
    bands = lambda a, b: F.sequence(F.floor(F.col(a) / band), F.greatest(F.floor(F.col(a) / band), F.floor(F.col(b) / band)))
    l = links.withColumn("band", F.explode(bands("y", "y1"))).alias("l")  # noqa: E741
    both = l.join(lines.withColumn("band", F.explode(bands("y", "y1"))).alias("t"), ["doc_id", "page", "band"])
    wide = F.greatest(F.least(F.col("l.x1"), F.col("t.x1")) - F.greatest(F.col("l.x0"), F.col("t.x0")), F.lit(0.0))
    high = F.greatest(F.least(F.col("l.y1"), F.col("t.y1")) - F.greatest(F.col("l.y"), F.col("t.y")), F.lit(0.0))
    area = F.greatest((F.col("t.x1") - F.col("t.x0")) * (F.col("t.y1") - F.col("t.y")), F.lit(1e-9))
    return both.where(wide * high / area > least).groupBy("doc_id", "page", *(F.col(f"t.{c}").alias(c) for c in ("ord", "text") if c in lines.columns)).agg(F.min_by("l.target", "l.link_ord").alias("target"))


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, body: the font size that most characters have; of equal sums the smallest."""
    n = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"))
    return n.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body"))


def text_measure(lines: DataFrame, body: DataFrame) -> DataFrame:
    """doc_id, measure: of the sorted widths of body lines the element at nine tenths (the last at most)."""
    own = lines.join(body, "doc_id").where((F.col("body") == 0) | (F.abs(F.col("size") - F.col("body")) <= 0.5)).withColumn("w", F.col("x1") - F.col("x0"))
    w = Window.partitionBy("doc_id")
    rank = own.withColumns({"k": F.row_number().over(w.orderBy("w", "ord")) - 1, "n": F.count("*").over(w)})
    return rank.where(F.col("k") == F.least(F.floor(F.col("n") * 0.9), F.col("n") - 1)).select("doc_id", F.col("w").alias("measure"))


def heading_score() -> Column:
    """Points of a line beside its document's body and measure; 0 when a gate keeps it out."""
    text, size, body = F.trim("text"), F.col("size"), F.col("body")
    words = F.size(F.split(text, r"\s+"))
    width = F.col("x1") - F.col("x0")
    out = (
        (F.col("y") < 0.06 * F.col("page_height")) | (F.col("y") > 0.93 * F.col("page_height")) | (F.length(text) < 3) | (F.length(text) > 110) | (words > 20) | text.rlike(CAPTION)
        | ((body > 0) & (size < body - 0.4)) | text.rlike(PROSE) | ((body > 0) & (size < 1.35 * body) & (F.col("measure") > 0) & (width > 0.85 * F.col("measure")))
    )
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("page_width") / 2) < 0.04 * F.col("page_width")
    points = [
        F.when((body > 0) & (size > 1.12 * body), 3),
        F.when((body > 0) & (size > 1.35 * body), 2),
        F.when(F.col("bold") & ((body <= 0) | (size >= body)), 2),
        F.when(text.rlike(NUMBERED), 3),
        F.when((text == F.upper(text)) & (text != F.lower(text)) & (F.length(text) > 4), 1),
        F.when(F.col("lines_in_block") <= 2, 1),
        F.when(~text.rlike("[.,;:]$"), 1),
        F.when(centred, 1),
    ]
    return F.when(out, 0).otherwise(reduce(lambda a, p: a + F.coalesce(p, F.lit(0)), points, F.lit(0)))


def scored_lines(lines: DataFrame) -> DataFrame:
    body = body_size(lines)
    own = lines.join(body, "doc_id").join(text_measure(lines, body), "doc_id", "left").withColumn("measure", F.coalesce("measure", F.lit(0.0)))
    return own.withColumn("score", heading_score())


def running_heads(lines: DataFrame) -> DataFrame:
    """doc_id, head of texts (folded) on three or more pages."""
    return lines.groupBy("doc_id", F.lower(F.trim("text")).alias("head")).agg(F.countDistinct("page").alias("n")).where(F.col("n") >= REPEATED).select("doc_id", "head")


def merge_wrapped(scored: DataFrame) -> DataFrame:
    """Headings that wrap over up to three lines (same page, size, weight; below the first line's top by 1.8 of the heading's
    height so far at most) as one; the first line's place, the best score. The fold is over lines of one page, size and
    weight that follow each other, so its state is short whatever the document."""
    row = F.struct("page", "y", "ord", "y1", F.trim("text").alias("text"), "size", "bold", "score")
    w = Window.partitionBy("doc_id").orderBy("page", "y", "ord")
    like = F.struct("page", "size", "bold")
    island = F.sum(F.coalesce(like != F.lag(like).over(w), F.lit(True)).cast("int")).over(w)
    docs = scored.withColumn("island", island).groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    state = "array<struct<page:int,y:double,ord:bigint,y1:double,text:string,size:double,bold:boolean,score:int,n:int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        dy = x["y"] - last["y"]
        joins = F.coalesce((last["page"] == x["page"]) & (last["size"] == x["size"]) & (last["bold"] == x["bold"]) & (dy > 0) & (dy <= LINE_GAP * F.greatest(last["y1"] - last["y"], F.lit(1.0))) & (last["n"] < WRAPPED), F.lit(False))
        first = lambda a, b: F.when(joins, a).otherwise(b)
        new = F.struct(
            x["page"].alias("page"), first(last["y"], x["y"]).alias("y"), first(last["ord"], x["ord"].cast("bigint")).alias("ord"), x["y1"].alias("y1"), first(T.join_wrapped(last["text"], x["text"]), x["text"]).alias("text"),
            x["size"].alias("size"), x["bold"].alias("bold"), first(F.greatest(last["score"], x["score"]), x["score"]).cast("int").alias("score"), first(last["n"] + 1, F.lit(1)).alias("n"),
        )
        return F.concat(F.when(joins, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc), F.array(new))

    merged = F.aggregate("rows", F.array().cast(state), step)
    return docs.select("doc_id", F.explode(merged).alias("x")).select("doc_id", "x.page", "x.y", "x.ord", "x.text", "x.size", "x.bold", "x.score")


def heading_candidates(lines: DataFrame, threshold: int = THRESHOLD, cap: int = CAP) -> DataFrame:
    """The best ``cap`` headings of each document (ties: reading order), with ``truncated``; headings that stand on three or
    more pages are running heads and left out."""
    good = merge_wrapped(scored_lines(lines).where(F.col("score") >= threshold))
    heads = running_heads(good)
    own = good.withColumn("head", F.lower(F.trim("text"))).join(heads, ["doc_id", "head"], "left_anti").drop("head")
    w = Window.partitionBy("doc_id")
    rank = own.withColumns({"place": F.row_number().over(w.orderBy(F.desc("score"), "page", "y", "ord")), "n": F.count("*").over(w)})
    return rank.where(F.col("place") <= cap).select("doc_id", "page", "y", "ord", "text", "size", "score", (F.col("n") > cap).alias("truncated"))


def heading_levels(candidates: DataFrame, most: int = 4) -> DataFrame:
    """doc_id, ord, level: by its section number when three and two fifths of a document's headings have one, else (and for a
    heading without one) by the rank of sizes that stand on three or more pages, another size taking the nearest one's."""
    own = candidates.withColumn("depth", T.numbering_depth("text"))
    doc = own.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("depth") > 0).alias("numbered")).withColumn("by_number", F.col("numbered") >= F.greatest(F.lit(3.0), 0.4 * F.col("n")))
    pages = own.groupBy("doc_id", "size").agg(F.countDistinct("page").alias("p"))
    enough = pages.where(F.col("p") >= REPEATED)
    usable = pages.join(enough.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(enough)  # all sizes, if none repeats
    ranked = usable.withColumn("rank", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))).select("doc_id", F.col("size").alias("known"), "rank")
    nearest = pages.select("doc_id", "size").join(ranked, "doc_id").groupBy("doc_id", "size").agg(F.min_by("rank", F.struct(F.abs(F.col("size") - F.col("known")), "rank")).alias("rank"))
    out = own.join(doc, "doc_id").join(nearest, ["doc_id", "size"], "left")
    level = F.when(F.col("by_number") & (F.col("depth") > 0), F.col("depth")).otherwise(F.col("rank"))
    return out.select("doc_id", "ord", F.least(level, F.lit(most)).alias("level"))


def normalize(entries: Column, page_count: Column | None = None, most: int | None = None) -> Column:
    """An outline (array of struct(level, title, page)): titles squeezed and empty ones dropped, pages clamped, a level at
    most one deeper than the last, the first at 1, repeats in a row (as given) dropped."""
    kind = "array<struct<level:int,title:string,page:int,asked:int>>"

    def step(acc: Column, e: Column) -> Column:
        title, page = T.squeeze(F.coalesce(e["title"], F.lit(""))), F.greatest(F.coalesce(e["page"], F.lit(1)), F.lit(1))
        page = F.least(page, page_count) if page_count is not None else page
        level = F.greatest(F.coalesce(e["level"], F.lit(1)), F.lit(1))
        level = asked = F.least(level, F.lit(most)) if most else level
        last = F.get(acc, F.size(acc) - 1)
        level = F.least(level, F.coalesce(last["level"], F.lit(0)) + 1)
        same = F.coalesce((last["asked"] == asked) & (last["title"] == title) & (last["page"] == page), F.lit(False))
        new = F.struct(level.cast("int").alias("level"), title.alias("title"), page.cast("int").alias("page"), asked.cast("int").alias("asked"))
        return F.when((title == "") | same, acc).otherwise(F.concat(acc, F.array(new)))

    folded = F.aggregate(entries, F.array().cast(kind), step)
    return F.transform(folded, lambda e: F.struct(e["level"].alias("level"), e["title"].alias("title"), e["page"].alias("page")))


def normalize_rows(entries: DataFrame, page_count: Column | None = None, most: int | None = None) -> DataFrame:
    """doc_id, i (from 0), level, title, page of outline rows (doc_id, ord, level, title, page), by the rules of ``normalize``.

    The level of the i-th entry that stays is at most one deeper than the one before, hence
    i + min(1, the least of (level asked - i) up to it): a running minimum, in linear time for a document of any length.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    level = F.greatest(F.coalesce("level", F.lit(1)), F.lit(1))
    page = F.greatest(F.coalesce("page", F.lit(1)), F.lit(1))
    own = entries.withColumns({"title": T.squeeze(F.coalesce("title", F.lit(""))), "level": F.least(level, F.lit(most)) if most else level, "page": F.least(page, page_count) if page_count is not None else page}).where("title <> ''")
    same = F.struct("level", "title", "page")
    own = own.withColumn("again", F.coalesce(same == F.lag(same).over(w), F.lit(False))).where("not again")
    own = own.withColumn("i", F.row_number().over(w) - 1)
    least = F.min(F.col("level") - F.col("i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return own.select("doc_id", "i", (F.col("i") + F.least(F.lit(1), least)).cast("int").alias("level"), "title", F.col("page").cast("int").alias("page"))


def backwards(entries: Column) -> Column:
    """Places (from 0) of entries whose page is before the one before."""
    return F.filter(F.transform(entries, lambda e, i: F.when(e["page"] < F.get(entries, i - 1)["page"], i)), lambda i: i.isNotNull())


def render(entries: Column) -> Column:
    """Outline text: two spaces a level, title, tab, page."""
    return F.array_join(F.transform(entries, lambda e: F.concat(F.repeat(F.lit("  "), e["level"] - 1), e["title"], F.lit("\t"), e["page"].cast("string"))), "\n")


def parse(text: Column) -> Column:
    """Outline entries of outline text; tabs or pairs of spaces indent, ``#`` starts a comment, two spaces may stand for the
    tab. A line that fits neither raises."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda line, i: F.struct(line.alias("line"), i.alias("i"))), lambda x: ~T.is_blank(x["line"]) & ~x["line"].rlike(r"^\s*#"))
    form = r"^(\t*| *)(\S.*?)(?:\t\s*| {2,})(\d+)\s*$"

    def entry(x: Column) -> Column:
        lead = F.regexp_extract(x["line"], form, 1)
        level = F.when(F.contains(lead, F.lit("\t")), F.length(lead)).otherwise(F.floor(F.length(lead) / 2)).cast("int") + 1
        good = F.struct(level.alias("level"), T.strip(F.regexp_extract(x["line"], form, 2)).alias("title"), F.regexp_extract(x["line"], form, 3).try_cast("int").alias("page"))
        return F.when(x["line"].rlike(form), good).otherwise(F.raise_error(F.concat(F.lit("outline line "), (x["i"] + 1).cast("string"), F.lit(": no page"))).cast("struct<level:int,title:string,page:int>"))

    return F.transform(lines, entry)


def load(raw: Column) -> Column:
    """Entries of outline text or JSON: a list, or an object with entries, outline or toc; ``physicalPage`` stands for page."""
    kind = "array<struct<level:int,title:string,page:int,physicalPage:int>>"
    as_json = F.when(raw.rlike(r"^\s*\[") , F.from_json(raw, kind)).otherwise(F.coalesce(*(F.get(F.array(F.from_json(raw, f"{n} {kind}")[n]), F.lit(0)) for n in ("entries", "outline", "toc"))))
    own = F.transform(as_json, lambda e: F.struct(F.coalesce(e["level"], F.lit(1)).alias("level"), e["title"].alias("title"), F.coalesce(e["page"], e["physicalPage"]).alias("page")))
    return F.when(raw.rlike(r"^\s*[\[{]"), own).otherwise(parse(F.when(~raw.rlike(r"^\s*[\[{]"), raw).otherwise(F.lit(""))))


def contents_pages(lines: DataFrame, links: DataFrame | None = None, page_count: DataFrame | None = None, front: float = FRONT) -> DataFrame:
    """doc_id, page, rows, titled of pages that read as contents, within the document's first part (four pages at least).

    Evidence is printed entries or internal links (doc_id, page), the more of both; on a page whose first HEAD characters
    name it contents and that has few of either, titles paired with a column of numbers. Four are needed, and either such a
    name or as many as two fifths of the lines. Lists of exhibits, by their name or by their rows, are left out. Without
    ``page_count`` a document ends at its last page with lines.
    """
    own = lines.where(F.col("text").rlike(r"\S"))
    own = own.select("doc_id", "page", "ord", F.substring(F.btrim("text", F.lit(WHITE)), 1, HEAD).alias("text"), contents_line("text").isNotNull().alias("entry"), F.col("text").rlike(EXHIBIT_ROW.replace("^", r"^\s*", 1)).alias("exhibit"))
    ends = page_count if page_count is not None else lines.groupBy("doc_id").agg(F.max("page").alias("page_count"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    own = own.join(ends, "doc_id").where(F.col("page") <= F.greatest(F.lit(4), F.floor(F.col("page_count") * front)))
    p = own.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.count_if("entry").alias("printed"), F.count_if("exhibit").alias("exhibits"), F.substring(whole, 1, HEAD).alias("head"))
    listed = F.col("head").rlike(EXHIBIT_LIST) | (F.col("exhibits") >= EXHIBIT_ROWS) | ((F.col("exhibits") >= 2) & (F.col("exhibits") / F.col("n") > EXHIBIT_SHARE))
    p = p.where(~listed).withColumn("titled", F.col("head").rlike(CONTENTS))
    linked = links.groupBy("doc_id", "page").agg(F.count("*").alias("linked")) if links is not None else None
    p = p.join(linked, ["doc_id", "page"], "left").fillna(0, ["linked"]) if linked is not None else p.withColumn("linked", F.lit(0))
    p = written(p.select("doc_id", "page", "n", "printed", "titled", "linked"), "pages")
    poor = F.col("titled") & (F.col("printed") < LEAST_ROWS) & (F.col("linked") < LEAST_ROWS)
    pairs = pair_columns(untitled(lines).join(p.where(poor).select("doc_id", "page"), ["doc_id", "page"], "left_semi")).groupBy("doc_id", "page").agg(F.count("*").alias("paired"))
    rows = F.greatest(F.when(poor, F.coalesce("paired", F.lit(0))).otherwise(F.col("printed")), F.col("linked"))
    found = p.join(pairs, ["doc_id", "page"], "left").withColumn("rows", rows)
    return found.where((F.col("rows") >= LEAST_ROWS) & (F.col("titled") | (F.col("rows") / F.col("n") > DENSE))).select("doc_id", "page", "rows", "titled")


def contents_runs(pages: DataFrame) -> DataFrame:
    """doc_id, first, last, titled of runs of adjacent contents pages; the titled runs, or the earliest if none is."""
    island = F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    runs = pages.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.max("titled").alias("titled"))
    w = Window.partitionBy("doc_id")
    keep = runs.withColumns({"any": F.max("titled").over(w), "k": F.row_number().over(w.orderBy("first"))})
    return keep.where(F.col("titled") | (~F.col("any") & (F.col("k") == 1))).select("doc_id", "first", "last", "titled")


def route(evidence: DataFrame) -> DataFrame:
    """doc_id, route from counts (links, printed, headings) and has_text."""
    r = F.when(~F.col("has_text"), "ocr-needed").when(F.col("links") > 0, "contents-links").when(F.col("printed") > 0, "contents-printed-numbers").when(F.col("headings") > 0, "typography").otherwise("nothing-found")
    return evidence.select("doc_id", r.alias("route"))


def follows(y: Column, page: Column, first_y: Column, first_page: Column, first_height: Column) -> Column:
    """Whether a line stands directly below another: same page, at most 1.8 of the first's heights down."""
    dy = y - first_y
    return (page == first_page) & (dy > 0) & (dy <= LINE_GAP * F.greatest(first_height, F.lit(1.0)))


def linked_contents(links: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, ord, title, printed, roman, page: contents entries from linked lines; the link's target is the physical page.

    A line that reads as an entry gives its title and printed number, another is freed of leaders; lines without letters and
    the page's own heading are left out. A line with the same target directly below the line before, not starting with a
    capital or digit, goes on that entry. Last, titles are freed of page numbers that ran into them (``glued_numbers``).
    """
    hit = link_titles(links, lines.drop("text")).select("doc_id", "page", "ord", "target", F.lit(False).alias("line"))
    # targets meet their lines in the order of the document that is needed anyway, so that texts are shuffled once
    both = lines.select("doc_id", "page", "ord", F.lit(None).cast(hit.schema["target"].dataType).alias("target"), F.lit(True).alias("line"), "text", "y", "y1").unionByName(hit, allowMissingColumns=True).repartition("doc_id")
    rows = both.withColumn("target", F.max("target").over(Window.partitionBy("doc_id", "page", "ord"))).where("line")
    rows = rows.withColumn("e", F.when(F.col("target").isNotNull(), contents_line("text")))
    edge = rf"^[\s{LEADERS}]+|[\s{LEADERS}]+$".replace("-–", r"\-–")
    bare = F.when(F.substring("text", -1, 1).rlike("[\x85\u2028\u2029]"), F.regexp_replace("text", edge, "")).otherwise(F.btrim("text", F.lit(WHITE + LEADERS)))  # a pattern's end may be before a line's
    rows = rows.withColumn("part", F.coalesce("e.title", bare))
    good = F.col("target").isNotNull() & (F.length("part") >= 2) & F.col("part").rlike(r"\p{L}") & ~F.col("part").rlike(CONTENTS.replace(r"\b(", r"^(", 1))
    rows = rows.withColumn("good", good)
    w = Window.partitionBy("doc_id").orderBy("page", "ord")
    before = lambda c: F.lag(c).over(w)
    goes_on = before("good") & (F.col("target") == before("target")) & follows(F.col("y"), F.col("page"), before("y"), before("page"), before(F.col("y1") - F.col("y"))) & ~F.col("part").rlike(r"^[\p{Lu}\d]")
    entry = rows.withColumn("starts", (~F.coalesce(goes_on, F.lit(False))).cast("int")).where("good").withColumn("entry", F.sum("starts").over(w))
    row = F.struct("page", "ord", "part", "e.printed", "e.roman", "target")
    parts = entry.groupBy("doc_id", "entry").agg(F.sort_array(F.collect_list(row)).alias("t"))
    first = F.get("t", F.lit(0))
    title = F.aggregate(F.slice("t", F.lit(2), F.size("t")), F.regexp_replace(first["part"], r"^\s+", ""), lambda a, x: T.join_wrapped(a, x["part"]))
    made = parts.select("doc_id", first["ord"].alias("ord"), title.alias("title"), first["printed"].alias("printed"), F.coalesce(first["roman"], F.lit(False)).alias("roman"), first["target"].cast("int").alias("page"))
    return glued_numbers(made.withColumnRenamed("page", "link_page")).withColumnRenamed("link_page", "page")


def column_contents(runs: DataFrame, lines: DataFrame, enough: int = 4) -> DataFrame:
    """doc_id, first, page, ord, title, printed, roman, x0 of the runs' pages on which ``enough`` titles pair with a column of
    numbers. Up to three lines directly above a title that no number claimed are its beginning; x0 is then the topmost's."""
    own = lines.join(runs.select("doc_id", "first", "last"), "doc_id").where((F.col("page") >= F.col("first")) & (F.col("page") <= F.col("last")))
    pairs = pair_columns(untitled(own)).select("doc_id", "page", "ord", "printed")
    told = own.join(pairs, ["doc_id", "page", "ord"], "left").withColumn("line", F.trim("text"))
    told = told.withColumn("free", F.col("printed").isNull() & ~T.is_page_number("text"))
    page = Window.partitionBy("doc_id", "first", "page")
    told = told.withColumn("n", F.count("printed").over(page))
    w = page.orderBy("ord")
    told = told.withColumns({f"p{k}": F.lag(F.struct("free", "line", "page", "y", "y1", "x0"), k).over(w) for k in range(1, WRAPPED + 1)})
    going, at, title, x0 = F.lit(True), {"page": F.col("page"), "y": F.col("y")}, F.col("line"), F.col("x0")
    whole, start = title, x0
    for k in range(1, WRAPPED + 1):
        p = F.col(f"p{k}")
        going = going & F.coalesce(p["free"] & follows(at["y"], at["page"], p["y"], p["page"], p["y1"] - p["y"]), F.lit(False))
        title = T.join_wrapped(p["line"], title)
        whole, start = F.when(going, title).otherwise(whole), F.when(going, p["x0"]).otherwise(start)
        at = {"page": p["page"], "y": p["y"]}
    arabic = F.col("printed").rlike(r"^\d+$")
    value = F.when(arabic, F.when(arabic, F.col("printed")).try_cast("int")).otherwise(T.roman_value("printed"))
    heading = F.col("line").rlike(CONTENTS.replace(r"\b(", r"^(", 1))
    rows = told.where(F.col("printed").isNotNull() & (F.col("n") >= enough) & (F.length("line") >= 2) & ~heading)
    rows = rows.select("doc_id", "first", "page", "ord", whole.alias("title"), value.alias("printed"), (~arabic).alias("roman"), start.alias("x0"))
    return rows.where((F.col("printed") > 0) & (~F.col("roman") | (F.col("printed") <= ROMAN_CEILING)))


def printed_contents(runs: DataFrame, lines: DataFrame, enough: int = 4) -> DataFrame:
    """doc_id, first, page, ord, title, printed, roman, x0 of each run of contents pages: lines that are entries by themselves;
    where a run has fewer than four of them, titles paired with a column of numbers, if there are any.

    A title that begins in lower case goes on what stands directly above: up to three lines without a number, up to one
    that does not begin so; x0 is then that line's.
    """
    r = runs.select("doc_id", "first", "last")
    own = lines.join(r, "doc_id").where((F.col("page") >= F.col("first")) & (F.col("page") <= F.col("last")))
    heading = lambda c: c.rlike(CONTENTS.replace(r"\b(", r"^(", 1))
    told = own.withColumns({"e": contents_line("text"), "line": F.trim("text")})
    told = told.withColumn("pending", F.col("e").isNull() & F.length("line").between(2, 120) & ~heading(F.col("line")))
    w = Window.partitionBy("doc_id", "first").orderBy("page", "ord")
    told = told.withColumns({f"p{k}": F.lag(F.struct("pending", "line", "page", "y", "y1", "x0"), k).over(w) for k in range(1, WRAPPED + 1)})
    going, at, title = F.lit(True), {"text": F.col("e.title"), "page": F.col("page"), "y": F.col("y")}, F.col("e.title")
    whole, x0 = F.col("e.title"), F.col("x0")
    for k in range(1, WRAPPED + 1):
        p = F.col(f"p{k}")
        going = going & F.coalesce(at["text"].rlike(r"^\p{Ll}") & p["pending"] & follows(at["y"], at["page"], p["y"], p["page"], p["y1"] - p["y"]), F.lit(False))
        title = T.join_wrapped(p["line"], title)
        whole, x0 = F.when(going, title).otherwise(whole), F.when(going, p["x0"]).otherwise(x0)
        at = {"text": p["line"], "page": p["page"], "y": p["y"]}
    by_line = told.where(F.col("e").isNotNull() & ~heading(F.col("e.title"))).select("doc_id", "first", "page", "ord", whole.alias("title"), "e.printed", "e.roman", x0.alias("x0"))
    by_line = written(by_line, "by_line")
    count = by_line.groupBy("doc_id", "first").agg(F.count("*").alias("n"))
    poor = r.join(count.where(F.col("n") >= enough), ["doc_id", "first"], "left_anti")
    columns = written(column_contents(poor, lines, enough), "columns")
    kept = by_line.join(columns.select("doc_id", "first").distinct(), ["doc_id", "first"], "left_anti")
    return kept.unionByName(columns)


def indented(entries: DataFrame, group: list[str]) -> DataFrame:
    """``entries`` (with x0) with a level from their indents, compared within a group: only the distinct ones are gathered."""
    rows = entries.groupBy(*group).agg(F.array_sort(F.collect_set("x0")).alias("r"))
    leveled = rows.select(*group, F.explode(F.arrays_zip("r", indent_levels(F.col("r")).alias("levels"))).alias("x"))
    return entries.join(leveled.select(*group, F.col("x.r").alias("x0"), F.col("x.levels").alias("level")), [*group, "x0"])


def auto_outline(lines: DataFrame, links: DataFrame | None = None, labels: DataFrame | None = None, page_count: DataFrame | None = None, most: int = 4) -> DataFrame:
    """doc_id, source, ord, level, title, page: a document's outline from the best evidence it has: contents pages whose rows
    are links (``contents-links``), contents pages with printed numbers (``contents-printed-numbers``: by page labels, folios
    and votes, searched for in the text), else headings by their typography (``typography``)."""
    spark = lines.sparkSession
    ends = page_count if page_count is not None else lines.groupBy("doc_id").agg(F.max("page").alias("page_count"))
    listed = written(contents_runs(contents_pages(lines, links, ends)), "runs")  # the steps that follow read it, and each other, many times
    inside = (F.col("page") >= F.col("first")) & (F.col("page") <= F.col("last"))
    own = lines.join(listed.select("doc_id", "first", "last"), "doc_id").where(inside).select(*lines.columns)
    out = []
    rest = listed
    if links is not None:
        linked = written(linked_contents(links, own), "linked")
        out.append(indented(linked.join(own.select("doc_id", "ord", "x0"), ["doc_id", "ord"]), ["doc_id"]).select("doc_id", F.lit("contents-links").alias("source"), "ord", "level", "title", "page"))
        rest = listed.join(linked.select("doc_id").distinct(), "doc_id", "left_anti")
    printed = written(printed_contents(rest, lines), "printed")
    labels = labels if labels is not None else spark.createDataFrame([], "doc_id long, label string, page int")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    near = lines.join(printed.select("doc_id").distinct(), "doc_id", "left_semi")
    pages = near.groupBy("doc_id", "page").agg(text.alias("text"))
    placed = resolve_pages(printed.select("doc_id", "ord", "printed", "roman"), labels, folios(near), ends).where("page is not null")
    placed = written(placed.join(printed.select("doc_id", "ord", "title", "printed", "roman"), ["doc_id", "ord"]), "placed")
    found = repair_pages(written(verify_pages(placed, pages), "verified"), pages)
    leveled = indented(printed.select("doc_id", "first", "ord", "x0"), ["doc_id", "first"]).select("doc_id", "ord", "level")
    out.append(found.join(leveled, ["doc_id", "ord"]).select("doc_id", F.lit("contents-printed-numbers").alias("source"), "ord", "level", "title", "page"))
    done = written(reduce(DataFrame.unionByName, out), "contents")
    candidates = written(heading_candidates(lines.join(done.select("doc_id").distinct(), "doc_id", "left_anti")), "headings")
    by_size = heading_levels(candidates, most).join(candidates.select("doc_id", "ord", F.col("text").alias("title"), "page"), ["doc_id", "ord"])
    return done.unionByName(by_size.select("doc_id", F.lit("typography").alias("source"), "ord", "level", "title", "page")).withColumn("level", F.least("level", F.lit(most)))


def set_outlines(outlines: DataFrame, new: DataFrame) -> DataFrame:
    """Outlines (doc_id, entries) with those of ``new`` in place of older ones; one that is set to nothing is an error."""
    empty = F.coalesce(F.size("entries"), F.lit(0)) <= 0
    entries = F.when(empty, F.raise_error(F.concat(F.lit("no outline entries for "), F.col("doc_id").cast("string"))).cast(new.schema["entries"].dataType)).otherwise(F.col("entries"))
    return outlines.join(new, "doc_id", "left_anti").select("doc_id", "entries").unionByName(new.select("doc_id", entries.alias("entries")))


def clear_outlines(outlines: DataFrame, docs: DataFrame) -> DataFrame:
    """Outlines with empty ones for ``docs`` (doc_id)."""
    mark = docs.select("doc_id", F.lit(True).alias("clear")).distinct()
    none = F.array().cast(outlines.schema["entries"].dataType)
    return outlines.join(mark, "doc_id", "left").select("doc_id", F.when(F.col("clear"), none).otherwise(F.col("entries")).alias("entries"))
