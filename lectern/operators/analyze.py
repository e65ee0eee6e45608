"""Reading a library: projections, search, counts and lint.

A null and an empty text are told apart in records and alike in checks for missing values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Other names of fields; any other name stands for itself.
ALIASES = {"abstract": "abstract", "abstractnote": "abstract", "doi": "doi", "venue": "publisher", "publicationtitle": "publisher", "citekey": "citekey", "citationkey": "citekey", "lang": "language", "itemtype": "type"}
#: Separators that show a list of names in a single-field name. Fixed values.
COMBINED = r"(?i),| y | & |;| and "
EXPORT_COLUMNS = ["key", "citekey", "type", "title", "date", "year", "creators", "venue", "doi", "url", "tags"]
NO_YEAR = "(none)"


def field_name(name: str) -> str:
    return ALIASES.get(name.lower(), name)


def flatten_wire(wire: DataFrame) -> DataFrame:
    """Flat records from wire items (key, data struct with itemType, title, date, DOI, url, citationKey, abstractNote,
    publicationTitle, bookTitle, publisher, university, creators, tags)."""
    d = lambda n: F.coalesce(F.col(f"data.{n}"), F.lit(""))
    venue = F.coalesce(*(F.nullif(F.col(f"data.{n}"), F.lit("")) for n in ("publicationTitle", "bookTitle", "publisher", "university")), F.lit(""))
    return wire.select(
        "key",
        F.nullif(F.col("data.citationKey"), F.lit("")).alias("citekey"),
        d("itemType").alias("type"),
        d("title").alias("title"),
        d("date").alias("date"),
        F.nullif(T.year_text(F.col("data.date")), F.lit("")).alias("year"),
        F.transform("data.creators", lambda c: T.display_name(c["firstName"], c["lastName"], c["name"])).alias("creators"),
        venue.alias("venue"),
        d("DOI").alias("doi"),
        d("url").alias("url"),
        F.transform("data.tags", lambda t: t["tag"]).alias("tags"),
        d("abstractNote").alias("abstract"),
    )


def project(items: DataFrame, detail: str = "concise") -> DataFrame:
    """``concise`` leaves the abstract out, ``full`` keeps it."""
    return items if detail == "full" else items.drop("abstract")


def export_rows(flat: DataFrame) -> DataFrame:
    """The export's columns in order, lists joined by ``; ``."""
    return flat.withColumns({"creators": F.array_join("creators", "; "), "tags": F.array_join("tags", "; ")}).select(*EXPORT_COLUMNS)


def search(items: DataFrame, query: str = "", item_type: str | None = None, tag: str | None = None, item_tags: DataFrame | None = None) -> DataFrame:
    """Items whose title, creator or year hold every word of the query (ours: case-insensitive substrings), of a type, with a tag."""
    hay = F.lower(F.concat_ws(" ", "title", "first_name", "last_name", T.year_text("date")))
    for word in query.lower().split():
        items = items.where(F.contains(hay, F.lit(word)))
    if item_type:
        items = items.where(F.col("type") == item_type)
    if tag is not None:
        items = items.join(item_tags.where(F.col("tag") == tag), F.col("key") == F.col("item_key"), "left_semi")
    return items


def missing(items: DataFrame, field: str) -> DataFrame:
    """Items whose field is null, empty or blank."""
    return items.where(T.is_blank(F.col(field_name(field))))


def missing_counts(items: DataFrame, fields: list[str]) -> DataFrame:
    """field, total, missing; one pass over the items for all fields."""
    one = items.agg(F.count("*").alias("total"), *(F.count_if(T.is_blank(F.col(field_name(f)))).alias(f) for f in fields))
    return one.select("total", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields))).alias("x")).select("x.field", "total", "x.missing")


def by_author(items: DataFrame, name: str) -> DataFrame:
    """Items with a creator that holds the name, latest date first (missing dates last)."""
    own = F.lower(T.display_name(F.col("first_name"), F.col("last_name")))
    return items.where(F.contains(own, F.lit(name.lower()))).orderBy(F.desc(F.coalesce("date", F.lit(""))), "key")


def recent(items: DataFrame, limit: int = 20) -> DataFrame:
    """The items added last; ties by key."""
    return items.orderBy(F.desc("scan_order"), "key").limit(limit)


def with_pdf(items: DataFrame, attachments: DataFrame, how: str = "left_semi") -> DataFrame:
    """Items that have a PDF (``left_semi``) or none (``left_anti``)."""
    pdf = attachments.where((F.col("content_type") == "application/pdf") & ~F.col("deleted"))
    return items.join(pdf, items.key == pdf.parent_key, how)


def stats_totals(items: DataFrame, collections: DataFrame, item_tags: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row: items, collections, distinct tags, items with and without PDF and without abstract."""
    n = items.agg(F.count("*").alias("total_items"), F.count_if(T.is_blank("abstract")).alias("without_abstract"))
    p = with_pdf(items, attachments).agg(F.count("*").alias("with_pdf"))
    c = collections.agg(F.count("*").alias("collections"))
    t = item_tags.agg(F.countDistinct("tag").alias("tags"))
    one = n.crossJoin(p).crossJoin(c).crossJoin(t)  # one row each
    return one.withColumn("without_pdf", F.col("total_items") - F.col("with_pdf"))


def stats_by_type(items: DataFrame) -> DataFrame:
    return items.groupBy("type").agg(F.count("*").alias("n"))


def stats_by_year(items: DataFrame) -> DataFrame:
    return items.groupBy(F.coalesce(F.nullif(T.year_text("date"), F.lit("")), F.lit(NO_YEAR)).alias("year")).agg(F.count("*").alias("n"))


def lint_no_date(items: DataFrame) -> DataFrame:
    return missing(items, "date")


def lint_no_creators(items: DataFrame) -> DataFrame:
    return items.where(T.is_blank("last_name") & T.is_blank("first_name"))


def is_combined(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(COMBINED)


def lint_combined_creators(creators: DataFrame) -> DataFrame:
    """item_key, name: of each item the first single-field creator whose name looks like several."""
    bad = creators.where(is_combined(F.col("name")))
    return bad.groupBy("item_key").agg(F.min_by("name", "ord").alias("name"))


def lint_duplicate_titles(items: DataFrame) -> DataFrame:
    """key, title, first: items whose title (lower case, stripped; nothing else is folded) an earlier item has."""
    at = F.struct("scan_order", "key")
    own = items.select("key", "title", at.alias("at"), T.strip(F.lower("title")).alias("norm")).where("norm <> ''")
    first = own.groupBy("norm").agg(F.count("*").alias("n"), F.min("at").alias("least")).where("n > 1")
    return own.join(first, "norm").where("at <> least").select("key", "title", F.col("least.key").alias("first"))


def lint_report(items: DataFrame, creators: DataFrame | None = None) -> DataFrame:
    """rule, n of all four checks; ``creators`` (item_key, ord, name) are those written in a single field."""
    one = items.agg(F.count_if(T.is_blank("date")).alias("no_date"), F.count_if(T.is_blank("last_name") & T.is_blank("first_name")).alias("no_creators"))
    one = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in ("no_date", "no_creators")))).alias("x")).select("x.*")
    combined = lint_combined_creators(creators) if creators is not None else items.select("key").limit(0)
    counted = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    return one.unionByName(counted(combined, "combined_creators")).unionByName(counted(lint_duplicate_titles(items), "duplicate_titles"))


def notes_preview(notes: DataFrame, items: DataFrame) -> DataFrame:
    """item_key, conv_id, turn, preview of the notes whose item exists."""
    return notes.join(items.select(F.col("key").alias("item_key")), "item_key").select("item_key", "conv_id", "turn", T.note_preview("text").alias("preview"))


def annotations_html(notes: DataFrame) -> DataFrame:
    """item_key, html: an item's annotations in order, each a paragraph with its page."""
    line = F.concat(F.lit("<p>[p. "), F.coalesce(F.col("turn").cast("string"), F.lit("?")), F.lit("] "), F.coalesce("text", F.lit("")), F.lit("</p>"))
    own = notes.groupBy("item_key").agg(F.sort_array(F.collect_list(F.struct("conv_id", "turn", line.alias("line")))).alias("x"))
    return own.select("item_key", F.array_join(F.transform("x", lambda r: r["line"]), "").alias("html"))


def related(items: DataFrame, relations: DataFrame) -> DataFrame:
    """item_key, related_key, title; keys that no item has are left out."""
    target = items.select(F.col("key").alias("related_key"), "title")
    return relations.join(items.select(F.col("key").alias("item_key")), "item_key", "left_semi").join(target, "related_key").select("item_key", "related_key", "title")


def status_counts(reports: DataFrame) -> DataFrame:
    return reports.groupBy("status").agg(F.count("*").alias("n"))
