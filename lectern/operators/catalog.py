"""Scopes: which items, attachments and collections an operator works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: How many parents a collection path climbs; the bound also ends a cycle.
MOST_PARENTS = 12
ITEM_KEY = "^[A-Z0-9]{8}$"


class NotFoundError(LookupError):
    """A key, name or citekey that stands for nothing."""


class AmbiguousError(LookupError):
    """Several rows where one is asked for."""


def regular_items(items: DataFrame) -> DataFrame:
    """Items that are not attachments or notes."""
    return items.where(~F.col("type").isin("attachment", "note"))


def in_collection(items: DataFrame, membership: DataFrame, collection: str) -> DataFrame:
    """Direct members."""
    own = membership.where(F.col("collection_key") == collection)
    return items.join(own, items.key == own.item_key, "left_semi")


def descendants(collections: DataFrame, root: str) -> DataFrame:
    """key, depth of the collection and all below it, however deep; a path ends where it would meet a key again. (The
    session's limit on recursion, spark.sql.cteRecursionLevelLimit, raises an error; nothing is lost silently.)"""
    return collections.sparkSession.sql(
        """with recursive tree(key, depth, path) as (
              select key, 0, concat('/', key, '/') from {c} where key = {root}
              union all
              select c.key, t.depth + 1, concat(t.path, c.key, '/') from tree t join {c} c on c.parent_key = t.key where not contains(t.path, concat('/', c.key, '/')))
            select key, min(depth) as depth from tree group by key""",
        c=collections,
        root=root,
    )


def in_collection_tree(items: DataFrame, membership: DataFrame, collections: DataFrame, root: str) -> DataFrame:
    """Members of the collection or of any below it, each once."""
    own = membership.join(descendants(collections, root), F.col("collection_key") == F.col("key"), "left_semi")
    return items.join(own, items.key == own.item_key, "left_semi")


def scope(items: DataFrame, membership: DataFrame | None = None, collection: str | None = None) -> DataFrame:
    """Regular items, or those of a collection."""
    found = regular_items(items)
    return found if collection is None else in_collection(found, membership, collection)


def resolve_collection(collections: DataFrame, asked: str) -> str:
    """Key of the collection with that key, else of the first (least key) with that name."""
    row = collections.where((F.col("key") == asked) | (F.col("name") == asked)).orderBy(F.col("key") != asked, "key").select("key").first()
    if row is None:
        raise NotFoundError(f"no collection {asked!r}")
    return row.key


def by_keys(items: DataFrame, keys: list[str], citekeys: DataFrame | None = None) -> DataFrame:
    """Items of the keys asked for, once each; a key of another form, or with @, is looked up as a citekey."""
    spark = items.sparkSession
    asked = spark.createDataFrame([(k.lstrip("@"), not k.startswith("@")) for k in dict.fromkeys(keys)], "asked string, plain boolean")
    direct = asked.where(F.col("plain") & F.col("asked").rlike(ITEM_KEY)).select(F.col("asked").alias("key"))
    if citekeys is not None:
        named = asked.where(~(F.col("plain") & F.col("asked").rlike(ITEM_KEY)))
        direct = direct.union(named.join(citekeys, named.asked == citekeys.citekey).select("key"))
    return items.join(direct, "key", "left_semi")


def unresolved(items: DataFrame, keys: list[str]) -> DataFrame:
    """Keys asked for that no item has."""
    asked = items.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")
    return asked.join(items, "key", "left_anti")


def collection_paths(collections: DataFrame) -> DataFrame:
    """key, path (names from the top, ``A / B / C``), depth; at most MOST_PARENTS parents."""
    return collections.sparkSession.sql(
        f"""with recursive up(key, above, path, depth) as (
              select key, parent_key, name, 0 from {{c}}
              union all
              select u.key, c.parent_key, concat(c.name, ' / ', u.path), u.depth + 1 from up u join {{c}} c on c.key = u.above where u.depth < {MOST_PARENTS})
            select key, max_by(path, depth) as path, max(depth) as depth from up group by key""",
        c=collections,
    )


def item_paths(membership: DataFrame, collections: DataFrame) -> DataFrame:
    """item_key, path of every collection of every item."""
    paths = collection_paths(collections)
    return membership.join(paths, F.col("collection_key") == F.col("key")).select("item_key", "path")


def collections_with_counts(collections: DataFrame, membership: DataFrame) -> DataFrame:
    n = membership.groupBy("collection_key").agg(F.countDistinct("item_key").alias("n_items"))
    return collections.join(n, F.col("key") == F.col("collection_key"), "left").select("key", "name", "parent_key", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def tags_with_counts(item_tags: DataFrame) -> DataFrame:
    return item_tags.groupBy("tag").agg(F.countDistinct("item_key").alias("n_items"))


def keys_of(items: DataFrame) -> DataFrame:
    """Keys alone: only that column is read."""
    return items.select("key")


#: How many rows a listing shows: of a search, and of collections and tags.
SEARCH_LIMIT, LIST_LIMIT = 25, 100


def page_of(df: DataFrame, order: list[Column], limit: int = SEARCH_LIMIT) -> tuple[DataFrame, int]:
    """The first rows in an order (at most ``limit``, read here), and how many there are in all: counted as they pass by, in the
    same job."""
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("total")).orderBy(*order).limit(limit).collect()
    return df.sparkSession.createDataFrame(rows, df.schema), seen.get["total"]


def notice(shown: int, total: int) -> str:
    """What a listing says below its rows when it leaves some out."""
    return f"showing {shown} of {total}" if shown < total else ""


def pdfs_of(items: DataFrame, attachments: DataFrame) -> DataFrame:
    """item_key, key of the PDF attachments of items, own or by parent; the two equi-joins keep it from a nested loop."""
    pdf = attachments.where((F.col("content_type") == "application/pdf") & ~F.col("deleted")).select("key", "parent_key")
    own = items.select(F.col("key").alias("item_key"))
    return pdf.join(own, pdf.parent_key == own.item_key).select("item_key", "key").union(pdf.join(own, pdf.key == own.item_key).select("item_key", "key")).distinct()


def the_pdf(attachments: DataFrame, item_key: str) -> str:
    """Key of an item's only PDF; none, several and a lost file are three different errors."""
    own = attachments.where(((F.col("parent_key") == item_key) | (F.col("key") == item_key)) & (F.col("content_type") == "application/pdf") & ~F.col("deleted"))
    rows = own.select("key", "has_file").orderBy("key").take(2)
    if not rows:
        raise NotFoundError(f"{item_key} has no PDF")
    if len(rows) > 1:
        raise AmbiguousError(f"{item_key} has several PDFs; name one of them")
    if not rows[0].has_file:
        raise FileNotFoundError(f"the file of {rows[0].key} is missing")
    return rows[0].key


def cite(items: DataFrame, attachments: DataFrame) -> DataFrame:
    """key, title, type, pdfs (sorted keys) of each item."""
    pdfs = pdfs_of(items, attachments).groupBy("item_key").agg(F.sort_array(F.collect_list("key")).alias("pdfs"))
    return items.join(pdfs, F.col("key") == F.col("item_key"), "left").select("key", "title", "type", F.coalesce("pdfs", F.array().cast("array<string>")).alias("pdfs"))


def first_by(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group in an order."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
