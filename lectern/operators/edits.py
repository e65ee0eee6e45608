"""Declarative batch edits, and undoing them from the rows as they were.

Edits are rows (seq, key, field, value, tag, remove_tag, collection, trash); within one seq a removal comes after an
addition. Nothing is changed in place: operators return the tables as they would be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .analyze import field_name


def unmatched(items: DataFrame, edits: DataFrame) -> DataFrame:
    """key, n of edits whose item does not exist."""
    return edits.join(items, "key", "left_anti").groupBy("key").agg(F.count("*").alias("n"))


def last_sets(edits: DataFrame) -> DataFrame:
    """key, field, value: of each field of an item the last set."""
    return edits.where("field is not null").groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))


def apply_sets(items: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """Items after the edits' sets. One aggregation by key gives all fields' values, so items are joined once."""
    own = {f: field_name(f) for f in fields}
    last = edits.where(F.col("field").isin(list(own))).groupBy("key").agg(*(F.max_by(F.when(F.col("field") == f, F.struct("value")), F.when(F.col("field") == f, F.col("seq"))).alias(f"__{f}") for f in own))
    joined = items.join(last, "key", "left")
    return joined.withColumns({c: F.when(F.col(f"__{f}").isNotNull(), F.col(f"__{f}.value")).otherwise(F.col(c)) for f, c in own.items()}).select(*items.columns)


def apply_tags(item_tags: DataFrame, edits: DataFrame, items: DataFrame) -> DataFrame:
    """Item tags after the edits: of each item and tag the last operation counts."""
    ops = edits.where("tag is not null").join(items, "key", "left_semi").groupBy(F.col("key").alias("item_key"), "tag").agg(F.max(F.struct("seq", F.col("remove_tag").cast("int").alias("op"))).alias("x"))
    kept = item_tags.select("item_key", "tag").join(ops, ["item_key", "tag"], "left_anti")
    return kept.union(ops.where("x.op = 0").select("item_key", "tag")).distinct()


def apply_trash(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Items with ``trashed``."""
    gone = edits.where("trash").select("key").distinct().withColumn("trashed", F.lit(True))
    return items.join(gone, "key", "left").withColumn("trashed", F.coalesce("trashed", F.lit(False)))


def apply_collections(membership: DataFrame, edits: DataFrame, collections: DataFrame, items: DataFrame) -> DataFrame:
    """Membership after the edits; a collection that does not exist is ignored (moving items to one is an error)."""
    new = edits.where("collection is not null").join(items, "key", "left_semi").join(collections.select(F.col("key").alias("collection")), "collection", "left_semi")
    return membership.select("item_key", "collection_key").union(new.select(F.col("key"), F.col("collection"))).distinct()


def snapshot(items: DataFrame, edits: DataFrame, op_id: str) -> DataFrame:
    """op_id and the rows as they are of the items that the edits touch."""
    return items.join(edits, "key", "left_semi").withColumn("op_id", F.lit(op_id))


def undo(items: DataFrame, log: DataFrame, op_id: str) -> DataFrame:
    """Items with the operation's rows as they were; an item that has gone since stays gone."""
    was = log.where(F.col("op_id") == op_id).drop("op_id")
    mine = items.join(was, "key", "left_anti")
    return mine.unionByName(was.join(items, "key", "left_semi").select(*items.columns))


def gone_since(items: DataFrame, log: DataFrame, op_id: str) -> DataFrame:
    return log.where(F.col("op_id") == op_id).join(items, "key", "left_anti").select("key")


def dry_run(items: DataFrame, edits: DataFrame) -> DataFrame:
    """key, field, old, new that the sets would change; nothing is executed until the result is read."""
    sets = last_sets(edits)
    names = [r for r in items.columns if r != "key"]
    old = items.select("key", F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("string"))))).alias("field", "old"))
    return sets.join(old, ["key", "field"]).where(~F.col("old").eqNullSafe(F.col("value"))).select("key", "field", "old", F.col("value").alias("new"))


def move(membership: DataFrame, items: DataFrame, collections: DataFrame, keys: DataFrame, collection: str) -> DataFrame:
    """Membership with the items in the collection as well; they stay in others."""
    if collections.where(F.col("key") == collection).isEmpty():
        raise LookupError(f"no collection {collection!r}")
    new = keys.join(items, "key", "left_semi").select(F.col("key").alias("item_key"), F.lit(collection).alias("collection_key"))
    return membership.select("item_key", "collection_key").union(new).distinct()


def create_collection(collections: DataFrame, key: str, name: str, parent: str | None = None) -> DataFrame:
    if parent is not None and collections.where(F.col("key") == parent).isEmpty():
        raise LookupError(f"no collection {parent!r}")
    new = collections.sparkSession.createDataFrame([(key, parent, name)], "key string, parent_key string, name string")
    return collections.unionByName(new)


def add_notes(notes: DataFrame, new: DataFrame, if_not_exists: bool = False) -> DataFrame:
    """Notes (item_key, html) with new ones (item_key, text); ``if_not_exists`` leaves out a note that the item has word for word."""
    made = new.select("item_key", T.text_to_html("text").alias("html"))
    made = made.join(notes, ["item_key", "html"], "left_anti").distinct() if if_not_exists else made
    return notes.select("item_key", "html").unionByName(made)


def attach(attachments: DataFrame, items: DataFrame, new: DataFrame) -> DataFrame:
    """``attachments`` with rows for new ones (key, parent_key, file, url, link): exactly one of file and url, under a regular
    item, else an error. A file is kept (``file``), a url as ``link`` or, without it, as a ``snapshot``; bytes are the host's."""
    parent = items.select(F.col("key").alias("parent_key"), F.lit(True).alias("known"), F.col("type").isin("attachment", "note").alias("child"))
    file, url = F.coalesce("file", F.lit("")) != "", F.coalesce("url", F.lit("")) != ""
    rows = new.join(parent, "parent_key", "left")
    wrong = F.when(file == url, F.concat(F.col("key"), F.lit(": exactly one of file and url"))).when(F.col("known").isNull(), F.concat(F.lit("no item "), F.col("parent_key"))).when(F.col("child"), F.concat(F.col("parent_key"), F.lit(" is not a regular item")))
    mode = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).when(file, "file").when(F.coalesce("link", F.lit(False)), "link").otherwise("snapshot")
    own = rows.select("key", "parent_key", mode.alias("mode"), F.when(file, F.col("file")).otherwise(F.col("url")).alias("source"))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in attachments.schema if f.name not in own.columns]
    base = [c if c in attachments.columns else F.lit(None).cast("string").alias(c) for c in own.columns]
    names = [*attachments.columns, *(c for c in own.columns if c not in attachments.columns)]
    return attachments.select("*", *(c for c in base if not isinstance(c, str))).select(*names).unionByName(own.select("*", *missing).select(*names))


def fetch_status(items: DataFrame, attachments: DataFrame, fetched: DataFrame, wanted: DataFrame, retry: bool = False) -> DataFrame:
    """key, status of open-access fetches: not-found, has-pdf, attached, error, none (fetched: key, ok)."""
    has = attachments.where((F.col("content_type") == "application/pdf") & ~F.col("deleted")).select(F.col("parent_key").alias("key"), F.lit(True).alias("has")).distinct()
    rows = wanted.join(items.select("key", F.lit(True).alias("known")), "key", "left").join(has, "key", "left").join(fetched, "key", "left")
    status = F.when(F.col("known").isNull(), "not-found").when(F.col("has").isNotNull() & F.lit(not retry), "has-pdf").when(F.col("ok"), "attached").when(~F.col("ok"), "error").otherwise("none")
    return rows.select("key", status.alias("status"))


def first_success(attempts: DataFrame) -> DataFrame:
    """identifier, translator, result of the first attempt (ord) that gave something, and how many there were."""
    return attempts.groupBy("identifier").agg(F.min_by("translator", F.when(F.col("result").isNotNull(), F.col("ord"))).alias("translator"), F.min_by("result", F.when(F.col("result").isNotNull(), F.col("ord"))).alias("result"), F.count("*").alias("attempts"))
