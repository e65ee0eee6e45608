"""Storage: inventory, clean-up plans, and what to shrink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MB = 1024 * 1024
PDF, SNAPSHOT = "application/pdf", "text/html"
TITLE_CUT = 70
MAX_RATIO = 0.8


def inventory(attachments: DataFrame, parents: DataFrame) -> DataFrame:
    """Attachments with their parent's title (cut) and year; attachments without a parent stay. These take no part in the join, in
    which their null keys would all be one task's."""
    own = parents.select(F.col("key").alias("parent_key"), F.substring("title", 1, TITLE_CUT).alias("title"), F.regexp_extract("date", r"\d{4}", 0).alias("year"))
    with_key = attachments.where("parent_key is not null").join(own, "parent_key", "left")
    return with_key.unionByName(attachments.where("parent_key is null"), allowMissingColumns=True).select("key", "parent_key", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("year", F.lit("")).alias("year"), "content_type", "size")


def is_disposable_orphan() -> Column:
    """No parent, collection, tag or annotation, and not in the trash yet."""
    return F.col("parent_key").isNull() & (F.col("n_collections") == 0) & (F.col("n_tags") == 0) & (F.col("annotations") == 0) & ~F.col("deleted")


def disk_summary(attachments: DataFrame) -> DataFrame:
    """kind, n, bytes; the kinds overlap, so they do not add up to ``total``."""
    kinds = {"pdfs": F.col("content_type") == PDF, "snapshots": F.col("content_type") == SNAPSHOT, "orphans": F.col("parent_key").isNull(), "trashed": F.col("deleted"), "total": F.lit(True)}
    one = attachments.agg(*(x for k, c in kinds.items() for x in (F.count_if(c).alias(f"n_{k}"), F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).alias(f"b_{k}"))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n"), F.col(f"b_{k}").alias("bytes")) for k in kinds))).alias("x")).select("x.*")


def heavy_pdfs(attachments: DataFrame, limit: int = 15, least: int = 25 * MB) -> DataFrame:
    """The largest PDFs not in the trash; ties by key."""
    return attachments.where((F.col("content_type") == PDF) & ~F.col("deleted") & (F.col("size") >= least)).orderBy(F.desc("size"), "key").limit(limit)


def gc_plan(attachments: DataFrame) -> DataFrame:
    """key, size, reason (``orphan``, ``snapshot``) of what may go. Annotated files and those in the trash never do; a snapshot has a parent."""
    reason = F.when(is_disposable_orphan(), "orphan").when(F.col("parent_key").isNotNull() & (F.col("content_type") == SNAPSHOT) & (F.col("annotations") == 0) & ~F.col("deleted"), "snapshot")
    return attachments.withColumn("reason", reason).where("reason is not null").select("key", "size", "reason")


def gc_summary(attachments: DataFrame) -> DataFrame:
    """reason, n, bytes; ``kept-annotated`` are snapshots that only their annotations save, ``trash`` what is in it."""
    reason = (
        F.when(F.col("deleted"), "trash")
        .when(is_disposable_orphan(), "orphan")
        .when(F.col("parent_key").isNotNull() & (F.col("content_type") == SNAPSHOT), F.when(F.col("annotations") == 0, "snapshot").otherwise("kept-annotated"))
    )
    return attachments.withColumn("reason", reason).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def gc_execute(attachments: DataFrame, plan: DataFrame, erase: bool = False) -> DataFrame:
    """Attachments after the plan: its keys in the trash, and the whole trash erased if asked."""
    out = attachments.join(plan.select("key", F.lit(True).alias("__go")), "key", "left").withColumn("deleted", F.col("deleted") | F.coalesce("__go", F.lit(False))).drop("__go")
    return out.where(~F.col("deleted")) if erase else out


def shrink_targets(attachments: DataFrame, least: int = 25 * MB, below: int | None = None, keys: DataFrame | None = None, force: bool = False) -> DataFrame:
    """PDFs with a file, not linked, not in the trash, largest first: of the keys asked for (own or parent's), or of a
    size band without those done before (unless forced; keys that are asked for are never skipped)."""
    able = attachments.where((F.col("content_type") == PDF) & F.col("has_file") & ~F.col("deleted") & ~F.col("linked"))
    if keys is not None:
        own = able.join(keys, "key", "left_semi")
        by_parent = able.join(keys.select(F.col("key").alias("parent_key")), "parent_key", "left_semi").select(*able.columns)
        return own.unionByName(by_parent).dropDuplicates(["key"]).orderBy(F.desc("size"), "key")
    band = F.col("size") >= least
    band = band if below is None else band & (F.col("size") < below)
    band = band if force else band & ~F.col("done")
    return able.where(band).orderBy(F.desc("size"), "key")


def unmatched_keys(attachments: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys asked for that are neither an attachment's nor a parent's."""
    return keys.join(attachments, "key", "left_anti").join(attachments.select(F.col("parent_key").alias("key")), "key", "left_anti")


def shrink_verdict(before: Column, after: Column, pages_before: Column, pages_after: Column, most: float = MAX_RATIO) -> Column:
    """struct(accept, ratio, reason): the first rule that rejects gives the reason."""
    ratio = F.round(after / F.nullif(before, F.lit(0)), 6)
    reason = (
        F.when(F.coalesce(after, F.lit(0)) <= 0, "empty output")
        .when(pages_before.isNull() | pages_after.isNull(), "unreadable page count")
        .when(pages_before != pages_after, "page count differs")
        .when(F.coalesce(ratio, F.lit(1.0)) > most, "no meaningful gain")
        .otherwise("ok")
    )
    return F.struct((reason == "ok").alias("accept"), ratio.alias("ratio"), reason.alias("reason"))


def shrink_report(results: DataFrame) -> DataFrame:
    """status, n, bytes_saved of shrink results (size_before, size_after, pages_before, pages_after); only accepted ones save."""
    v = results.withColumn("v", shrink_verdict(F.col("size_before"), F.col("size_after"), F.col("pages_before"), F.col("pages_after")))
    status = F.when(F.col("size_before").isNull(), "missing-file").when(F.col("v.accept"), "shrunk").when(F.col("v.reason") == "no meaningful gain", "kept").otherwise("failed")
    return v.withColumn("status", status).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.when(F.col("status") == "shrunk", F.col("size_before") - F.col("size_after")).otherwise(0)).alias("bytes_saved"))


def prune_plan(attachments: DataFrame, notes: DataFrame) -> DataFrame:
    """key, status of originals that a processed file's note says it replaces (JSON ``{"replaces": key}`` in the note)."""
    marker = notes.select(F.get_json_object(F.regexp_extract("text", r"(\{[^{}]*\"replaces\"[^{}]*\})", 1), "$.replaces").alias("key")).where("key is not null").distinct()
    status = F.when(F.col("deleted"), "already-deleted").when(F.col("annotations") > 0, "kept-annotated").otherwise("prune")
    return attachments.join(marker, "key").select("key", status.alias("status"))
