"""Tags: normalisation plans, and tags from the collection tree."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Share of the library above which a rule's tag is flagged, in per cent.
WIDE = 40


def normalization_plan(tags: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """tag, target: spellings that differ in case and spacing only go to one of them (an all-lowercase one last, then by
    code point); an explicit map (tag, target) wins. Rows without a change or target are left out; no chains are followed."""
    own = tags.select("tag").distinct().withColumn("canon", T.canonical_tag("tag"))
    w = Window.partitionBy("canon").orderBy(F.col("tag") == F.lower("tag"), "tag")
    plan = own.withColumn("target", F.first("tag").over(w)).select("tag", "target")
    if explicit is not None:
        given = explicit.select("tag", F.col("target").alias("__given"))
        plan = plan.join(given, "tag", "left").select("tag", F.coalesce("__given", "target").alias("target"))
    return plan.where("target <> tag and target <> ''")


def apply_renames(item_tags: DataFrame, plan: DataFrame) -> DataFrame:
    """Item tags after a plan; an item gets each tag once."""
    return item_tags.join(plan, "tag", "left").select("item_key", F.coalesce("target", "tag").alias("tag")).distinct()


def check_rules(rules: list[dict], containers: list[str] | None = None) -> tuple[list[dict], list[str]]:
    """The rules, if each has a valid pattern and tags; else ValueError with the rule's place."""
    for k, rule in enumerate(rules):
        if not isinstance(rule.get("match"), str) or not isinstance(rule.get("tags"), list):
            raise ValueError(f"rule {k}: needs match and tags")
        try:
            re.compile(rule["match"])
        except re.error as e:
            raise ValueError(f"rule {k}: {rule['match']!r} is not a pattern: {e}") from e
    return rules, list(containers or [])


def load_rules(path: str) -> tuple[list[dict], list[str]]:
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict) or not isinstance(data.get("rules"), list):
        raise ValueError(f"{path}: an object with a list of rules is needed")
    return check_rules(data["rules"], data.get("containers"))


def path_text(path: Column, containers: list[str]) -> Column:
    """What rules are matched against: the path's segments without containers, folded; the whole path if none is left."""
    skip = F.array(*(T.container_key(F.lit(c)) for c in containers)) if containers else F.array().cast("array<string>")
    parts = F.filter(F.transform(F.split(path, "/"), T.strip), lambda s: s != "")
    own = F.filter(parts, lambda s: ~F.array_contains(skip, T.container_key(s)))
    fold = lambda a: F.array_join(F.transform(a, T.norm_title), " / ")
    return F.when(F.size(own) > 0, fold(own)).otherwise(fold(parts))


def tags_of_paths(paths: DataFrame, rules: list[dict], containers: list[str] | None = None) -> DataFrame:
    """item_key, tag that the rules give an item for any of its paths (item_key, path)."""
    rules, containers = check_rules(rules, containers)
    text = path_text(F.col("path"), containers)
    fired = [F.when(F.col("__text").rlike(r["match"]), F.array(*(F.lit(t) for t in r["tags"]))).otherwise(F.array().cast("array<string>")) for r in rules]
    return paths.withColumn("__text", text).select("item_key", F.explode(F.array_distinct(F.concat(*fired))).alias("tag")).distinct()


def missing_tags(wanted: DataFrame, item_tags: DataFrame) -> DataFrame:
    """Wanted item tags that the items lack."""
    return wanted.join(item_tags, ["item_key", "tag"], "left_anti")


def tag_gains(new: DataFrame, items: DataFrame) -> DataFrame:
    """tag, n, share (per cent of all items), wide: what a plan would add."""
    total = items.agg(F.count("*").alias("total"))  # one row
    n = new.groupBy("tag").agg(F.countDistinct("item_key").alias("n"))
    share = F.round(100.0 * F.col("n") / F.col("total"), 6)
    return n.crossJoin(F.broadcast(total)).select("tag", "n", share.alias("share"), (share > WIDE).alias("wide"))


def gain_list(gains: DataFrame) -> DataFrame:
    """Gains with ``rank``: the tags that most items would get first, of equals by name. A row a tag of the plan."""
    return gains.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "tag")))


def add_tag(item_tags: DataFrame, items: DataFrame, keys: DataFrame, tag: str) -> DataFrame:
    """Item tags with the tag on the keys that are items."""
    new = keys.join(items, "key", "left_semi").select(F.col("key").alias("item_key"), F.lit(tag).alias("tag"))
    return item_tags.select("item_key", "tag").union(new).distinct()


def remove_tag(item_tags: DataFrame, keys: DataFrame, tag: str) -> DataFrame:
    gone = keys.select(F.col("key").alias("item_key"), F.lit(tag).alias("tag"))
    return item_tags.join(gone, ["item_key", "tag"], "left_anti").select("item_key", "tag")


def rename_tag(item_tags: DataFrame, old: str, new: str) -> DataFrame:
    """The whole library's tag under another name; it merges into a tag that is there."""
    return item_tags.select("item_key", F.when(F.col("tag") == old, F.lit(new)).otherwise(F.col("tag")).alias("tag")).distinct()


def unused_tags(tags: DataFrame, item_tags: DataFrame) -> DataFrame:
    return tags.join(item_tags, "tag", "left_anti")
