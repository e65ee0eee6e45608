"""Files that people write or that a library exports: edits, merge plans, tag maps, outlines, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.analyze import export_rows
from ..session import written
from .ordered import running

EDIT = "key string, `set` map<string,string>, addTags array<string>, removeTags array<string>, addToCollection string, trash boolean"
PLAN = "master string, others array<string>"


class BadLineError(ValueError):
    """A line that is not what the file should hold; says which."""


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (in its file, from 1), seq (over all files, by path), text of the lines that are neither blank nor start
    with ``#``.

    Files are read in splits like any text. A line's number is its place in its split and the lines of the splits before it;
    those counts (a row a split) are added up beside the lines.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    rows = read.select(F.regexp_replace("value", r"\r$", "").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    block = Window.partitionBy("file", "block")  # a task reads a split's lines in order
    rows = written(rows.withColumn("in_block", F.row_number().over(block.orderBy("at"))).drop("at"), "lines")
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    sizes = sizes.withColumns({"before": F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n"), "above": F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")})
    placed = rows.join(sizes.select("file", "block", "before", "above"), ["file", "block"])
    own = placed.select("file", (F.col("before") + F.col("in_block")).cast("int").alias("line_no"), (F.col("above") + F.col("in_block")).cast("long").alias("seq"), "text")
    return own.where(~T.is_blank("text") & ~F.col("text").rlike(r"^\s*#"))


def _parsed(spark: SparkSession, path: str, schema: str, good: str) -> DataFrame:
    lines = numbered_lines(spark, path)
    rows = lines.withColumn("x", F.from_json("text", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    rows = written(rows.select("file", "line_no", "seq", "x.*"), "parsed")  # judged and used: the files are read once
    bad = rows.where(f"_bad is not null or not coalesce({good}, false)").agg(F.min(F.struct("file", "line_no"))).first()[0]
    if bad is not None:
        raise BadLineError(f"{bad.file}, line {bad.line_no}: not a valid record")
    return rows.drop("_bad")


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """Edits as rows (seq, key, field, value, tag, remove_tag, collection, trash), one for each single change. ``seq`` is the
    line's number over all files of a folder, in the order of their paths: of two files the later one's set is the last."""
    rows = _parsed(spark, path, EDIT, "key <> ''")
    null = lambda kind: F.lit(None).cast(kind)
    base = {"field": null("string"), "value": null("string"), "tag": null("string"), "remove_tag": F.lit(False), "collection": null("string"), "trash": F.lit(False)}

    def change(**own):  # noqa: ANN003, ANN202
        return F.struct(*((own.get(k, v)).alias(k) for k, v in base.items()))

    empty = F.array().cast("array<struct<field:string,value:string,tag:string,remove_tag:boolean,collection:string,trash:boolean>>")
    each = [
        F.coalesce(F.transform(F.map_entries("set"), lambda e: change(field=e["key"], value=e["value"])), empty),
        F.coalesce(F.transform("addTags", lambda t: change(tag=t)), empty),
        F.coalesce(F.transform("removeTags", lambda t: change(tag=t, remove_tag=F.lit(True))), empty),
        F.when(F.col("addToCollection").isNotNull(), F.array(change(collection=F.col("addToCollection")))).otherwise(empty),
        F.when(F.coalesce("trash", F.lit(False)), F.array(change(trash=F.lit(True)))).otherwise(empty),
    ]
    return rows.select("seq", "key", F.explode(F.concat(*each)).alias("c")).select("seq", "key", "c.*")


def read_merge_plan(spark: SparkSession, path: str) -> DataFrame:
    """master, other."""
    return _parsed(spark, path, PLAN, "master <> '' and size(others) > 0").select("master", F.explode("others").alias("other"))


def read_tag_map(spark: SparkSession, path: str) -> DataFrame:
    """tag, target from the first two columns of a CSV file."""
    rows = spark.read.csv(path, header=False)
    return rows.select(T.strip(rows.columns[0]).alias("tag"), T.strip(rows.columns[1]).alias("target")).where("tag <> ''")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_export_csv(flat: DataFrame, path: str) -> None:
    export_rows(flat).write.mode("overwrite").csv(path, header=True)


def write_export_json(flat: DataFrame, path: str) -> None:
    flat.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str, by: str) -> None:
    """Append to a log, partitioned (audit by date, undo by op_id): old parts can be dropped without a rewrite."""
    df.write.mode("append").partitionBy(by).parquet(path)


def batches(keys: DataFrame, size: int = 50) -> DataFrame:
    """batch (from 0), keys: the distinct keys in order, ``size`` a batch, the last one shorter."""
    own = running(keys.select("key").distinct(), ["key"]).withColumn("batch", F.floor(F.col("before") / size))
    return own.groupBy("batch").agg(F.sort_array(F.collect_list("key")).alias("keys"))
