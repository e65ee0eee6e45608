"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``, whatever further columns there are.

Defined cases, for every stage: a null text counts as empty where it is scored or counted, and stays null where it is
kept; an empty document goes only if the classifier rejects it (all of its features are zero); equal rows are judged
alike, and the Jaccard stage leaves one of them; a null doc_id is an id like others; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm.jaccard_join import one_of_each
from lectern.llm.line_dedup import kept_texts
from lectern.llm.mixing import mix
from lectern.llm.packing import pack
from lectern.llm.quality_gam import fit_quality, keep_good
from lectern.llm.queries import tokenizer_path

#: A document goes when its score says low quality is likelier.
QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = common.table(spark, sf_dir, "labels")
    return keep_good(docs, fit_quality(docs, labels, use=F.lit(True)), QUALITY)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier in the corpus; a document that loses all its text goes."""
    left = kept_texts(docs, least_exact=1).where(~((F.col("n_removed") > 0) & (F.trim("text") == "")))
    changed = {"text": F.col("text"), "n_chars": F.length("text")}
    return left.select(*(changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(f"own.`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group whose 5-word shingles are linked by a Jaccard of 0.8 or more."""
    return one_of_each(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that expected tokens of each language match the target shares; none is dropped."""
    return mix(docs, common.table(spark, sf_dir, "labels"), least=1.0, grow=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences."""
    return pack(docs, tokenizer_path(), window=2048, end_id=1)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: The classifiers' scores and token ids are beyond SQL; tests/llm/test_registered.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cut = common.table(spark, sf_dir, "documents"), common.Cuts(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut.last(docs, f"stage-{k}-{name.replace(' ', '-')}")
    return docs
