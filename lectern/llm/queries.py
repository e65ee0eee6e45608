"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .chat_prefix import digests, expand
from .collocations import collocations
from .divergence import divergence
from .html_wrappers import extract
from .jaccard_join import jaccard_components
from .line_dedup import line_dedup
from .media_mpeg import audio_features, store_audio
from .mixing import mixing_rates
from .packing import pack
from .quality_gam import fit_quality, fold, score_quality
from .simhash import RADIUS, simhash, with_neighbours
from .sql import ORACLES
from .substring_dedup import substring_dedup
from .toxicity import fit_toxicity, score_toxicity


def tokenizer_path() -> str:
    """The vocabulary file that the packing query uses; pack() takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    classifier, _, _ = fit_toxicity(docs, labels, use=fold(F.col("doc_id"), 5) != 0)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return score_toxicity(docs, classifier).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(store_audio(common.table(spark, sf_dir, "documents")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    # searches take the rows whose id is divisible by 20 as queries, against all rows
    return with_neighbours(simhash(common.table(spark, sf_dir, "documents")), F.col("doc_id") % 20 == 0, RADIUS)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return jaccard_components(docs, words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, use=fold(F.col("doc_id"), 4) != 2)
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_chat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"SELECT -1L AS conv_id, posexplode(array('user', 'assistant')) AS (turn, role), '{said}' AS text").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(expand(turns.unionByName(probe)))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(common.table(spark, sf_dir, "documents"), width=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"), least_exact=1)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path(), window=2048, end_id=1)


def op11_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(common.table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mpeg_audio": op2_mpeg_audio,
    "op3_simhash": op3_simhash,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_quality_gam": op5_quality_gam,
    "op6_chat_prefix": op6_chat_prefix,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_html_wrappers": op11_html_wrappers,
    "op12_source_divergence": op12_source_divergence,
    "op13_phrase_collocations": op13_phrase_collocations,
}
