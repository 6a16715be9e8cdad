"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, linededup, media, mixing, ngramjoin, packing, rollup, toxicity, warc, winnowing
from .common import table


def tokenizer() -> str:
    """The vocabulary file of production runs; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(spark, table(spark, sf_dir, "pages"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_join(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    model = toxicity.train(*toxicity.training_rows(docs.where(fold != 1), table(spark, sf_dir, "labels")))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", (fold == 1).alias("held_out"), "score", "predicted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("n_lines").cast("long"), F.col("removed_lines").cast("long"), F.sha2("text", 256).alias("text_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.count_corpus(spark, sf_dir)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_corpus(table(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_packing, op2_warc, op3_ngram_join, op4_media, op5_toxicity, op6_line_dedup, op7_token_counts, op8_lm_scoring, op9_winnowing, op10_mixing)
    return {f.__name__: f for f in found}
