"""Queries of the training-data operators over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prosescan.llm import fingerprints, forest, lattice, logbilinear, mixing, ngramjoin, pii, tokencount, tokenfile, toxicity
from prosescan.llm.common import table
from prosescan.llm.oracles import MIXING_SQL


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(table(spark, sf_dir, "embeddings"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfile.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read_files(files)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logbilinear.score(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_ngram_join": op3_ngram_join,
    "op4_nearest": op4_nearest,
    "op5_fingerprints": op5_fingerprints,
    "op6_token_counts": op6_token_counts,
    "op7_token_files": op7_token_files,
    "op8_toxicity": op8_toxicity,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_lm_scoring": op10_lm_scoring,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op2_mixing": MIXING_SQL,
}
