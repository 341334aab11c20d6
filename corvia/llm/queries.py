"""The training-data operators over their whole tables, with production parameters, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvia.llm import bpe, dialogue, html, language, license, middle, mixing, packing, quality, secrets, sharding, simhash, vafile
from corvia.llm.common import read


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(read(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(read(spark, sf_dir, "documents"))


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(read(spark, sf_dir, "documents"))


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.fingerprint_classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(found["fp"]).alias("fingerprint"), "component_id")


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.query(read(spark, sf_dir, "documents"))


def op6_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.query(read(spark, sf_dir, "embeddings"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.query(read(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), packing.tokenizer_file())


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.query(read(spark, sf_dir, "pages"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.query(read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.query(read(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.query(read(spark, sf_dir, "documents"))


_ALL = (op1_robust_outliers, op2_mix_sources, op3_minimax_shards, op4_simhash_near_duplicates, op5_language_crf, op6_va_file_top_k, op7_license_scan, op8_secret_scan, op9_best_fit_packing, op10_main_text, op11_byte_bpe, op12_conversation_repair, op13_fill_in_middle)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES = {"op2_mix_sources": mixing.ORACLE, "op6_va_file_top_k": vafile.ORACLE, "op7_license_scan": license.oracle(), "op13_fill_in_middle": middle.ORACLE}
