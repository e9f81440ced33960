"""The thin queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import common, decontamination, html_blocks, packing, quality, records, secrets, simhash, substrings, token_counts, weak_rules


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "records")
    records.write_records(common.table(spark, sf_dir, "documents"), path, tokenizer_path())
    return records.read_records(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(common.table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "turn", "bins", "bound")


def op4_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(common.table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(common.table(spark, sf_dir, "documents"), tokenizer_path())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(common.table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicate(common.table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.train(pages))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_packing": op2_packing,
        "op3_records": op3_records,
        "op4_weak_rules": op4_weak_rules,
        "op5_token_counts": op5_token_counts,
        "op6_decontamination": op6_decontamination,
        "op7_secrets": op7_secrets,
        "op8_substrings": op8_substrings,
        "op9_html_blocks": op9_html_blocks,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_weak_rules": weak_rules.oracle_sql(), "op8_substrings": substrings.oracle_sql()}
