"""The corpus pipeline over documents: classify, deduplicate, decontaminate, mask secrets, pack.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes each stage's rows to the shared folder as Parquet and reads them
back as the next one's docs, so that a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import common, decontamination, packing, quality, secrets, simhash

#: No SQL: every stage but none of its parts is a model, a search or an assignment. Tested against brute force.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the rated ones among docs, keeps."""
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return docs.filter(quality.kept(model, docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints within three bits, as in op10; the README says which near copies that leaves."""
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in text and n_chars brought up to date."""
    masked = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality classifier", classify), ("SimHash near-dedup", deduplicate), ("benchmark decontamination", decontaminate), ("secret scans", mask_secrets), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        kept, path = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            common.delete(spark, before)
        docs, before = kept, path
    return docs
