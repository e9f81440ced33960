"""Scans with stated schemas; a missing source is an error that says what to do, or an empty table where that is the meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def shards(spark: SparkSession, path: str, split: str, schema: str | StructType | None = None) -> DataFrame:
    """All Parquet shards of one split, by file name."""
    reader = spark.read.option("pathGlobFilter", f"*{split}*.parquet")
    return (reader.schema(schema) if schema else reader).parquet(path)


def partition(spark: SparkSession, path: str, column: str, value: str) -> DataFrame:
    """One value of a partition column: only its folder is listed and read."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"{path} is not there; build it first")
    return spark.read.parquet(path).filter(F.col(column) == value)


def json_lines(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True) -> DataFrame:
    """JSON lines; strict: a bad line is an error and a missing file is empty; else bad lines are skipped."""
    if strict and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def tolerant_spans(spark: SparkSession, path: str) -> DataFrame:
    """content and annotation, where a label may be a string or a list and lines may be blank or broken."""
    raw = "content string, annotation array<struct<label: string, points: array<struct<start: int, end: int, text: string>>>>"
    rows = spark.read.schema(raw).option("mode", "DROPMALFORMED").json(path).filter("content is not null")
    labels = lambda x: F.coalesce(F.from_json(x["label"], "array<string>"), F.array(x["label"]))
    return rows.withColumn("annotation", F.transform("annotation", lambda x: F.struct(labels(x).alias("labels"), x["points"].alias("points"))))


def documents_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Whole-file JSON with an object or a list at its root."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only CSV log of strings; empty before its first write."""
    return csv(spark, path, schema).fillna("") if _exists(spark, path) else spark.createDataFrame([], schema)


def files(spark: SparkSession, path: str, glob: str = "*", with_content: bool = False) -> DataFrame:
    """path, bytes, category (the folder's name) of files below a folder; digest too if content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    cols = ["path", F.col("length").alias("bytes"), F.element_at(F.split("path", "/"), -2).alias("category")]
    return found.select(*cols, *([F.sha2("content", 256).alias("sha256")] if with_content else []))


def count_rows(spark: SparkSession, path: str, kind: str) -> int | None:
    """Rows by format; Parquet from its footers; none for other kinds."""
    if kind == "parquet":
        return spark.read.option("recursiveFileLookup", True).parquet(path).count()
    if kind == "csv":
        return spark.read.csv(path, header=True, multiLine=True, escape='"').count()
    if kind == "jsonl":
        return spark.read.text(path).filter("trim(value) <> ''").count()
    return None


def artifact_groups(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """source, ok, problem: observed (source, n_files, n_rows) against expected (source, min_files, rows)."""
    both = expected.join(observed, "source", "left")
    problem = F.when(F.col("n_files").isNull() | (F.col("n_files") < F.col("min_files")), "files missing").when(F.col("rows").isNotNull() & ~F.col("rows").eqNullSafe(F.col("n_rows")), "rows differ")
    return both.select("source", problem.isNull().alias("ok"), problem.alias("problem"))


def with_texts(units: DataFrame, *texts: DataFrame) -> DataFrame:
    """Units of several legs with one text lookup: legs may lack columns."""
    every = texts[0]
    for more in texts[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    one = every.groupBy("doc_id").agg(F.min("text").alias("text"))  # of several texts of an id the first in order
    return units.join(one, "doc_id", "left")


def campaign(spark: SparkSession, path: str, default: list[dict]) -> list[dict]:
    """Batch specs of a campaign, from JSON lines in order of batch; the default where there is no file."""
    import json

    if not _exists(spark, path):
        return list(default)
    return sorted((json.loads(r["value"]) for r in spark.read.text(path).filter("trim(value) <> ''").collect()), key=lambda b: b["batch"])  # a short list


def in_language(documents: DataFrame, language: str = "en", regions: DataFrame | None = None, region: str = "eval") -> DataFrame:
    """Documents of one language with a text that is not blank; of one region if regions (doc_id, region) are given."""
    kept = documents.filter((F.col("lang") == language) & F.col("text").isNotNull() & (F.trim("text") != ""))
    return kept if regions is None else kept.join(regions.filter(F.col("region") == region).select("doc_id"), "doc_id", "left_semi")
