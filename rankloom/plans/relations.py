"""The engine's relations over the driver's tables, in Spark and as DuckDB common table expressions.

Benchmark items are queries and labelled documents their candidates: each document draws a few queries by the hash of
its id and the draw's number. Suppliers and customers are the two sides of a partition with keywords (nation) and
bands (balance). Conversations are groups that annotators label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import order
from rankloom.operators import splits

SEED = 0
TEST, VAL = 0.3, 0.1
#: Queries that a document draws.
DRAWS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def label(quality: Column, toxic: Column) -> Column:
    return F.when((quality == 1) & (toxic == 0), "Good Fit").when(quality == 1, "Potential Fit").otherwise("No Fit")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, doc_id, label: each labelled document with the distinct ones of DRAWS queries that it draws."""
    numbered = order.drawn(queries(spark, sf_dir).select("query_id").distinct(), SEED, "number", "query_id").select("query_id", (F.col("_r") - 1).alias("_q"))
    n = numbered.agg(F.count("*").alias("_n")).filter("_n > 0")  # one row
    labels = table(spark, sf_dir, "labels").select("doc_id", label(F.col("quality"), F.col("toxic")).alias("label")).crossJoin(F.broadcast(n))
    drawn = F.array(*(order.hash_int(8, F.col("doc_id"), j).cast("long") % F.col("_n") for j in range(DRAWS)))
    return labels.select("doc_id", "label", F.explode(F.array_distinct(drawn)).alias("_q")).join(numbered, "_q").select("query_id", "doc_id", "label")


def doc_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign(table(spark, sf_dir, "labels"), "doc_id", TEST, VAL, SEED, "doc")


def query_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign(queries(spark, sf_dir), "query_id", TEST, VAL, SEED, "query")


def split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_pairs(pairs(spark, sf_dir), doc_split(spark, sf_dir), query_split(spark, sf_dir), "doc_id", "query_id")


def test_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pairs(spark, sf_dir).filter("split = 'test'").drop("split")


def band(balance: Column) -> Column:
    return F.when(balance < 0, "0-1").when(balance < 3000, "2-3").when(balance < 6000, "4-6").otherwise("7+")


def cell_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_nationkey").alias("keyword"), band(F.col("s_acctbal")).alias("band"))


def cell_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("keyword"), band(F.col("c_acctbal")).alias("band"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, query_id, doc_id, batch, stratum of conversation turns."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("query_id"), F.col("turn").alias("doc_id")).agg(F.min("role").alias("_role"))
    return c.select(
        F.concat_ws("__", "query_id", "doc_id").alias("pair_id"), "query_id", "doc_id", (F.col("query_id") % 3 + 1).alias("batch"), F.when(F.col("query_id") % 3 == 0, "generic").otherwise("targeted").alias("stratum")
    )


ANNOTATORS, VOTED = ("ann", "bob", "cyd"), ("0", "1", "2", "3", "4", "5")


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, query_id, doc_id, batch, annotator, label: an annotator has labelled a unit if a hash says so."""
    who = F.explode(F.array(*map(F.lit, ANNOTATORS))).alias("annotator")
    each = units(spark, sf_dir).select("*", who).withColumn("_h", order.digest(F.col("annotator"), F.col("pair_id")))
    chosen = each.filter(F.substring("_h", 1, 1).isin(*VOTED))
    name = F.when(F.substring("_h", 2, 1) < "6", "Good Fit").when(F.substring("_h", 2, 1) < "b", "Potential Fit").otherwise("No Fit")
    return chosen.select("pair_id", "query_id", "doc_id", "batch", "annotator", name.alias("label"))


# --- the same for DuckDB ---------------------------------------------------

_LABEL = "CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'Good Fit' WHEN l.quality = 1 THEN 'Potential Fit' ELSE 'No Fit' END"


def _assigned(name: str, source: str, ident: str, salt: str, test: float, val: float) -> str:
    return f"""{name} AS (SELECT {ident}, CASE WHEN r <= round_even(n * {test}, 0) THEN 'test' WHEN r <= round_even(n * {test}, 0) + round_even(n * {val}, 0) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT {ident}, count(*) OVER () AS n, row_number() OVER (ORDER BY sha256('{SEED}|{salt}|' || {ident}), {ident}) AS r FROM (SELECT DISTINCT {ident} FROM {source})))"""


SQL_QUERIES = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"
_DRAWN = f"list_distinct([CAST(('0x' || substr(sha256(l.doc_id || '|' || j), 1, 8))::UBIGINT AS BIGINT) % n FOR j IN range({DRAWS})])"
SQL_PAIRS = f"""numbered AS (SELECT query_id, row_number() OVER (ORDER BY sha256('{SEED}|number|' || query_id), query_id) - 1 AS q FROM (SELECT DISTINCT item_id AS query_id FROM benchmark)),
pairs AS (SELECT query_id, doc_id, label FROM (SELECT l.doc_id, {_LABEL} AS label, unnest({_DRAWN}) AS q FROM labels l CROSS JOIN (SELECT count(*) AS n FROM numbered)) JOIN numbered USING (q))"""
SQL_SPLITS = ", ".join((_assigned("doc_split", "labels", "doc_id", "doc", TEST, VAL), SQL_QUERIES, _assigned("query_split", "queries", "query_id", "query", TEST, VAL)))
SQL_SPLIT_PAIRS = f"{SQL_PAIRS}, {SQL_SPLITS}, split_pairs AS (SELECT p.*, CASE WHEN d.split = q.split THEN d.split ELSE 'discarded' END AS split FROM pairs p LEFT JOIN doc_split d USING (doc_id) LEFT JOIN query_split q USING (query_id))"
SQL_TEST = f"{SQL_SPLIT_PAIRS}, test_pairs AS (SELECT query_id, doc_id, label FROM split_pairs WHERE split = 'test')"
_BAND = "CASE WHEN {0} < 0 THEN '0-1' WHEN {0} < 3000 THEN '2-3' WHEN {0} < 6000 THEN '4-6' ELSE '7+' END"
SQL_CELLS = f"cq AS (SELECT s_suppkey AS query_id, s_nationkey AS keyword, {_BAND.format('s_acctbal')} AS band FROM supplier), cd AS (SELECT c_custkey AS doc_id, c_nationkey AS keyword, {_BAND.format('c_acctbal')} AS band FROM customer)"
SQL_UNITS = "units AS (SELECT query_id || '__' || doc_id AS pair_id, query_id, doc_id, query_id % 3 + 1 AS batch, CASE WHEN query_id % 3 = 0 THEN 'generic' ELSE 'targeted' END AS stratum FROM (SELECT DISTINCT conv_id AS query_id, turn AS doc_id FROM conversations))"
SQL_JUDGEMENTS = f"""{SQL_UNITS}, judgements AS (SELECT pair_id, query_id, doc_id, batch, annotator, CASE WHEN substr(h, 2, 1) < '6' THEN 'Good Fit' WHEN substr(h, 2, 1) < 'b' THEN 'Potential Fit' ELSE 'No Fit' END AS label
  FROM (SELECT u.*, annotator, sha256(annotator || '|' || pair_id) AS h FROM units u CROSS JOIN (VALUES ('ann'), ('bob'), ('cyd')) AS a(annotator)) WHERE substr(h, 1, 1) IN ('0', '1', '2', '3', '4', '5'))"""
