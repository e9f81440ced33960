"""Campaigns of frozen, append-only batches, and what stands on their labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom import shared
from rankloom.operators import sampling
from rankloom.operators.guards import GuardError, check, require_known


def replay(queries: DataFrame, docs: DataFrame, batches: list[dict], pool_seed: int = 0) -> DataFrame:
    """batch, query_id, doc_id, keyword_match, stratum of all batches in order.

    A batch is {batch, n_queries, per_query, same_min, seed, keywords (optional), deeper (optional)}. Later batches
    take documents that earlier ones have not used, and queries too unless deeper is set: such a batch goes on with
    the queries of those before it. Adding a batch never changes those before it. The loop is over batches, a short
    list; queries and documents stay tables.
    """
    spark = queries.sparkSession
    out: list[DataFrame] = []
    for spec in batches:
        free_q, free_d = queries, docs
        if out:
            used = reduce(DataFrame.unionByName, out)
            free_q = free_q.join(used.select("query_id").distinct(), "query_id", "left_semi" if spec.get("deeper") else "left_anti")
            free_d = free_d.join(used.select("doc_id").distinct(), "doc_id", "left_anti")
        if spec.get("keywords"):
            wanted = spark.createDataFrame([(k,) for k in spec["keywords"]], queries.select("keyword").schema)
            require_known(wanted, queries.select("keyword").distinct(), "keyword")
            free_q = free_q.join(wanted, "keyword", "left_semi")
        chosen = shared.kept(sampling.choose_queries(free_q, spec["n_queries"], spec["seed"]).select("query_id", "keyword"), "chosen")
        picks = sampling.quota_candidates(chosen, free_d, spec["per_query"], spec["same_min"], spec["seed"] + pool_seed)
        stratum = "targeted" if spec.get("keywords") else "generic"
        picks = picks.select(F.lit(spec["batch"]).alias("batch"), "query_id", "doc_id", "keyword_match", F.lit(stratum).alias("stratum"))
        out.append(shared.kept(picks, "batch"))  # every later batch reads it
    return reduce(DataFrame.unionByName, out)


def holdout(picks: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """kind, id of all that a campaign keeps out of training: its queries and the whole pools they were drawn from (every document of their keywords), not the pairs alone."""
    chosen = queries.join(picks.select("query_id").distinct(), "query_id", "left_semi")
    pool = docs.join(chosen.select("keyword").distinct(), "keyword", "left_semi").select("doc_id").unionByName(picks.select("doc_id")).distinct()
    return chosen.select(F.lit("query").alias("kind"), F.col("query_id").alias("id")).unionByName(pool.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id")))


#: What one batch may ask for at most.
MOST_PAIRS, MOST_PER_QUERY = 200, 20


def add_batch(batches: list[dict], spec: dict, keywords: set | None = None) -> list[dict]:
    """The specs with one more at their end; existing ones stay as they are. All keywords chosen is the same as none: a generic batch."""
    if spec["n_queries"] * spec["per_query"] > MOST_PAIRS or spec["per_query"] > MOST_PER_QUERY:
        raise GuardError(f"a batch has at most {MOST_PAIRS} pairs and {MOST_PER_QUERY} for each query")
    if any(b["batch"] == spec["batch"] for b in batches):
        raise GuardError(f"batch {spec['batch']} is there already, and batches are frozen")
    if keywords is not None and set(spec.get("keywords") or ()) == keywords:
        spec = {k: v for k, v in spec.items() if k != "keywords"}
    return [*batches, spec]


def labels_survive(pairs: DataFrame, judgements: DataFrame) -> DataFrame:
    """Every label still has its pair after a rebuild."""
    return check("campaign: labels survive", judgements.select("pair_id").distinct().join(pairs.select("pair_id"), "pair_id", "left_anti"))


def overlay(pools: DataFrame, judgements: DataFrame) -> DataFrame:
    """pools with relevance from judgements where there is one; label_source says which."""
    own = judgements.select("query_id", "doc_id", F.col("relevance").alias("_new"))
    joined = pools.join(own, ["query_id", "doc_id"], "left")
    return joined.withColumn("label_source", F.when(F.col("_new").isNotNull(), "judgement").otherwise(F.col("source"))).withColumn("relevance", F.coalesce("_new", "relevance")).drop("_new")


def union_pool(scores: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, surfaced_by, best_rank: what any model has in its first k. scores: model, query_id, doc_id, score."""
    ranked = scores.withColumn("rn", F.row_number().over(W.partitionBy("model", "query_id").orderBy(F.col("score").desc_nulls_last(), "doc_id"))).filter(F.col("rn") <= k)
    return ranked.groupBy("query_id", "doc_id").agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("surfaced_by"), F.min("rn").alias("best_rank"))


def mean_ranks(values: DataFrame, column: str) -> DataFrame:
    """column's distinct values with their mean 1-based rank over all rows.

    Distinct values are counted, written in ranges, numbered within each range, and the totals of the ranges before
    are added; those totals are one row for each range.
    """
    counted = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    ranges = counted.repartitionByRange(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("v").asc_nulls_first()).withColumn("p", F.spark_partition_id())
    ranges = shared.kept(ranges, "ranges")
    totals = ranges.groupBy("p").agg(F.sum("c").alias("t"))
    before = totals.select("p", (F.sum("t").over(W.partitionBy(F.lit(0)).orderBy("p").rowsBetween(W.unboundedPreceding, 0)) - F.col("t")).alias("before"))
    inside = F.sum("c").over(W.partitionBy("p").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    return ranges.withColumn("upto", inside).join(F.broadcast(before), "p").select("v", (F.col("before") + F.col("upto") - (F.col("c") - 1) / 2).alias("rank"))


def rank_correlation(values: DataFrame) -> DataFrame:
    """n, rho: Spearman correlation of columns a and b, ties at their mean rank."""
    one, two = (mean_ranks(values, c).select(F.col("v").alias(f"_{c}"), F.col("rank").alias(f"r{c}")) for c in ("a", "b"))
    ranked = values.join(one, F.col("a").eqNullSafe(F.col("_a"))).join(two, F.col("b").eqNullSafe(F.col("_b")))
    return ranked.agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("rho"))


def floor_verdicts(reports: DataFrame, floor: DataFrame) -> DataFrame:
    """reports (model, accuracy, macro_f1) with whether each beats the floor's."""
    f = F.broadcast(floor.select(F.col("accuracy").alias("_a"), F.col("macro_f1").alias("_f")))  # one row
    return reports.crossJoin(f).select("model", "accuracy", "macro_f1", (F.col("accuracy") > F.col("_a")).alias("beats_accuracy"), (F.col("macro_f1") > F.col("_f")).alias("beats_macro_f1"))
