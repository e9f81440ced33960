"""Nested retrieval pools of judged candidates and unjudged distractors, and what they allow at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions import order
from rankloom.operators import evaluation
from rankloom.operators.guards import GuardError, require_none

#: Pool variants and the depth each aims at; none: all.
TARGETS = {"N20": 20, "N100": 100, "Nfull": None}
RELEVANCE = {"Good Fit": "good", "Potential Fit": "potential", "No Fit": "none"}


def relevance(label):
    return F.when(label == "Good Fit", "good").when(label == "Potential Fit", "potential").otherwise("none")


def build(judged: DataFrame, universe: DataFrame, seed: int, targets: dict[str, int | None] = TARGETS) -> DataFrame:
    """query_id, doc_id, relevance, source, pool_variant.

    judged: query_id, doc_id, label; universe: doc_id. Judged candidates are in every variant, whatever its target;
    distractors are a prefix of one shuffle for each query, so that smaller pools are subsets of larger ones. The
    universe of queries times documents is what the full variant asks for, so it is a cross join by definition; without
    that variant each query's places are cut to the deepest target as they are drawn.
    """
    queries = judged.groupBy("query_id").agg(F.count("*").alias("_judged"))
    # Judged pairs grow with the documents: merged, as their files' size tells little of what a broadcast would take.
    candidates = universe.select("doc_id").crossJoin(F.broadcast(queries)).join(judged.select("query_id", "doc_id").hint("merge"), ["query_id", "doc_id"], "left_anti")
    spark = judged.sparkSession
    bounded, full = {k: n for k, n in targets.items() if n is not None}, [(k,) for k, n in targets.items() if n is None]
    columns = ("query_id", "doc_id", F.lit("none").alias("relevance"), F.lit("distractor").alias("source"), "pool_variant")
    own = judged.select("query_id", "doc_id", relevance(F.col("label")).alias("relevance"), F.lit("labelled").alias("source"))
    out = own.crossJoin(spark.createDataFrame([(k,) for k in targets], "pool_variant string"))  # a handful of variants
    if bounded:
        # The limit on places is applied before the shuffle too, so each query sends as many rows as the deepest bounded pool.
        place = F.row_number().over(W.partitionBy("query_id").orderBy(order.digest(seed, F.col("query_id"), F.col("doc_id")), "doc_id"))
        ranked = candidates.withColumn("_r", place).filter(F.col("_r") <= max(bounded.values()))
        aims = spark.createDataFrame(list(bounded.items()), "pool_variant string, _target int")
        out = out.unionByName(ranked.crossJoin(aims).filter(F.col("_r") <= F.col("_target") - F.col("_judged")).select(*columns))
    if full:
        out = out.unionByName(candidates.crossJoin(spark.createDataFrame(full, "pool_variant string")).select(*columns))
    return out


def with_texts(pools: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Pools with both texts; raises if a text is missing."""
    out = pools.join(queries.withColumnRenamed("text", "query_text"), "query_id", "left").join(documents.withColumnRenamed("text", "doc_text"), "doc_id", "left")
    require_none(out.filter("query_text is null or doc_text is null").select("query_id", "doc_id"), "no document text")
    return out


def summary(pools: DataFrame) -> DataFrame:
    """Per variant: queries, rows, least and most depth, whole median depth, labelled and distractor rows."""
    depth = pools.groupBy("pool_variant", "query_id").agg(F.count("*").alias("depth"), F.count_if(F.col("source") == "labelled").alias("labelled"))
    return depth.groupBy("pool_variant").agg(
        F.count("*").alias("queries"), F.sum("depth").alias("n_rows"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"),
        F.floor(F.median("depth")).cast("long").alias("median_depth"), F.sum("labelled").alias("labelled"), F.sum(F.col("depth") - F.col("labelled")).alias("distractors"),
    )


def relevant_counts(pools: DataFrame) -> DataFrame:
    """pool_variant, query_id, definition, r: relevant candidates by both definitions, queries without any left out."""
    counts = pools.groupBy("pool_variant", "query_id").agg(
        F.count("*").alias("depth"), F.count_if(F.col("relevance") == "good").alias("strict"), F.count_if(F.col("relevance") != "none").alias("graded")
    )
    return counts.unpivot(["pool_variant", "query_id", "depth"], ["strict", "graded"], "definition", "r").filter("r > 0")


def attainability(pools: DataFrame, ks: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """Per variant, definition and k: how much recall the best ranking can reach."""
    each = relevant_counts(pools).select("*", F.explode(F.array(*map(F.lit, ks))).alias("k")).withColumn("cap", F.least("k", "r") / F.col("r"))
    return each.groupBy("pool_variant", "definition", "k").agg(
        F.count("*").alias("n"), F.round(F.median("cap"), 6).alias("median_cap"), F.round(F.avg((F.col("cap") >= 0.9).cast("double")), 6).alias("share_90"),
        F.round(F.avg((F.col("cap") == 1).cast("double")), 6).alias("share_full"),
    )


def ceiling_interval(pools: DataFrame, metric: str, k: int, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """pool_variant, definition, mean, n, ci_low, ci_high of the best precision or recall that any ranking can reach. nDCG has no ceiling below 1 and is refused."""
    if metric not in ("precision", "recall"):
        raise GuardError(f"no ceiling for {metric}: an ideal from the same pool is 1 by definition" if metric == "ndcg" else f"unknown metric {metric}")
    evaluation.require_depth(pools, k)
    won = F.least(F.lit(k), F.col("r")) / (F.lit(k) if metric == "precision" else F.col("r"))
    each = relevant_counts(pools).select("pool_variant", "definition", F.col("query_id").alias("unit"), won.alias("value"))
    return evaluation.bootstrap(each, ("pool_variant", "definition"), draws, seed)


def ceilings(pools: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Per variant, definition and k: best mean precision and recall, queries able to reach precision 1, slots that cannot be won."""
    each = relevant_counts(pools).select("*", F.explode(F.array(*map(F.lit, ks))).alias("k")).withColumn("won", F.least("k", "r"))
    return each.groupBy("pool_variant", "definition", "k").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("won") / F.col("k")), 6).alias("precision_ceiling"), F.round(F.avg(F.col("won") / F.col("r")), 6).alias("recall_ceiling"),
        F.count_if(F.col("r") >= F.col("k")).alias("can_be_full"), F.sum(F.col("k") - F.col("won")).alias("unwinnable"), F.sum("k").cast("long").alias("slots"),
    )
