"""Leak-free splits: documents are assigned, pairs follow if both sides agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import order


def conflicts(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs given more than once: rows, distinct labels in order, and how they are resolved."""
    found = pairs.groupBy(left, right).agg(F.count("*").alias("rows"), F.concat_ws(" | ", F.array_sort(F.collect_set("label"))).alias("labels"))
    return found.filter("rows > 1").withColumn("resolution", F.when(F.col("labels").contains(" | "), "dropped: labels conflict").otherwise("kept one"))


def resolve(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One row for each pair; pairs with conflicting labels go."""
    one = pairs.groupBy(left, right).agg(F.min("label").alias("label"), F.max("label").alias("_other"))
    return one.filter(F.col("label") == F.col("_other")).drop("_other")


def assign(ids: DataFrame, ident: str, test: float, val: float, seed: int, salt: str) -> DataFrame:
    """ident, split: the first round(test * n) of the shuffle are test, the next val, the rest train."""
    ranked = order.drawn(ids.select(ident).distinct(), seed, salt, ident, "_r", "_n")
    n_test, n_val = F.bround(F.col("_n") * F.lit(test)), F.bround(F.col("_n") * F.lit(val))
    split = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val").otherwise("train")
    return ranked.select(ident, split.alias("split"))


def split_pairs(pairs: DataFrame, lefts: DataFrame, rights: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with split: the common split of both sides, else discarded."""
    a, b = lefts.withColumnRenamed("split", "_a"), rights.withColumnRenamed("split", "_b")
    both = pairs.join(a, left, "left").join(b, right, "left")
    return both.withColumn("split", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("discarded")).drop("_a", "_b")


def summary(pairs: DataFrame, left: str, right: str, positive: str = "Good Fit") -> DataFrame:
    """Per split: pairs, documents, queries, queries with a positive, positives and their whole median over those queries."""
    by_query = pairs.groupBy("split", right).agg(F.count("*").alias("n"), F.count_if(F.col("label") == positive).alias("p"))
    queries = by_query.groupBy("split").agg(
        F.sum("n").alias("pairs"), F.count("*").alias("queries"), F.count_if(F.col("p") > 0).alias("queries_with_positive"), F.sum("p").alias("positives"),
        F.floor(F.median(F.when(F.col("p") > 0, F.col("p")))).cast("long").alias("median_positives"),
    )
    return queries.join(pairs.groupBy("split").agg(F.count_distinct(left).alias("documents")), "split")


def folds(pairs: DataFrame, left: str, right: str, k: int, seed: int) -> DataFrame:
    """fold, fit, eval: pairs usable on each side if both buckets must agree."""

    def buckets(column: str) -> DataFrame:
        ids = pairs.select(column).distinct()
        return order.drawn(ids, seed, f"fold-{column}", column).select(column, ((F.col("_r") - 1) % k).alias(f"_{column}"))

    dealt = pairs.join(buckets(left), left).join(buckets(right), right)
    each = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"), F.col(f"_{left}").alias("a"), F.col(f"_{right}").alias("b"))
    inside, outside = (F.col("a") == F.col("fold")) & (F.col("b") == F.col("fold")), (F.col("a") != F.col("fold")) & (F.col("b") != F.col("fold"))
    return each.groupBy("fold").agg(F.count_if(outside).alias("fit"), F.count_if(inside).alias("eval"), F.count_if(~inside & ~outside).alias("unused"))


def survey(pairs: DataFrame, left: str, right: str, fractions: list[float], seeds: list[int]) -> DataFrame:
    """fraction, mean, least and most test pairs over seeds: one plan over the grid of fractions and seeds."""
    spark = pairs.sparkSession
    drawings, shares = spark.createDataFrame([(s,) for s in seeds], "seed int"), spark.createDataFrame([(f,) for f in fractions], "fraction double")  # a handful of rows
    grid = shares.crossJoin(drawings)

    def side(column: str) -> DataFrame:
        ids = pairs.select(column).distinct().crossJoin(F.broadcast(drawings))
        ranked = order.drawn(ids, F.col("seed"), f"survey-{column}", column, "_r", "_n", ["seed"]).crossJoin(F.broadcast(shares))
        return ranked.filter(F.col("_r") <= F.bround(F.col("_n") * F.col("fraction"))).select("fraction", "seed", column)

    found = pairs.join(side(left), left).join(side(right), [right, "fraction", "seed"]).groupBy("fraction", "seed").agg(F.count("*").alias("n"))
    every = grid.join(found, ["fraction", "seed"], "left").fillna(0, ["n"])
    return every.groupBy("fraction").agg(F.round(F.avg("n"), 6).alias("mean_pairs"), F.min("n").alias("min_pairs"), F.max("n").alias("max_pairs"))


def side_survey(pairs: DataFrame, left: str, right: str, fraction: float, seeds: list[int]) -> DataFrame:
    """seed, both, left_only, right_only, neither: how the pairs fall if each side's first fraction is held out."""
    spark = pairs.sparkSession
    drawings = spark.createDataFrame([(s,) for s in seeds], "seed int")  # a handful of rows

    def side(column: str) -> DataFrame:
        ids = pairs.select(column).distinct().crossJoin(F.broadcast(drawings))
        ranked = order.drawn(ids, F.col("seed"), f"survey-{column}", column, "_r", "_n", ["seed"])
        return ranked.select("seed", column, (F.col("_r") <= F.bround(F.col("_n") * F.lit(fraction))).alias(f"_{column}"))

    a, b = F.col(f"_{left}"), F.col(f"_{right}")
    return pairs.join(side(left), left).join(side(right), [right, "seed"]).groupBy("seed").agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"), F.count_if(~a & ~b).alias("neither")
    )


def regions(ids: DataFrame, ident: str, fraction: float, seed: int, salt: str) -> DataFrame:
    """ident, region: the first round(fraction * n) of a side's own shuffle are eval, the rest train."""
    out = assign(ids, ident, fraction, 0.0, seed, salt)
    return out.select(ident, F.when(F.col("split") == "test", "eval").otherwise("train").alias("region"))


def shortlist(queries: DataFrame, documents: DataFrame, cells: list[str], per_query: int, per_doc: int, seed: int) -> DataFrame:
    """Pairs of the first few queries and documents of each cell's shuffle; cells without one side give none.

    queries: query_id and cells; documents: doc_id and cells. Both sides are cut before they are joined.
    """
    a = queries.withColumn("_r", order.draw_rank(seed, "short-query", F.col("query_id"), cells)).filter(F.col("_r") <= per_query).drop("_r")
    b = documents.withColumn("_r", order.draw_rank(seed, "short-doc", F.col("doc_id"), cells)).filter(F.col("_r") <= per_doc).drop("_r")
    return a.join(b, cells).select(F.concat_ws("__", "query_id", "doc_id").alias("pair_id"), "query_id", "doc_id", *cells)


def nested_sample(df: DataFrame, ident: str, n: int, seed: int, salt: str, by: list | None = None) -> DataFrame:
    """The first n of each group's shuffle: a larger n keeps every row of a smaller one."""
    if not by:
        return df.orderBy(order.digest(seed, salt, F.col(ident)), ident).limit(n)
    return df.withColumn("_r", order.draw_rank(seed, salt, F.col(ident), by)).filter(F.col("_r") <= n).drop("_r")


def quota_sample(df: DataFrame, ident: str, group: str, quotas: dict[str, int], seed: int) -> DataFrame:
    """Each group's first rows up to its quota."""
    quota: Column = F.lit(0)
    for k, n in quotas.items():
        quota = F.when(F.col(group) == k, n).otherwise(quota)
    return df.withColumn("_r", order.draw_rank(seed, "quota", F.col(ident), [group])).filter(F.col("_r") <= quota).drop("_r")


def even_quota(df: DataFrame, ident: str, band: str, n: int, seed: int) -> DataFrame:
    """ceil(n / bands) of each band, then the n smallest ids of them."""
    bands = df.select(F.count_distinct(band).alias("_b"))  # one row
    picked = df.crossJoin(F.broadcast(bands)).withColumn("_r", order.draw_rank(seed, "even", F.col(ident), [band]))
    return picked.filter(F.col("_r") <= F.ceil(F.lit(n) / F.col("_b"))).drop("_r", "_b").orderBy(ident).limit(n)
