"""Ranking metrics over pools: model, metric, definition and variant are columns of one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom import shared
from rankloom.functions import order, text
from rankloom.operators.guards import GuardError

CLASSES = ("judged_relevant_strict", "judged_relevant_graded", "judged_none", "unjudged_distractor")


def rank(pools: DataFrame, scores: DataFrame, by: tuple[str, ...] = ("pool_variant", "query_id")) -> DataFrame:
    """pools with score and rn: score falling, missing or undefined scores last, then doc_id."""
    known = [c for c in by if c in scores.columns and c != "query_id"]
    joined = pools.join(scores, ["query_id", "doc_id", *[c for c in known if c in pools.columns]], "left")
    clean = joined.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    return clean.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(F.col("score").desc_nulls_last(), "doc_id")))


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.filter(F.col("rn") <= k)


def require_depth(pools: DataFrame, k: int) -> None:
    """k must not exceed the shallowest pool."""
    least = pools.groupBy("pool_variant", "query_id").count().agg(F.min("count")).first()[0]
    if least is not None and k > least:
        raise GuardError(f"k={k} is deeper than the shallowest pool ({least})")


def query_metrics(ranked: DataFrame, by: tuple[str, ...] = ("pool_variant", "query_id"), recall_k: int = 10, precision_k: int = 5, ndcg_k: int = 10, places: int | None = None) -> DataFrame:
    """by, definition, recall, precision, ndcg of every query that has a relevant candidate; rounded only if asked for, never before a mean.

    nDCG has graded gains (2, 1, 0) under either definition, which then only says which queries count.
    """
    good, potential = F.col("relevance") == "good", F.col("relevance") == "potential"
    each = ranked.select(*by, "doc_id", "rn", F.when(good, 2).when(potential, 1).otherwise(0).alias("gain"))
    each = each.withColumn("ideal", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("gain"), "doc_id")))
    each = each.select("*", F.explode(F.array(F.lit("strict"), F.lit("graded"))).alias("definition"))
    each = each.withColumn("rel", F.when(F.col("definition") == "strict", F.col("gain") == 2).otherwise(F.col("gain") > 0).cast("int"))
    found = each.groupBy(*by, "definition").agg(
        F.sum("rel").alias("_r"),
        F.sum(F.col("rel") * (F.col("rn") <= recall_k).cast("int")).alias("_hit"),
        F.sum(F.col("rel") * (F.col("rn") <= precision_k).cast("int")).alias("_top"),
        F.sum(F.when(F.col("rn") <= ndcg_k, F.col("gain") / F.log2(F.col("rn") + 1)).otherwise(0.0)).alias("_dcg"),
        F.sum(F.when(F.col("ideal") <= ndcg_k, F.col("gain") / F.log2(F.col("ideal") + 1)).otherwise(0.0)).alias("_best"),
    )
    values = {"recall": F.col("_hit") / F.col("_r"), "precision": F.col("_top") / precision_k, "ndcg": F.col("_dcg") / F.col("_best")}
    return found.filter("_r > 0").select(*by, "definition", *((v if places is None else F.round(v, places)).alias(k) for k, v in values.items()))


def grid(metrics: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Means over queries with their number, one row for each metric."""
    long = metrics.unpivot([*by, "query_id", "definition"], ["recall", "precision", "ndcg"], "metric", "value")
    return long.groupBy(*by, "definition", "metric").agg(F.round(F.avg("value"), 5).alias("value"), F.count("*").alias("n_queries"))


#: Draws that one row of a resampling makes.
_DRAWS_EACH = 50
#: Places of a draw that one row of a counted resampling makes, and hashes that one of its tasks takes at most, but for one row.
_PLACES_EACH, _HASHES_EACH = 1 << 14, 1 << 22


def resampled(values: DataFrame, by: list[str], unit: str, value: str, draws: int, seed: int) -> DataFrame:
    """by, _d, _v (a draw's resampled values): draw d of place i takes the value whose number, in order of unit, is a hash of both.

    A group's values travel as one array, one for each query or judged pair, and groups times draws are dealt over all tasks.
    """
    rows = values.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(value).alias("v")))).alias("_a"))
    parts = rows.select(*by, F.transform("_a", lambda x: x["v"]).alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(_DRAWS_EACH))).alias("_from"))
    parts = parts.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_from")
    each = parts.select(*by, "_a", F.explode(F.sequence("_from", F.least(F.col("_from") + _DRAWS_EACH, F.lit(draws)) - 1)).alias("_d"))
    number = lambda i: (F.conv(F.substring(order.digest(seed, F.col("_d"), i), 1, 8), 16, 10).cast("long") % F.size("_a")).cast("int")
    drawn = F.transform(F.sequence(F.lit(0), F.size("_a") - 1), lambda i: F.get("_a", number(i)))
    return each.select(*by, "_d", text.once(drawn).alias("_v"))


def _ordered_codes(values: DataFrame, by: list[str], unit: str, code: str) -> DataFrame:
    """One row: _g, the groups (by, _k, _n, and _at, the place where they begin) and _v, all their codes as bytes, in order of unit within a group; _most, the size of the largest.

    Rows are dealt by range of group and unit, so that no task orders a whole group; only the bytes meet.
    """
    known = values.filter(F.col(code).isNotNull()).select(F.struct(F.lit(0).alias("_0"), *by).alias("_by"), F.col(unit).alias("u"), F.col(code).cast("tinyint").alias("v"))
    dealt = known.repartitionByRange(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_by", "u").withColumn("_p", F.spark_partition_id())
    chunks = dealt.groupBy("_by", "_p").agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("_a")).select("_by", "_p", F.transform("_a", lambda x: x["v"]).alias("_a"))
    each = chunks.groupBy("_by").agg(F.array_sort(F.collect_list(F.struct("_p", "_a"))).alias("_a")).select("_by", F.flatten(F.transform("_a", lambda x: x["_a"])).alias("_a"))
    one = each.select("_by", F.size("_a").cast("long").alias("_n"), "_a").agg(F.collect_list(F.struct("_by", "_n", "_a")).alias("_all"), F.max("_n").alias("_most"))
    sizes = F.transform("_all", lambda x: x["_n"])
    before = lambda k: F.aggregate(F.slice(sizes, 1, k), F.lit(0).cast("long"), lambda s, n: s + n)
    groups = F.transform("_all", lambda x, k: F.struct(x["_by"].alias("_by"), k.alias("_k"), x["_n"].alias("_n"), before(k).alias("_at")))
    return one.select(groups.alias("_g"), F.flatten(F.transform("_all", lambda x: x["_a"])).alias("_v"), "_most")


def resampled_counts(values: DataFrame, by: list[str], unit: str, code: str, codes: int, draws: int, seed: int) -> DataFrame:
    """by, _d, n, c: how often each code from 0 stands in draw d, the draws being those of ``resampled``.

    The hash of draw and place does not depend on the group, so it is taken once for all of them; no draw is ever held
    as an array, as each of its places is counted where it is drawn. Draws and places are dealt over tasks of like size.
    """
    groups = shared.kept(_ordered_codes(values, by, unit, code), "codes")
    most = groups.select("_most").first()[0] or 0
    blocks = max(1, -(-most // _PLACES_EACH))
    tasks = max(-(-draws // _DRAWS_EACH), -(-draws * most // _HASHES_EACH))
    parts = values.sparkSession.range(0, draws * blocks if most else 0, 1, tasks).select(F.floor(F.col("id") / blocks).alias("_d"), (F.col("id") % blocks * _PLACES_EACH).alias("_from"))
    places = parts.crossJoin(F.broadcast(groups)).select("_g", "_v", "_d", F.explode(F.sequence("_from", F.least(F.col("_from") + _PLACES_EACH, "_most") - 1)).alias("_i"))
    hashed = places.select("_g", "_v", "_d", "_i", F.conv(F.substring(order.digest(seed, F.col("_d"), F.col("_i")), 1, 8), 16, 10).cast("long").alias("_h"))
    taken = hashed.select("_v", "_d", "_i", "_h", F.explode("_g").alias("_g")).filter(F.col("_i") < F.col("_g._n"))
    one = taken.select("_d", F.col("_g._k").alias("_k"), F.get("_v", (F.col("_g._at") + F.col("_h") % F.col("_g._n")).cast("int")).alias("_c"))
    cells = one.groupBy("_d", "_k", "_c").agg(F.count("*").alias("_m"))
    counted = cells.groupBy("_d", "_k").agg(F.array(*(F.sum(F.when(F.col("_c") == c, F.col("_m")).otherwise(0)) for c in range(codes))).alias("c"))
    named = groups.select(F.explode("_g").alias("_g")).select("_g._k", *(F.col("_g._by")[c].alias(c) for c in by), F.col("_g._n").alias("n"))
    return counted.join(F.broadcast(named), "_k").select(*by, "_d", "n", "c")


def interval(drawn: DataFrame, by: list[str], value: str, places: int) -> DataFrame:
    """by, ci_low, ci_high: the middle 95 % of a value over draws."""
    low, high = (F.round(F.percentile(value, F.lit(p)), places) for p in (0.025, 0.975))
    return drawn.groupBy(*by).agg(low.alias("ci_low"), high.alias("ci_high"))


def bootstrap(values: DataFrame, by: tuple[str, ...], draws: int = 10_000, seed: int = 0, places: int = 5) -> DataFrame:
    """by, mean, n, ci_low, ci_high: percentile interval of the mean over resampled rows. values: by, unit, value."""
    by = list(by)
    means = resampled(values, by, "unit", "value", draws, seed).select(*by, (F.aggregate("_v", F.lit(0.0), lambda s, x: s + x) / F.size("_v")).alias("m"))
    return values.groupBy(*by).agg(F.round(F.avg("value"), places).alias("mean"), F.count("*").alias("n")).join(interval(means, by, "m", places), by)


def figures(metrics: DataFrame, by: tuple[str, ...], draws: int = 10_000, seed: int = 0) -> DataFrame:
    """by, definition, metric, value, n_queries, ci_low, ci_high: means over queries with their number and interval."""
    long = metrics.unpivot([*by, "query_id", "definition"], ["recall", "precision", "ndcg"], "metric", "value").withColumnRenamed("query_id", "unit")
    found = bootstrap(long, (*by, "definition", "metric"), draws, seed)
    if found.filter("n = 0").limit(1).count():
        raise GuardError("a figure needs at least one query")
    return found.withColumnsRenamed({"mean": "value", "n": "n_queries"})


def _slots(ranked: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    top = top_k(ranked, k)
    return top.groupBy(*by, "query_id").agg(
        F.count_if(F.col("relevance") == "good").alias(CLASSES[0]), F.count_if(F.col("relevance") != "none").alias(CLASSES[1]),
        F.count_if((F.col("relevance") == "none") & (F.col("source") == "labelled")).alias(CLASSES[2]), F.count_if(F.col("source") == "distractor").alias(CLASSES[3]),
    )


def exposure(ranked: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    """What fills the first k places: counts of the four classes, all slots, and the distractors' mean share."""
    each = _slots(ranked, k, by)
    return each.groupBy(*by).agg(*(F.sum(c).alias(c) for c in CLASSES), (F.count("*") * k).alias("total_slots"), F.round(F.avg(F.col(CLASSES[3]) / k), 6).alias("distractor_share"))


def exposure_interval(ranked: DataFrame, k: int, by: tuple[str, ...], draws: int = 10_000, seed: int = 0) -> DataFrame:
    """by, mean, n, ci_low, ci_high of the distractors' share of the first k places over queries."""
    share = _slots(ranked, k, by).select(*by, F.col("query_id").alias("unit"), (F.col(CLASSES[3]) / k).alias("value"))
    return bootstrap(share, by, draws, seed)


def attainable_share(figures: DataFrame, ceilings: DataFrame, on: list[str]) -> DataFrame:
    """figures with the share of the ceiling they reach."""
    return figures.join(ceilings, on).withColumn("share_of_ceiling", F.round(F.col("value") / F.col("ceiling"), 6))
