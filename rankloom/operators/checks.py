"""Integrity checks: each is a table of violations that must be empty, reported as (check, ok, n_violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import order, text
from rankloom.operators.agreement import LABELS
from rankloom.operators.guards import check, duplicate_keys


def union(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def split_checks(assigned: DataFrame, universe: DataFrame, pairs: DataFrame, rebuilt: DataFrame) -> list[DataFrame]:
    """assigned and rebuilt: doc_id, split; universe: doc_id; pairs: doc_id, split (of kept pairs)."""
    agree = pairs.filter("split <> 'discarded'").join(assigned.withColumnRenamed("split", "_own"), "doc_id", "left")
    return [
        check("split: every id resolves", assigned.join(universe, "doc_id", "left_anti")),
        check("split: every document is assigned", universe.join(assigned, "doc_id", "left_anti")),
        check("split: no document in two splits", duplicate_keys(assigned, "doc_id")),
        check("split: pairs follow their documents", agree.filter("split <> _own or _own is null")),
        check("split: rebuild equals", assigned.select("doc_id", "split").exceptAll(rebuilt.select("doc_id", "split"))),
    ]


def pool_checks(pools: DataFrame, judged: DataFrame, universe: DataFrame, targets: dict[str, int | None]) -> list[DataFrame]:
    """pools: pool_variant, query_id, doc_id, source; judged: query_id, doc_id; universe: doc_id.

    Pool rows and judged pairs are dealt once by their pair and counted there, so no pool is joined with another or sent
    to the driver; keys without a value match nothing, as in a join.
    """
    spark = pools.sparkSession
    aims = F.broadcast(spark.createDataFrame(list(targets.items()), "pool_variant string, _target int"))
    depth = pools.groupBy("pool_variant", "query_id").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "labelled").alias("own")).join(aims, "pool_variant")
    total = universe.agg(F.count("*").alias("_all"))
    expected = F.least(F.greatest("own", F.coalesce("_target", F.lit(1 << 30))), F.col("_all"))
    strays = pools.groupBy("doc_id").agg(F.count("*").alias("n")).join(universe.hint("merge"), "doc_id", "left_anti")
    names = list(targets)
    own = pools.select("query_id", "doc_id", "pool_variant", (F.col("source") == "distractor").alias("_other"), F.lit(True).alias("_pool"))
    asked = judged.select("query_id", "doc_id", F.lit(None).cast("string").alias("pool_variant"), F.lit(False).alias("_other"), F.lit(False).alias("_pool"))
    dealt = own.unionByName(asked).repartition("query_id", "doc_id")
    each = dealt.groupBy("query_id", "doc_id", "_pool", "pool_variant").agg(F.count("*").alias("n"), F.count_if("_other").alias("_d"))
    within = [F.sum(F.when(F.col("_pool") & (F.col("pool_variant") == v), F.col("n")).otherwise(0)).alias(f"_n{k}") for k, v in enumerate(names)]
    by_pair = each.groupBy("query_id", "doc_id").agg(
        F.sum("_d").alias("_d"), F.sum(F.when(F.col("_pool"), F.col("n")).otherwise(0)).alias("_p"), F.sum(F.when(F.col("_pool"), 0).otherwise(F.col("n"))).alias("_j"), F.count_if(F.col("_pool") & (F.col("n") > 1)).alias("_twice"), *within,
    )
    has = lambda c: (F.col(c) > 0) & F.col("query_id").isNotNull() & F.col("doc_id").isNotNull()
    counts = {
        "pools: no distractor is judged": F.when(has("_j"), F.col("_d")), "pools: every judged pair is there": F.when(~has("_p"), F.col("_j")), "pools: no candidate twice": F.col("_twice"),
        **{f"pools: {a} is within {b}": F.when(~has(f"_n{k + 1}"), F.col(f"_n{k}")) for k, (a, b) in enumerate(zip(names, names[1:], strict=False))},
    }
    found = by_pair.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(name) for name, n in counts.items()))
    rows = F.array(*(F.struct(F.lit(name).alias("check"), (F.col(f"`{name}`") == 0).alias("ok"), F.col(f"`{name}`").alias("n_violations")) for name in counts))
    return [
        found.select(F.inline(rows)),
        strays.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_violations")).select(F.lit("pools: candidates come from the universe").alias("check"), (F.col("n_violations") == 0).alias("ok"), "n_violations"),
        check("pools: depth", depth.crossJoin(F.broadcast(total)).filter(F.col("n") != expected)),
    ]


def region_checks(regions: DataFrame, again: DataFrame, shortlist: DataFrame) -> list[DataFrame]:
    """regions, again: doc_id, region; shortlist: pair_id, doc_id."""
    return [
        check("regions: one for each document", duplicate_keys(regions, "doc_id")),
        check("regions: determinism", regions.exceptAll(again)),
        check("shortlist: train region only", shortlist.join(regions.filter("region = 'train'"), "doc_id", "left_anti")),
        check("shortlist: unique pairs", duplicate_keys(shortlist, "pair_id")),
    ]


def queue_checks(queue: DataFrame, judged: DataFrame) -> list[DataFrame]:
    dirty = [F.col("residual") > 0]
    texts = queue.select(F.explode(F.array("query_text", "candidate_text")).alias("t")).select(sum(text.residuals(F.col("t")).values()).alias("residual"))
    return [
        check("queue: unique ids", duplicate_keys(queue, "queue_id")),
        check("queue: one dispatch for each pair", duplicate_keys(queue, "query_id", "doc_id")),
        check("queue: nothing judged is dispatched", queue.join(judged, "pair_id", "left_semi")),
        check("queue: no residual personal data", texts.filter(dirty[0])),
        check("queue: ids recompute", queue.filter(F.col("queue_id") != order.opaque_id(F.col("corpus"), F.col("query_id"), F.col("doc_id")))),
    ]


def blinding_checks(dispatch: DataFrame, columns: tuple[str, ...], hidden: tuple[str, ...] = ("relevance", "label", "a1_label", "selection_reason", "lexical_band")) -> list[DataFrame]:
    """What a judge opens has the agreed columns and none that tells an answer: a matter of the schema, not of rows."""
    names = lambda found: dispatch.sparkSession.createDataFrame([(x,) for x in found], "name string")
    return [check("queue: dispatch is blind", names([c for c in dispatch.columns if c in hidden])), check("queue: dispatch has its columns", names([c for c in columns if c not in dispatch.columns]))]


def label_checks(judgements: DataFrame, units: DataFrame) -> list[DataFrame]:
    """judgements: pair_id, query_id, annotator, label, batch, stratum, picked; units: pair_id, batch, stratum."""
    both = judgements.join(units.select("pair_id", F.col("batch").alias("_b"), F.col("stratum").alias("_s")), "pair_id")
    return [
        check("labels: in the scheme", judgements.filter(~F.col("label").isin(*LABELS) | F.col("label").isNull())),
        check("labels: no annotator twice on a pair", duplicate_keys(judgements, "pair_id", "annotator")),
        check("labels: known pairs", judgements.join(units, "pair_id", "left_anti")),
        check("labels: batch has not drifted", both.filter(~F.col("batch").eqNullSafe(F.col("_b")))),
        check("labels: stratum has not drifted", both.filter(~F.col("stratum").eqNullSafe(F.col("_s")))),
        check("labels: one pick for each query", duplicate_keys(judgements.filter("picked"), "annotator", "query_id")),
    ]


def machine_checks(judged: DataFrame, human: DataFrame, current: str, wide: DataFrame, narrow: DataFrame) -> list[DataFrame]:
    """judged: pair_id, run, draw, prompt, prompt_sha256, agent_sha256, label; human: annotator; wide and narrow: pair_id of the two draws."""
    return [
        check("machine: one draw for each run", judged.groupBy("run").agg(F.count_distinct("draw").alias("d"), F.count_if(F.col("draw").isNull()).alias("m")).filter("d > 1 or m > 0")),
        check("machine: prompt digests", judged.filter(F.sha2("prompt", 256) != F.col("prompt_sha256"))),
        check("machine: no machine rows in the human log", human.filter(F.col("annotator").startswith("llm:"))),
        check("machine: no prompt twice", duplicate_keys(judged, "pair_id", "run")),
        check("machine: the instrument is current", judged.filter(~F.col("agent_sha256").eqNullSafe(F.lit(current)))),
        check("machine: in the scheme", judged.filter(~F.col("label").isin(*LABELS))),
        check("machine: within the drawn pairs", judged.join(wide.select("pair_id").distinct(), "pair_id", "left_anti")),
        check("machine: the narrow draw is within the wide one", narrow.select("pair_id").join(wide.select("pair_id"), "pair_id", "left_anti")),
    ]


def domain_checks(pairs: DataFrame, regions: DataFrame, shortlist: DataFrame, holdout: DataFrame, specs: DataFrame) -> list[DataFrame]:
    """pairs: pair_id, doc_id, batch, stratum of a campaign; regions: doc_id, region; shortlist, holdout: doc_id; specs: batch, stratum as declared."""
    sizes = holdout.select("doc_id").distinct().agg(F.count("*").alias("h")).crossJoin(pairs.agg(F.count_distinct("doc_id").alias("p")))
    declared = specs.select("batch", F.col("stratum").alias("_s")).distinct()
    return [
        check("campaign: eval region only", pairs.join(regions, "doc_id").filter("region <> 'eval'")),
        check("campaign: nothing of the shortlist", pairs.join(shortlist.select("doc_id").distinct(), "doc_id", "left_semi")),
        check("campaign: all held out", pairs.join(holdout.select("doc_id").distinct(), "doc_id", "left_anti")),
        check("campaign: the holdout is wider than the pairs", sizes.filter("h <= p")),
        check("campaign: unique pairs", duplicate_keys(pairs, "pair_id")),
        check("campaign: every batch is declared", pairs.join(declared.select("batch").distinct(), "batch", "left_anti")),
        check("campaign: no document in two batches", pairs.groupBy("doc_id").agg(F.count_distinct("batch").alias("n")).filter("n > 1")),
        check("campaign: strata are those of their batches", pairs.join(declared, "batch").filter("stratum <> _s")),
        check("campaign: known strata", pairs.filter("stratum not in ('generic', 'targeted')")),
        check("campaign: batches are declared once", duplicate_keys(specs, "batch")),
    ]
