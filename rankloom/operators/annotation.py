"""The annotation session: a queue, an append-only log, and everything else derived from the two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions import order, text
from rankloom.operators.agreement import LABELS
from rankloom.operators.guards import require_clean, require_none

DISPATCH = ("queue_id", "query_text", "candidate_text")
KEY = ("queue_id", "corpus", "query_id", "doc_id", "selection_reason", "position")
REASON_CHARS = 120


def judged(judgements: DataFrame) -> DataFrame:
    """All that has a label: the whole resume state."""
    return judgements.select("pair_id").distinct()


def build_queue(pairs: DataFrame, judgements: DataFrame, seed: int) -> DataFrame:
    """Unjudged pairs with texts masked, opaque ids and a position; the shuffle depends on how many are left.

    pairs: corpus, query_id, doc_id, selection_reason, query_text, candidate_text.
    """
    keyed = pairs.withColumn("pair_id", F.concat_ws("__", "query_id", "doc_id"))
    left = keyed.join(judged(judgements), "pair_id", "left_anti")
    require_none(left.filter("query_text is null or candidate_text is null").select("pair_id"), "no text")
    n = left.agg(F.count("*").alias("_n"))  # one row
    out = left.withColumn("queue_id", order.opaque_id(F.col("corpus"), F.col("query_id"), F.col("doc_id"))).crossJoin(F.broadcast(n))
    out = order.ranked(out, order.digest(seed, F.col("_n"), F.col("pair_id")), F.col("pair_id"), "position").withColumn("position", F.col("position") - 1)
    return out.withColumn("query_text", text.redact(F.col("query_text"))).withColumn("candidate_text", text.redact(F.col("candidate_text"))).drop("_n")


def projections(queue: DataFrame) -> dict[str, DataFrame]:
    """The committed key, the blind dispatch and the full table."""
    return {"key": queue.select(*KEY), "dispatch": queue.select(*DISPATCH), "full": queue}


def outstanding(pairs: DataFrame, judgements: DataFrame, annotator: str, fraction: float, seed: int) -> DataFrame:
    """Pairs that need more labels and that the annotator has not labelled; pairs of the doubled share need two."""
    have = judgements.groupBy("pair_id").agg(F.count("*").alias("_have"), F.max((F.col("annotator") == annotator).cast("int")).alias("_mine"))
    wanted = F.when(order.doubly(F.col("pair_id"), fraction, seed), 2).otherwise(1)
    joined = pairs.join(have, "pair_id", "left").fillna(0, ["_have", "_mine"])
    return joined.filter((F.col("_have") < wanted) & (F.col("_mine") == 0)).drop("_have", "_mine")


def _seat_key(annotator: str, seed: int):
    """The twelve hex digits that order queries for an annotator."""
    return F.substring(order.digest(seed, F.concat_ws("|", F.lit(annotator), "query_id")), 1, 12)


def _place(seed: int):
    return F.row_number().over(W.partitionBy("query_id").orderBy(order.group_order(F.concat_ws("|", "query_id", "doc_id"), seed), "doc_id"))


def serving_order(owed: DataFrame, annotator: str, seed: int) -> DataFrame:
    """owed with seat (the query's place for this annotator) and place (the candidate's in its query)."""
    seats = order.ranked(owed.select("query_id").distinct(), _seat_key(annotator, seed), F.col("query_id"), "seat")
    return owed.join(seats, "query_id").withColumn("place", _place(seed))


def serve(pairs: DataFrame, judgements: DataFrame, annotator: str, fraction: float, seed: int, redact: tuple[str, ...] = ()) -> DataFrame:
    """The next group for an annotator, whole and in order; complete says whether it is all of its query's pairs.

    Columns named in redact are masked, and none may have personal data left.
    """
    owed = outstanding(pairs, judgements, annotator, fraction, seed)
    first = owed.agg(F.min(F.struct(_seat_key(annotator, seed).alias("k"), "query_id")).alias("f")).select("f.query_id")  # one row
    group = owed.join(F.broadcast(first), "query_id", "left_semi").withColumn("place", _place(seed))
    size = pairs.join(F.broadcast(first), "query_id", "left_semi").agg(F.count("*").alias("_all"))
    out = group.crossJoin(F.broadcast(size)).withColumn("complete", F.count("*").over(W.partitionBy("query_id")) == F.col("_all")).drop("_all")
    for name in redact:
        out = out.withColumn(name, text.redact(F.col(name)))
    if redact:
        require_clean(out, *redact)
    return out


def validate(groups: DataFrame, relevant: tuple[str, ...] = ("Good Fit", "Potential Fit")) -> DataFrame:
    """group_id, problem (null: record it): rows are group_id, annotator, doc_id, label, pick, asks_pick, for all that was served."""
    ok = F.col("label").isin(*relevant)
    each = groups.groupBy("group_id").agg(
        F.max(F.length(F.trim(F.coalesce("annotator", F.lit(""))))).alias("_who"), F.count_if(F.col("label").isNull()).alias("_open"), F.count_if(~F.col("label").isin(*LABELS)).alias("_bad"),
        F.max("pick").alias("_pick"), F.max(F.col("asks_pick").cast("int")).alias("_asks"), F.count_if(ok).alias("_fit"), F.count_if(ok & (F.col("doc_id") == F.col("pick"))).alias("_hit"),
    )
    problem = (
        F.when(F.col("_who") == 0, "no annotator").when(F.col("_open") > 0, "labels missing").when(F.col("_bad") > 0, "label outside the scheme")
        .when((F.col("_asks") == 0) & F.col("_pick").isNotNull(), "pick was not asked").when(F.col("_pick").isNotNull() & (F.col("_hit") == 0), "pick is not relevant")
        .when((F.col("_asks") == 1) & F.col("_pick").isNull() & (F.col("_fit") > 0), "pick is missing")
    )
    return each.select("group_id", problem.alias("problem"))


def progress(pairs: DataFrame, judgements: DataFrame, by: str) -> DataFrame:
    """by, total, done, partial queries (begun, not finished)."""
    marked = pairs.join(judged(judgements).withColumn("_done", F.lit(1)), "pair_id", "left").fillna(0, ["_done"])
    per = marked.groupBy(by, "query_id").agg(F.count("*").alias("n"), F.sum("_done").alias("d"))
    return per.groupBy(by).agg(F.sum("n").alias("total"), F.sum("d").alias("done"), F.count_if((F.col("d") > 0) & (F.col("d") < F.col("n"))).alias("partial_queries"))


def overview(pairs: DataFrame, judgements: DataFrame, fraction: float, seed: int) -> DataFrame:
    """batch, wanted, have, owed labels; labels beyond what a pair wants do not count."""
    have = judgements.groupBy("pair_id").agg(F.count("*").alias("_have"))
    wanted = F.when(order.doubly(F.col("pair_id"), fraction, seed), 2).otherwise(1)
    joined = pairs.join(have, "pair_id", "left").fillna(0, ["_have"]).withColumn("_want", wanted).withColumn("_got", F.least("_have", "_want"))
    return joined.groupBy("batch").agg(F.sum("_want").alias("wanted"), F.sum("_got").alias("have"), F.sum(F.col("_want") - F.col("_got")).alias("owed"))


def undispatched(prompts: DataFrame, log: DataFrame) -> DataFrame:
    """Prompts whose (pair_id, run) is not in the log: appending them twice changes nothing."""
    return prompts.join(log.select("pair_id", "run").distinct(), ["pair_id", "run"], "left_anti")


def mixed_runs(prompts: DataFrame) -> DataFrame:
    """Runs that hold more than one draw, or none."""
    return prompts.groupBy("run").agg(F.count_distinct("draw").alias("draws"), F.count_if(F.col("draw").isNull()).alias("missing")).filter("draws > 1 or missing > 0")


def parse_returns(returns: DataFrame) -> DataFrame:
    """returns with label, reason, reason_overlong and problem (null: good), from raw text: one JSON object, fenced or bare."""
    whole = text.strip(F.coalesce("raw", F.lit("")))
    fenced = F.regexp_extract(whole, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    body = F.when(fenced != "", fenced).otherwise(whole)
    out = returns.withColumn("_b", body)
    parsed = F.try_parse_json(F.col("_b"))
    label = text.strip(F.get_json_object("_b", "$.label"))
    reason = text.strip(F.coalesce(F.get_json_object("_b", "$.reason"), F.lit("")))
    problem = F.when(parsed.isNull(), "not JSON").when(~F.startswith("_b", F.lit("{")) | label.isNull(), "no label").when(~label.isin(*LABELS), "label outside the scheme")
    out = out.withColumn("problem", problem)
    good = F.col("problem").isNull()
    return out.withColumn("label", F.when(good, label)).withColumn("reason", F.when(good, F.substring(reason, 1, REASON_CHARS))).withColumn("reason_overlong", good & (F.length(reason) > REASON_CHARS)).drop("_b")


def collect(prompts: DataFrame, returns: DataFrame) -> DataFrame:
    """Parsed returns with their prompts' provenance; every return must have been dispatched."""
    require_none(returns.join(prompts, ["pair_id", "run"], "left_anti").select("pair_id", "run"), "return was never dispatched")
    return parse_returns(returns).join(prompts, ["pair_id", "run"])


def kept_sections(guides: DataFrame, dropped: tuple[str, ...]) -> DataFrame:
    """guide_id, text without the named second-level sections and all below them."""
    lines = guides.select("guide_id", F.posexplode(text.section_lines(F.col("text"))).alias("at", "line"))
    second = F.col("line").startswith("## ")
    named = F.lit(False)
    for name in dropped:
        named = named | text.strip(F.substring("line", 4, 10_000)).startswith(name)
    state = F.when(second, named.cast("int")).when(F.col("line").startswith("# "), 0)
    skip = F.last(state, ignorenulls=True).over(W.partitionBy("guide_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    kept = lines.withColumn("_skip", F.coalesce(skip, F.lit(0))).filter("_skip = 0")
    joined = kept.groupBy("guide_id").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    return joined.select("guide_id", F.concat(F.regexp_replace(F.array_join(F.col("l.line"), "\n"), f"{text.SPACE}+$", ""), F.lit("\n")).alias("text"))
