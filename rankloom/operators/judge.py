"""The machine judge: prompts and their guards, dispatch, collected returns by instrument, and reports beside the human labels.

An instrument is a rendered definition and is named by its digest: a row says which one judged it, and figures are
never pooled over two of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom import shared
from rankloom.functions import text
from rankloom.operators import agreement, annotation
from rankloom.operators.agreement import LABELS
from rankloom.operators.guards import GuardError, keep_first, require_clean, require_none

#: The form of a prompt and of the answer it asks for, and names that would tell a judge the answer.
ANSWER = '{"label":"Good Fit"|"Potential Fit"|"No Fit","reason":"<=' + str(annotation.REASON_CHARS) + ' chars"}'
PROMPT = ("JOB DESCRIPTION\n", "\n\nCANDIDATE\n", "\n\nReply with one JSON object, no prose, no markdown fence:\n" + ANSWER)
ANCHORING = ("a1_label", "selection_reason", "lexical_band", "a1_recheck", "second_opinion")
EXAMPLE = r"\b[jr]_[0-9a-f]{4,}\b"
#: What stands before the guide in an instrument; a parameter, as it is part of what the digest names.
HEAD = "---\nname: judge\ntools: []\n---\n\nAnswer with one JSON object and nothing else:\n" + ANSWER + "\n\n"


class MixedDraw(GuardError):
    """A run that holds more than one draw, or rows without one."""


class NotCurrent(GuardError):
    """A stored instrument that is not what the guide renders."""


def prompt(query_text: Column, doc_text: Column) -> Column:
    """The whole message for one pair."""
    return F.concat(F.lit(PROMPT[0]), F.coalesce(query_text, F.lit("")), F.lit(PROMPT[1]), F.coalesce(doc_text, F.lit("")), F.lit(PROMPT[2]))


def instruments(guides: DataFrame, dropped: tuple[str, ...], head: str = HEAD) -> DataFrame:
    """guide_id, definition, agent_sha256: the head and each guide without its operator sections."""
    kept = annotation.kept_sections(guides, dropped).withColumn("definition", F.concat(F.lit(head), "text"))
    return kept.select("guide_id", "definition", F.sha2("definition", 256).alias("agent_sha256"))


def require_current(stored: str | None, definition: str) -> str:
    """The digest of the stored instrument, which must be the rendered one."""
    import hashlib

    if stored != definition:
        raise NotCurrent("the stored instrument is missing or not what the guide renders")
    return hashlib.sha256(stored.encode()).hexdigest()


def example_ids(guides: DataFrame) -> DataFrame:
    """guide_id, example: ids of real documents that a guide's examples name."""
    return guides.select("guide_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(EXAMPLE), 0))).alias("example"))


def anchoring(prompts: DataFrame, forbidden: tuple[str, ...] = ANCHORING) -> DataFrame:
    """prompts with found, the forbidden literals in the message itself; only those with any."""
    held = F.filter(F.array(*map(F.lit, forbidden)), lambda x: F.contains(F.col("prompt"), x))
    return prompts.withColumn("found", held).filter(F.size("found") > 0)


def render(pairs: DataFrame, run: int, draw: str, agent_sha256: str | None = None) -> DataFrame:
    """pair_id, run, draw, prompt, prompt_sha256, chars_sent of pairs (pair_id, query_text, candidate_text): texts masked, checked clean and free of anchors."""
    masked = pairs.select("pair_id", text.redact(F.col("query_text")).alias("query_text"), text.redact(F.col("candidate_text")).alias("candidate_text"))
    require_clean(masked, "query_text", "candidate_text")
    out = masked.select("pair_id", F.lit(run).alias("run"), F.lit(draw).alias("draw"), prompt(F.col("query_text"), F.col("candidate_text")).alias("prompt"))
    require_none(anchoring(out).select("pair_id", "found"), "a prompt tells the judge the answer")
    out = out.withColumn("prompt_sha256", F.sha2("prompt", 256)).withColumn("chars_sent", F.length("prompt"))
    return out if agent_sha256 is None else out.withColumn("agent_sha256", F.lit(agent_sha256))


def require_one_draw(log: DataFrame, run: int, draw: str) -> None:
    """A run holds one draw: rows of another, or of none, refuse the dispatch."""
    try:
        require_none(log.filter(F.col("run") == run).filter(F.col("draw").isNull() | (F.col("draw") != draw)).select("run", "draw").distinct(), f"run {run} holds another draw")
    except GuardError as error:
        raise MixedDraw(str(error)) from None


def dispatch(pairs: DataFrame, log: DataFrame, run: int, draw: str) -> DataFrame:
    """Prompts of a run that the log does not hold yet; the caller appends them (writers.append_new)."""
    require_one_draw(log, run, draw)
    return annotation.undispatched(render(pairs, run, draw), log)


def backfill_draw(log: DataFrame, narrow: DataFrame, narrow_draw: str, wide_draw: str) -> DataFrame:
    """log with a draw on every row: runs within the narrow pairs are of its draw; of a mixed run, which must hold all of them, the narrow pairs are, and all others are wide."""
    marked = log.join(narrow.select("pair_id").distinct().withColumn("_in", F.lit(1)), "pair_id", "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
    runs = marked.filter("draw is null").groupBy("run").agg(F.count_distinct("pair_id").alias("_n"), F.count_distinct(F.when(F.col("_in") == 1, F.col("pair_id"))).alias("_k"))
    size = narrow.select("pair_id").distinct().count()
    require_none(runs.filter((F.col("_k") > 0) & (F.col("_k") < F.col("_n")) & (F.col("_k") < size)).select("run"), "a mixed run does not hold the whole narrow draw")
    return marked.withColumn("draw", F.coalesce("draw", F.when(F.col("_in") == 1, narrow_draw).otherwise(wide_draw))).drop("_in").select(*log.columns)


def routed(collected: DataFrame, draws: tuple[str, ...]) -> dict[str, DataFrame]:
    """Collected returns by draw; a draw that no file is for is an error."""
    require_none(collected.filter(F.col("draw").isNull() | ~F.col("draw").isin(*draws)).select("pair_id", "draw"), "no file for this draw")
    return {name: collected.filter(F.col("draw") == name) for name in draws}


def all_groups(units: DataFrame, annotator: str, seed: int) -> DataFrame:
    """Every unit in the order it would be served, whatever has been judged: seat, place."""
    return annotation.serving_order(units, annotator, seed)


def one_label(judged: DataFrame, *by: str) -> DataFrame:
    """The first run's label of each pair."""
    return keep_first(judged.filter("label is not null"), [*by, "pair_id"], F.col("run"))


def current_labels(judged: DataFrame, current: str) -> DataFrame:
    """pair_id, label: the majority over the current instrument's runs; ties are left out."""
    return agreement.majority(judged.filter((F.col("agent_sha256") == current) & F.col("label").isNotNull()), "pair_id").filter("label is not null").select("pair_id", "label")


def per_instrument(judged: DataFrame, truth: DataFrame, draws: int = 2000, seed: int = 0) -> DataFrame:
    """agent_sha256, scheme, n, agreement, kappa, ci_low, ci_high against truth (pair_id, label): three classes and two."""
    both = one_label(judged, "agent_sha256").select("agent_sha256", "pair_id", F.col("label").alias("b")).join(truth.select("pair_id", F.col("label").alias("a")), "pair_id")
    both = shared.kept(both, "judged_and_truth")
    # Classes are named by their place in their scheme, so that one resampling counts both schemes.
    named = lambda c, names: F.coalesce(*(F.when(c == x, str(k)) for k, x in enumerate(names)), c)
    three = both.select("agent_sha256", "pair_id", F.lit("three").alias("scheme"), *(named(F.col(c), LABELS).alias(c) for c in "ab"))
    two = both.select("agent_sha256", "pair_id", F.lit("binary").alias("scheme"), *(named(agreement.binary(F.col(c)), ("relevant", "not relevant")).alias(c) for c in "ab"))
    return agreement.kappa_interval(three.unionByName(two), ["scheme", "agent_sha256"], "pair_id", tuple(str(k) for k in range(len(LABELS))), draws, seed)


def marginals(judged: DataFrame, drawn: DataFrame) -> DataFrame:
    """agent_sha256, label, n over drawn pairs, in label order with zeros."""
    own = one_label(judged, "agent_sha256").join(drawn.select("pair_id").distinct(), "pair_id", "left_semi")
    names = judged.sparkSession.createDataFrame(list(enumerate(LABELS)), "place int, label string")
    every = judged.select("agent_sha256").distinct().crossJoin(names)
    return every.join(own.groupBy("agent_sha256", "label").agg(F.count("*").alias("n")), ["agent_sha256", "label"], "left").fillna(0, ["n"])


def self_consistency(judged: DataFrame) -> DataFrame:
    """agent_sha256, run_a, run_b, n, agreement, kappa of two runs of one instrument; runs of two are never compared."""
    one = judged.filter("label is not null").select("agent_sha256", "pair_id", "run", "label")
    two = one.select("agent_sha256", "pair_id", F.col("run").alias("run_b"), F.col("label").alias("b"))
    both = one.withColumnsRenamed({"run": "run_a", "label": "a"}).join(two, ["agent_sha256", "pair_id"]).filter("run_a < run_b")
    return agreement.kappa(both, ["agent_sha256", "run_a", "run_b"])


def three_way(first: DataFrame, human: DataFrame, machine: DataFrame) -> DataFrame:
    """pair_id, first, human, machine for pairs that all three have."""
    named = lambda df, name: df.select("pair_id", F.col("label").alias(name))
    return named(first, "first").join(named(human, "human"), "pair_id").join(named(machine, "machine"), "pair_id")


def classwise(three: DataFrame) -> DataFrame:
    """label (of first), n, human_agrees, machine_agrees."""
    share = lambda c: F.round(F.avg((F.col(c) == F.col("first")).cast("double")), 6)
    return three.groupBy(F.col("first").alias("label")).agg(F.count("*").alias("n"), share("human").alias("human_agrees"), share("machine").alias("machine_agrees"))


def disagreements(three: DataFrame) -> DataFrame:
    return three.filter(~((F.col("first") == F.col("human")) & (F.col("human") == F.col("machine"))))


def calibration(judged: DataFrame, truth: DataFrame, by: str = "variant") -> DataFrame:
    """by, n, agreement, kappa of prompt variants on probe pairs, the best first."""
    both = judged.select(by, "pair_id", F.col("label").alias("b")).join(truth.select("pair_id", F.col("label").alias("a")), "pair_id")
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("kappa").desc_nulls_last(), by))  # a handful of variants
    return agreement.kappa(both, [by]).withColumn("place", place)
