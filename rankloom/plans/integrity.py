"""Integrity checks over relations with seeded violations, and their DuckDB twins, which count the same violations on their own.

Each check_ query runs its checks on a relation that was damaged in a stated way, so that a check that finds nothing
fails; check_clean runs all of them on the relations as they are, where nothing may be found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom import shared
from rankloom.operators import annotation, campaign, checks, judge, pools, splits
from rankloom.plans import relations as R
from rankloom.plans.annotate import _REGION, _SHORT, _regions, _shortlist
from rankloom.plans.catalog import query
from rankloom.plans.extended import SQL_CAMPAIGN, _campaign
from rankloom.plans.retrieval import SQL_POOLS


def _counts(**found: str) -> str:
    """One row for each check from a query that counts its violations."""
    return " UNION ALL ".join(f"SELECT '{name.replace('__', ': ').replace('_', ' ')}' AS \"check\", n = 0 AS ok, n AS n_violations FROM (SELECT CAST(({sql}) AS BIGINT) AS n)" for name, sql in found.items())


def _n(relation: str) -> str:
    return f"SELECT count(*) FROM {relation}"


def _twice(relation: str, keys: str) -> str:
    return f"SELECT count(*) FROM (SELECT {keys} FROM {relation} GROUP BY {keys} HAVING count(*) > 1)"


# --- split: every tenth document is gone, the next of ten stands twice, the next has an unknown one beside it


def _split(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return shared.kept(R.doc_split(spark, d), "doc_split"), R.table(spark, d, "labels").select("doc_id").distinct(), R.split_pairs(spark, d)


@query("check_split", f"""WITH {R.SQL_SPLIT_PAIRS}, universe AS (SELECT DISTINCT doc_id FROM labels), bad AS MATERIALIZED (SELECT doc_id, split FROM doc_split WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, 'other' FROM doc_split WHERE doc_id % 10 = 1 UNION ALL SELECT -1 - doc_id, split FROM doc_split WHERE doc_id % 10 = 2)
""" + _counts(
    split__every_id_resolves=_n("bad ANTI JOIN universe USING (doc_id)"), split__every_document_is_assigned=_n("universe ANTI JOIN bad USING (doc_id)"), split__no_document_in_two_splits=_twice("bad", "doc_id"),
    split__pairs_follow_their_documents=_n("split_pairs p LEFT JOIN bad b USING (doc_id) WHERE p.split <> 'discarded' AND (b.split IS NULL OR b.split <> p.split)"), split__rebuild_equals=_n("(SELECT * FROM bad EXCEPT ALL SELECT doc_id, split FROM doc_split)"),
))
def check_split(spark, d):
    good, universe, pairs = _split(spark, d)
    more = good.filter("doc_id % 10 = 1").select("doc_id", F.lit("other").alias("split")).unionByName(good.filter("doc_id % 10 = 2").select((-1 - F.col("doc_id")).alias("doc_id"), "split"))
    return checks.union(checks.split_checks(good.filter("doc_id % 10 <> 0").unionByName(more), universe, pairs, R.doc_split(spark, d)))


# --- pools: some judged candidates become distractors, some places of N100 go, some candidates come twice or from nowhere


def _pools(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    universe = shared.kept(R.doc_split(spark, d).filter("split = 'test'").select("doc_id"), "universe")
    judged = shared.kept(R.test_pairs(spark, d), "judged")
    return shared.kept(pools.build(judged, universe, R.SEED), "pools"), judged.select("query_id", "doc_id"), universe


_DAMAGED = """bad AS MATERIALIZED (SELECT query_id, doc_id, relevance, CASE WHEN source = 'labelled' AND doc_id % 5 = 0 THEN 'distractor' ELSE source END AS source, pool_variant FROM pools WHERE NOT (pool_variant = 'N100' AND doc_id % 7 = 0)
  UNION ALL SELECT query_id, doc_id, relevance, source, pool_variant FROM pools WHERE pool_variant = 'N20' AND source = 'distractor' AND doc_id % 6 = 0 UNION ALL SELECT query_id, -1 - doc_id, relevance, source, pool_variant FROM pools WHERE pool_variant = 'Nfull' AND source = 'distractor' AND doc_id % 9 = 0)"""


@query("check_pools", f"""WITH {SQL_POOLS}, {_DAMAGED}, depth AS (SELECT pool_variant, query_id, count(*) AS n, count(*) FILTER (WHERE source = 'labelled') AS own FROM bad GROUP BY 1, 2)
""" + _counts(
    pools__no_distractor_is_judged=_n("bad SEMI JOIN test_pairs USING (query_id, doc_id) WHERE source = 'distractor'"), pools__candidates_come_from_the_universe=_n("bad ANTI JOIN universe USING (doc_id)"),
    pools__every_judged_pair_is_there=_n("test_pairs ANTI JOIN bad USING (query_id, doc_id)"), pools__depth=_n("depth JOIN variants USING (pool_variant) WHERE n <> least(greatest(own, coalesce(target, 1 << 30)), (SELECT count(*) FROM universe))"),
    pools__no_candidate_twice=_twice("bad", "pool_variant, query_id, doc_id"), pools__N20_is_within_N100=_n("(SELECT * FROM bad WHERE pool_variant = 'N20') ANTI JOIN (SELECT * FROM bad WHERE pool_variant = 'N100') b USING (query_id, doc_id)"),
    pools__N100_is_within_Nfull=_n("(SELECT * FROM bad WHERE pool_variant = 'N100') ANTI JOIN (SELECT * FROM bad WHERE pool_variant = 'Nfull') b USING (query_id, doc_id)"),
))
def check_pools(spark, d):
    made, judged, universe = _pools(spark, d)
    own = F.when((F.col("source") == "labelled") & (F.col("doc_id") % 5 == 0), "distractor").otherwise(F.col("source"))
    bad = made.filter("not (pool_variant = 'N100' and doc_id % 7 = 0)").withColumn("source", own)
    bad = bad.unionByName(made.filter("pool_variant = 'N20' and source = 'distractor' and doc_id % 6 = 0"))
    bad = bad.unionByName(made.filter("pool_variant = 'Nfull' and source = 'distractor' and doc_id % 9 = 0").withColumn("doc_id", -1 - F.col("doc_id")))
    return checks.union(checks.pool_checks(shared.kept(bad, "damaged"), judged, universe, pools.TARGETS))


# --- regions and shortlist: every tenth document is in both regions; the shortlist has pairs twice and documents of eval


@query("check_regions", f"""WITH {_SHORT}, bad AS MATERIALIZED (SELECT * FROM regions UNION ALL SELECT doc_id, CASE region WHEN 'eval' THEN 'train' ELSE 'eval' END FROM regions WHERE doc_id % 10 = 0),
list AS MATERIALIZED (SELECT pair_id, doc_id, keyword, band FROM short UNION ALL SELECT pair_id, doc_id, keyword, band FROM short WHERE doc_id % 3 = 0 UNION ALL SELECT 'x__' || doc_id, doc_id, -1, '?' FROM regions WHERE region = 'eval' AND doc_id % 4 = 1)
""" + _counts(
    regions__one_for_each_document=_twice("bad", "doc_id"), regions__determinism=_n("(SELECT * FROM bad EXCEPT ALL SELECT * FROM regions)"), shortlist__train_region_only=_n("list ANTI JOIN (SELECT * FROM bad WHERE region = 'train') b USING (doc_id)"),
    shortlist__unique_pairs=_twice("list", "pair_id"), shortlist__scope=_n("list ANTI JOIN (SELECT DISTINCT keyword, band FROM cq) c USING (keyword, band)"),
))
def check_regions(spark, d):
    good, short = shared.kept(_regions(spark, d), "regions"), shared.kept(_shortlist(spark, d).select("pair_id", "doc_id", "keyword", "band"), "shortlist")
    flipped = F.when(F.col("region") == "eval", "train").otherwise("eval")
    bad = good.unionByName(good.filter("doc_id % 10 = 0").withColumn("region", flipped))
    strays = good.filter("region = 'eval' and doc_id % 4 = 1").select(F.concat(F.lit("x__"), F.col("doc_id").cast("string")).alias("pair_id"), "doc_id", F.lit(-1).cast(short.schema["keyword"].dataType).alias("keyword"), F.lit("?").alias("band"))
    short = short.unionByName(short.filter("doc_id % 3 = 0")).unionByName(strays)
    cells = R.cell_queries(spark, d).select("keyword", "band").distinct()
    return checks.union([*checks.region_checks(bad, _regions(spark, d), short), checks.check("shortlist: scope", short.join(cells, ["keyword", "band"], "left_anti"))])


# --- queue: pairs come twice, have been judged, show personal data, carry wrong ids


_QUEUE = f"""{R.SQL_TEST}, queue AS (SELECT query_id, doc_id, query_id || '__' || doc_id AS pair_id, 'q_' || substr(sha256('a1|' || query_id || '|' || doc_id), 1, 12) AS queue_id FROM test_pairs WHERE doc_id % 3 <> 0),
bad AS MATERIALIZED (SELECT query_id, doc_id, pair_id, CASE WHEN doc_id % 10 = 4 THEN 'q_' || pair_id ELSE queue_id END AS queue_id, doc_id % 10 = 2 AS dirty FROM queue UNION ALL SELECT query_id, doc_id, pair_id, queue_id, false FROM queue WHERE doc_id % 10 = 1)"""


def _queue(spark, d) -> DataFrame:
    t = shared.kept(R.test_pairs(spark, d), "test_pairs")
    pairs = t.join(R.queries(spark, d).withColumnRenamed("text", "query_text"), "query_id").join(R.documents(spark, d).withColumnRenamed("text", "candidate_text"), "doc_id")
    pairs = pairs.select(F.lit("a1").alias("corpus"), "query_id", "doc_id", F.lit("recheck").alias("selection_reason"), "query_text", F.coalesce("candidate_text", F.lit("")).alias("candidate_text"))
    done = t.filter("doc_id % 3 = 0").select(F.concat_ws("__", "query_id", "doc_id").alias("pair_id"))
    return shared.kept(annotation.build_queue(pairs, done, R.SEED), "queue")


@query("check_queue", f"WITH {_QUEUE} " + _counts(
    queue__unique_ids=_twice("bad", "queue_id"), queue__one_dispatch_for_each_pair=_twice("bad", "query_id, doc_id"), queue__nothing_judged_is_dispatched=_n("bad WHERE doc_id % 10 = 5"), queue__no_residual_personal_data=_n("bad WHERE dirty"),
    queue__ids_recompute=_n("bad WHERE queue_id <> 'q_' || substr(sha256('a1|' || query_id || '|' || doc_id), 1, 12)"), queue__dispatch_is_blind="SELECT 2", queue__dispatch_has_its_columns="SELECT 0",
))
def check_queue(spark, d):
    good = _queue(spark, d)
    dirty = F.when(F.col("doc_id") % 10 == 2, F.concat("candidate_text", F.lit(" someone@example.org"))).otherwise(F.col("candidate_text"))
    bad = good.withColumn("candidate_text", dirty).withColumn("queue_id", F.when(F.col("doc_id") % 10 == 4, F.concat(F.lit("q_"), "pair_id")).otherwise(F.col("queue_id")))
    bad = bad.unionByName(good.filter("doc_id % 10 = 1"))
    judged = good.filter("doc_id % 10 = 5").select("pair_id")
    dispatch = annotation.projections(bad)["dispatch"].withColumn("relevance", F.lit("good")).withColumn("selection_reason", F.lit("recheck"))
    return checks.union([*checks.queue_checks(bad, judged), *checks.blinding_checks(dispatch, annotation.DISPATCH)])


# --- labels: outside the scheme, twice, for unknown pairs, from another batch or stratum, two picks


_LABELS = f"""{R.SQL_JUDGEMENTS}, judged AS (SELECT j.*, u.stratum FROM judgements j JOIN units u USING (pair_id)), bad AS MATERIALIZED (
  SELECT CASE WHEN query_id % 10 = 2 THEN 'no__' || pair_id ELSE pair_id END AS pair_id, query_id, doc_id, CASE WHEN query_id % 10 = 3 THEN batch + 1 ELSE batch END AS batch, annotator, CASE WHEN query_id % 10 = 0 THEN 'Great Fit' ELSE label END AS label, CASE WHEN query_id % 10 = 4 THEN 'none' ELSE stratum END AS stratum, doc_id % 2 = 0 AS picked FROM judged
  UNION ALL SELECT pair_id, query_id, doc_id, batch, annotator, label, stratum, false FROM judged WHERE query_id % 10 = 1)"""


@query("check_labels", f"WITH {_LABELS} " + _counts(
    labels__in_the_scheme=_n("bad WHERE label NOT IN ('Good Fit', 'Potential Fit', 'No Fit')"), labels__no_annotator_twice_on_a_pair=_twice("bad", "pair_id, annotator"), labels__known_pairs=_n("bad ANTI JOIN units USING (pair_id)"),
    labels__batch_has_not_drifted=_n("bad b JOIN units u USING (pair_id) WHERE b.batch IS DISTINCT FROM u.batch"), labels__stratum_has_not_drifted=_n("bad b JOIN units u USING (pair_id) WHERE b.stratum IS DISTINCT FROM u.stratum"),
    labels__one_pick_for_each_query=_twice("(SELECT * FROM bad WHERE picked)", "annotator, query_id"),
))
def check_labels(spark, d):
    units = R.units(spark, d)
    judged = R.judgements(spark, d).join(units.select("pair_id", "stratum"), "pair_id")
    k = F.col("query_id") % 10
    bad = judged.withColumn("pair_id", F.when(k == 2, F.concat(F.lit("no__"), "pair_id")).otherwise(F.col("pair_id"))).withColumn("batch", F.when(k == 3, F.col("batch") + 1).otherwise(F.col("batch")))
    bad = bad.withColumn("label", F.when(k == 0, "Great Fit").otherwise(F.col("label"))).withColumn("stratum", F.when(k == 4, "none").otherwise(F.col("stratum"))).withColumn("picked", F.col("doc_id") % 2 == 0)
    return checks.union(checks.label_checks(bad.unionByName(judged.filter(k == 1).withColumn("picked", F.lit(False))), units))


# --- machine: other prompts than dispatched, two draws in a run, machine rows among human ones, a stale instrument


_MACHINE = f"""{R.SQL_JUDGEMENTS}, prompts AS (SELECT pair_id, query_id, run, 'draw' || run AS draw, 'Judge pair ' || pair_id AS prompt, sha256('Judge pair ' || pair_id) AS prompt_sha256, CASE WHEN query_id % 10 = 5 THEN 'old' ELSE 'current' END AS agent_sha256, 'No Fit' AS label FROM units CROSS JOIN (VALUES (1), (2)) AS v(run)),
bad AS MATERIALIZED (SELECT pair_id, query_id, run, CASE WHEN query_id % 10 = 3 AND run = 1 THEN 'draw2' ELSE draw END AS draw, CASE WHEN query_id % 10 = 0 THEN prompt || '!' ELSE prompt END AS prompt, prompt_sha256, agent_sha256, CASE WHEN query_id % 10 = 6 THEN 'Great Fit' ELSE label END AS label FROM prompts UNION ALL SELECT * FROM prompts WHERE query_id % 10 = 2),
human AS (SELECT CASE WHEN query_id % 10 = 1 THEN 'llm:x' ELSE annotator END AS annotator FROM judgements)"""


@query("check_machine", f"WITH {_MACHINE} " + _counts(
    machine__one_draw_for_each_run=_n("(SELECT run FROM bad GROUP BY run HAVING count(DISTINCT draw) > 1 OR count(*) FILTER (WHERE draw IS NULL) > 0)"), machine__prompt_digests=_n("bad WHERE sha256(prompt) <> prompt_sha256"), machine__no_machine_rows_in_the_human_log=_n("human WHERE annotator LIKE 'llm:%'"),
    machine__no_prompt_twice=_twice("bad", "pair_id, run"), machine__the_instrument_is_current=_n("bad WHERE agent_sha256 <> 'current'"), machine__in_the_scheme=_n("bad WHERE label NOT IN ('Good Fit', 'Potential Fit', 'No Fit')"),
    machine__within_the_drawn_pairs=_n("bad WHERE query_id % 4 = 0"), machine__the_narrow_draw_is_within_the_wide_one=_n("units WHERE query_id % 6 = 0 AND query_id % 4 = 0"),
))
def check_machine(spark, d):
    k = F.col("query_id") % 10
    units = R.units(spark, d)
    prompts = units.select("pair_id", "query_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("run")).withColumn("draw", F.concat(F.lit("draw"), F.col("run").cast("string"))).withColumn("prompt", F.concat(F.lit("Judge pair "), "pair_id"))
    prompts = prompts.withColumn("prompt_sha256", F.sha2("prompt", 256)).withColumn("agent_sha256", F.when(k == 5, "old").otherwise("current")).withColumn("label", F.lit("No Fit"))
    bad = prompts.withColumn("draw", F.when((k == 3) & (F.col("run") == 1), "draw2").otherwise(F.col("draw"))).withColumn("prompt", F.when(k == 0, F.concat("prompt", F.lit("!"))).otherwise(F.col("prompt")))
    bad = bad.withColumn("label", F.when(k == 6, "Great Fit").otherwise(F.col("label"))).unionByName(prompts.filter(k == 2))
    human = R.judgements(spark, d).withColumn("annotator", F.when(k == 1, "llm:x").otherwise(F.col("annotator")))
    wide, narrow = units.filter("query_id % 4 <> 0").select("pair_id"), units.filter("query_id % 6 = 0").select("pair_id")
    return checks.union(checks.machine_checks(shared.kept(bad, "prompts"), human, "current", wide, narrow))


# --- campaign: documents of the wrong region, shared with the shortlist, outside the holdout, in two batches, of another stratum


_CAMPAIGN = f"""{SQL_CAMPAIGN}, regions AS ({_REGION}), pairs_ AS (SELECT query_id || '__' || doc_id AS pair_id, query_id, doc_id, batch, stratum FROM campaign),
bad AS MATERIALIZED (SELECT * FROM pairs_ UNION ALL SELECT pair_id || 'b', query_id, doc_id, batch + 1, stratum FROM pairs_ WHERE doc_id % 3 = 0 UNION ALL SELECT pair_id, query_id, doc_id, 9, 'other' FROM pairs_ WHERE doc_id % 4 = 1),
held AS (SELECT DISTINCT doc_id FROM campaign WHERE doc_id % 5 <> 0), listed AS (SELECT DISTINCT doc_id FROM campaign WHERE doc_id % 7 = 0), specs AS (SELECT * FROM (VALUES (1, 'generic'), (2, 'targeted'), (3, 'generic')) AS v(batch, stratum)), labelled AS (SELECT pair_id FROM pairs_ UNION SELECT 'gone__' || doc_id FROM pairs_ WHERE doc_id % 6 = 0)"""


@query("check_campaign", f"WITH RECURSIVE {_CAMPAIGN} " + _counts(
    campaign__eval_region_only=_n("bad JOIN regions USING (doc_id) WHERE region <> 'eval'"), campaign__nothing_of_the_shortlist=_n("bad SEMI JOIN listed USING (doc_id)"), campaign__all_held_out=_n("bad ANTI JOIN held USING (doc_id)"),
    campaign__the_holdout_is_wider_than_the_pairs=_n("(SELECT 1 WHERE (SELECT count(*) FROM held) <= (SELECT count(DISTINCT doc_id) FROM bad))"), campaign__unique_pairs=_twice("bad", "pair_id"), campaign__every_batch_is_declared=_n("bad ANTI JOIN specs USING (batch)"),
    campaign__no_document_in_two_batches=_n("(SELECT doc_id FROM bad GROUP BY 1 HAVING count(DISTINCT batch) > 1)"), campaign__strata_are_those_of_their_batches=_n("bad JOIN specs USING (batch) WHERE bad.stratum <> specs.stratum"),
    campaign__known_strata=_n("bad WHERE stratum NOT IN ('generic', 'targeted')"), campaign__batches_are_declared_once="SELECT 1", campaign__labels_survive=_n("labelled ANTI JOIN (SELECT DISTINCT pair_id FROM bad) b USING (pair_id)"),
))
def check_campaign(spark, d):
    made = shared.kept(_campaign(spark, d).withColumn("pair_id", F.concat_ws("__", "query_id", "doc_id")).select("pair_id", "query_id", "doc_id", "batch", "stratum"), "campaign")
    bad = made.unionByName(made.filter("doc_id % 3 = 0").withColumn("pair_id", F.concat("pair_id", F.lit("b"))).withColumn("batch", F.col("batch") + 1))
    bad = shared.kept(bad.unionByName(made.filter("doc_id % 4 = 1").withColumn("batch", F.lit(9)).withColumn("stratum", F.lit("other"))), "damaged")
    held, listed = made.filter("doc_id % 5 <> 0").select("doc_id").distinct(), made.filter("doc_id % 7 = 0").select("doc_id").distinct()
    specs = spark.createDataFrame([(1, "generic"), (2, "targeted"), (3, "generic"), (3, "generic")], "batch int, stratum string")
    labelled = made.select("pair_id").unionByName(made.filter("doc_id % 6 = 0").select(F.concat(F.lit("gone__"), F.col("doc_id").cast("string")).alias("pair_id")))
    return checks.union([*checks.domain_checks(bad, _regions(spark, d), listed, held, specs), campaign.labels_survive(bad, labelled)])


@query("check_clean", "SELECT CAST(0 AS BIGINT) AS failed, CAST(48 AS BIGINT) AS checks")
def check_clean(spark, d):
    """All checks on the relations as they are: how many there are, and how many find anything."""
    good, universe, pairs = _split(spark, d)
    made, judged, test = _pools(spark, d)
    regions, short = shared.kept(_regions(spark, d), "regions"), shared.kept(_shortlist(spark, d), "shortlist")
    queue, units, human = _queue(spark, d), R.units(spark, d), R.judgements(spark, d)
    labelled = human.join(units.select("pair_id", "stratum"), "pair_id").withColumn("picked", F.lit(False))
    prompts = units.select("pair_id", F.lit(1).alias("run"), F.lit("draw1").alias("draw"), F.concat(F.lit("Judge pair "), "pair_id").alias("prompt"), F.lit("current").alias("agent_sha256"), F.lit("No Fit").alias("label")).withColumn("prompt_sha256", F.sha2("prompt", 256))
    eval_docs = R.cell_documents(spark, d).select("doc_id", "keyword").join(regions.filter("region = 'eval'"), "doc_id", "left_semi")
    specs = [{"batch": 1, "n_queries": 4, "per_query": 3, "same_min": 1, "seed": 1}, {"batch": 2, "n_queries": 2, "per_query": 3, "same_min": 1, "seed": 2}]
    drawn = shared.kept(campaign.replay(R.cell_queries(spark, d).select("query_id", "keyword"), eval_docs, specs).withColumn("pair_id", F.concat_ws("__", "query_id", "doc_id")), "campaign")
    held = eval_docs.select("doc_id")
    declared = spark.createDataFrame([(s["batch"], "generic") for s in specs], "batch int, stratum string")
    every = [
        *checks.split_checks(good, universe, pairs, R.doc_split(spark, d)), *checks.pool_checks(made, judged, test, pools.TARGETS), *checks.region_checks(regions, _regions(spark, d), short), *checks.queue_checks(queue, queue.filter("false").select("pair_id")),
        *checks.blinding_checks(annotation.projections(queue)["dispatch"], annotation.DISPATCH), *checks.label_checks(labelled, units), *checks.machine_checks(prompts, human, "current", units, units.filter("query_id % 6 = 0")),
        *checks.domain_checks(drawn, regions, short.filter("false").select("doc_id"), held, declared), campaign.labels_survive(drawn, drawn.select("pair_id")),
    ]
    return checks.union(every).agg(F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("checks"))


@query("split_sides", f"""WITH {R.SQL_PAIRS}, seeds AS (SELECT unnest([0, 1, 2]) AS seed), a AS (SELECT seed, doc_id, r <= round_even(n * 0.3, 0) AS inside FROM (SELECT seed, doc_id, count(*) OVER (PARTITION BY seed) AS n, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || '|survey-doc_id|' || doc_id), doc_id) AS r FROM (SELECT DISTINCT doc_id FROM pairs) CROSS JOIN seeds)),
q AS (SELECT seed, query_id, r <= round_even(n * 0.3, 0) AS inside FROM (SELECT seed, query_id, count(*) OVER (PARTITION BY seed) AS n, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || '|survey-query_id|' || query_id), query_id) AS r FROM (SELECT DISTINCT query_id FROM pairs) CROSS JOIN seeds))
SELECT a.seed, count(*) FILTER (WHERE a.inside AND q.inside) AS "both", count(*) FILTER (WHERE a.inside AND NOT q.inside) AS left_only, count(*) FILTER (WHERE NOT a.inside AND q.inside) AS right_only, count(*) FILTER (WHERE NOT a.inside AND NOT q.inside) AS neither FROM pairs p JOIN a USING (doc_id) JOIN q ON q.query_id = p.query_id AND q.seed = a.seed GROUP BY 1""")
def split_sides(spark, d):
    return splits.side_survey(R.pairs(spark, d), "doc_id", "query_id", 0.3, [0, 1, 2])


@query("prompt_guards", "SELECT CAST(0 AS BIGINT) AS examples, (SELECT count(*) FROM benchmark WHERE item_id % 3 = 0) AS anchored")
def prompt_guards(spark, d):
    """Prompts that would tell a judge the answer, seeded into every third item, and real ids in a guide's examples, of which there are none."""
    items = R.queries(spark, d)
    prompts = items.select(F.col("query_id").alias("pair_id"), judge.prompt(F.when(F.col("query_id") % 3 == 0, "its selection_reason is").otherwise("a query"), F.col("text")).alias("prompt"))
    examples = judge.example_ids(spark.createDataFrame([(1, "see j_12 and r_abc for a sketch")], "guide_id int, text string"))
    return examples.agg(F.count("*").alias("examples")).crossJoin(judge.anchoring(prompts).agg(F.count("*").alias("anchored")))
