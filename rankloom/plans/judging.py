"""Machine-judge queries: prompts, dispatch, and reports by instrument, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom import shared
from rankloom.functions import order
from rankloom.operators import agreement, judge
from rankloom.operators.guards import keep_first
from rankloom.plans import relations as R
from rankloom.plans.catalog import query

# The first labels of a unit, the human ones (its first annotator's) and the machine's: two instruments, three runs of the one and two of the other.
_FIRST = "CASE WHEN substr(sha256('first|' || pair_id), 1, 1) < '6' THEN 'Good Fit' WHEN substr(sha256('first|' || pair_id), 1, 1) < 'b' THEN 'Potential Fit' ELSE 'No Fit' END"
_SAID = f"CASE WHEN substr(sha256('run' || run || '|' || pair_id), 1, 1) < 'a' THEN {_FIRST} WHEN substr(sha256('run' || run || '|' || pair_id), 1, 1) < 'd' THEN 'Good Fit' WHEN substr(sha256('run' || run || '|' || pair_id), 1, 1) < 'e' THEN NULL ELSE 'No Fit' END"
_FRAMES = f"""{R.SQL_JUDGEMENTS}, first AS (SELECT pair_id, {_FIRST} AS label FROM units), human AS (SELECT pair_id, label FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY annotator) AS r FROM judgements) WHERE r = 1),
said AS MATERIALIZED (SELECT pair_id, run, CASE WHEN run <= 3 THEN 'one' ELSE 'two' END AS agent_sha256, {_SAID} AS label FROM units CROSS JOIN (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS run)),
one_label AS (SELECT agent_sha256, pair_id, label FROM (SELECT *, row_number() OVER (PARTITION BY agent_sha256, pair_id ORDER BY run) AS r FROM said WHERE label IS NOT NULL) WHERE r = 1),
votes AS (SELECT pair_id, label, count(*) AS n FROM said WHERE agent_sha256 = 'one' AND label IS NOT NULL GROUP BY 1, 2), machine AS (SELECT pair_id, label FROM (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS second FROM votes WINDOW w AS (PARTITION BY pair_id ORDER BY n DESC, label)) WHERE r = 1 AND (second IS NULL OR second < n)),
three AS (SELECT f.pair_id, f.label AS first, h.label AS human, m.label AS machine FROM first f JOIN human h USING (pair_id) JOIN machine m USING (pair_id))"""


def _first(spark, d) -> DataFrame:
    h = F.substring(order.digest("first", F.col("pair_id")), 1, 1)
    return R.units(spark, d).select("pair_id", F.when(h < "6", "Good Fit").when(h < "b", "Potential Fit").otherwise("No Fit").alias("label"))


def _human(spark, d) -> DataFrame:
    return keep_first(R.judgements(spark, d), ["pair_id"], F.col("annotator")).select("pair_id", "label")


def _said(spark, d) -> DataFrame:
    each = _first(spark, d).select("pair_id", F.col("label").alias("_f"), F.explode(F.array(*map(F.lit, range(1, 6)))).alias("run"))
    h = F.substring(F.sha2(F.concat(F.lit("run"), F.col("run").cast("string"), F.lit("|"), "pair_id"), 256), 1, 1)
    label = F.when(h < "a", F.col("_f")).when(h < "d", "Good Fit").when(h < "e", None).otherwise("No Fit")
    return shared.kept(each.select("pair_id", "run", F.when(F.col("run") <= 3, "one").otherwise("two").alias("agent_sha256"), label.alias("label")), "said")


def _three(spark, d) -> DataFrame:
    return judge.three_way(_first(spark, d), _human(spark, d), judge.current_labels(_said(spark, d), "one"))


def _sql_kappa(name: str, by: str, draws: int = 2000) -> str:
    """name(by, n, agreement, kappa, ci_low, ci_high) over joint(by, pair_id, a, b)."""

    def kappa(source: str, key: str) -> str:
        return f"""(SELECT {key}, n, po, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa, one AND two AS constant FROM (SELECT {key}, n, po, coalesce(pe, 0) / CAST(n * n AS DOUBLE) AS pe, one, two FROM
  (SELECT {key}, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, min(a) = max(a) AS one, min(b) = max(b) AS two FROM {source} GROUP BY ALL) LEFT JOIN
  (SELECT {key}, sum(x.c * y.c) AS pe FROM (SELECT {key}, a AS l, count(*) AS c FROM {source} GROUP BY ALL) x JOIN (SELECT {key}, b AS l, count(*) AS c FROM {source} GROUP BY ALL) y USING ({key}, l) GROUP BY ALL) USING ({key})))"""

    return f"""{name}_v AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY pair_id) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM joint),
{name}_x AS MATERIALIZED (SELECT n, d, CAST(('0x' || substr(sha256('0|' || d || '|' || p), 1, 8))::UBIGINT AS BIGINT) % n AS i FROM (SELECT n, d, unnest(range(n)) AS p FROM (SELECT DISTINCT n FROM {name}_v) CROSS JOIN (SELECT unnest(range({draws})) AS d))),
{name}_s AS MATERIALIZED (SELECT {by}, d, a, b FROM {name}_x JOIN {name}_v USING (n, i)), {name}_d AS (SELECT * FROM {kappa(name + '_s', by + ', d')} WHERE NOT constant),
{name} AS (SELECT {by}, n, round(po, 6) AS agreement, round(kappa, 6) AS kappa, ci_low, ci_high FROM {kappa('joint', by)} LEFT JOIN (SELECT {by}, round(quantile_cont(kappa, 0.025), 5) AS ci_low, round(quantile_cont(kappa, 0.975), 5) AS ci_high FROM {name}_d GROUP BY ALL) USING ({by}))"""


@query("kappa_ci", f"WITH {R.SQL_JUDGEMENTS}, joint AS (SELECT x.batch, x.pair_id, x.label AS a, y.label AS b FROM judgements x JOIN judgements y ON x.pair_id = y.pair_id AND x.annotator = 'ann' AND y.annotator = 'bob'), {_sql_kappa('k', 'batch')} SELECT * FROM k")
def kappa_ci(spark, d):
    j = R.judgements(spark, d)
    one, two = j.filter("annotator = 'ann'"), j.filter("annotator = 'bob'")
    both = one.select("pair_id", "batch", F.col("label").alias("a")).join(two.select("pair_id", F.col("label").alias("b")), "pair_id")
    return agreement.kappa_interval(shared.kept(both, "joint"), ["batch"], "pair_id")


_BIN = "CASE WHEN {0} = 'No Fit' THEN 'not relevant' ELSE 'relevant' END"


@query("judge_report", f"""WITH {_FRAMES}, joint AS (SELECT 'three' AS scheme, o.agent_sha256, o.pair_id, f.label AS a, o.label AS b FROM one_label o JOIN first f USING (pair_id) UNION ALL SELECT 'binary', o.agent_sha256, o.pair_id, {_BIN.format("f.label")}, {_BIN.format("o.label")} FROM one_label o JOIN first f USING (pair_id)),
{_sql_kappa('k', 'scheme, agent_sha256')} SELECT * FROM k""")
def judge_report(spark, d):
    """Each instrument against the first labels, in three classes and in two."""
    return judge.per_instrument(_said(spark, d), _first(spark, d))


@query("judge_marginals", f"WITH {_FRAMES} SELECT a.agent_sha256, n.label, CAST(n.place AS INTEGER) AS place, count(o.label) AS n FROM (SELECT DISTINCT agent_sha256 FROM said) a CROSS JOIN (VALUES (0, 'Good Fit'), (1, 'Potential Fit'), (2, 'No Fit')) AS n(place, label) LEFT JOIN one_label o ON o.agent_sha256 = a.agent_sha256 AND o.label = n.label GROUP BY ALL")
def judge_marginals(spark, d):
    return judge.marginals(_said(spark, d), _first(spark, d))


@query("judge_consistency", f"""WITH {_FRAMES}, joint AS MATERIALIZED (SELECT x.agent_sha256, x.run AS run_a, y.run AS run_b, x.label AS a, y.label AS b FROM said x JOIN said y ON x.agent_sha256 = y.agent_sha256 AND x.pair_id = y.pair_id AND x.run < y.run WHERE x.label IS NOT NULL AND y.label IS NOT NULL),
o AS (SELECT agent_sha256, run_a, run_b, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po FROM joint GROUP BY ALL), e AS (SELECT agent_sha256, run_a, run_b, sum(x.c * y.c) AS pe FROM (SELECT agent_sha256, run_a, run_b, a AS l, count(*) AS c FROM joint GROUP BY ALL) x JOIN (SELECT agent_sha256, run_a, run_b, b AS l, count(*) AS c FROM joint GROUP BY ALL) y USING (agent_sha256, run_a, run_b, l) GROUP BY ALL)
SELECT agent_sha256, run_a, run_b, n, round(po, 6) AS agreement, round((po - pe / CAST(n * n AS DOUBLE)) / (1 - pe / CAST(n * n AS DOUBLE)), 6) AS kappa FROM o JOIN e USING (agent_sha256, run_a, run_b)""")
def judge_consistency(spark, d):
    return judge.self_consistency(_said(spark, d))


@query("judge_classwise", f"WITH {_FRAMES} SELECT first AS label, count(*) AS n, round(avg(CASE WHEN human = first THEN 1.0 ELSE 0.0 END), 6) AS human_agrees, round(avg(CASE WHEN machine = first THEN 1.0 ELSE 0.0 END), 6) AS machine_agrees FROM three GROUP BY 1")
def judge_classwise(spark, d):
    return judge.classwise(_three(spark, d))


@query("judge_disagreements", f"WITH {_FRAMES} SELECT * FROM three WHERE NOT (first = human AND human = machine)")
def judge_disagreements(spark, d):
    return judge.disagreements(_three(spark, d))


@query("prompt_calibration", f"""WITH {_FRAMES}, joint AS MATERIALIZED (SELECT s.run AS variant, f.label AS a, s.label AS b FROM said s JOIN first f USING (pair_id) WHERE s.label IS NOT NULL), o AS (SELECT variant, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po FROM joint GROUP BY 1),
e AS (SELECT variant, sum(x.c * y.c) AS pe FROM (SELECT variant, a AS l, count(*) AS c FROM joint GROUP BY ALL) x JOIN (SELECT variant, b AS l, count(*) AS c FROM joint GROUP BY ALL) y USING (variant, l) GROUP BY 1), k AS (SELECT variant, n, round(po, 6) AS agreement, round((po - pe / CAST(n * n AS DOUBLE)) / (1 - pe / CAST(n * n AS DOUBLE)), 6) AS kappa FROM o JOIN e USING (variant))
SELECT *, CAST(row_number() OVER (ORDER BY kappa DESC, variant) AS INTEGER) AS place FROM k""")
def prompt_calibration(spark, d):
    said = _said(spark, d).filter("label is not null").withColumnRenamed("run", "variant")
    return judge.calibration(said, _first(spark, d))


_MESSAGE = "'" + judge.PROMPT[0].replace("\n", "' || chr(10) || '") + "' || q.text || '" + judge.PROMPT[1].replace("\n", "' || chr(10) || '") + "' || 'candidate ' || t.doc_id || '" + judge.PROMPT[2].replace("\n", "' || chr(10) || '") + "'"


@query("prompt_dispatch", f"WITH {R.SQL_TEST}, p AS (SELECT t.query_id || '__' || t.doc_id AS pair_id, {_MESSAGE} AS prompt FROM test_pairs t JOIN (SELECT query_id, 'query ' || query_id AS text FROM queries) q USING (query_id) WHERE t.doc_id % 4 <> 0) SELECT pair_id, 1 AS run, 'recheck' AS draw, sha256(prompt) AS prompt_sha256, CAST(length(prompt) AS INTEGER) AS chars_sent FROM p")
def prompt_dispatch(spark, d):
    """Prompts that are not in the log yet, rendered, masked and guarded."""
    t = shared.kept(R.test_pairs(spark, d), "test_pairs")
    pairs = t.select(F.concat_ws("__", "query_id", "doc_id").alias("pair_id"), "doc_id", F.concat(F.lit("query "), F.col("query_id").cast("string")).alias("query_text"), F.concat(F.lit("candidate "), F.col("doc_id").cast("string")).alias("candidate_text"))
    sent = pairs.filter("doc_id % 4 = 0").select("pair_id", F.lit(1).alias("run"), F.lit("recheck").alias("draw"))
    return judge.dispatch(pairs, sent, 1, "recheck").select("pair_id", "run", "draw", "prompt_sha256", "chars_sent")


@query("queue_report", f"""WITH {R.SQL_UNITS} SELECT stratum, CAST(batch AS BIGINT) AS batch, count(*) AS total, count(DISTINCT query_id) AS queries, CAST(round_even(0.3 * count(*), 0) AS BIGINT) AS double_target FROM units GROUP BY 1, 2""")
def queue_report(spark, d):
    """What a queue holds by stratum and batch, and how many of its pairs are to be judged twice."""
    return R.units(spark, d).groupBy("stratum", "batch").agg(F.count("*").alias("total"), F.count_distinct("query_id").alias("queries"), F.bround(F.count("*") * 0.3).cast("long").alias("double_target"))
