"""Campaign, overlay, pooling and verdict queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom import shared
from rankloom.operators import agreement, campaign, pools, sampling, scoring
from rankloom.plans import relations as R
from rankloom.plans.annotate import sql_quota
from rankloom.plans.catalog import query
from rankloom.plans.retrieval import _CELLS, _REPORT, SQL_POOLS, _cells, _pools

SPECS = [{"batch": 1, "n_queries": 6, "per_query": 4, "same_min": 3, "seed": 1}, {"batch": 2, "n_queries": 3, "per_query": 4, "same_min": 2, "seed": 2, "keywords": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]}, {"batch": 3, "n_queries": 4, "per_query": 3, "same_min": 1, "seed": 3, "deeper": True}]


def _sql_batch(k: int, spec: dict, free_q: str, free_d: str) -> str:
    s, n = spec["seed"], spec["n_queries"]
    return f"""fq{k} AS ({free_q}), fd{k} AS ({free_d}), c{k} AS (SELECT query_id, keyword FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY sha256('{s}|even|' || query_id), query_id) AS r FROM fq{k}) WHERE r <= ceil({n}.0 / (SELECT count(DISTINCT keyword) FROM fq{k})) ORDER BY query_id LIMIT {n}),
{sql_quota(str(k), f"c{k}", f"fd{k}", spec["per_query"], spec["same_min"], s)}, b{k} AS (SELECT {k} AS batch, query_id, doc_id, keyword_match, '{"targeted" if spec.get("keywords") else "generic"}' AS stratum FROM picks{k})"""


SQL_CAMPAIGN = f"""{R.SQL_CELLS}, {_sql_batch(1, SPECS[0], "SELECT query_id, keyword FROM cq", "SELECT doc_id, keyword FROM cd")},
{_sql_batch(2, SPECS[1], "SELECT query_id, keyword FROM cq WHERE keyword <= 12 AND query_id NOT IN (SELECT query_id FROM b1)", "SELECT doc_id, keyword FROM cd WHERE doc_id NOT IN (SELECT doc_id FROM b1)")},
{_sql_batch(3, SPECS[2], "SELECT query_id, keyword FROM cq WHERE query_id IN (SELECT query_id FROM b1 UNION SELECT query_id FROM b2)", "SELECT doc_id, keyword FROM cd WHERE doc_id NOT IN (SELECT doc_id FROM b1 UNION SELECT doc_id FROM b2)")},
campaign AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3)"""


def _campaign(spark, d):
    queries = R.cell_queries(spark, d).select("query_id", "keyword")
    known = {r["keyword"] for r in queries.select("keyword").distinct().collect()}  # nations
    specs = [spec | {"keywords": [k for k in spec["keywords"] if k in known]} if "keywords" in spec else spec for spec in SPECS]  # a small table lacks some
    return campaign.replay(queries, R.cell_documents(spark, d).select("doc_id", "keyword"), specs)


@query("campaign_replay", f"WITH RECURSIVE {SQL_CAMPAIGN} SELECT CAST(batch AS INTEGER) AS batch, query_id, doc_id, keyword_match, stratum FROM campaign")
def campaign_replay(spark, d):
    return _campaign(spark, d)


@query("campaign_holdout", f"WITH RECURSIVE {SQL_CAMPAIGN} SELECT 'query' AS kind, query_id AS id FROM (SELECT DISTINCT query_id FROM campaign) UNION ALL SELECT 'document', doc_id FROM (SELECT doc_id FROM cd WHERE keyword IN (SELECT keyword FROM cq WHERE query_id IN (SELECT query_id FROM campaign)) UNION SELECT doc_id FROM campaign)")
def campaign_holdout(spark, d):
    return campaign.holdout(shared.kept(_campaign(spark, d), "campaign"), R.cell_queries(spark, d).select("query_id", "keyword"), R.cell_documents(spark, d).select("doc_id", "keyword"))


@query("stratum_summary", f"""WITH RECURSIVE {SQL_CAMPAIGN}, per AS (SELECT stratum, batch, query_id, count(*) AS n, count(*) FILTER (WHERE keyword_match) AS m FROM campaign GROUP BY 1, 2, 3)
SELECT c.stratum, count(*) AS pairs, count(DISTINCT doc_id) AS documents, round(avg(CASE WHEN keyword_match THEN 1.0 ELSE 0.0 END), 6) AS match_rate, any_value(batches) AS batches, any_value(queries) AS queries, any_value(missing) AS missing, any_value(short_same) AS short_same
FROM campaign c JOIN (SELECT stratum, count(DISTINCT batch) AS batches, count(*) AS queries, CAST(sum(4 - n) AS BIGINT) AS missing, count(*) FILTER (WHERE m < 2) AS short_same FROM per GROUP BY 1) p ON p.stratum = c.stratum GROUP BY c.stratum""")
def stratum_summary(spark, d):
    return sampling.stratum_summary(shared.kept(_campaign(spark, d), "campaign"), 4, 2)


@query("judgement_overlay", f"""WITH {SQL_POOLS}, j AS (SELECT query_id, doc_id, 'potential' AS relevance FROM pools WHERE pool_variant = 'N20' AND source = 'distractor' AND doc_id % 4 = 0)
SELECT pool_variant, p.query_id, p.doc_id, coalesce(j.relevance, p.relevance) AS relevance, CASE WHEN j.relevance IS NOT NULL THEN 'judgement' ELSE source END AS label_source FROM pools p LEFT JOIN j ON j.query_id = p.query_id AND j.doc_id = p.doc_id""")
def judgement_overlay(spark, d):
    made = _pools(spark, d)
    extra = made.filter("pool_variant = 'N20' and source = 'distractor' and doc_id % 4 = 0").select("query_id", "doc_id", F.lit("potential").alias("relevance"))
    return campaign.overlay(made, extra).select("pool_variant", "query_id", "doc_id", "relevance", "label_source")


def _sql_drawn(seed: int) -> str:
    return f"round(('0x' || substr(sha256('{seed}|' || query_id || '|' || doc_id), 1, 8))::UBIGINT / 4294967296.0::DOUBLE, 6)"


@query("union_pooling", f"""WITH {R.SQL_TEST}, s AS (SELECT 'a' AS model, query_id, doc_id, {_sql_drawn(1)} AS score FROM test_pairs UNION ALL SELECT 'b', query_id, doc_id, {_sql_drawn(2)} FROM test_pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, doc_id) AS rn FROM s) SELECT query_id, doc_id, string_agg(model, ',' ORDER BY model) AS surfaced_by, min(rn) AS best_rank FROM r WHERE rn <= 3 GROUP BY 1, 2""")
def union_pooling(spark, d):
    pairs = R.test_pairs(spark, d)
    both = scoring.random_scores(pairs, 1).withColumn("model", F.lit("a")).unionByName(scoring.random_scores(pairs, 2).withColumn("model", F.lit("b")))
    return campaign.union_pool(both, 3)


@query("rank_correlation", """WITH v AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0::DOUBLE AS b FROM part) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM v""")
def rank_correlation(spark, d):
    return campaign.rank_correlation(R.table(spark, d, "part").select(F.col("p_size").alias("a"), F.col("p_retailprice").alias("b")))


@query("floor_verdicts", f"""WITH {_REPORT}, f AS (SELECT max(c) / CAST(sum(c) AS DOUBLE) AS s FROM (SELECT count(*) AS c FROM pairs GROUP BY label)), o AS (SELECT (SELECT round(sum(CASE WHEN truth = predicted THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) FROM cells) AS accuracy, (SELECT round(avg(f1), 6) FROM report) AS macro_f1)
SELECT 'second' AS model, accuracy, macro_f1, accuracy > round(s, 6) AS beats_accuracy, macro_f1 > round(2 * s / (1 + s) / 3, 6) AS beats_macro_f1 FROM o CROSS JOIN f""")
def floor_verdicts(spark, d):
    report = agreement.overall(_cells(spark, d)).withColumn("model", F.lit("second"))
    return campaign.floor_verdicts(report, agreement.majority_floor(R.pairs(spark, d)))


_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


@query("local_tfidf", f"""WITH {R.SQL_TEST}, docs AS (SELECT t.query_id, 'd' || t.doc_id AS d, d.text FROM test_pairs t JOIN documents d USING (doc_id) UNION ALL SELECT query_id, 'q', text FROM queries WHERE query_id IN (SELECT query_id FROM test_pairs)),
tf AS (SELECT query_id, d, term, count(*) AS tf FROM (SELECT query_id, d, unnest({_TOK.format("text")}) AS term FROM docs) GROUP BY 1, 2, 3), n AS (SELECT query_id, count(*) AS n FROM docs GROUP BY 1), df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
w AS (SELECT tf.query_id, d, tf.term, tf * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN df ON df.query_id = tf.query_id AND df.term = tf.term JOIN n ON n.query_id = tf.query_id), u AS (SELECT query_id, d, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id, d)) AS w FROM w)
SELECT t.query_id, t.doc_id, round(coalesce(sum(a.w * b.w), 0.0), 6) AS score FROM test_pairs t LEFT JOIN u a ON a.query_id = t.query_id AND a.d = 'd' || t.doc_id LEFT JOIN u b ON b.query_id = t.query_id AND b.d = 'q' AND b.term = a.term GROUP BY 1, 2""")
def local_tfidf(spark, d):
    q, docs = R.queries(spark, d).withColumnRenamed("text", "query_text"), R.documents(spark, d)
    candidates = R.test_pairs(spark, d).join(q, "query_id").join(docs, "doc_id").select("query_id", "query_text", "doc_id", "text")
    return scoring.local_tfidf(candidates)


@query("relevance_map", f"WITH {_CELLS} SELECT label, CASE label WHEN 'Good Fit' THEN 'good' WHEN 'Potential Fit' THEN 'potential' ELSE 'none' END AS relevance, CASE label WHEN 'Good Fit' THEN 2 WHEN 'Potential Fit' THEN 1 ELSE 0 END AS gain, count(*) AS n FROM pairs GROUP BY 1")
def relevance_map(spark, d):
    rel = pools.relevance(F.col("label"))
    gain = F.when(rel == "good", 2).when(rel == "potential", 1).otherwise(0)
    return R.pairs(spark, d).groupBy("label").agg(F.count("*").alias("n")).select("label", rel.alias("relevance"), gain.alias("gain"), "n")
