"""Split, pool, scoring and evaluation queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom import shared
from rankloom.functions import text
from rankloom.operators import agreement, evaluation, pools, scoring, splits
from rankloom.plans import relations as R
from rankloom.plans.catalog import query

# --- splits ----------------------------------------------------------------

_ID = "sha256(trim(regexp_replace(text, '[\\t-\\r\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')))"
_MINTED = f"minted AS (SELECT query_id, 'r_' || substr({_ID}, 1, 12) AS resume_id, p.label FROM pairs p JOIN documents d USING (doc_id))"


def _minted(spark, d) -> DataFrame:
    from rankloom.functions.text import mint_id

    docs = R.documents(spark, d).select("doc_id", mint_id(F.col("text"), "r_").alias("resume_id"))
    return R.pairs(spark, d).join(docs, "doc_id").select("query_id", "resume_id", "label")


@query("conflict_pairs", f"""WITH {R.SQL_PAIRS}, {_MINTED} SELECT query_id, resume_id, count(*) AS rows, string_agg(DISTINCT label, ' | ' ORDER BY label) AS labels,
  CASE WHEN count(DISTINCT label) > 1 THEN 'dropped: labels conflict' ELSE 'kept one' END AS resolution FROM minted GROUP BY 1, 2 HAVING count(*) > 1""")
def conflict_pairs(spark, d):
    return splits.conflicts(_minted(spark, d), "query_id", "resume_id")


@query("pool_clean_pairs", f"WITH {R.SQL_PAIRS}, {_MINTED} SELECT query_id, resume_id, min(label) AS label FROM minted GROUP BY 1, 2 HAVING count(DISTINCT label) = 1")
def pool_clean_pairs(spark, d):
    return splits.resolve(_minted(spark, d), "query_id", "resume_id")


@query("doc_split", f"WITH {R.SQL_SPLITS} SELECT doc_id, split FROM doc_split")
def doc_split(spark, d):
    return R.doc_split(spark, d)


@query("pair_split", f"WITH {R.SQL_SPLIT_PAIRS} SELECT query_id, doc_id, label, split FROM split_pairs")
def pair_split(spark, d):
    return R.split_pairs(spark, d).select("query_id", "doc_id", "label", "split")


@query("split_summary", f"""WITH {R.SQL_SPLIT_PAIRS}, q AS (SELECT split, query_id, count(*) AS n, count(*) FILTER (WHERE label = 'Good Fit') AS p FROM split_pairs GROUP BY 1, 2)
SELECT q.split, CAST(sum(n) AS BIGINT) AS pairs, count(*) AS queries, count(*) FILTER (WHERE p > 0) AS queries_with_positive, CAST(sum(p) AS BIGINT) AS positives,
  CAST(floor(median(CASE WHEN p > 0 THEN p END)) AS BIGINT) AS median_positives, any_value(documents) AS documents
FROM q JOIN (SELECT split, count(DISTINCT doc_id) AS documents FROM split_pairs GROUP BY 1) d ON q.split = d.split GROUP BY q.split""")
def split_summary(spark, d):
    return splits.summary(R.split_pairs(spark, d), "doc_id", "query_id")


@query("cv_folds", f"""WITH {R.SQL_PAIRS},
a AS (SELECT doc_id, (row_number() OVER (ORDER BY sha256('0|fold-doc_id|' || doc_id), doc_id) - 1) % 5 AS b FROM (SELECT DISTINCT doc_id FROM pairs)),
q AS (SELECT query_id, (row_number() OVER (ORDER BY sha256('0|fold-query_id|' || query_id), query_id) - 1) % 5 AS b FROM (SELECT DISTINCT query_id FROM pairs)),
x AS (SELECT f.fold, a.b = f.fold AS i, q.b = f.fold AS j FROM pairs JOIN a USING (doc_id) JOIN q USING (query_id) CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f)
SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (WHERE NOT i AND NOT j) AS fit, count(*) FILTER (WHERE i AND j) AS eval, count(*) FILTER (WHERE i <> j) AS unused FROM x GROUP BY fold""")
def cv_folds(spark, d):
    return splits.folds(R.pairs(spark, d), "doc_id", "query_id", 5, R.SEED)


@query("split_survey", f"""WITH {R.SQL_PAIRS}, grid AS (SELECT f.fraction, s.seed FROM (SELECT unnest([0.1, 0.2, 0.3]::DOUBLE[]) AS fraction) f CROSS JOIN (SELECT unnest([0, 1, 2]) AS seed) s),
a AS (SELECT fraction, seed, doc_id FROM (SELECT g.*, doc_id, count(*) OVER (PARTITION BY fraction, seed) AS n, row_number() OVER (PARTITION BY fraction, seed ORDER BY sha256(seed || '|survey-doc_id|' || doc_id), doc_id) AS r FROM (SELECT DISTINCT doc_id FROM pairs) CROSS JOIN grid g) WHERE r <= round_even(n * fraction, 0)),
q AS (SELECT fraction, seed, query_id FROM (SELECT g.*, query_id, count(*) OVER (PARTITION BY fraction, seed) AS n, row_number() OVER (PARTITION BY fraction, seed ORDER BY sha256(seed || '|survey-query_id|' || query_id), query_id) AS r FROM (SELECT DISTINCT query_id FROM pairs) CROSS JOIN grid g) WHERE r <= round_even(n * fraction, 0)),
c AS (SELECT a.fraction, a.seed, count(*) AS n FROM pairs p JOIN a USING (doc_id) JOIN q ON q.query_id = p.query_id AND q.fraction = a.fraction AND q.seed = a.seed GROUP BY 1, 2)
SELECT g.fraction, round(avg(coalesce(n, 0)), 6) AS mean_pairs, min(coalesce(n, 0)) AS min_pairs, max(coalesce(n, 0)) AS max_pairs FROM grid g LEFT JOIN c ON g.fraction = c.fraction AND g.seed = c.seed GROUP BY g.fraction""")
def split_survey(spark, d):
    return splits.survey(R.pairs(spark, d), "doc_id", "query_id", [0.1, 0.2, 0.3], [0, 1, 2])


# --- pools -----------------------------------------------------------------

SQL_POOLS = f"""{R.SQL_TEST}, judged AS (SELECT query_id, count(*) AS j FROM test_pairs GROUP BY 1), universe AS (SELECT doc_id FROM doc_split WHERE split = 'test'),
ranked AS (SELECT g.query_id, u.doc_id, g.j, row_number() OVER (PARTITION BY g.query_id ORDER BY sha256('0|' || g.query_id || '|' || u.doc_id), u.doc_id) AS r FROM universe u CROSS JOIN judged g ANTI JOIN test_pairs t ON t.query_id = g.query_id AND t.doc_id = u.doc_id),
variants AS (SELECT * FROM (VALUES ('N20', 20), ('N100', 100), ('Nfull', NULL)) AS v(pool_variant, target)),
pools AS (SELECT query_id, doc_id, CASE label WHEN 'Good Fit' THEN 'good' WHEN 'Potential Fit' THEN 'potential' ELSE 'none' END AS relevance, 'labelled' AS source, pool_variant FROM test_pairs CROSS JOIN variants
  UNION ALL SELECT query_id, doc_id, 'none', 'distractor', pool_variant FROM ranked CROSS JOIN variants WHERE target IS NULL OR r <= target - j)"""


def _pools(spark, d) -> DataFrame:
    universe = R.doc_split(spark, d).filter("split = 'test'")
    return pools.build(R.test_pairs(spark, d), universe, R.SEED)


@query("pools_nested", f"WITH {SQL_POOLS} SELECT query_id, doc_id, relevance, source, pool_variant FROM pools")
def pools_nested(spark, d):
    return _pools(spark, d)


@query("pools_with_text", f"WITH {SQL_POOLS} SELECT pool_variant, count(*) AS n, CAST(sum(length(d.text)) AS BIGINT) AS doc_chars, CAST(sum(length(q.text)) AS BIGINT) AS query_chars FROM pools JOIN documents d USING (doc_id) JOIN queries q USING (query_id) GROUP BY 1")
def pools_with_text(spark, d):
    full = pools.with_texts(_pools(spark, d), R.queries(spark, d), R.documents(spark, d))
    return full.groupBy("pool_variant").agg(F.count("*").alias("n"), F.sum(F.length("doc_text")).alias("doc_chars"), F.sum(F.length("query_text")).alias("query_chars"))


@query("pool_summary", f"""WITH {SQL_POOLS}, x AS (SELECT pool_variant, query_id, count(*) AS depth, count(*) FILTER (WHERE source = 'labelled') AS l FROM pools GROUP BY 1, 2)
SELECT pool_variant, count(*) AS queries, CAST(sum(depth) AS BIGINT) AS n_rows, min(depth) AS min_depth, max(depth) AS max_depth, CAST(floor(median(depth)) AS BIGINT) AS median_depth, CAST(sum(l) AS BIGINT) AS labelled, CAST(sum(depth - l) AS BIGINT) AS distractors FROM x GROUP BY 1""")
def pool_summary(spark, d):
    return pools.summary(_pools(spark, d))


SQL_RELEVANT = f"""{SQL_POOLS}, counts AS (SELECT pool_variant, query_id, count(*) FILTER (WHERE relevance = 'good') AS s, count(*) FILTER (WHERE relevance <> 'none') AS g FROM pools GROUP BY 1, 2),
relevant AS (SELECT pool_variant, query_id, 'strict' AS definition, s AS r FROM counts WHERE s > 0 UNION ALL SELECT pool_variant, query_id, 'graded', g FROM counts WHERE g > 0)"""


@query("attainability", f"""WITH {SQL_RELEVANT}, c AS (SELECT *, least(k, r) / CAST(r AS DOUBLE) AS cap FROM relevant CROSS JOIN (SELECT unnest([5, 10, 20, 50]) AS k))
SELECT pool_variant, definition, k, count(*) AS n, round(median(cap), 6) AS median_cap, round(avg(CASE WHEN cap >= 0.9 THEN 1.0 ELSE 0.0 END), 6) AS share_90, round(avg(CASE WHEN cap = 1 THEN 1.0 ELSE 0.0 END), 6) AS share_full FROM c GROUP BY 1, 2, 3""")
def attainability(spark, d):
    return pools.attainability(_pools(spark, d))


@query("ceilings", f"""WITH {SQL_RELEVANT} SELECT pool_variant, definition, k, count(*) AS n, round(avg(least(k, r) / CAST(k AS DOUBLE)), 6) AS precision_ceiling, round(avg(least(k, r) / CAST(r AS DOUBLE)), 6) AS recall_ceiling,
  count(*) FILTER (WHERE r >= k) AS can_be_full, CAST(sum(k - least(k, r)) AS BIGINT) AS unwinnable, CAST(sum(k) AS BIGINT) AS slots FROM relevant CROSS JOIN (SELECT unnest([5, 10]) AS k) GROUP BY 1, 2, 3""")
def ceilings(spark, d):
    return pools.ceilings(_pools(spark, d))


# --- scoring ---------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')".replace("{{", "{").replace("}}", "}")


def _sql_terms(name: str, source: str, ident: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT {ident}, term, count(*) AS tf FROM (SELECT {ident}, unnest({_TOKENS}) AS term FROM {source}) GROUP BY 1, 2)"


_SQL_STATS = f"""{_sql_terms("dt", "documents", "doc_id")}, sized AS MATERIALIZED (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM dt) / CAST((SELECT count(*) FROM documents) AS DOUBLE) AS avgdl),
counted AS MATERIALIZED (SELECT term, count(*) AS df FROM dt GROUP BY 1), raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM counted CROSS JOIN sized), mean AS MATERIALIZED (SELECT avg(raw) AS m FROM raw),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw CROSS JOIN mean)"""


@query("bm25_stats", f"WITH {_SQL_STATS} SELECT term, df, round(idf, 5) AS idf FROM idf")
def bm25_stats(spark, d):
    idf, _ = scoring.bm25_statistics(R.documents(spark, d), "doc_id")
    return idf.select("term", "df", F.round("idf", 5).alias("idf"))


def _sql_bm25(pairs: str) -> str:
    return f"""{_SQL_STATS}, {_sql_terms("qt", "queries", "query_id")}, dl AS (SELECT doc_id, sum(tf) AS dl FROM dt GROUP BY 1),
bm25 AS (SELECT p.query_id, p.doc_id, round(coalesce(sum(q.tf * i.idf * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * l.dl / avgdl))), 0.0), 6) AS score
  FROM (SELECT DISTINCT query_id, doc_id FROM {pairs}) p CROSS JOIN sized LEFT JOIN qt q USING (query_id) LEFT JOIN dt t ON t.doc_id = p.doc_id AND t.term = q.term LEFT JOIN idf i ON i.term = t.term LEFT JOIN dl l ON l.doc_id = p.doc_id GROUP BY 1, 2)"""


@query("bm25_scores", f"WITH {R.SQL_TEST}, {_sql_bm25('test_pairs')} SELECT query_id, doc_id, score FROM bm25")
def bm25_scores(spark, d):
    return scoring.bm25(shared.kept(R.test_pairs(spark, d), "test_pairs"), R.queries(spark, d), R.documents(spark, d))


_STOP = ", ".join(f"'{w}'" for w in scoring.STOP_WORDS)


def _sql_grams(name: str, source: str, ident: str) -> str:
    return f"""{name}_w AS (SELECT {ident}, term, row_number() OVER (PARTITION BY {ident} ORDER BY i) AS i FROM (SELECT {ident}, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM (SELECT {ident}, {_TOKENS} AS t FROM {source})) WHERE term NOT IN ({_STOP})),
{name} AS (SELECT {ident}, term, count(*) AS tf FROM (SELECT {ident}, term FROM {name}_w UNION ALL SELECT a.{ident}, a.term || ' ' || b.term FROM {name}_w a JOIN {name}_w b ON a.{ident} = b.{ident} AND b.i = a.i + 1) GROUP BY 1, 2)"""


_SQL_VOCAB = f"""fit AS (SELECT 'q' || item_id AS id, text FROM benchmark UNION ALL SELECT 'd' || doc_id, text FROM documents), {_sql_grams("ft", "fit", "id")},
vocab AS (SELECT term, df, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS cf, (SELECT count(*) FROM fit) AS n FROM ft GROUP BY 1) WHERE df >= 2 AND df <= 0.8 * n ORDER BY cf DESC, term LIMIT 5000)"""


def _fit(spark, d) -> DataFrame:
    q = R.queries(spark, d).select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("id"), "text")
    return q.unionByName(R.documents(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text"))


@query("tfidf_vocab", f"WITH {_SQL_VOCAB} SELECT term, df, round(idf, 6) AS idf FROM vocab")
def tfidf_vocab(spark, d):
    return scoring.tfidf_vocabulary(_fit(spark, d), "id").select("term", "df", F.round("idf", 6).alias("idf"))


def _sql_cosine(pairs: str) -> str:
    return f"""{_SQL_VOCAB}, w AS (SELECT id, term, tf * idf AS w FROM ft JOIN vocab USING (term)), unit AS MATERIALIZED (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
cosine AS (SELECT p.query_id, p.doc_id, round(coalesce(sum(a.w * b.w), 0.0), 6) AS score FROM (SELECT DISTINCT query_id, doc_id FROM {pairs}) p LEFT JOIN unit a ON a.id = 'q' || p.query_id LEFT JOIN unit b ON b.id = 'd' || p.doc_id AND b.term = a.term GROUP BY 1, 2)"""


_SQL_COSINE = _sql_cosine("test_pairs")


@query("tfidf_cosine", f"WITH {R.SQL_TEST}, {_SQL_COSINE} SELECT query_id, doc_id, score FROM cosine")
def tfidf_cosine(spark, d):
    vocabulary = scoring.tfidf_vocabulary(_fit(spark, d), "id")
    return scoring.tfidf_cosine(shared.kept(R.test_pairs(spark, d), "test_pairs"), R.queries(spark, d), R.documents(spark, d), vocabulary)


_SQL_RANDOM = "SELECT query_id, doc_id, round(('0x' || substr(sha256('7|' || query_id || '|' || doc_id), 1, 8))::UBIGINT / 4294967296.0::DOUBLE, 6) AS score FROM (SELECT DISTINCT query_id, doc_id FROM pools)"


def _random(spark, d) -> DataFrame:
    return scoring.random_scores(_pools(spark, d), 7)


@query("random_scores", f"WITH {SQL_POOLS} {_SQL_RANDOM}")
def random_scores(spark, d):
    return _random(spark, d)


# --- ranking and metrics ---------------------------------------------------

SQL_RANKED = f"""{SQL_POOLS}, random_scores AS ({_SQL_RANDOM}),
ranked_pools AS (SELECT p.*, s.score, row_number() OVER (PARTITION BY pool_variant, p.query_id ORDER BY s.score DESC NULLS LAST, p.doc_id) AS rn FROM pools p LEFT JOIN random_scores s USING (query_id, doc_id))"""


def _ranked(spark, d) -> DataFrame:
    made = shared.kept(_pools(spark, d), "pools")
    return shared.kept(evaluation.rank(made, scoring.random_scores(made, 7)), "ranked")


@query("rank_pool", f"WITH {SQL_RANKED} SELECT pool_variant, query_id, doc_id, score, rn FROM ranked_pools WHERE rn <= 10")
def rank_pool(spark, d):
    return evaluation.top_k(_ranked(spark, d), 10).select("pool_variant", "query_id", "doc_id", "score", "rn")


def _sql_metrics(ranked: str, by: str) -> str:
    return f"""graded AS (SELECT {by}, doc_id, rn, gain, row_number() OVER (PARTITION BY {by} ORDER BY gain DESC, doc_id) AS ideal FROM (SELECT {by}, doc_id, rn, CASE relevance WHEN 'good' THEN 2 WHEN 'potential' THEN 1 ELSE 0 END AS gain FROM {ranked})),
gains AS (SELECT *, CASE WHEN definition = 'strict' THEN gain = 2 ELSE gain > 0 END AS rel FROM graded CROSS JOIN (VALUES ('strict'), ('graded')) AS v(definition)),
metrics AS MATERIALIZED (SELECT {by}, definition, count(*) FILTER (WHERE rel AND rn <= 10) / CAST(count(*) FILTER (WHERE rel) AS DOUBLE) AS recall, count(*) FILTER (WHERE rel AND rn <= 5) / 5.0::DOUBLE AS precision,
  sum(CASE WHEN rn <= 10 THEN gain / log2(rn + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 10 THEN gain / log2(ideal + 1) ELSE 0 END) AS ndcg FROM gains GROUP BY ALL HAVING count(*) FILTER (WHERE rel) > 0)"""


def _sql_interval(name: str, source: str, by: str, draws: int = 10_000) -> str:
    """name(by, mean, n, ci_low, ci_high) over source(by, unit, value)."""
    return f"""{name}_v AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
{name}_x AS MATERIALIZED (SELECT n, d, CAST(('0x' || substr(sha256('0|' || d || '|' || p), 1, 8))::UBIGINT AS BIGINT) % n AS i FROM (SELECT n, d, unnest(range(n)) AS p FROM (SELECT DISTINCT n FROM {name}_v) CROSS JOIN (SELECT unnest(range({draws})) AS d))),
{name}_m AS (SELECT {by}, d, avg(value) AS m FROM {name}_x JOIN {name}_v USING (n, i) GROUP BY ALL),
{name}_c AS (SELECT {by}, round(quantile_cont(m, 0.025), 5) AS ci_low, round(quantile_cont(m, 0.975), 5) AS ci_high FROM {name}_m GROUP BY ALL),
{name} AS (SELECT {by}, round(mean, 5) AS mean, n, ci_low, ci_high FROM (SELECT {by}, avg(value) AS mean, count(*) AS n FROM {name}_v GROUP BY ALL) JOIN {name}_c USING ({by}))"""


_SQL_QM = f"{SQL_RANKED}, {_sql_metrics('ranked_pools', 'pool_variant, query_id')}"


@query("query_metrics", f"WITH {_SQL_QM} SELECT pool_variant, query_id, definition, round(recall, 6) AS recall, round(precision, 6) AS precision, round(ndcg, 6) AS ndcg FROM metrics")
def query_metrics(spark, d):
    return evaluation.query_metrics(_ranked(spark, d), places=6)


def _one_metric(name: str):
    @query(name, f"WITH {_SQL_QM} SELECT pool_variant, definition, round(avg({name.split('_')[0]}), 5) AS value, count(*) AS n_queries FROM metrics GROUP BY 1, 2")
    def metric(spark, d):
        m = evaluation.query_metrics(_ranked(spark, d))
        return m.groupBy("pool_variant", "definition").agg(F.round(F.avg(name.split("_")[0]), 5).alias("value"), F.count("*").alias("n_queries"))

    return metric


recall_at_k, precision_at_k, ndcg_at_k = map(_one_metric, ("recall_at_k", "precision_at_k", "ndcg_at_k"))


@query("metric_grid", f"""WITH {R.SQL_TEST}, {_sql_bm25("test_pairs")}, {_SQL_COSINE},
scored AS (SELECT 'bm25' AS model, * FROM bm25 UNION ALL SELECT 'tfidf', * FROM cosine UNION ALL SELECT 'random', query_id, doc_id, round(('0x' || substr(sha256('7|' || query_id || '|' || doc_id), 1, 8))::UBIGINT / 4294967296.0::DOUBLE, 6) FROM test_pairs),
ranked AS (SELECT model, s.query_id, s.doc_id, CASE label WHEN 'Good Fit' THEN 'good' WHEN 'Potential Fit' THEN 'potential' ELSE 'none' END AS relevance, row_number() OVER (PARTITION BY model, s.query_id ORDER BY score DESC, s.doc_id) AS rn FROM scored s JOIN test_pairs t ON t.query_id = s.query_id AND t.doc_id = s.doc_id),
{_sql_metrics("ranked", "model, query_id")}, long AS (UNPIVOT metrics ON recall, precision, ndcg INTO NAME metric VALUE value)
SELECT model, definition, metric, round(avg(value), 5) AS value, count(*) AS n_queries FROM long GROUP BY 1, 2, 3""")
def metric_grid(spark, d):
    pairs = shared.kept(R.test_pairs(spark, d), "test_pairs")
    scored = _scores(spark, d, pairs).unionByName(scoring.random_scores(pairs, 7).withColumn("model", F.lit("random")))
    judged = pairs.select("query_id", "doc_id", pools.relevance(F.col("label")).alias("relevance"))
    ranked = evaluation.rank(judged, scored, ("model", "query_id"))
    return evaluation.grid(evaluation.query_metrics(ranked, ("model", "query_id")), ("model",))


def _scores(spark, d, pairs: DataFrame, dense: bool = False) -> DataFrame:
    """model, query_id, doc_id, score of both lexical models."""
    q, docs = R.queries(spark, d), R.documents(spark, d)
    lexical = scoring.bm25(pairs, q, docs, dense=dense).withColumn("model", F.lit("bm25"))
    return lexical.unionByName(scoring.tfidf_cosine(pairs, q, docs, scoring.tfidf_vocabulary(_fit(spark, d), "id"), dense=dense).withColumn("model", F.lit("tfidf")))


_SQL_POOL_RANKED = f"""{SQL_POOLS}, made AS MATERIALIZED (SELECT * FROM pools), every AS MATERIALIZED (SELECT query_id, doc_id FROM made WHERE pool_variant = 'Nfull'), {_sql_bm25("every")}, {_sql_cosine("every")},
scored AS MATERIALIZED (SELECT 'bm25' AS model, * FROM bm25 UNION ALL SELECT 'tfidf', * FROM cosine UNION ALL SELECT 'random', query_id, doc_id, round(('0x' || substr(sha256('7|' || query_id || '|' || doc_id), 1, 8))::UBIGINT / 4294967296.0::DOUBLE, 6) FROM every),
pool_ranked AS MATERIALIZED (SELECT model, p.*, row_number() OVER (PARTITION BY model, pool_variant, p.query_id ORDER BY score DESC, p.doc_id) AS rn FROM made p JOIN scored s ON s.query_id = p.query_id AND s.doc_id = p.doc_id)"""


def _pool_ranked(spark, d) -> DataFrame:
    """Every pool ranked by each model; pairs are scored once, in the deepest variant, and the smaller ones are within it."""
    made = shared.kept(_pools(spark, d), "pools")
    evaluation.require_depth(made, 10)
    every = shared.kept(made.filter("pool_variant = 'Nfull'").select("query_id", "doc_id"), "deepest")
    scored = _scores(spark, d, every, dense=True).unionByName(scoring.random_scores(every, 7).withColumn("model", F.lit("random")))
    models = spark.createDataFrame([(m,) for m in ("bm25", "tfidf", "random")], "model string")  # three rows
    return shared.kept(evaluation.rank(made.crossJoin(models), scored, ("model", "pool_variant", "query_id")), "pool_ranked")


@query("pool_grid", f"""WITH {_SQL_POOL_RANKED}, {_sql_metrics("pool_ranked", "model, pool_variant, query_id")}, long AS (SELECT model, pool_variant, definition, metric, query_id AS unit, value FROM (UNPIVOT metrics ON recall, precision, ndcg INTO NAME metric VALUE value)),
{_sql_interval("grid", "long", "model, pool_variant, definition, metric")} SELECT model, pool_variant, definition, metric, mean AS value, n AS n_queries, ci_low, ci_high FROM grid""")
def pool_grid(spark, d):
    """All figures over pools: model, metric, definition and variant, with the number of queries and the interval over them."""
    return evaluation.figures(evaluation.query_metrics(_pool_ranked(spark, d), ("model", "pool_variant", "query_id")), ("model", "pool_variant"))


@query("pool_exposure", f"""WITH {_SQL_POOL_RANKED}, s AS (SELECT model, pool_variant, query_id AS unit, count(*) FILTER (WHERE source = 'distractor') / 5.0::DOUBLE AS value FROM pool_ranked WHERE rn <= 5 GROUP BY 1, 2, 3), {_sql_interval("grid", "s", "model, pool_variant")} SELECT * FROM grid""")
def pool_exposure(spark, d):
    return evaluation.exposure_interval(_pool_ranked(spark, d), 5, ("model", "pool_variant"))


@query("ceiling_interval", f"""WITH {SQL_RELEVANT}, s AS (SELECT pool_variant, definition, query_id AS unit, least(5, r) / 5.0::DOUBLE AS value FROM relevant), {_sql_interval("grid", "s", "pool_variant, definition")} SELECT * FROM grid""")
def ceiling_interval(spark, d):
    return pools.ceiling_interval(shared.kept(_pools(spark, d), "pools"), "precision", 5)


@query("metric_slice", f"""WITH {R.SQL_TEST}, {_sql_bm25("test_pairs")},
ranked AS (SELECT b.query_id, b.doc_id, CASE label WHEN 'Good Fit' THEN 'good' WHEN 'Potential Fit' THEN 'potential' ELSE 'none' END AS relevance, row_number() OVER (PARTITION BY b.query_id ORDER BY score DESC, b.doc_id) AS rn FROM bm25 b JOIN test_pairs t ON t.query_id = b.query_id AND t.doc_id = b.doc_id),
{_sql_metrics("ranked", "query_id")} SELECT query_id, definition, round(recall, 6) AS recall, round(precision, 6) AS precision, round(ndcg, 6) AS ndcg FROM metrics""")
def metric_slice(spark, d):
    pairs = shared.kept(R.test_pairs(spark, d), "test_pairs")
    judged = pairs.select("query_id", "doc_id", pools.relevance(F.col("label")).alias("relevance"))
    return evaluation.query_metrics(evaluation.rank(judged, scoring.bm25(pairs, R.queries(spark, d), R.documents(spark, d)), ("query_id",)), ("query_id",), places=6)


@query("topk_exposure", f"""WITH {SQL_RANKED}, t AS (SELECT pool_variant, query_id, count(*) FILTER (WHERE relevance = 'good') AS a, count(*) FILTER (WHERE relevance <> 'none') AS b, count(*) FILTER (WHERE relevance = 'none' AND source = 'labelled') AS c, count(*) FILTER (WHERE source = 'distractor') AS e FROM ranked_pools WHERE rn <= 5 GROUP BY 1, 2)
SELECT pool_variant, CAST(sum(a) AS BIGINT) AS judged_relevant_strict, CAST(sum(b) AS BIGINT) AS judged_relevant_graded, CAST(sum(c) AS BIGINT) AS judged_none, CAST(sum(e) AS BIGINT) AS unjudged_distractor, count(*) * 5 AS total_slots, round(avg(e / 5.0::DOUBLE), 6) AS distractor_share FROM t GROUP BY 1""")
def topk_exposure(spark, d):
    return evaluation.exposure(_ranked(spark, d), 5, ("pool_variant",))


@query("attainable_share", f"""WITH {_SQL_QM}, {", ".join(SQL_RELEVANT.split(", counts AS")[1:]).join(["counts AS", ""])}
SELECT m.pool_variant, m.definition, m.value, c.ceiling, round(m.value / c.ceiling, 6) AS share_of_ceiling FROM (SELECT pool_variant, definition, round(avg(precision), 5) AS value FROM metrics GROUP BY 1, 2) m
JOIN (SELECT pool_variant, definition, round(avg(least(5, r) / 5.0::DOUBLE), 6) AS ceiling FROM relevant GROUP BY 1, 2) c ON m.pool_variant = c.pool_variant AND m.definition = c.definition""")
def attainable_share(spark, d):
    made = _pools(spark, d)
    figures = evaluation.query_metrics(_ranked(spark, d)).groupBy("pool_variant", "definition").agg(F.round(F.avg("precision"), 5).alias("value"))
    best = pools.ceilings(made).filter("k = 5").select("pool_variant", "definition", F.col("precision_ceiling").alias("ceiling"))
    return evaluation.attainable_share(figures, best, ["pool_variant", "definition"])


@query("bootstrap_ci", f"""WITH {_SQL_QM}, s AS (SELECT pool_variant, definition, query_id AS unit, recall AS value FROM metrics), {_sql_interval("grid", "s", "pool_variant, definition")} SELECT * FROM grid""")
def bootstrap_ci(spark, d):
    m = evaluation.query_metrics(_ranked(spark, d))
    return evaluation.bootstrap(m.select("pool_variant", "definition", F.col("query_id").alias("unit"), F.col("recall").alias("value")), ("pool_variant", "definition"))


# --- classification and agreement ------------------------------------------

_SECOND = "CASE WHEN substr(sha256('second|' || query_id || '|' || doc_id), 1, 1) < 'a' THEN label WHEN substr(sha256('second|' || query_id || '|' || doc_id), 1, 1) < 'd' THEN 'Good Fit' ELSE 'No Fit' END"
_TWO = f"{R.SQL_PAIRS}, two AS (SELECT query_id, doc_id, label AS a, {_SECOND} AS b FROM pairs)"


def _two(spark, d) -> DataFrame:
    from rankloom.functions import order

    first = F.substring(order.digest("second", F.col("query_id"), F.col("doc_id")), 1, 1)
    b = F.when(first < "a", F.col("label")).when(first < "d", "Good Fit").otherwise("No Fit")
    return R.pairs(spark, d).select("query_id", "doc_id", F.col("label").alias("a"), b.alias("b"))


def _cells(spark, d) -> DataFrame:
    return agreement.confusion(_two(spark, d).select(F.col("a").alias("truth"), F.col("b").alias("predicted")))


_CELLS = f"""{_TWO}, names AS (SELECT unnest(['Good Fit', 'Potential Fit', 'No Fit']) AS name), cells AS (SELECT x.name AS truth, y.name AS predicted, count(t.a) AS n FROM names x CROSS JOIN names y LEFT JOIN two t ON t.a = x.name AND t.b = y.name GROUP BY 1, 2)"""
_REPORT = f"""{_CELLS}, report AS (SELECT s.label, round(CASE WHEN called = 0 THEN 0.0 ELSE tp / CAST(called AS DOUBLE) END, 6) AS precision, round(CASE WHEN support = 0 THEN 0.0 ELSE tp / CAST(support AS DOUBLE) END, 6) AS recall, round(CASE WHEN called + support = 0 THEN 0.0 ELSE 2 * tp / CAST(called + support AS DOUBLE) END, 6) AS f1, CAST(support AS BIGINT) AS support
FROM (SELECT truth AS label, sum(n) AS support, sum(CASE WHEN truth = predicted THEN n ELSE 0 END) AS tp FROM cells GROUP BY 1) s JOIN (SELECT predicted AS label, sum(n) AS called FROM cells GROUP BY 1) c ON s.label = c.label)"""


@query("confusion", f"WITH {_CELLS} SELECT truth, predicted, n FROM cells")
def confusion(spark, d):
    return _cells(spark, d)


@query("class_report", f"WITH {_REPORT} SELECT * FROM report")
def class_report(spark, d):
    return agreement.report(_cells(spark, d))


@query("overall_report", f"WITH {_REPORT} SELECT (SELECT round(sum(CASE WHEN truth = predicted THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) FROM cells) AS accuracy, (SELECT round(avg(f1), 6) FROM report) AS macro_f1, (SELECT CAST(sum(n) AS BIGINT) FROM cells) AS n")
def overall_report(spark, d):
    return agreement.overall(_cells(spark, d))


@query("majority_floor", f"""WITH {R.SQL_PAIRS}, c AS (SELECT label, count(*) / CAST((SELECT count(*) FROM pairs) AS DOUBLE) AS s FROM pairs GROUP BY 1)
SELECT label, round(s, 6) AS accuracy, round(2 * s / (1 + s) / 3, 6) AS macro_f1 FROM c ORDER BY s DESC, CASE label WHEN 'Good Fit' THEN 0 WHEN 'Potential Fit' THEN 1 ELSE 2 END LIMIT 1""")
def majority_floor(spark, d):
    return agreement.majority_floor(R.pairs(spark, d))


def _sql_kappa(source: str) -> str:
    return f"""SELECT n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po,
  coalesce((SELECT sum(x.c * y.c) FROM (SELECT a, count(*) AS c FROM {source} GROUP BY 1) x JOIN (SELECT b, count(*) AS c FROM {source} GROUP BY 1) y ON x.a = y.b), 0) / CAST(count(*) * count(*) AS DOUBLE) AS pe FROM {source})"""


@query("kappa_pairwise", f"WITH {_TWO} {_sql_kappa('two')}")
def kappa_pairwise(spark, d):
    return agreement.kappa(_two(spark, d))


@query("kappa_binary", f"WITH {_TWO}, bin AS (SELECT CASE WHEN a = 'No Fit' THEN 'not relevant' ELSE 'relevant' END AS a, CASE WHEN b = 'No Fit' THEN 'not relevant' ELSE 'relevant' END AS b FROM two) {_sql_kappa('bin')}")
def kappa_binary(spark, d):
    return agreement.kappa(_two(spark, d).select(agreement.binary(F.col("a")).alias("a"), agreement.binary(F.col("b")).alias("b")))


@query("classwise_agreement", f"WITH {_TWO} SELECT a AS label, count(*) AS n, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM two GROUP BY 1")
def classwise_agreement(spark, d):
    return agreement.classwise(_two(spark, d))


@query("majority_vote", f"""WITH {R.SQL_JUDGEMENTS}, c AS (SELECT pair_id, label, count(*) AS n FROM judgements GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS rn, lead(n) OVER w AS second, sum(n) OVER (PARTITION BY pair_id) AS n_votes FROM c WINDOW w AS (PARTITION BY pair_id ORDER BY n DESC, label))
SELECT pair_id, CASE WHEN second IS NULL OR second < n THEN label END AS label, CAST(n_votes AS BIGINT) AS n_votes FROM r WHERE rn = 1""")
def majority_vote(spark, d):
    return agreement.majority(R.judgements(spark, d), "pair_id")


@query("self_consistency", f"""WITH {R.SQL_JUDGEMENTS}, joint AS (SELECT x.batch, x.label AS a, y.label AS b FROM judgements x JOIN judgements y ON x.pair_id = y.pair_id AND x.annotator = 'ann' AND y.annotator = 'bob'),
o AS (SELECT batch, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po FROM joint GROUP BY 1), e AS (SELECT x.batch, sum(x.c * y.c) AS pe FROM (SELECT batch, a, count(*) AS c FROM joint GROUP BY 1, 2) x JOIN (SELECT batch, b, count(*) AS c FROM joint GROUP BY 1, 2) y ON x.batch = y.batch AND x.a = y.b GROUP BY 1)
SELECT o.batch, n, round(po, 6) AS agreement, round(CASE WHEN coalesce(pe, 0) / CAST(n * n AS DOUBLE) < 1 THEN (po - coalesce(pe, 0) / CAST(n * n AS DOUBLE)) / (1 - coalesce(pe, 0) / CAST(n * n AS DOUBLE)) END, 6) AS kappa FROM o LEFT JOIN e ON o.batch = e.batch""")
def self_consistency(spark, d):
    j = R.judgements(spark, d)
    one, two = j.filter("annotator = 'ann'"), j.filter("annotator = 'bob'")
    both = one.select("pair_id", "batch", F.col("label").alias("a")).join(two.select("pair_id", F.col("label").alias("b")), "pair_id")
    return agreement.kappa(both, ["batch"])


@query("fleiss_kappa", f"""WITH {R.SQL_UNITS}, v AS (SELECT pair_id, CASE WHEN substr(sha256(annotator || '|f|' || pair_id), 1, 1) < '8' THEN 'Good Fit' WHEN substr(sha256(annotator || '|f|' || pair_id), 1, 1) < 'c' THEN 'Potential Fit' ELSE 'No Fit' END AS label FROM units CROSS JOIN (VALUES ('ann'), ('bob'), ('cyd')) AS a(annotator)),
c AS (SELECT pair_id, label, count(*) AS n FROM v GROUP BY 1, 2), p AS (SELECT pair_id, (sum(n * n) - sum(n)) / CAST(sum(n) * (sum(n) - 1) AS DOUBLE) AS p, sum(n) AS r FROM c GROUP BY 1), t AS (SELECT label, sum(n) / CAST((SELECT sum(n) FROM c) AS DOUBLE) AS s FROM c GROUP BY 1), e AS (SELECT sum(s * s) AS pe FROM t)
SELECT count(*) AS items, CAST(max(r) AS BIGINT) AS raters, round((avg(p) - any_value(pe)) / (1 - any_value(pe)), 6) AS kappa FROM p CROSS JOIN e""")
def fleiss_kappa(spark, d):
    from rankloom.functions import order

    each = R.units(spark, d).select("pair_id", F.explode(F.array(*map(F.lit, R.ANNOTATORS))).alias("annotator"))
    h = F.substring(order.digest(F.col("annotator"), "f", F.col("pair_id")), 1, 1)
    return agreement.fleiss(each.select("pair_id", F.when(h < "8", "Good Fit").when(h < "c", "Potential Fit").otherwise("No Fit").alias("label")), "pair_id")


def _labelled(spark, d) -> DataFrame:
    """Pairs with score, label and split, of texts with their skill terms added."""
    q, docs = (x.withColumn("text", text.augment(F.coalesce("text", F.lit("")))) for x in (R.queries(spark, d), R.documents(spark, d)))
    pairs = shared.kept(R.split_pairs(spark, d).filter("split <> 'discarded'"), "split_pairs")
    train = pairs.filter("split = 'train'").select("doc_id").distinct()
    fit = docs.join(train, "doc_id", "left_semi")
    lexical = scoring.bm25(pairs, q, docs, fit_on=fit).withColumn("model", F.lit("bm25"))
    both = fit.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text").unionByName(q.join(pairs.filter("split = 'train'").select("query_id").distinct(), "query_id", "left_semi").select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("id"), "text"))
    vector = scoring.tfidf_cosine(pairs, q, docs, scoring.tfidf_vocabulary(both, "id")).withColumn("model", F.lit("tfidf"))
    return shared.kept(lexical.unionByName(vector).join(pairs, ["query_id", "doc_id"]), "labelled")


def baseline(spark, d) -> tuple[DataFrame, DataFrame]:
    """Test predictions (model, query_id, doc_id, score, label, predicted) and reports (model, accuracy, macro_f1, n): add terms, fit on train, score, classify, report for both models."""
    scored, predictions, reports = _labelled(spark, d), None, None
    for name in ("bm25", "tfidf"):  # two models
        own = scored.filter(F.col("model") == name)
        model = agreement.fit_label_model(own.filter("split = 'train'").select("query_id", "doc_id", "score", "label"))
        said = agreement.predict_label(model, own.filter("split = 'test'")).join(own.select("query_id", "doc_id", "label"), ["query_id", "doc_id"])
        said = shared.kept(said.withColumn("model", F.lit(name)), "predictions")
        report = agreement.overall(agreement.confusion(said.select(F.col("label").alias("truth"), "predicted"))).withColumn("model", F.lit(name))
        predictions = said if predictions is None else predictions.unionByName(said)
        reports = report if reports is None else reports.unionByName(report)
    return predictions, reports


@query("lr_predict")
def lr_predict(spark, d):
    return baseline(spark, d)[0].select("model", "query_id", "doc_id", "score", "predicted")


@query("baseline_report")
def baseline_report(spark, d):
    """Accuracy and macro F1 of both models on test pairs beside the floor of the most common label."""
    floor = agreement.majority_floor(shared.kept(R.test_pairs(spark, d), "test_pairs")).select(F.lit("floor").alias("model"), "accuracy", "macro_f1")
    return baseline(spark, d)[1].select("model", "accuracy", "macro_f1").unionByName(floor)


#: Stored coefficients of a label model on BM25 scores: intercept and slope of each label.
STORED = {"Good Fit": (-0.75, 0.125), "Potential Fit": (0.25, 0.0625), "No Fit": (0.5, -0.1875)}


@query("label_rule", f"""WITH {R.SQL_TEST}, {_sql_bm25('test_pairs')}, margins AS (SELECT query_id, doc_id, score, label, margin, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY margin DESC, place) AS r FROM (
  SELECT query_id, doc_id, score, v.label, v.place, v.intercept + v.slope * score AS margin FROM bm25 CROSS JOIN (VALUES {", ".join(f"('{k}', {i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (k, (a, b)) in enumerate(STORED.items()))}) AS v(label, place, intercept, slope)))
SELECT query_id, doc_id, score, label AS predicted FROM margins WHERE r = 1""")
def label_rule(spark, d):
    scored = scoring.bm25(shared.kept(R.test_pairs(spark, d), "test_pairs"), R.queries(spark, d), R.documents(spark, d))
    return agreement.apply_rule(scored, STORED)


@query("embedding_neighbours", """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS score FROM q CROSS JOIN embeddings e WHERE e.vec_id <> q.vec_id)
SELECT query_id, doc_id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM s) WHERE rn <= 5""")
def embedding_neighbours(spark, d):
    """A top-k report: cosine of a stated query set against all vectors, queries as the bounded side."""
    e = R.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e = e.withColumn("n", F.sqrt(dot(F.col("v"), F.col("v"))))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("n").alias("qn"))
    s = e.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", F.col("vec_id").alias("doc_id"), F.round(dot(F.col("qv"), F.col("v")) / (F.col("qn") * F.col("n")), 5).alias("score"))
    return evaluation.top_k(evaluation.rank(s.select("query_id", "doc_id"), s, ("query_id",)), 5).select("query_id", "doc_id", "score", "rn")
