import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators import agreement, diff, evaluation, guards, pools, scoring, splits

POOLS = "query_id string, doc_id string, relevance string, source string, pool_variant string"


def graded(spark, queries, depth=10):
    """Queries with (good, potential) candidates, padded, in two variants."""
    rows = []
    for q, (good, potential) in enumerate(queries):
        names = ["good"] * good + ["potential"] * potential
        names += ["none"] * (depth - len(names))
        rows += [(f"Q{q}", f"d{i}", n, "labelled", v) for i, n in enumerate(names) for v in ("N20", "N100")]
    return spark.createDataFrame(rows, POOLS)


def test_ceilings(spark):
    made = graded(spark, [(1, 0), (3, 0), (4, 2)])
    found = {(r.pool_variant, r.definition, r.k): r for r in pools.ceilings(made).collect()}
    assert found["N20", "strict", 5].precision_ceiling == pytest.approx(0.533333) and found["N20", "strict", 5].recall_ceiling == 1.0
    assert found["N20", "strict", 5].n == 3 and found["N100", "graded", 5].can_be_full == 1
    without = {(r.definition, r.k): r for r in pools.ceilings(graded(spark, [(0, 0), (3, 0), (4, 2)])).filter("pool_variant = 'N20'").collect()}
    assert without["strict", 5].n == 2 and without["strict", 5].precision_ceiling == pytest.approx(0.7)
    evaluation.require_depth(made, 10)
    with pytest.raises(guards.GuardError):
        evaluation.require_depth(made, 20)


def test_metrics_and_exposure(spark):
    grades = ["good", "potential", "none", "none", "none", "good"]
    rows = [("Q", f"d{i}", g, "distractor" if i in (3, 4) else "labelled", "N20") for i, g in enumerate(grades)]
    made = spark.createDataFrame(rows, POOLS)
    scores = spark.createDataFrame([("Q", f"d{i}", None if i == 5 else float("nan") if i == 4 else 1.0 - i / 10) for i in range(6)], "query_id string, doc_id string, score double")
    ranked = evaluation.rank(made, scores)
    assert [r.doc_id for r in ranked.orderBy("rn").collect()] == [f"d{i}" for i in range(6)]
    m = {r.definition: r for r in evaluation.query_metrics(ranked).collect()}
    assert m["strict"].precision == 0.2 and m["strict"].recall == 1.0 and m["graded"].precision == 0.4
    dcg = 2 / math.log2(2) + 1 / math.log2(3) + 2 / math.log2(7)
    assert m["graded"].ndcg == pytest.approx(dcg / (2 + 2 / math.log2(3) + 1 / math.log2(4)))
    e = evaluation.exposure(ranked, 5, ("pool_variant",)).first()
    assert (e.judged_relevant_strict, e.judged_relevant_graded, e.judged_none, e.unjudged_distractor, e.total_slots) == (1, 2, 1, 2, 5)


def test_bootstrap(spark):
    values = spark.createDataFrame([("m", i, float(i % 2)) for i in range(40)] + [("c", i, 0.5) for i in range(5)], "metric string, unit int, value double")
    got = {r.metric: r for r in evaluation.bootstrap(values, ("metric",), draws=400).collect()}
    assert got["m"].mean == 0.5 and 0.25 < got["m"].ci_low < 0.45 < 0.55 < got["m"].ci_high < 0.75
    assert (got["c"].ci_low, got["c"].ci_high, got["c"].n) == (0.5, 0.5, 5)


def test_pools_are_nested_and_keep_judged(spark):
    judged = spark.createDataFrame([("q1", f"d{i}", "Good Fit") for i in range(25)] + [("q2", "d1", "No Fit")], "query_id string, doc_id string, label string")
    universe = spark.createDataFrame([(f"d{i}",) for i in range(60)], "doc_id string")
    made = pools.build(judged, universe, 0).cache()
    depth = {(r.query_id, r.pool_variant): r["count"] for r in made.groupBy("query_id", "pool_variant").count().collect()}
    assert depth == {("q1", "N20"): 25, ("q1", "N100"): 60, ("q1", "Nfull"): 60, ("q2", "N20"): 20, ("q2", "N100"): 60, ("q2", "Nfull"): 60}
    small = {(r.query_id, r.doc_id) for r in made.filter("pool_variant = 'N20'").collect()}
    assert small <= {(r.query_id, r.doc_id) for r in made.filter("pool_variant = 'N100'").collect()}
    docs = spark.createDataFrame([(f"d{i}", "t") for i in range(59)], "doc_id string, text string")
    with pytest.raises(guards.GuardError, match="no document text"):
        pools.with_texts(made, spark.createDataFrame([("q1", "a"), ("q2", "b")], "query_id string, text string"), docs)


def test_classification(spark):
    truth = ["Good Fit", "Good Fit", "Potential Fit", "Potential Fit", "No Fit", "No Fit"]
    said = ["Good Fit", "Good Fit", "No Fit", "No Fit", "No Fit", "No Fit"]
    cells = agreement.confusion(spark.createDataFrame(list(zip(truth, said, strict=True)), "truth string, predicted string"))
    assert cells.count() == 9
    row = agreement.overall(cells).first()
    assert row.accuracy == pytest.approx(4 / 6, abs=1e-6) and row.macro_f1 == pytest.approx(5 / 9, abs=1e-6)
    f1 = {r.label: r.f1 for r in agreement.report(cells).collect()}
    assert f1["Potential Fit"] == 0.0 and f1["Good Fit"] == 1.0
    with pytest.raises(guards.GuardError):
        agreement.confusion(spark.createDataFrame([("Good Fit", "Great")], "truth string, predicted string"))
    floor = agreement.majority_floor(spark.createDataFrame([("No Fit",), ("Good Fit",)], "label string")).first()
    assert floor.label == "Good Fit" and floor.accuracy == 0.5


def test_agreement(spark):
    both = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("y", "y")], "a string, b string")
    assert agreement.kappa(both).first().kappa == pytest.approx(0.5)
    assert agreement.kappa(spark.createDataFrame([("x", "x")], "a string, b string")).first().kappa is None
    votes = spark.createDataFrame([("p", "x"), ("p", "x"), ("p", "y"), ("t", "x"), ("t", "y"), ("s", "y")], "pair_id string, label string")
    assert {r.pair_id: r.label for r in agreement.majority(votes, "pair_id").collect()} == {"p": "x", "t": None, "s": "y"}


def test_bm25(spark):
    texts = ["python data pipelines spark", "java backend services spring", "nurse hospital care ward", "chef kitchen cooking menu", "python machine learning models", "sales retail store manager"]
    docs = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)] + [("held", "python unseen words")], "doc_id string, text string")
    queries = spark.createDataFrame([("q", "python python data zzz_unseen_term"), ("e", "")], "query_id string, text string")
    pairs = spark.createDataFrame([(q, d) for q in ("q", "e") for d in ("r0", "r2", "r4", "held")], "query_id string, doc_id string")
    got = {(r.query_id, r.doc_id): r.score for r in scoring.bm25(pairs, queries, docs, docs.filter("doc_id <> 'held'")).collect()}
    n, avgdl = 6, 4.0
    idf = lambda df: math.log(n - df + 0.5) - math.log(df + 0.5)
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert got["q", "r0"] == pytest.approx(2 * idf(2) * part(1, 4) + idf(1) * part(1, 4), abs=1e-6)
    assert got["q", "held"] == pytest.approx(2 * idf(2) * part(1, 3), abs=1e-6) and got["q", "r2"] == 0 and got["e", "r0"] == 0


def test_tfidf(spark):
    docs = spark.createDataFrame([("a", "red fox jumps"), ("b", "red fox sleeps"), ("c", "orphan lonely")], "doc_id string, text string")
    queries = docs.select(F.col("doc_id").alias("query_id"), "text")
    vocabulary = scoring.tfidf_vocabulary(docs, "doc_id", stop_words=())
    assert {r.term for r in vocabulary.collect()} == {"red", "fox", "red fox"}
    pairs = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "c")], "query_id string, doc_id string")
    got = {(r.query_id, r.doc_id): r.score for r in scoring.tfidf_cosine(pairs, queries, docs, vocabulary, stop_words=()).collect()}
    assert got == {("a", "b"): 1.0, ("a", "a"): 1.0, ("c", "c"): 0.0}


def test_splits(spark):
    ids = spark.createDataFrame([(i,) for i in range(200)], "doc_id int")
    made = splits.assign(ids, "doc_id", 0.3, 0.1, 0, "x").cache()
    assert {r.split: r["count"] for r in made.groupBy("split").count().collect()} == {"test": 60, "val": 20, "train": 120}
    assert made.exceptAll(splits.assign(ids.repartition(7), "doc_id", 0.3, 0.1, 0, "x")).count() == 0
    assert made.exceptAll(splits.assign(ids, "doc_id", 0.3, 0.1, 1, "x")).count() > 0
    pairs = spark.createDataFrame([("r", "j", "a"), ("r", "j", "b"), ("s", "j", "a"), ("s", "j", "a"), ("t", "j", "c")], "resume string, jd string, label string")
    assert {(r.resume, r.labels, r.rows) for r in splits.conflicts(pairs, "resume", "jd").collect()} == {("r", "a | b", 2), ("s", "a", 2)}
    assert {r.resume for r in splits.resolve(pairs, "resume", "jd").collect()} == {"s", "t"}


def test_golden_diff(spark):
    e, a = {"x": 1, "y": [1.0, 2], "z": {"k": None}}, {"x": True, "y": [1.0 + 1e-13, 2], "w": "n"}
    got = {r.path: r.problem for r in diff.differences(diff.flatten(spark, e), diff.flatten(spark, a)).collect()}
    assert got == {"x": "differs", "z.k": "missing", "w": "unexpected"}
    assert diff.differences(diff.flatten(spark, e), diff.flatten(spark, e)).count() == 0


def test_guards(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert {tuple(r) for r in guards.keep_first(df, ["k"], F.col("v")).collect()} == {(1, "a"), (2, "c")}
    row = guards.check("dup", guards.duplicate_keys(df, "k")).first()
    assert (row.check, row.ok, row.n_violations) == ("dup", False, 1)
    with pytest.raises(guards.GuardError):
        guards.require_known(df, df.filter("k = 1"), "k")
