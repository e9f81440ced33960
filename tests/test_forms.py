"""Operators that were reshaped for size, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import order, text
from rankloom.operators import campaign, diff, evaluation, guards, overlap, pools, profile, sampling, splits


def digest(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def test_ranks_over_all_rows(spark):
    ids = spark.range(5000).select(F.col("id"), (F.col("id") % 2).alias("side"))
    got = {r.id: (r._r, r.n) for r in order.drawn(ids, 3, "salt", "id", "_r", "n").collect()}
    want = sorted(range(5000), key=lambda k: digest(3, "salt", k))
    assert got == {k: (i + 1, 5000) for i, k in enumerate(want)}
    by = {(r.side, r.id): r._r for r in order.drawn(ids, F.col("side"), "salt", "id", "_r", "n", ["side"]).collect()}
    for side in (0, 1):
        own = sorted((k for k in range(5000) if k % 2 == side), key=lambda k: digest(side, "salt", k))
        assert all(by[side, k] == i + 1 for i, k in enumerate(own))
    assert order.drawn(ids.limit(0), 3, "salt", "id").collect() == []
    plan = splits.assign(ids, "id", 0.3, 0.1, 0, "doc")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(id" not in plan  # no window over all ids


def test_mean_ranks(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(40)]), rng.randint(0, 10)) for _ in range(500)]
    got = {r.v: r["rank"] for r in campaign.mean_ranks(spark.createDataFrame(rows, "a int, b int"), "a").collect()}
    ordered = sorted((a for a, _ in rows), key=lambda a: (a is not None, a or 0))
    for v in set(ordered):
        places = [i + 1 for i, x in enumerate(ordered) if x == v]
        assert got[v] == sum(places) / len(places)


def test_quotas_are_drawn_one_query_after_another(spark):
    rng = random.Random(6)
    queries = [(f"q{k}", rng.choice("xyz")) for k in range(6)]
    docs = [(k, rng.choice("xxyw")) for k in range(40)]
    for per_query, same_min in ((5, 3), (9, 9), (3, 0)):
        used, want = set(), set()
        for q, kw in sorted(queries):
            free = sorted((d for d in docs if d[0] not in used), key=lambda d: digest(0, q, d[0]))
            same = [d for d, k in free if k == kw][:same_min]
            off = [d for d, k in free if k != kw][: per_query - len(same)]
            used |= {*same, *off}
            want |= {(q, d, True) for d in same} | {(q, d, False) for d in off}
        got = sampling.quota_candidates(spark.createDataFrame(queries, "query_id string, keyword string"), spark.createDataFrame(docs, "doc_id int, keyword string"), per_query, same_min, 0)
        assert {tuple(r) for r in got.collect()} == want
    none = spark.createDataFrame([], "query_id string, keyword string")
    assert sampling.quota_candidates(none, spark.createDataFrame(docs, "doc_id int, keyword string"), 3, 1, 0).collect() == []


def test_batches_can_go_deeper(spark):
    queries = spark.createDataFrame([(i, i % 3) for i in range(30)], "query_id int, keyword int")
    docs = spark.createDataFrame([(i, i % 3) for i in range(400)], "doc_id int, keyword int")
    specs = [{"batch": 1, "n_queries": 4, "per_query": 5, "same_min": 4, "seed": 1}, {"batch": 2, "n_queries": 2, "per_query": 6, "same_min": 2, "seed": 2, "deeper": True}]
    rows = campaign.replay(queries, docs, specs)
    one, two = ({r.query_id for r in rows.filter(F.col("batch") == b).collect()} for b in (1, 2))
    assert len(one) == 4 and len(two) == 2 and two <= one and rows.select("doc_id").distinct().count() == rows.count() == 32
    held = {(r.kind, r.id) for r in campaign.holdout(rows, queries, docs).collect()}
    assert {("query", q) for q in one} < held and {("document", r.doc_id) for r in rows.collect()} < held
    assert campaign.add_batch(specs, {"batch": 3, "n_queries": 1, "per_query": 1, "keywords": [0, 1, 2]}, {0, 1, 2})[2] == {"batch": 3, "n_queries": 1, "per_query": 1}
    for bad in ({"batch": 1, "n_queries": 1, "per_query": 1}, {"batch": 3, "n_queries": 11, "per_query": 20}, {"batch": 3, "n_queries": 1, "per_query": 21}):
        with pytest.raises(guards.GuardError):
            campaign.add_batch(specs, bad)


def test_probes(spark):
    words = lambda *k: " ".join(f"word{i}" for i in k)
    refs = spark.createDataFrame([(1, words(*range(20))), (2, words(*range(20))), (3, words(*range(30, 50))), (4, "z" * 70), (5, "short")], "ref_id int, text string")
    docs = [(10, "x " + words(*range(20))), (11, words(*range(25))), (12, words(*range(9))), (13, "a" + "z" * 90 + " b"), (14, None), (15, words(*range(30, 39)) + "  " + words(*range(39, 60)))]
    docs = spark.createDataFrame(docs, "doc_id int, text string")
    assert {tuple(r) for r in overlap.probe_hits(refs, docs).collect()} == {(1, 10), (1, 11), (2, 10), (2, 11), (3, 15), (4, 13)}
    assert {tuple(r) for r in overlap.probes(refs, docs).collect()} == {(1, 10), (2, 10), (3, 15), (4, 13)}
    assert {tuple(r) for r in overlap.probes_once(refs, docs).collect()} == {(1, 10), (2, 11), (3, 15), (4, 13)}
    assert overlap.probes_once(refs, docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_probes_once_is_greedy(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(12), rng.randrange(10)) for _ in range(40)})
    used, want = set(), set()
    for ref in sorted({r for r, _ in pairs}):
        free = [d for r, d in pairs if r == ref and d not in used]
        if free:
            used.add(free[0])
            want.add((ref, free[0]))
    before = overlap.probe_hits
    overlap.probe_hits = lambda *_: spark.createDataFrame(pairs, "ref_id int, doc_id int")
    try:
        assert {tuple(r) for r in overlap.probes_once(None, None).collect()} == want
    finally:
        overlap.probe_hits = before


def test_containment_by_classes_of_references(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(40)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    refs = [(k, " ".join([passage, *rng.choices(vocabulary, k=rng.randint(0, 15))])) for k in range(8)] + [(9, "a b"), (10, None)]
    docs = [(k, " ".join([*rng.choices(vocabulary, k=5), passage[: rng.randint(0, len(passage))], refs[k % 8][1]])) for k in range(20)] + [(50, None), (51, "nothing of that kind is there at all, you see")]
    got = {r.doc_id: tuple(r)[1:] for r in overlap.best_containment(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(refs, "ref_id int, text string"), 4).collect()}

    def grams(t):
        w = (t or "").split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}

    for i, t in docs:
        t = (t or "").replace(",", "")
        best = max(((len(grams(t) & grams(r)), -k) for k, r in refs), default=(0, 0))
        if not best[0]:
            assert got[i] == (-1, 0, 0.0)
        else:
            r = grams(dict(refs)[-best[1]])
            assert got[i] == (-best[1], best[0], pytest.approx(max(best[0] / len(grams(t)), best[0] / len(r)), abs=1e-6))


def test_parsed_lists(spark):
    cells = {"['a', \"it's\", 'b']": ["a", "it's", "b"], "['it\\'s']": ["it's"], "[]": [], "['a', 1, None, 'b',]": ["a", "b"], "['open": [], "a, b": [], "['it's']": [], None: [], "['" + "x" * 20000 + "']": ["x" * 20000]}
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string")
    got = {r.k: r.l for r in df.select("k", text.parse_list(F.col("c")).alias("l")).collect()}
    assert [got[k] for k in range(len(cells))] == list(cells.values())


def test_ndcg_has_graded_gains_under_both_definitions(spark):
    rows = [("v", "q", "a", "potential", 1), ("v", "q", "b", "good", 2), ("v", "q", "c", "none", 3), ("v", "p", "a", "potential", 1)]
    ranked = spark.createDataFrame(rows, "pool_variant string, query_id string, doc_id string, relevance string, rn int")
    got = {(r.query_id, r.definition): r.ndcg for r in evaluation.query_metrics(ranked, places=6).collect()}
    assert set(got) == {("q", "strict"), ("q", "graded"), ("p", "graded")} and got["q", "strict"] == got["q", "graded"] == pytest.approx((1 + 2 * 0.63093) / (2 + 0.63093), abs=1e-5)


def test_intervals_and_guards(spark):
    rows = [("N20", q, f"d{i}", "good" if i < g else "none", "labelled") for q, g in (("q1", 1), ("q2", 3), ("q3", 4), ("q0", 0)) for i in range(10)]
    made = spark.createDataFrame(rows, "pool_variant string, query_id string, doc_id string, relevance string, source string")
    row = pools.ceiling_interval(made, "precision", 5, draws=500).filter("definition = 'strict'").first()
    assert row["mean"] == pytest.approx((1 / 5 + 3 / 5 + 4 / 5) / 3, abs=1e-5) and row.n == 3 and 0.2 <= row.ci_low < row["mean"] < row.ci_high <= 0.8
    for metric, k in (("ndcg", 5), ("accuracy", 5), ("recall", 20)):
        with pytest.raises(guards.GuardError):
            pools.ceiling_interval(made, metric, k)


def test_golden_groups_and_fingerprints(spark):
    expected = diff.flatten(spark, {"a": {"x": 1}, "environment": {"v": 1}})
    found = diff.by_group(diff.differences(expected, diff.flatten(spark, {"a": {"x": 2}, "environment": {"v": 2}})), expected)
    assert {tuple(r) for r in found.collect()} == {("a", 1, 1, False), ("environment", 1, 1, True)}
    rows = spark.createDataFrame([(k, f"n{k % 7}") for k in range(100)], "k int, name string")
    one, two = (profile.collection_fingerprint(df, "k", "name").first() for df in (rows, rows.orderBy(F.desc("k")).repartition(7)))
    assert one == two and profile.collection_fingerprint(rows.filter("k <> 5"), "k", "name").first().digest != one.digest
    assert {tuple(r) for r in profile.label_counts(rows.withColumn("by", F.col("k") % 2), "by", "name", ("n0", "n9")).select("by", "name", "n").collect()} == {(0, "n0", 8), (1, "n0", 7), (0, "n9", 0), (1, "n9", 0)}
