import pytest

from rankloom.operators import campaign, guards


def sides(spark):
    queries = spark.createDataFrame([(i, i % 3) for i in range(30)], "query_id int, keyword int")
    docs = spark.createDataFrame([(i, i % 3) for i in range(400)], "doc_id int, keyword int")
    return queries, docs


def test_batches_are_frozen_and_disjoint(spark):
    queries, docs = sides(spark)
    specs = [{"batch": 1, "n_queries": 4, "per_query": 5, "same_min": 4, "seed": 1}, {"batch": 2, "n_queries": 3, "per_query": 5, "same_min": 4, "seed": 2, "keywords": [1]}]
    one = {tuple(r) for r in campaign.replay(queries, docs, specs[:1]).collect()}
    both = [tuple(r) for r in campaign.replay(queries.repartition(5), docs.repartition(5), specs).collect()]
    assert {r for r in both if r[0] == 1} == one and len(one) == 20
    assert len({r[2] for r in both}) == len(both) and len({r[1] for r in both}) == 7
    assert {r[4] for r in both if r[0] == 2} == {"targeted"} and all(q % 3 == 1 for b, q, *_ in both if b == 2)
    with pytest.raises(guards.GuardError):
        campaign.replay(queries, docs, [{**specs[1], "keywords": [9]}])


def test_overlay_and_union(spark):
    pools = spark.createDataFrame([("q", "a", "none", "distractor"), ("q", "b", "good", "labelled")], "query_id string, doc_id string, relevance string, source string")
    new = spark.createDataFrame([("q", "a", "potential")], "query_id string, doc_id string, relevance string")
    assert {(r.doc_id, r.relevance, r.label_source) for r in campaign.overlay(pools, new).collect()} == {("a", "potential", "judgement"), ("b", "good", "labelled")}
    scores = spark.createDataFrame([("m", "q", "a", 0.9), ("m", "q", "b", 0.1), ("n", "q", "a", 0.2), ("n", "q", "c", 0.8)], "model string, query_id string, doc_id string, score double")
    assert {tuple(r) for r in campaign.union_pool(scores, 1).collect()} == {("q", "a", "m", 1), ("q", "c", "n", 1)}
    values = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (3, 30)], "a int, b int")
    assert campaign.rank_correlation(values).first().rho == 1.0
