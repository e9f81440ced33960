"""Registered queries against their DuckDB twins on the smallest tables."""

import os

import duckdb
import pytest

from rankloom.plans import annotate, catalog, corpus, extended, integrity, judging, retrieval  # noqa: F401

DIR = "/root/testdata/sf0.001"
#: Queries that need more rows than the smallest tables have.
LARGER = {"campaign_replay", "campaign_holdout", "stratum_summary", "check_campaign"}
#: Compared by the driver alone: slow, or one of several that read the same relation.
SLOW = {"check_clean", "pool_grid", "pool_exposure", "metric_grid", "attainable_share", "pools_with_text", "local_tfidf", "precision_at_k", "recall_at_k", "split_survey", "ceilings", "attainability", "judgement_overlay", "pool_summary", "query_metrics", "tfidf_cosine", "overall_report", "topk_exposure", "random_scores"}
NAMES = sorted(set(catalog.oracle_sql()) - LARGER - SLOW)

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DIR):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_equals_twin(spark, con, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_every_query_is_callable_and_named_once():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 80
