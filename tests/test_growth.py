"""Plans that hold when tables grow, and the results of the forms they replaced."""

import hashlib

from pyspark.sql import functions as F

from rankloom.operators import agreement, checks, evaluation, judge, pools, sampling, scoring


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pool_checks_send_no_pool_to_the_driver(spark):
    targets = {"N2": 2, "Nfull": None}
    made = [
        ("N2", 1, 1, "labelled"), ("N2", 1, 2, "distractor"), ("N2", 1, 2, "distractor"), ("N2", 1, 9, "distractor"), ("N2", None, 3, "distractor"), ("Nfull", None, 3, "labelled"),
        ("Nfull", 1, 1, "distractor"), ("Nfull", 1, 1, "distractor"), ("Nfull", 1, 2, "labelled"), ("N2", 2, 3, "labelled"), ("Nfull", 2, None, "distractor"), (None, 2, 3, "labelled"), (None, 2, 3, "labelled"),
    ]
    judged = [(1, 1), (2, 3), (2, 4), (2, 4), (None, 3), (2, None)]
    universe = [1, 2, 3, 4]
    frame = spark.createDataFrame(made, "pool_variant string, query_id long, doc_id long, source string")
    found = checks.union(checks.pool_checks(frame, spark.createDataFrame(judged, "query_id long, doc_id long"), spark.createDataFrame([(x,) for x in universe], "doc_id long"), targets))
    assert _plan(found).count("BroadcastHashJoin") == 1  # the targets
    whole = lambda *k: None not in k
    pairs = lambda v: {(q, d) for x, q, d, _ in made if x == v and whole(q, d)}
    depth = {}
    for v, q, _, s in made:
        if v in targets:
            n, own = depth.get((v, q), (0, 0))
            depth[v, q] = n + 1, own + (s == "labelled")
    want = {
        "pools: no distractor is judged": sum(s == "distractor" and whole(q, d) and (q, d) in judged for _, q, d, s in made), "pools: candidates come from the universe": sum(d not in universe for _, _, d, _ in made),
        "pools: every judged pair is there": sum(not whole(q, d) or (q, d) not in {(x, y) for _, x, y, _ in made} for q, d in judged), "pools: no candidate twice": len({m[:3] for m in made if sum(x[:3] == m[:3] for x in made) > 1}),
        "pools: N2 is within Nfull": sum(v == "N2" and (q, d) not in pairs("Nfull") for v, q, d, _ in made), "pools: depth": sum(n != min(max(own, targets[v] or 1 << 30), 4) for (v, _), (n, own) in depth.items()),
    }
    assert {r["check"]: (r.ok, r.n_violations) for r in found.collect()} == {k: (n == 0, n) for k, n in want.items()} and all(want.values())


def test_pools_are_built_without_a_broadcast_of_judged_pairs(spark):
    judged = spark.range(40).select((F.col("id") % 4).alias("query_id"), F.col("id").alias("doc_id"), F.lit("No Fit").alias("label"))
    plan = _plan(pools.build(judged, spark.range(60).select(F.col("id").alias("doc_id")), 0))
    assert "LeftAnti" in plan and "BroadcastHashJoin" not in plan


def test_draws_are_counted_and_not_held(spark):
    labels = agreement.LABELS
    rows = [(g, f"p{k:03}", labels[k * 7 % 3], labels[k * k % 3]) for g, n in (("x", 40), ("y", 23)) for k in range(n)] + [("y", "p900", "Great Fit", labels[0])]
    both = spark.createDataFrame(rows, "grp string, pair_id string, a string, b string")
    code = F.array_position(F.array(*map(F.lit, labels)), F.col("a")) - 1
    coded = both.select("grp", "pair_id", F.when(code >= 0, code).alias("code"))
    counted = evaluation.resampled_counts(coded, ["grp"], "pair_id", "code", 3, 120, 0)
    held = evaluation.resampled(coded, ["grp"], "pair_id", "code", 120, 0)
    assert {(r.grp, r._d): (r.n, r.c) for r in counted.collect()} == {(r.grp, r._d): (len(r._v), [r._v.count(c) for c in range(3)]) for r in held.collect()}
    assert evaluation.resampled_counts(coded.filter("false"), ["grp"], "pair_id", "code", 3, 120, 0).count() == 0
    report = judge.per_instrument(both.select(F.col("grp").alias("agent_sha256"), "pair_id", F.lit(1).alias("run"), F.col("b").alias("label")), both.filter("grp = 'x'").select("pair_id", F.col("a").alias("label")), 40)
    plan = _plan(report)
    assert plan.count("sha2(") == 1 and "lambda i_" not in plan  # one resampling for both schemes and all instruments
    assert {(r.scheme, r.agent_sha256, r.n) for r in report.collect()} == {("three", "x", 40), ("three", "y", 23), ("binary", "x", 40), ("binary", "y", 23)}


def test_kappa_interval_of_groups_whose_square_exceeds_an_int(spark):
    labels, n = agreement.LABELS, 46_400
    code = {"big": lambda k: (k % 3, k % 7 % 3), "small": lambda k: (k % 2, k % 5 % 3)}
    name = lambda x: F.element_at(F.array(*map(F.lit, labels)), x.cast("int") + 1)
    made = [spark.range(m).select(F.lit(g).alias("grp"), F.format_string("%05d", "id").alias("pair_id"), *(name(x).alias(c) for c, x in zip("ab", code[g](F.col("id")), strict=True))) for g, m in (("big", n), ("small", 50))]
    got = {r.grp: r for r in agreement.kappa_interval(made[0].unionByName(made[1]), ["grp"], "pair_id", draws=9).collect()}
    for grp, m in (("big", n), ("small", 50)):
        pairs, drawn = [code[grp](k) for k in range(m)], []
        for d in range(9):
            taken = [pairs[int(hashlib.sha256(f"0|{d}|{i}".encode()).hexdigest()[:8], 16) % m] for i in range(m)]
            po, pe = sum(a == b for a, b in taken) / m, sum(sum(a == x for a, _ in taken) * sum(b == x for _, b in taken) for x in range(3)) / m**2
            drawn.append((po - pe) / (1 - pe))
        at = lambda p, v=sorted(drawn): v[int(8 * p)] + (8 * p - int(8 * p)) * (v[int(8 * p) + 1] - v[int(8 * p)])
        assert got[grp].n == m and abs(got[grp].ci_low - at(0.025)) < 1e-5 and abs(got[grp].ci_high - at(0.975)) < 1e-5
    assert agreement.kappa_interval(made[1].drop("grp"), [], "pair_id", draws=9).first()["ci_low"] == got["small"].ci_low


def test_codes_of_a_group_are_ordered_in_parts(spark):
    rows = [(g, k * 7919 % 997, k % 9) for g, n in ((None, 997), ("x", 500)) for k in range(n)] + [("x", 3, 8), ("x", None, 2), ("y", 1, None)]
    found = evaluation._ordered_codes(spark.createDataFrame(rows, "grp string, unit long, code int"), ["grp"], "unit", "code")
    assert "rangepartitioning" in _plan(found)
    one = found.first()
    key = lambda x: (x[1] is not None, x[1] or 0, x[2])
    assert {g._by.grp: (g._n, list(one._v[g._at : g._at + g._n])) for g in one._g} == {grp: (len(own), [x[2] for x in own]) for grp in (None, "x") for own in [sorted((x for x in rows if x[0] == grp and x[2] is not None), key=key)]}
    assert one._most == 997 and len(one._v) == sum(g._n for g in one._g) and sorted(g._k for g in one._g) == [0, 1]


def test_banded_pick_without_rows_of_pairs(spark):
    queries = spark.createDataFrame([(q, g) for q in range(30) for g in ([1, 2, 3, 9, None][q % 5],)], "query_id long, keyword long").unionByName(spark.createDataFrame([(0, 1), (0, 2)], "query_id long, keyword long"))
    docs = [(d, 1) for d in range(400)] + [(d, 1) for d in range(5)] + [(d, 2) for d in range(1000, 1060)] + [(1, 3), (2, 3), (3, None)]
    docs = spark.createDataFrame(docs, "doc_id long, keyword long")
    queries = queries.filter("not (query_id = 0 and keyword = 2)")
    want = sampling.banded_pick(scoring.random_scores(queries.join(docs, "keyword"), 3), 5, 0).select("query_id", "doc_id", "score", "band", "slot")
    want = sorted(map(tuple, want.collect()))
    for drawn in (6, 48):  # with six, many queries have to fall back on all documents
        got = sampling.banded_pick_by_hash(queries, docs, "keyword", 5, 3, 0, drawn=drawn).select("query_id", "doc_id", "score", "band", "slot")
        assert sorted(map(tuple, got.collect())) == want and len(want) > 60
