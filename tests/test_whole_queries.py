"""Queries over all rows, without a twin, against brute force."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from rankloom.operators import profile
from rankloom.plans import annotate, catalog, corpus  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_prefix_derivatives_of_all_whole_texts(spark, tmp_path):
    rng = random.Random(2)
    base = [" ".join(rng.choices([f"w{k}" for k in range(50)], k=n)) for n in (1, 3, 30, 60, 120)]
    texts = [None, "", "  "]
    for b in base:
        texts += [b, b, f" {b[:50]}  ", b + " and more", b[:130] + " another end", b + " and more again"]
    rows = [(k + 1, t, "en", "s", None) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    norm = {i: " ".join((t or "").split()) for i, t, *_ in rows}
    first = {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    want = sorted((i, r) for i, t in norm.items() for ref, r in first.items() if ref and t.startswith(ref) and i != r)
    assert any(r % 10 for _, r in want) and any(len(norm[r]) > 120 for _, r in want)
    assert sorted(map(tuple, catalog.queries()["prefix_derivative"](spark, str(tmp_path)).select("doc_id", "ref_id").collect())) == want


def test_span_offsets_hands_on_whole_texts(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "x" * 5000, "en", "s", 5000)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr(profile, "span_problems", lambda df, content, spans: seen.append(df.agg(F.max(F.length(content))).first()[0]))
    catalog.queries()["span_offsets"](spark, str(tmp_path))
    assert seen == [5000]


def test_banded_picks_of_all_queries(spark, tmp_path):
    nation = {k: k % 3 for k in range(1, 26)}
    customers = {k: k % 4 for k in range(1, 41)}
    spark.createDataFrame([(k, n, 1.0) for k, n in nation.items()], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, n, 1.0) for k, n in customers.items()], "c_custkey long, c_nationkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    draw = lambda seed, q, c: hashlib.sha256(f"{seed}|{q}|{c}".encode()).hexdigest()
    want = []
    for q, n in nation.items():
        scored = sorted(((round(int(draw(3, q, c)[:8], 16) / 2**32, 6), c) for c, m in customers.items() if m == n), key=lambda x: (-x[0], x[1]))
        each, more = divmod(len(scored), 3)
        ends, bands = (each + (more > 0), 2 * each + more), defaultdict(list)
        for k, (s, c) in enumerate(scored):
            bands["high" if k < ends[0] else "mid" if k < ends[1] else "low"].append((draw(0, q, c), c, s))
        for b in bands.values():
            b.sort()
        slots = {}
        for slot, band in enumerate(("high", "mid", "low", "high", "mid")):
            if bands[band]:
                slots[slot] = (*bands[band].pop(0), band)
        rest = sorted((*x, band) for band, b in bands.items() for x in b)
        for slot in range(5):
            if slot not in slots and rest:
                slots[slot] = rest.pop(0)
        want += [(q, c, s, band, slot) for slot, (_, c, s, band) in slots.items()]
    got = catalog.queries()["banded_pick"](spark, str(tmp_path)).select("query_id", "doc_id", "score", "band", "slot")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({w[0] for w in want}) == 25
