import random

import numpy as np
from pyspark.sql import functions as F

from rankloom.llm import quality

from .conftest import documents

LABELS = "doc_id long, quality int, toxic int"


def corpus(rng, n):
    bad, fine = "scum idiot trash moron".split(), [f"word{k}" for k in range(300)]
    out = []
    for k in range(n):
        own = rng.choices(fine, k=rng.randint(20, 120))
        kind = k % 4
        if kind == 0:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(bad))
        if kind == 1:
            own = [w + rng.choice(["###", "$$$", "%%%"]) for w in own] if k % 8 == 1 else [w for w in own[:9] for _ in range(9)]
        out.append((k, " ".join(own), (1, 1) if kind == 0 else (0, 0) if kind == 1 else (1, 0)))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(1), 1200)
    docs = documents(spark, [(i, t) for i, t, _ in rows], extra=True)
    labels = spark.createDataFrame([(i, *g) for i, _, g in rows if i < 800] + [(None, 1, 0), (5, None, 1), (7000, 1, None)], LABELS)
    model = quality.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == 1200
    held = [(i, g) for i, _, g in rows if i >= 800]
    assert np.mean([got[i].kept == (g == (1, 0)) for i, g in held]) > 0.95
    mean = lambda g: np.mean([got[i].expected_grade for i, own in held if own == g])
    assert mean((1, 1)) < mean((1, 0)) and mean((0, 0)) < mean((1, 0))
    assert docs.filter(quality.kept(model, docs)).count() == sum(r.kept for r in got.values())


def test_gradient_reaches_a_stationary_point():
    rng = np.random.default_rng(0)
    found = [np.unique(rng.integers(0, 30, 6)).astype(np.int32) for _ in range(600)]
    truth = rng.normal(size=30)
    s = np.array([truth[x].sum() for x in found]) + rng.logistic(size=600)
    grades = (s > -1).astype(int) + (s > 1)
    model = quality.fit(found, grades, least_docs=1, rounds=1500, rate=0.02)
    w, t = model.weights[:30].astype(float), model.thresholds

    def loss(w, t):
        s = np.array([w[x].sum() for x in found])
        c = np.column_stack([np.zeros(600), *(1 / (1 + np.exp(-(t[k] - s))) for k in range(2)), np.ones(600)])
        return -np.log(c[np.arange(600), grades + 1] - c[np.arange(600), grades]).mean() + 0.5e-3 * (w**2).sum()

    for k in range(5):
        for d in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += d
            assert loss(moved, t) > loss(w, t) - 1e-5
    assert loss(w, t + [0.05, 0]) > loss(w, t) - 1e-5 and loss(w, t + [0, -0.05]) > loss(w, t) - 1e-5


def test_edges(spark):
    pairs = [(1, None), (1, ""), (None, "a word"), (2, "long " * 30_000)]
    docs = documents(spark, pairs, extra=True)
    none = spark.createDataFrame([], LABELS)
    assert quality.train(docs, none) is None
    rows = quality.score(docs, None).collect()
    assert len(rows) == 4 and all(r.kept and r.p_top is None for r in rows)
    model = quality.train(docs, spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None)], LABELS))
    rows = quality.score(docs, model).collect()
    assert len(rows) == 4 and all(0 <= r.p_top <= 1 for r in rows)
    assert {r.grade for r in quality.graded(spark.createDataFrame([(1, 1, 0), (1, 0, 0)], LABELS)).collect()} == {1}
    assert quality.score(documents(spark, []), model).collect() == []
    assert quality.train(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS), most_labels=1) is not None
    assert docs.filter(F.lit(True) & quality.kept(None, docs)).count() == 4


def test_query_equals_plain_python(spark):
    """Token sets, grades, the fit and the scores of the whole query, from lists in plain Python."""
    import re
    import zlib

    rng = random.Random(11)
    rows = corpus(rng, 300)
    labels = [(i, *g) for i, _, g in rows if i % 3] + [(4, 0, 0), (7, None, 1), (9999, 1, 0)]
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    got = {r.doc_id: r for r in quality.score(docs, quality.train(docs, spark.createDataFrame(labels, LABELS))).collect()}

    def places(t):
        own = t.split()
        lines = [x for x in t.split("\n") if x]
        shares = {"capitals": sum(w.isupper() for w in own) / len(own), "repeats": sum(own[k] == own[k + 1] for k in range(len(own) - 1)) / len(own), "lines": 1 - len(set(lines)) / len(lines), "symbols": sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in own) / len(own)}
        found = set(re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", t.lower())) | {f"<{k} {s}>" for k, x in shares.items() for s in (0.05, 0.1, 0.2, 0.4, 0.7) if x > s}
        return sorted({zlib.crc32(x.encode()) % quality.DIMENSIONS for x in found})

    grades = {}
    for i, q, t in labels:
        if q is not None and i < 300:
            grades[i] = min(grades.get(i, 2), 0 if t else 2 if q else 1)
    text = {i: t for i, t, _ in rows}
    model = quality.fit([np.array(places(text[i]), np.int32) for i in sorted(grades)], np.array([grades[i] for i in sorted(grades)]))
    for i, t in text.items():
        s = sum(float(model.weights[k]) for k in places(t))
        tails = [1 / (1 + np.exp(x - s)) for x in model.thresholds]
        assert abs(got[i].expected_grade - sum(tails)) < 2e-6 and abs(got[i].p_top - tails[1]) < 2e-6
        assert got[i].kept == (tails[1] >= 0.5) or abs(tails[1] - 0.5) < 1e-6
