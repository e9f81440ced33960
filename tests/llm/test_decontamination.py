import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rankloom.llm import decontamination as dc

from .conftest import documents

ITEMS = "item_id long, text string"


def brute(pairs, items):
    """Every window of every item's size, without fingerprints."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    own = {i: words(t) for i, t in items if words(t)}
    holders = Counter(g for w in own.values() for g in set(grams(w, min(5, len(w)))))
    weight = lambda g: math.log1p(len(own) / holders.get(g, 1))
    out = []
    for doc_id, text in pairs:
        w, hit = words(text), {}
        for i, item in own.items():
            n, m = min(5, len(item)), len(item)
            two = Counter(grams(item, n))
            for s in range(len(w) - m + 1):
                one = Counter(grams(w[s : s + m], n))
                if one & two:
                    value = sum(weight(g) * min(one[g], two[g]) for g in one | two) / sum(weight(g) * max(one[g], two[g]) for g in one | two)
                    if value >= 0.8:
                        hit[i] = max(hit.get(i, 0), value)
        out.append((doc_id, len(hit), ",".join(map(str, sorted(hit))), round(max(hit.values(), default=0.0), 6), bool(hit)))
    return out


def brute_short(pairs, items):
    """brute, where a document of fewer words than an item is compared whole."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    own = [(i, words(t)) for i, t in items if words(t)]
    holders = Counter(g for _, w in own for g in set(grams(w, min(5, len(w)))))
    weight = lambda g: math.log1p(len(own) / holders.get(g, 1))
    out = []
    for (doc_id, text), long in zip(pairs, brute(pairs, items), strict=True):
        w, hit = words(text), {int(i): None for i in long[2].split(",") if i}
        best = long[3]
        for i, item in own:
            one, two = (Counter(grams(x, min(5, len(item)))) for x in (w, item))
            if len(w) < len(item) and one & two:
                value = sum(weight(g) * min(one[g], two[g]) for g in one | two) / sum(weight(g) * max(one[g], two[g]) for g in one | two)
                if value >= 0.8:
                    hit[i], best = None, max(best, round(value, 6))
        out.append((doc_id, len(hit), ",".join(map(str, sorted(hit))), best, bool(hit)))
    return out


def corpus(rng):
    fresh = lambda n: rng.choices([f"w{k}" for k in range(500)], k=n)
    items = [(k, " ".join(fresh(n))) for k, n in enumerate([15, 20, 30, 40, 59, 59, 30, 3, 1, 6])]
    items += [(20, items[3][1]), (21, " ".join(items[4][1].split()[:40] + fresh(4))), (22, ""), (23, None), (24, "... !!")]
    items[8] = (8, "uniqueword")
    texts = [None, "", "uniqueword", items[2][1], items[0][1].upper() + "!", "la la la " * 40]
    for _ in range(80):
        p = rng.choice(items[:7])[1].split()
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(p))
            way = rng.randrange(3)
            p = p[:k] + p[k + 1 :] if way == 0 else [*p[:k], "new", *p[k:]] if way == 1 else [*p[:k], "other", *p[k + 1 :]]
        texts.append(" ".join([*fresh(rng.randint(0, 60)), *p, *fresh(rng.randint(0, 60))]))
    texts.append(" ".join([*fresh(4000), *items[5][1].split(), *fresh(4000)]))
    return items, texts


@pytest.mark.parametrize("most_chars", [8_000_000, 900])
def test_equals_brute_force(spark, most_chars):
    items, texts = corpus(random.Random(3))
    pairs = [*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, texts[3])]
    df = dc.scan(documents(spark, pairs, extra=True), spark.createDataFrame(items, ITEMS).repartition(2), most_chars=most_chars)
    got, want = sorted(map(tuple, df.collect()), key=repr), sorted(brute(pairs, items), key=repr)
    assert got == want
    kept = dc.clean(documents(spark, pairs, extra=True), spark.createDataFrame(items, ITEMS), most_chars=most_chars)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((w[0] for w in want if not w[4]), key=repr)
    assert dc.scan(documents(spark, []), spark.createDataFrame(items, ITEMS)).collect() == []


def test_empty_benchmark(spark):
    rows = dc.scan(documents(spark, [(1, "a b c d e f")]), spark.createDataFrame([], ITEMS)).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "", 0.0, False)]


def test_blocks_guarantee_the_radius():
    rng = random.Random(5)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randint(0, dc.RADIUS)):
            b ^= 1 << k
        assert any(((a ^ b) >> 8 * k & 255).bit_count() <= dc.RADIUS // 8 for k in range(8))
    h = np.array([1, 2, 3], np.uint64)
    assert dc._fingerprints(dc._signs(h).sum(axis=0)[None])[0] == 3


def test_document_shorter_than_the_item(spark):
    rng = random.Random(9)
    item = rng.choices([f"w{k}" for k in range(500)], k=40)
    other = rng.choices([f"v{k}" for k in range(500)], k=40)
    items = [(1, " ".join(item)), (2, " ".join(other)), (3, " ".join(item[:6])), (4, "a b c")]
    pairs = [(k, " ".join(item[:n])) for k, n in enumerate(range(41))] + [(100, " ".join(item[2:])), (101, " ".join([*item[:20], *item[22:]])), (102, " ".join([*other[:30], "new", "words"])), (103, "a b"), (104, None)]
    want = brute_short(pairs, items)
    assert {r[0] for r in want if r[2] == "1,3"} >= {36, 38, 40} and {r[0]: r[2] for r in want}[100] == "1"
    benchmark = spark.createDataFrame(items, ITEMS)
    got = dc.scan(documents(spark, pairs), benchmark)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    kept = dc.clean(documents(spark, pairs), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in want if not r[4])


@pytest.mark.parametrize("most_chars", [8_000_000, 2_000])
def test_passes_change_no_result(spark, most_chars):
    """Texts near the threshold and shingles that many items share."""
    rng = random.Random(11)
    fresh = lambda n: rng.choices([f"w{k}" for k in range(3000)], k=n)
    shared = fresh(12)
    items = [(k, " ".join([*shared, *fresh(18)]) if k < 30 else " ".join(fresh(30))) for k in range(40)]
    texts = []
    for _, item in items * 6:
        p = item.split()
        k = rng.randint(0, 7)
        p = p[: len(p) - k] + rng.choice([fresh(k), shared[:k]])  # a window may hold what only items of other passes share
        texts.append(" ".join([*fresh(rng.randint(0, 5)), *p]))
    pairs = list(enumerate(texts))
    want = sorted(brute_short(pairs, items))
    assert 20 < sum(r[4] for r in want) < len(want) - 20
    benchmark = spark.createDataFrame(items, ITEMS).repartition(3)
    assert sorted(map(tuple, dc.scan(documents(spark, pairs), benchmark, most_chars=most_chars).collect())) == want
    kept = dc.clean(documents(spark, pairs), benchmark, most_chars=most_chars)
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in want if not r[4]]


def test_an_id_with_two_texts_counts_once_in_any_number_of_passes(spark):
    rng = random.Random(13)
    one, two = (" ".join(rng.choices([f"w{k}" for k in range(500)], k=30)) for _ in range(2))
    benchmark = spark.createDataFrame([(5, one), (5, two), *((k, f"other text {k} of its own words") for k in range(10, 30))], ITEMS)
    for most_chars in (8_000_000, 60):
        rows = dc.scan(documents(spark, [(1, one + " and " + two)]), benchmark, most_chars=most_chars).collect()
        assert [tuple(r) for r in rows] == [(1, 1, "5", 1.0, True)]


def test_recall_near_the_threshold():
    """Windows with a similarity of 0.8 to 0.85, by comparing every pair: nearly all are within the radius, and the index then finds them."""
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(800)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(25, 90)))) for k in range(150)]
    index, near, found = dc.Index(items), 0, 0
    while near < 400:
        i, item = rng.choice(items)
        p = item.split()
        for _ in range(rng.randint(1, 4)):
            p[rng.randrange(len(p))] = rng.choice(vocabulary)
        one, two = (Counter(dc.shingles(x, 5).tolist()) for x in (p, item.split()))
        if 0.8 <= index.similarity(one, two) < 0.85:
            near += 1
            found += i in index.find(" ".join(["before", "it", *p, "and", "after"]))
    assert found >= 0.97 * near
