import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import graph, simhash

from .conftest import documents


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(pairs):
    fps = [brute_fingerprint(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    small = {}
    for i, (doc_id, _) in enumerate(pairs):
        if doc_id is not None:
            small[find(i)] = min(small.get(find(i), doc_id), doc_id)
    return [(d, f"{f:016x}", small.get(find(i))) for i, ((d, _), f) in enumerate(zip(pairs, fps, strict=True))]


def corpus(rng):
    texts = [None, "", "  \n", "one", "one two", "ONE two", "ÉTÉ été", "a b c", "word " * 9000]
    long = [" ".join(rng.choices("alpha beta gamma delta eps zeta eta theta iota kappa".split(), k=150)) for _ in range(8)]
    for t in long:
        w = t.split()
        texts += [t, t.upper(), t.replace(" ", "\n", 3)]
        for _ in range(4):
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("most", [65_536, 2])
def test_components(spark, most):
    pairs = [*enumerate(corpus(random.Random(4))), (7, "same"), (7, "same"), (None, "lost and found again"), (2, "another with id two")]
    got = simhash.near_duplicates(documents(spark, pairs, extra=True), most)
    got = got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(pairs), key=repr)


@pytest.mark.parametrize("most", [65_536, 3])
def test_every_link_is_found(spark, most):
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps):
        for bits in (1, 2, 3, 3, 3, 4):
            y = x
            for b in rng.sample(range(64), bits):
                y ^= 1 << b
            fps.add(y)
    values = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in values], "fp long")
    edges = {(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(df, most).collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)

    def groups(pairs):
        root = {x: x for x in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for x in values:
            out.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    assert groups(edges) == groups([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3])


def test_blocks_cover_three_differing_bytes():
    from itertools import combinations

    assert len(simhash.BLOCKS) == 14
    assert all(any(not set(d) & set(q) for q in simhash.BLOCKS) for d in combinations(range(8), 3))


def test_one_of_each_component_stays(spark):
    pairs = [*enumerate(corpus(random.Random(4))), (7, "same"), (7, "same"), (None, "lost and found again"), (None, "lost and found again"), (2, "another with id two")]
    df = simhash.deduplicate(documents(spark, pairs, extra=True))
    assert set(df.columns) >= {"doc_id", "text", "start", "hash"} and not any("key" in c for c in df.columns)
    want = brute(pairs)
    ids = sorted(r.doc_id for r in df.collect() if r.doc_id is not None)
    # One for each component; id 7 is the smallest of two ("a b c" and "same"), so it stands twice.
    assert sorted(set(ids)) == sorted({c for _, _, c in want if c is not None})
    assert len(ids) == len(set(ids)) + 1 and ids.count(7) == 2
    assert df.filter("doc_id is null").count() == len({f for _, f, c in want if c is None}) == 1
    assert simhash.deduplicate(documents(spark, [])).collect() == [] and simhash.near_duplicates(documents(spark, [])).collect() == []


def test_components_of_paths(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (5, 5), (200, 100)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 200: 100}


def test_forest_is_linear():
    rng = np.random.default_rng(1)
    center = rng.integers(0, 1 << 63, dtype=np.uint64)
    own = np.unique(np.array([center] + [center ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(64) for b in range(a)], np.uint64))
    assert len(simhash.forest(own)) == len(own) - 1


@pytest.mark.parametrize("common", [0, 4, 5, 8])
def test_tally_of_a_list_loses_no_link(common):
    """Lists whose members share bytes, with bytes at both ends of their range."""
    rng = np.random.default_rng(common)
    own = rng.choice(np.array([0, 1, 2, 127, 128, 254, 255], np.uint8), size=(400, 8))
    own[:, :common] = own[0, :common]
    values = np.unique(own.reshape(-1).view(np.uint64))
    postings = simhash.Postings(values)
    for k in range(len(values)):
        want = np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 3)
        assert sorted(postings.linked(k, np.ones(len(values), bool)).tolist()) == want.tolist()
