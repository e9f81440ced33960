import hashlib
import random
import re
from collections import Counter

import pytest

from rankloom.llm import common, substrings

from .conftest import documents


def brute(pairs, size):
    own = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in pairs]
    n = Counter(tuple(w[i : i + size]) for w in own for i in range(len(w) - size + 1))
    out = []
    for (doc_id, _), w in zip(pairs, own, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if n[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(rng):
    fresh = lambda n: " ".join(rng.choices([f"w{k}" for k in range(400)], k=n))
    passages = [fresh(n) for n in (35, 36, 50, 90, 34)]
    texts = [None, "", "  ", "few words", "same " * 100, fresh(35), "la la lé " * 60, passages[2], passages[2]]
    for k in range(60):
        parts = [fresh(rng.randint(0, 80))]
        for _ in range(k % 4):
            p = rng.choice(passages).split()
            parts += [" ".join(p[rng.randint(0, 5) :]), fresh(rng.randint(0, 60))]
        texts.append("\n".join(parts))
    long = fresh(6000)
    return [*texts, long, "start " + long + "  end", long[:9000]]


def result(df):
    return sorted(((None if r.doc_id is None else int(r.doc_id), *r[1:]) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize(("most_bits", "batches"), [(substrings.MOST_BITS, 3), (1 << 13, 2), (64, 1)])
def test_equals_brute_force(spark, most_bits, batches):
    """With a sparse bitmap, a crowded one, and none at all."""
    pairs = [*enumerate(corpus(random.Random(6)))]
    pairs += [(3, pairs[20][1]), (20, pairs[20][1]), (20, pairs[20][1]), (None, pairs[30][1])]
    df = substrings.deduplicate(documents(spark, pairs, extra=True), batches=batches, most_bits=most_bits)
    assert result(df) == sorted(brute(pairs, 35), key=repr)
    for r in df.collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert substrings.deduplicate(documents(spark, [])).collect() == []


def test_words_of_any_bytes(spark):
    """Separators are the six ASCII ones alone, and text ends are word ends."""
    rng = random.Random(3)
    letters = ["a", "b", "é", "漢", "\u00a0", "\u2003", "\x00", "\x1c", "\x7f", " ", " ", "\t", "\x0b", "\r\n"]
    pairs = [(k, "".join(rng.choices(letters, k=rng.choice([0, 1, 40, 400])))) for k in range(200)]
    assert result(substrings.deduplicate(documents(spark, pairs), size=3, run=2)) == sorted(brute(pairs, 3), key=repr)


def test_many_equal_rows(spark):
    """A list of hits has a text's windows once, however often the row is there."""
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.range(10_000, numPartitions=4).selectExpr("cast(7 as long) doc_id", f"'{text}' as text").unionByName(documents(spark, [(1, "x " + text), (2, "a b")]).select("doc_id", "text"))
    rows = substrings.deduplicate(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, rows)) == [(1, 201, 200, 1), (2, 2, 0, 1), (7, 200, 200, 10_000)]
    hits, _ = substrings.verified(docs, substrings.anchors(docs).select("fp"))
    assert max(len(r.hits) for r in hits.collect()) <= 200 - 34


def test_new_batches_against_a_kept_log(spark):
    rng, path, seen = random.Random(8), common.new_path(spark, "log"), []
    texts = corpus(rng)
    rng.shuffle(texts)
    for k in range(4):
        batch = [(100 * k + i, t) for i, t in enumerate(texts[k::4])]
        log = substrings.WindowLog(spark, path, most_runs=2)  # opened anew each time
        history = documents(spark, seen) if seen else documents(spark, []).limit(0)
        got = result(substrings.deduplicate_batch(documents(spark, batch), history, log))
        own = {i for i, _ in batch}
        assert got == sorted((r for r in brute(seen + batch, 35) if r[0] in own), key=repr)
        seen += batch
        assert len(log.tables) <= 2
    log.compact()
    (run,) = log.tables
    assert log.read(run).count() == substrings.anchors(documents(spark, seen)).select("fp").distinct().count()
    two = substrings.WindowLog(spark, path)
    # a run joins another without a shuffle
    plan = two.read(run).select("fp").hint("merge").join(log.read(run).select("fp").hint("merge"), "fp", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
