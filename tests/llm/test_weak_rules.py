import random
import re
from collections import Counter

import duckdb
import pytest

from rankloom.llm import weak_rules

from .conftest import documents


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    at = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(at)


def corpus(rng):
    texts = [None, "", " \t\n", "a", "a b", "a b c", "a b c d", "x x x", "x x x x", "la " * 400, "é🙂 #$ |\n\n \ndup\ndup\n dup\n", "one\r\ntwo\x0bthree\x0cfour"]
    for k in range(150):
        own = rng.choices("the of and to in alpha beta gamma delta".split() + [f"w{i}" for i in range(200)], k=rng.randint(30, 200))
        if k % 7 == 1:
            own = [x + "###" for x in own]
        if k % 7 == 2:
            own = [x.upper() + "!!" for x in own]
        if k % 7 == 3:
            own = [x for x in own[:20] for _ in range(6)]
        for i in range(10, len(own), 15):
            own[i] += "\n"
        texts.append(" ".join(own))
    return [*texts, "long " + " ".join(f"u{i % 900}" for i in range(20_000))]


@pytest.mark.parametrize("extra", [False, True])
def test_measures_and_verdicts(spark, extra):
    pairs = [*enumerate(corpus(random.Random(2))), (3, "same"), (3, "same"), (None, "no id")]
    rows = weak_rules.judge(documents(spark, pairs, extra)).collect()
    want = sorted(((i, *brute(t)) for i, t in pairs), key=repr)
    assert sorted((tuple(r)[:6] for r in rows), key=repr) == want
    by = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id > 12}
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    good = [r.kept for i, r in by.items() if (i - 12) % 7 not in (1, 2, 3) and r.n_words >= 80 and not r.base_failed]
    bad = [r.kept for i, r in by.items() if (i - 12) % 7 in (1, 2, 3) and i < 162]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_oracle_agrees(spark):
    pairs = [*enumerate(corpus(random.Random(4))), (3, "same"), (None, "no id")]
    rows = weak_rules.judge(documents(spark, pairs)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(p) for p in pairs])
    assert sorted(map(tuple, rows), key=repr) == sorted(con.sql(weak_rules.oracle_sql()).fetchall(), key=repr)


def test_no_python_in_the_plan_and_empty(spark):
    df = weak_rules.judge(documents(spark, []))
    assert df.collect() == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("kind", list(weak_rules.KINDS))
@pytest.mark.parametrize(("share", "good", "bad"), [(0.8, (0.9, 0.85, 0.95), (0.8, 0.7, 0.75)), (0.6, (0.8, 0.9, 0.75), (0.9, 0.8, 0.85)), (0.93, (0.97, 0.99, 0.9), (0.7, 0.95, 0.6))])
def test_planted_accuracies_are_recovered(spark, kind, share, good, bad):
    """Votes drawn with known accuracies and rates of abstaining: the estimates find them, and the posterior the classes."""
    rules, rng, n, votes, truth = weak_rules.KINDS[kind], random.Random(7), 60_000, Counter(), Counter()
    quiet = {1: (0.05, 0.2, 0.1), -1: (0.3, 0.1, 0.25)}
    for _ in range(n):
        z = 1 if rng.random() < share else -1
        v = tuple(0 if rng.random() < quiet[z][k] else z if rng.random() < (good if z > 0 else bad)[k] else -z for k in range(3))
        votes[v] += 1
        truth[v] += z
    patterns = spark.createDataFrame([(*v, k) for v, k in votes.items()], ", ".join(f"{r} int" for r in rules) + ", n long")
    row = weak_rules.estimate(patterns, rules, steps=200).first()
    assert abs(row["share"] - share) < 0.05
    for k, r in enumerate(rules):
        assert abs(row[f"good_{r}"] - good[k]) < 0.05 and abs(row[f"bad_{r}"] - bad[k]) < 0.05, r
        assert abs(row[f"quiet_good_{r}"] - quiet[1][k]) < 0.05 and abs(row[f"quiet_bad_{r}"] - quiet[-1][k]) < 0.05, r


def test_every_kind_of_bad_document_goes(spark):
    """Kinds that never occur together, the rarer of one in forty: each is found, and clean documents stay."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("aeioutrnsl", k=rng.randint(3, 9)))
    texts = []
    for k in range(400):
        own = [word() for _ in range(rng.randint(90, 160))]
        if k % 40 == 1:
            own = [w + rng.choice(("###", "$$$", "%%%")) for w in own]
        if k % 40 == 2:
            own = [x for w in own for x in (w, "|")]
        if k % 40 == 3:
            own = (["BUY NOW!!!", "so cheap!"] * 60) + own[:40]
        texts.append("\n".join(" ".join(own[i : i + 12]) for i in range(0, len(own), 12)))
    rows = {r.doc_id: r.kept for r in weak_rules.judge(documents(spark, list(enumerate(texts)))).collect()}
    assert not any(v for k, v in rows.items() if k % 40 in (1, 2, 3))
    clean = [v for k, v in rows.items() if k % 40 not in (1, 2, 3)]
    assert sum(clean) >= 0.99 * len(clean)
