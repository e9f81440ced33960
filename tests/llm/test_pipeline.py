"""The pipeline against its stages' brute-force versions on a small corpus."""

import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from rankloom.llm import quality, secrets

from . import test_decontamination, test_simhash
from .conftest import DOCS

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rng = random.Random(12)
    fine = [f"word{k}" for k in range(400)]
    item = " ".join(rng.choices([f"bench{k}" for k in range(60)], k=30))
    rows = []
    for k in range(160):
        own = rng.choices(fine, k=rng.randint(30, 120))
        if k % 5 == 0:
            for _ in range(4):
                own.insert(rng.randrange(len(own)), rng.choice("scum idiot trash moron".split()))
        if k % 16 == 1:
            own[10:10] = item.split()
        if k % 16 == 2:
            own[5:5] = ['password = "Zq81kLmm02xx"']
        rows.append((k, " ".join(own)))
    rows += [(1000 + i, t) for i, t in rows[:40]] + [(2000, None), (2001, ""), (30, rows[30][1])]
    return rows, item


def test_run(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i, _ in rows if i < 120]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [(i, t) for i, t in rows if model.tails(t)[-1] >= 0.5]
    assert 0.7 * len(rows) < len(left) < len(rows)
    components = {c: (i, t) for (i, t), (_, _, c) in zip(left, test_simhash.brute(left), strict=True) if i == c}
    left = list(components.values())
    left = [p for p, r in zip(left, test_decontamination.brute(left, [(7, item)]), strict=True) if not r[4]]
    left = [(i, secrets.redact_text(t)) for i, t in left]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in left}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.length for r in got} == want and len(got) == len(want)
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(want.values()) // 1024) + 1
    assert not any("Zq81kLmm02xx" in (x or "") for _, x in left)


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (None, None, None, None, None), (1, "a b", "en", "s", 3)], DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], DOCS).schema], name
    assert docs.count() == 2
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.collect() == []
