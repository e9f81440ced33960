import json

import pytest
from pyspark.sql import functions as F

from rankloom.operators import annotation, guards, overlap, profile, sampling
from rankloom.sources import readers, schemas, writers
from rankloom.streaming import log


def test_readers_and_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", "train"), ("b", "y", "test")], schemas.SPLIT)
    writers.by_partition(df, f"{tmp_path}/s", "split")
    writers.by_partition(df.filter("split = 'test'").withColumn("doc_id", F.lit("c")), f"{tmp_path}/s", "split")
    assert {(r.doc_id, r.split) for r in spark.read.parquet(f"{tmp_path}/s").collect()} == {("a", "train"), ("c", "test")}
    assert readers.partition(spark, f"{tmp_path}/s", "split", "test").count() == 1
    writers.replace(df.filter("split = 'test'"), f"{tmp_path}/s", "split")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 1
    with pytest.raises(FileNotFoundError):
        readers.partition(spark, f"{tmp_path}/none", "split", "test")
    writers.manifest(df, f"{tmp_path}/m", "doc_id")
    assert [r.doc_id for r in readers.csv(spark, f"{tmp_path}/m", schemas.SPLIT).collect()] == ["a", "b"] and readers.count_rows(spark, f"{tmp_path}/m", "csv") == 2
    writers.record(df.agg(F.count("*").alias("n")), f"{tmp_path}/r")
    assert readers.documents_json(spark, f"{tmp_path}/r", "n long").first().n == 2
    files = readers.files(spark, f"{tmp_path}/m", "*.csv", with_content=True).first()
    assert files.category == "m" and len(files.sha256) == 64


def test_json_lines(spark, tmp_path):
    p = tmp_path / "d"
    p.mkdir()
    rows = [{"content": "abc def", "annotation": [{"label": ["Skill"], "points": [{"start": 0, "end": 2, "text": "abc"}]}, {"label": "Name", "points": []}]}]
    (p / "x.json").write_text("\n".join(map(json.dumps, rows)) + "\n\nnot json\n")
    got = readers.tolerant_spans(spark, str(p)).collect()
    assert len(got) == 1 and [a.labels for a in got[0].annotation] == [["Skill"], ["Name"]]
    assert readers.json_lines(spark, f"{tmp_path}/none", schemas.RETURNS).count() == 0
    new = spark.createDataFrame([("p", 1), ("p", 2), ("p", 2)], "pair_id string, run int")
    assert [writers.append_new(new, f"{tmp_path}/log", ["pair_id", "run"]) for _ in range(2)] == [2, 0]
    assert readers.log(spark, f"{tmp_path}/nolog", schemas.JUDGEMENTS).count() == 0


def units(spark):
    return spark.createDataFrame([(f"j{j}__c{c}", f"j{j}", f"c{c}", j % 2, "generic") for j in range(3) for c in range(5)], "pair_id string, query_id string, doc_id string, batch int, stratum string")


def test_session(spark):
    pairs = units(spark)
    none = spark.createDataFrame([], "pair_id string, annotator string")
    group = annotation.serve(pairs, none, "ann", 0.0, 0).collect()
    assert len(group) == 5 and len({r.query_id for r in group}) == 1 and all(r.complete for r in group)
    some = spark.createDataFrame([(r.pair_id, "ann") for r in group[:2]], "pair_id string, annotator string")
    again = annotation.serve(pairs, some, "ann", 0.0, 0).collect()
    assert {r.pair_id for r in again} == {r.pair_id for r in group[2:]} and not any(r.complete for r in again)
    assert annotation.outstanding(pairs, some, "bob", 1.0, 0).count() == 15 and annotation.outstanding(pairs, some, "ann", 1.0, 0).count() == 13
    p = annotation.progress(pairs, some, "stratum").first()
    assert (p.total, p.done, p.partial_queries) == (15, 2, 1)


def test_validation(spark):
    rows = [("ok", "ann", "a", "Good Fit", "a", True), ("ok", "ann", "b", "No Fit", "a", True), ("who", " ", "a", "No Fit", None, True), ("open", "ann", "a", None, None, True), ("bad", "ann", "a", "Great", None, True)]
    rows += [("pick", "ann", "a", "Good Fit", None, True), ("off", "ann", "a", "No Fit", "a", True), ("unasked", "ann", "a", "Good Fit", "a", False), ("none", "ann", "a", "No Fit", None, True)]
    df = spark.createDataFrame(rows, "group_id string, annotator string, doc_id string, label string, pick string, asks_pick boolean")
    got = {r.group_id: r.problem for r in annotation.validate(df).collect()}
    assert got == {"ok": None, "none": None, "who": "no annotator", "open": "labels missing", "bad": "label outside the scheme", "pick": "pick is missing", "off": "pick is not relevant", "unasked": "pick was not asked"}


def test_returns(spark):
    raws = {"bare": '{"label": "No Fit"}', "fenced": '```json\n{"label": "Good Fit", "reason": "' + "y" * 400 + '"}\n```', "prose": "I think so", "fourth": '{"label": "Fair"}', "empty": '{"label": ""}', "list": '["Good Fit"]'}
    df = spark.createDataFrame([(k, 1, v) for k, v in raws.items()], "pair_id string, run int, raw string")
    got = {r.pair_id: r for r in annotation.parse_returns(df).collect()}
    assert got["bare"].label == "No Fit" and len(got["fenced"].reason) == 120 and got["fenced"].reason_overlong
    assert got["prose"].problem == "not JSON" and got["fourth"].problem == got["empty"].problem == "label outside the scheme" and got["list"].problem == "no label"
    with pytest.raises(guards.GuardError):
        annotation.collect(spark.createDataFrame([("other", 1)], "pair_id string, run int"), df)


def test_sections(spark):
    guide = "# T\na\n## Run\nb\n### x\nc\n## Keep\nd\n# New\ne"
    df = spark.createDataFrame([(1, guide)], "guide_id int, text string")
    assert annotation.kept_sections(df, ("Run",)).first().text == "# T\na\n## Keep\nd\n# New\ne\n"


def test_banded_pick(spark):
    scored = spark.createDataFrame([("q", f"d{i}", 1.0 - i / 10) for i in range(9)] + [("s", "d1", 0.5), ("s", "d2", 0.4)], "query_id string, doc_id string, score double")
    rows = sampling.banded_pick(scored, 5, 0).collect()
    q = sorted((r.slot, r.band) for r in rows if r.query_id == "q")
    assert q == [(0, "high"), (1, "mid"), (2, "low"), (3, "high"), (4, "mid")] and len({r.doc_id for r in rows if r.query_id == "q"}) == 5
    assert len([r for r in rows if r.query_id == "s"]) == 2
    queries = spark.createDataFrame([("a", "x"), ("b", "y")], "query_id string, keyword string")
    docs = spark.createDataFrame([(i, "x" if i < 60 else "y") for i in range(63)], "doc_id int, keyword string")
    picks = sampling.quota_candidates(queries, docs, 10, 8, 0).collect()
    assert len(picks) == 20 and len({r.doc_id for r in picks}) == 20
    assert sum(r.keyword_match for r in picks if r.query_id == "a") == 8 and sum(r.keyword_match for r in picks if r.query_id == "b") <= 3


def test_overlap_and_profile(spark):
    words = [f"w{i}" for i in range(30)]
    refs = spark.createDataFrame([(1, " ".join(words[:15])), (2, " ".join(words)), (3, "too short")], "ref_id int, text string")
    docs = spark.createDataFrame([(10, " ".join(["x", *words[:15], "y"])), (11, "nothing"), (12, None)], "doc_id int, text string")
    got = {r.doc_id: (r.ref_id, r.shared, r.containment) for r in overlap.best_containment(docs, refs).collect()}
    assert got == {10: (1, 8, 1.0), 11: (-1, 0, 0.0), 12: (-1, 0, 0.0)}
    spans = spark.createDataFrame([("abc def", [("L", 0, 2, "abc"), ("L", 1, 3, "abc")])], "content string, spans array<struct<label:string,start:int,end:int,text:string>>")
    assert tuple(profile.span_problems(spans, "content", "spans").first()) == ("L", 2, 1)
    assert profile.long_text_columns(spark.createDataFrame([("a" * 300, "b")], "t string, s string")) == ["t"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"p{i % 7}", "ann" if i % 2 else "bob", "Good Fit" if i % 3 else "No Fit") for i in range(20)]
    df = spark.createDataFrame(sorted({r[:2]: r for r in rows}.values()), "pair_id string, annotator string, label string")
    df.write.json(f"{tmp_path}/log")
    q = log.run_progress(log.read_log(spark, f"{tmp_path}/log", "pair_id string, annotator string, label string"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, log.counts(df).collect()))
