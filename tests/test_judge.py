import hashlib
import random

import pytest

from rankloom.operators import agreement, annotation, guards, judge
from rankloom.sources import readers, registry, writers

LOG = "pair_id string, run int, draw string"


def pairs(spark):
    return spark.createDataFrame([("a__b", "a query, mail me@example.org", "a text"), ("a__c", "a query", None)], "pair_id string, query_text string, candidate_text string")


def test_prompts(spark):
    rows = {r.pair_id: r for r in judge.render(pairs(spark), 1, "recheck").collect()}
    text = rows["a__b"].prompt
    assert text.startswith("JOB DESCRIPTION\na query, mail [EMAIL]\n\nCANDIDATE\na text\n\nReply with one JSON object") and text.endswith('chars"}')
    assert rows["a__b"].prompt_sha256 == hashlib.sha256(text.encode()).hexdigest() and rows["a__b"].chars_sent == len(text)
    told = spark.createDataFrame([("x", "the a1_label is", "t")], "pair_id string, query_text string, candidate_text string")
    with pytest.raises(guards.GuardError, match="tells the judge"):
        judge.render(told, 1, "recheck")


def test_dispatch_is_idempotent_and_holds_one_draw(spark, tmp_path):
    none = spark.createDataFrame([], LOG)
    sent = judge.dispatch(pairs(spark), none, 1, "recheck").select("pair_id", "run", "draw")
    assert writers.append_new(sent, f"{tmp_path}/log", ["pair_id", "run"]) == 2
    log = readers.json_lines(spark, f"{tmp_path}/log", LOG)
    assert judge.dispatch(pairs(spark), log, 1, "recheck").count() == 0
    with pytest.raises(judge.MixedDraw):
        judge.dispatch(pairs(spark), log, 1, "whole")
    with pytest.raises(judge.MixedDraw):
        judge.dispatch(pairs(spark), spark.createDataFrame([("z", 1, None)], LOG), 1, "recheck")


def test_backfill(spark):
    log = spark.createDataFrame([("a", 1, None), ("b", 1, None), ("a", 2, None), ("b", 2, None), ("c", 2, None), ("c", 3, "given")], LOG)
    narrow = spark.createDataFrame([("a",), ("b",)], "pair_id string")
    got = {(r.pair_id, r.run): r.draw for r in judge.backfill_draw(log, narrow, "recheck", "whole").collect()}
    assert got == {("a", 1): "recheck", ("b", 1): "recheck", ("a", 2): "recheck", ("b", 2): "recheck", ("c", 2): "whole", ("c", 3): "given"}
    with pytest.raises(guards.GuardError):
        judge.backfill_draw(log.filter("not (pair_id = 'b' and run = 2)"), narrow, "recheck", "whole")


def test_instruments(spark):
    guides = spark.createDataFrame([(1, "# G\nkeep r_00ff and j_12\n## Run it\ndrop\n")], "guide_id int, text string")
    row = judge.instruments(guides, ("Run it",)).first()
    assert row.definition == judge.HEAD + "# G\nkeep r_00ff and j_12\n" and row.agent_sha256 == hashlib.sha256(row.definition.encode()).hexdigest()
    assert judge.require_current(row.definition, row.definition) == row.agent_sha256
    for stored in (None, row.definition + " "):
        with pytest.raises(judge.NotCurrent):
            judge.require_current(stored, row.definition)
    assert [r.example for r in judge.example_ids(guides).collect()] == ["r_00ff"]
    wide = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, doc_id string")
    guards.require_nested(wide.limit(1), wide, "query_id", "doc_id")
    with pytest.raises(guards.GuardError):
        guards.require_nested(wide, wide.filter("doc_id = 'a'"), "query_id", "doc_id")


def test_routes(spark):
    rows = spark.createDataFrame([("a", "one"), ("b", "two")], "pair_id string, draw string")
    assert {k: [r.pair_id for r in v.collect()] for k, v in judge.routed(rows, ("one", "two")).items()} == {"one": ["a"], "two": ["b"]}
    with pytest.raises(guards.GuardError):
        judge.routed(rows, ("one",))


def test_kappa_interval(spark):
    rng = random.Random(1)
    rows = [("g", f"p{k}", a := rng.choice(agreement.LABELS), a if rng.random() < 0.7 else rng.choice(agreement.LABELS)) for k in range(60)]
    rows += [("constant", f"p{k}", "No Fit", "No Fit") for k in range(5)]
    got = {r.grp: r for r in agreement.kappa_interval(spark.createDataFrame(rows, "grp string, pair_id string, a string, b string"), ["grp"], "pair_id", draws=400).collect()}
    g = got["g"]
    assert g.n == 60 and g.ci_low < g.kappa < g.ci_high and g.ci_high - g.ci_low < 0.6
    assert got["constant"].kappa is None and got["constant"].ci_low is None and got["constant"].agreement == 1.0

    def kappa(sample):
        n = len(sample)
        po = sum(a == b for a, b in sample) / n
        pe = sum(sum(a == k for a, _ in sample) * sum(b == k for _, b in sample) for k in agreement.LABELS) / n / n
        return (po - pe) / (1 - pe)

    own = [(a, b) for grp, _, a, b in sorted(rows, key=lambda r: r[1]) if grp == "g"]
    number = lambda d, i: int(hashlib.sha256(f"0|{d}|{i}".encode()).hexdigest()[:8], 16) % 60
    draws = sorted(kappa([own[number(d, i)] for i in range(60)]) for d in range(400))
    at = lambda q: draws[int(q * 399)] + (q * 399 - int(q * 399)) * (draws[int(q * 399) + 1] - draws[int(q * 399)])
    assert g.ci_low == pytest.approx(at(0.025), abs=1e-5) and g.ci_high == pytest.approx(at(0.975), abs=1e-5)


def test_reports_by_instrument(spark):
    said = spark.createDataFrame([("x", "a", 1, "No Fit"), ("x", "a", 2, "Good Fit"), ("x", "b", 1, None), ("x", "b", 2, "No Fit"), ("y", "a", 3, "Good Fit")], "agent_sha256 string, pair_id string, run int, label string")
    assert {(r.agent_sha256, r.pair_id): r.label for r in judge.one_label(said, "agent_sha256").collect()} == {("x", "a"): "No Fit", ("x", "b"): "No Fit", ("y", "a"): "Good Fit"}
    assert [tuple(r) for r in judge.current_labels(said, "x").collect()] == [("b", "No Fit")]  # a tie is left out
    drawn = spark.createDataFrame([("a",)], "pair_id string")
    assert {(r.agent_sha256, r.label): r.n for r in judge.marginals(said, drawn).collect()} == {(g, x): int((g, x) in {("x", "No Fit"), ("y", "Good Fit")}) for g in "xy" for x in agreement.LABELS}
    assert [(r.agent_sha256, r.run_a, r.run_b, r.n) for r in judge.self_consistency(said).collect()] == [("x", 1, 2, 1)]
    three = judge.three_way(*(spark.createDataFrame(x, "pair_id string, label string") for x in ([("a", "No Fit"), ("b", "Good Fit")], [("a", "No Fit"), ("b", "No Fit")], [("a", "No Fit"), ("b", "Good Fit"), ("c", "No Fit")])))
    assert {tuple(r) for r in judge.classwise(three).collect()} == {("No Fit", 1, 1.0, 1.0), ("Good Fit", 1, 0.0, 1.0)} and [r.pair_id for r in judge.disagreements(three).collect()] == ["b"]


def test_registry(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/one")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "x.txt").write_text("hello")
    digest = hashlib.sha256(b"hello").hexdigest()
    art = registry.Artifact
    sources = [
        registry.Source("fine", "a", True, True, (art("one", "*.parquet", 1, "parquet", 5), art("two", "*.txt", 1, "text", None, {"x.txt": digest}))),
        registry.Source("rows", "a", True, False, (art("one", "*.parquet", 1, "parquet", 6),)), registry.Source("gone", "b", False, True, (art("none"),)),
        registry.Source("changed", "b", False, False, (art("two", "*.txt", 1, "text", None, {"x.txt": "0" * 64}),)), registry.Source("bare", "c", False, False),
    ]
    got = {r.name: (r.ok, r.problems) for r in registry.verify_sources(spark, str(tmp_path), sources, with_digest=True).collect()}
    assert got == {"fine": (True, ""), "rows": (False, "rows differ"), "gone": (False, "files missing"), "changed": (False, "digests differ"), "bare": (True, "")}
    assert [s.name for s in registry.automated(sources)] == ["fine", "rows"] and len(registry.manual(sources)) == 3 and registry.table(spark, sources).count() == 5


def test_campaign_file_language_swap_and_streams(spark, tmp_path):
    from rankloom.streaming import log

    assert readers.campaign(spark, f"{tmp_path}/none", [{"batch": 1}]) == [{"batch": 1}]
    (tmp_path / "specs.json").write_text('{"batch": 2}\n\n{"batch": 1}\n')
    assert readers.campaign(spark, f"{tmp_path}/specs.json", []) == [{"batch": 1}, {"batch": 2}]
    docs = spark.createDataFrame([(1, "en", "x"), (2, "en", "  "), (3, "de", "x"), (4, "en", None), (5, "en", "y")], "doc_id int, lang string, text string")
    regions = spark.createDataFrame([(1, "eval"), (5, "train")], "doc_id int, region string")
    assert [r.doc_id for r in readers.in_language(docs).collect()] == [1, 5] and [r.doc_id for r in readers.in_language(docs, "en", regions).collect()] == [1]
    for k in range(2):
        before = spark.read.parquet(f"{tmp_path}/t") if k else spark.range(3)
        writers.swap(before.selectExpr("id + 1 as id"), f"{tmp_path}/t")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [2, 3, 4] and not (tmp_path / "t.old").exists()
    rows = spark.createDataFrame([("p", "ann", "No Fit", "2024-01-01 00:00:00"), ("p", "ann", "Good Fit", "2024-01-01 00:00:00"), ("p", "bob", "No Fit", "2024-01-01 00:00:00")], "pair_id string, annotator string, label string, at string")
    rows.selectExpr("pair_id", "annotator", "label", "cast(at as timestamp) at").write.json(f"{tmp_path}/in")
    stream = log.read_log(spark, f"{tmp_path}/in", "pair_id string, annotator string, label string, at timestamp")
    for _ in range(2):  # a second run finds nothing new
        log.append_labels(stream, f"{tmp_path}/sink", f"{tmp_path}/cp").awaitTermination(120)
    assert sorted((r.pair_id, r.annotator) for r in spark.read.json(f"{tmp_path}/sink").collect()) == [("p", "ann"), ("p", "bob")]


def test_served_texts_are_masked(spark):
    units = spark.createDataFrame([("q__d", "q", "d", "call me@example.org")], "pair_id string, query_id string, doc_id string, text string")
    none = spark.createDataFrame([], "pair_id string, annotator string")
    assert annotation.serve(units, none, "ann", 0.0, 0, redact=("text",)).first().text == "call [EMAIL]"
    with pytest.raises(guards.GuardError):
        guards.require_clean(units, "text")
