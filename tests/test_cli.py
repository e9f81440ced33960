import pytest
from pyspark.sql import functions as F

from rankloom import __main__ as cli
from rankloom.operators import profile
from rankloom.plans import bundles, catalog

DIR = "/root/testdata/sf0.001"


def test_names(capsys):
    assert cli.main(["list"]) == 0 and "pool_grid" in capsys.readouterr().out.split()
    assert all(set(q) <= set(catalog.queries()) for q in bundles.BUNDLES.values()) and set(bundles.BUILD) <= set(catalog.queries()) and len(bundles.BUNDLES) == 8
    with pytest.raises(SystemExit):
        cli.main(["run", "no_such_query", "--data", DIR])


def test_runs(spark, tmp_path):
    assert cli.main(["run", "doc_split", "--data", DIR, "--out", str(tmp_path)], spark) == 0
    assert cli.main(["build", "--data", DIR, "--out", str(tmp_path), "--task", "region_partition"], spark) == 0
    assert cli.main(["profile", "vocabulary", "--data", DIR, "--out", str(tmp_path)], spark) == 0
    for name in ("doc_split", "region_partition", *bundles.BUNDLES["vocabulary"]):
        assert spark.read.parquet(f"{tmp_path}/{name}").count() > 0


def test_repaired_spans_and_tags(spark):
    kind = "content string, spans array<struct<label:string,start:int,end:int,text:string>>"
    rows = [("  Java and  Spark SQL", [("L", 2, 5, "Java"), ("L", 11, 18, "Spark SQL"), ("L", 0, 3, "Rust"), ("L", 2, 6, "Java ")]), ("", [("L", 0, 1, "x")])]
    df = spark.createDataFrame(rows, kind)
    got = [(r.start, r.end, r.status) for r in profile.repaired_spans(df, "content", "spans").collect()]
    assert got == [(2, 5, "ok"), (12, 20, "moved"), (None, None, "lost"), (2, 6, "ok"), (None, None, "lost")]
    tagged = spark.createDataFrame([("  Java and  Spark SQL", [("K", 2, 5, ""), ("L", 12, 20, "")]), ("", []), (" one", [])], kind)
    assert [(r.tokens, r.tags) for r in profile.bio_tags(tagged, "content", "spans").collect()] == [(["Java", "and", "Spark", "SQL"], ["B-K", "O", "B-L", "I-L"]), ([], []), (["one"], ["O"])]
    labels = spark.createDataFrame([("Spark", ["PySpark", "spark"]), ("Go", None)], "name string, aliases array<string>")
    counts = spark.createDataFrame([("SPARK", 3), ("spark", 1), ("rust", 2)], "item string, n long")
    assert {tuple(r) for r in profile.build_vocabulary(labels, counts).collect()} == {("spark", 4, "label"), ("pyspark", 0, "label"), ("go", 0, "label"), ("rust", 2, "asked")}
    assert profile.containing(df, "content", "and  S").count() == 1 and df.select(F.count("*")).first()[0] == 2
