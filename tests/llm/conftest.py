import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("shared")))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, pairs, extra=False):
    """documents with the given (doc_id, text) rows; extra adds columns whose names clash with those of operators."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for name in ("start", "length", "kept", "hash", "fp", "value", "batch", "n_words", "piece"):
            df = df.withColumn(name, F.lit("clash"))
    return df
