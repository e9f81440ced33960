"""Differences between two flat golden records: whole numbers exact, floats within a tolerance, types must agree."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOLERANCE = 1e-12


def flatten(spark: SparkSession, document: dict) -> DataFrame:
    """path, kind, value of every leaf of one record; a list also gives its length."""
    rows: list[tuple[str, str, str]] = []

    def walk(x, path: str) -> None:
        if isinstance(x, dict):
            for k in sorted(x):
                walk(x[k], f"{path}.{k}" if path else k)
        elif isinstance(x, list):
            rows.append((f"{path}.length", "int", str(len(x))))
            for k, y in enumerate(x):
                walk(y, f"{path}[{k}]")
        else:
            kind = "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "float" if isinstance(x, float) else "null" if x is None else "str"
            rows.append((path, kind, json.dumps(x)))

    walk(document, "")
    return spark.createDataFrame(rows, "path string, kind string, value string")


def by_group(found: DataFrame, expected: DataFrame, informational: tuple[str, ...] = ("environment",)) -> DataFrame:
    """group (a path's first name), paths, problems, ok: differences of informational groups are counted but never fail."""
    first = F.regexp_extract("path", r"^[^.\[]*", 0)
    every = expected.select(first.alias("group")).unionByName(found.select(first.alias("group"))).groupBy("group").agg(F.lit(1).alias("_"))
    n = expected.groupBy(first.alias("group")).agg(F.count("*").alias("paths"))
    wrong = found.groupBy(first.alias("group")).agg(F.count("*").alias("problems"))
    out = every.join(n, "group", "left").join(wrong, "group", "left").fillna(0, ["paths", "problems"])
    return out.select("group", "paths", "problems", ((F.col("problems") == 0) | F.col("group").isin(*informational)).alias("ok"))


def differences(expected: DataFrame, actual: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """path, problem for each path that is missing, unexpected or different."""
    e = expected.select("path", F.col("kind").alias("ek"), F.col("value").alias("ev"))
    a = actual.select("path", F.col("kind").alias("ak"), F.col("value").alias("av"))
    both = e.join(a, "path", "full")
    numbers = F.col("ek").isin("int", "float") & F.col("ak").isin("int", "float") & ((F.col("ek") == "float") | (F.col("ak") == "float"))
    close = F.abs(F.col("ev").try_cast("double") - F.col("av").try_cast("double")) <= tolerance
    same = F.when(numbers, close).otherwise((F.col("ek") == F.col("ak")) & (F.col("ev") == F.col("av")))
    problem = F.when(F.col("ek").isNull(), "unexpected").when(F.col("ak").isNull(), "missing").when(~same, "differs")
    return both.select("path", problem.alias("problem")).filter("problem is not null")
