"""What the operators share: the shared folder, intermediate tables, whole-text helpers."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.shared import delete, materialize, new_path, path_and_files  # noqa: F401  (for the operators)

#: Words are runs of anything but the six ASCII separators.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEPARATORS = " \t\n\x0b\x0c\r"

#: Rows in one Arrow batch between the JVM and a Python worker, and its bytes: whole texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000


def prepare(spark: SparkSession) -> None:
    """What every operator needs of the session: workers that find this package, and Arrow batches of a bounded size (the session's own, if already smaller)."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    root = str(Path(__file__).resolve().parents[2])
    if root not in known.split(os.pathsep):  # executors on other machines need the package installed or shipped
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:  # a smaller one stays
            spark.conf.set(key, str(most))


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions of about that many stored bytes, by the optimizer's estimate from file sizes; the session's number where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return shuffle_partitions(df.sparkSession) if size >= 1 << 60 else max(1, -(-size // bytes_each))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: str | None) -> list[str]:
    """Words of a text in order; none for null."""
    return WORD.findall(text) if text else []


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, compared as Spark does, without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
