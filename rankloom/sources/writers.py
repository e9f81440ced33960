"""Sinks: Parquet by split, deterministic CSV manifests, one-row JSON records, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom import shared


def by_partition(df: DataFrame, path: str, column: str) -> None:
    """Replace the partitions that df has; others stay (an absent one is not truncated)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def replace(df: DataFrame, path: str, column: str) -> None:
    """All partitions anew: one that df lacks goes."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(column).parquet(path)


def manifest(df: DataFrame, path: str, *keys: str) -> None:
    """One sorted CSV file without a timestamp; for committed lists of bounded size."""
    df.orderBy(*keys).coalesce(1).write.mode("overwrite").csv(path, header=True, lineSep="\n")


def record(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON document."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows are only ever added."""
    df.write.mode("append").csv(path, header=True, escape='"')


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append as JSON lines what the log does not hold by its keys; returns how many rows were new."""
    from rankloom.sources.readers import json_lines

    fresh = df.join(json_lines(df.sparkSession, path, df.schema).select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    fresh = shared.kept(fresh, "fresh")  # counted and written, made once
    n = fresh.count()
    if n:
        fresh.write.mode("append").json(path)
    return n


def swap(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replace a table by one that may be made from it: the new one is written beside it, and takes its place when it is whole.

    A driver lost between the two renames leaves the old table under ``path.old``.
    """
    spark = df.sparkSession
    fresh, old = f"{path}.new", f"{path}.old"
    shared.delete(spark, fresh, old)
    df.write.format(kind).save(fresh)
    target, files = shared.path_and_files(spark, path)
    moved = not files.exists(target) or files.rename(target, shared.path_and_files(spark, old)[0])
    if not (moved and files.rename(shared.path_and_files(spark, fresh)[0], target)):
        raise OSError(f"{path} could not be replaced; the new table is at {fresh}")
    shared.delete(spark, old)


def exclusions(found: DataFrame, path: str) -> None:
    """The list of excluded documents as one CSV file, the largest containment first; as long as the overlap it lists."""
    found.orderBy(F.desc("containment"), "doc_id").coalesce(1).write.mode("overwrite").csv(path, header=True, lineSep="\n")
