"""Guards: raise on the driver before a wrong result leaves, one action each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text


class GuardError(ValueError):
    """A stated condition on a table does not hold."""


def require_none(violations: DataFrame, message: str) -> None:
    found = violations.limit(5).collect()
    if found:
        raise GuardError(f"{message}: {[tuple(r) for r in found]}")


def require_clean(df: DataFrame, *columns: str) -> None:
    """No text of these columns may have personal data left."""
    left = F.lit(0)
    for name in columns:
        for n in text.residuals(F.col(name)).values():
            left = left + n
    require_none(df.select(left.alias("residuals")).filter("residuals > 0"), "personal data is left")


def require_nested(narrow: DataFrame, wide: DataFrame, *keys: str) -> None:
    """Every row of the narrow draw must be in the wide one, or no figure over one may stand beside one over the other."""
    require_none(narrow.select(*keys).join(wide.select(*keys), list(keys), "left_anti"), "the narrow draw is not within the wide one")


def check(name: str, violations: DataFrame) -> DataFrame:
    """check, ok, n_violations: one row for a table that must be empty."""
    return violations.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("check"), (F.col("n_violations") == 0).alias("ok"), "n_violations")


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by an explicit order."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def require_known(requested: DataFrame, known: DataFrame, key: str) -> None:
    """Every requested key must be known; never an empty result in silence."""
    require_none(requested.join(known, key, "left_anti"), f"unknown {key}")
