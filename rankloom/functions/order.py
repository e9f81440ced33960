"""Seeded hash orders: the same draw in any engine and any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def digest(*parts: Column | str | int) -> Column:
    """Hex digest of the parts joined by bars."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws("|", *cols), 256)


#: First hex digits of a draw that deal rows to groups of near equal size, each ordered by one task: 4,096 groups.
DEAL_DIGITS = 3


def draw_rank(seed: int | str, salt: str, ident: Column, by: list) -> Column:
    """1-based position in the shuffle drawn from seed and salt, within groups of ``by``."""
    return F.row_number().over(W.partitionBy(*by).orderBy(digest(seed, salt, ident), ident))


def ranked(df: DataFrame, key: Column, tie: Column, rank: str, total: str | None = None, by: list[str] | None = None) -> DataFrame:
    """df with each row's 1-based place over all rows by key (uniform hex digits, as of a digest), then tie; and the number of rows.

    Rows are dealt by the first digits of their key, counted and ordered deal by deal, and the counts of the deals
    before are added: no task sees more than its deal. The counts (4,096 rows at most for each of by, a handful of
    values such as seeds) are the only thing that is ever in one place.
    """
    by = by or []
    keyed = df.withColumn("_key", key).withColumn("_deal", F.substring("_key", 1, DEAL_DIGITS))
    counts = keyed.groupBy(*by, "_deal").agg(F.count("*").alias("_c"))
    running = W.partitionBy(*(by or [F.lit(0)]))
    before = F.sum("_c").over(running.orderBy("_deal").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")
    deals = counts.select(*by, "_deal", before.alias("_before"), F.sum("_c").over(running).alias(total or "_total"))
    place = F.row_number().over(W.partitionBy(*by, "_deal").orderBy("_key", tie)) + F.col("_before")
    out = keyed.join(F.broadcast(deals), [*by, "_deal"]).withColumn(rank, place)
    return out.drop("_key", "_deal", "_before", "_total")


def drawn(df: DataFrame, seed: int | str | Column, salt: str, ident: str, rank: str = "_r", total: str | None = None, by: list[str] | None = None) -> DataFrame:
    """df with each row's place in the shuffle of all rows that seed and salt draw."""
    return ranked(df, digest(seed, salt, F.col(ident)), F.col(ident), rank, total, by)


def opaque_id(*parts: Column) -> Column:
    """q_ and twelve hex digits."""
    return F.concat(F.lit("q_"), F.substring(digest(*parts), 1, 12))


def hash_int(hex_digits: int, *parts: Column | str | int) -> Column:
    """The first hex digits as a whole number; decimal, as sixteen of them exceed a long."""
    return F.conv(F.substring(digest(*parts), 1, hex_digits), 16, 10).cast("decimal(20,0)")


def doubly(pair_id: Column, fraction: float, seed: int) -> Column:
    """Whether a pair is in the fixed share that two annotators label."""
    return hash_int(16, seed, pair_id) % 10_000 < F.lit(round(fraction * 10_000))


def group_order(ident: Column, seed: int = 0) -> Column:
    return hash_int(12, seed, ident).cast("long")
