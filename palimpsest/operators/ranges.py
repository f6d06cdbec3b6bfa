"""Ranges of a sort order: cut where Spark's range sampling cuts, found again by bisection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cuts(df: DataFrame, column: str, n: int | None = None) -> list:
    """Ascending first values of n ranges of about equal rows, without the first range's; n is by default the session's number of shuffle partitions.

    Equal values are never cut apart."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return []
    firsts = df.select(column).filter(F.col(column).isNotNull()).repartitionByRange(n, column).groupBy(F.spark_partition_id()).agg(F.min(column).alias("first"))
    return sorted(r["first"] for r in firsts.collect())[1:]  # one value a range


def range_of(column: str | Column, at: list) -> Column:
    """The number of the range: how many cuts are at most the value (0 for null)."""
    key = F.col(column) if isinstance(column, str) else column
    if not at:
        return F.lit(0)
    steps, values = F.array(*[F.lit(1 << k) for k in reversed(range(len(at).bit_length()))]), F.array(*map(F.lit, at))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= len(at)) & (F.get(values, n + s - 1) <= key), n + s).otherwise(n))
