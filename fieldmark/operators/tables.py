"""Shared table operations: broadcasts behind a count, the best rows of every group, staged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldmark.sources.fixtures import scratch

#: Rows of a registry (bands, topics, recipes) up to which it is broadcast.
REGISTRY_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = REGISTRY_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``max_rows`` rows; else the join is left to
    Spark (shuffle, with adaptive skew handling)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor repeats nothing before it."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a group up to which Spark cuts every task's groups before the shuffle, and parts that a group
#: is dealt to beyond.
GROUP_LIMIT, DEAL = 1000, 64


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of every group in ``order``, with their rank from 1. Every task first cuts its own
    rows of a group to k (Spark's group limit, for k up to GROUP_LIMIT), so a group sends at most k rows a
    task; for larger k a group is cut in DEAL parts by a hash of the row. ``order`` must set apart rows that
    differ, else their choice is open."""
    if k <= GROUP_LIMIT:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
    part = "__part"
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*df.columns), F.lit(DEAL)))
    first = Window.partitionBy(*keys, part).orderBy(*order)
    kept = dealt.withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= k).drop(part)
    last = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(last)).where(F.col(rank) <= k)
