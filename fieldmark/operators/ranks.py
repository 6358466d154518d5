"""Exact order statistics of groups of any size, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import small_side, written

#: Accuracy of the sketch that proposes ranges, the share of ranks that a range spans to either side, and
#: rows of a group up to which its whole range is taken.
ACCURACY, MARGIN, SMALL_GROUP = 10_000, 4e-4, 50_000
#: Groups whose ranges are broadcast; more meet their rows by a shuffle join.
BROADCAST_GROUPS = 200_000


def rank_of(p: float, how: str, n: Column) -> Column:
    """0-based rank of the statistic among n values: ``nearest`` is round((n - 1) p), half away from
    zero; ``low`` and ``high`` are the ranks to either side of (n - 1) p."""
    at = (n - 1) * F.lit(float(p))
    return {"nearest": F.floor(at + 0.5), "low": F.floor(at), "high": F.ceil(at)}[how].cast("bigint")


def order_statistics(df: DataFrame, keys: list[str], value: str, stats: dict[str, tuple[float, str]], more: list[Column] | None = None) -> DataFrame:
    """One row per group: the exact value at every rank of ``stats`` (name: (p, how), see ``rank_of``), and
    the aggregates ``more``. Nulls and NaN of ``value`` have no rank, but count in ``more``; a group without
    values has null statistics.

    Groups of up to SMALL_GROUP values count equal values and run a sum over them. If there is a larger one,
    a sketch proposes a range of values around each rank; one pass counts exactly what lies below and within
    every range, which tells the range that holds the rank, whatever the sketch said; another counts equal
    values inside that range only. All passes combine on the map side. ``df`` is read two to four times:
    pass a table."""
    v = F.when(~F.isnan(value), F.col(value).cast("double"))
    base = written(df.groupBy(*keys).agg(F.count(v).alias("__n"), *(more or [])))
    rows = df.select(*keys, v.alias("__v")).where("__v is not null")
    every = range(len(stats))
    if (base.agg(F.max("__n")).first()[0] or 0) <= SMALL_GROUP:
        equal = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
        group = Window.partitionBy(*keys)
        summed = equal.select(*keys, "__v", F.sum("__c").over(group.orderBy("__v")).alias("__upto"), F.sum("__c").over(group).alias("__all"))
        at = [F.min(F.when(F.col("__upto") > rank_of(p, how, F.col("__all")), F.col("__v"))).alias(name) for name, (p, how) in stats.items()]
        return base.drop("__n").join(summed.groupBy(*keys).agg(*at), keys, "left")
    points = sorted({x for p, _ in stats.values() for x in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))})
    sketch = written(df.groupBy(*keys).agg(F.count(v).alias("__n"), F.min(v).alias("__min"), F.max(v).alias("__max"), F.percentile_approx(v, points, ACCURACY).alias("__q")))
    small = F.col("__n") <= SMALL_GROUP

    def bound(name: str, x: float, end: str) -> Column:
        return F.when(small, F.col(end)).otherwise(F.get("__q", F.lit(points.index(x)))).alias(name)

    ranges = sketch.where("__n > 0").select(
        *keys,
        "__n",
        *[bound(f"__lo{j}", max(p - MARGIN, 0.0), "__min") for j, (p, _) in enumerate(stats.values())],
        *[bound(f"__hi{j}", min(p + MARGIN, 1.0), "__max") for j, (p, _) in enumerate(stats.values())],
    )
    side = small_side(ranges, BROADCAST_GROUPS)
    counts = rows.join(side, keys).groupBy(*keys).agg(
        *[F.count_if(F.col("__v") < F.col(f"__lo{j}")).alias(f"__below{j}") for j in every],
        *[F.count_if(F.col("__v") <= F.col(f"__hi{j}")).alias(f"__upto{j}") for j in every],
    )

    def pick(j: int, p: float, how: str) -> Column:
        """The range that holds rank j: 0 below, 1 within, 2 above what was proposed."""
        rank, below, upto = rank_of(p, how, F.col("__n")), F.col(f"__below{j}"), F.col(f"__upto{j}")
        part = F.when(rank < below, 0).when(rank < upto, 1).otherwise(2)
        before = F.when(rank < below, F.lit(0).cast("bigint")).when(rank < upto, below).otherwise(upto)
        return F.struct(F.lit(j).alias("j"), (rank - before).alias("left"), part.alias("part"), F.col(f"__lo{j}").alias("lo"), F.col(f"__hi{j}").alias("hi"))

    picks = written(counts.join(ranges, keys).select(*keys, F.array(*[pick(j, p, how) for j, (p, how) in enumerate(stats.values())]).alias("__picks")))
    holds = F.filter(
        "__picks",
        lambda x: F.when(x["part"] == 0, F.col("__v") < x["lo"]).when(x["part"] == 1, F.col("__v").between(x["lo"], x["hi"])).otherwise(F.col("__v") > x["hi"]),
    )
    inside = rows.join(small_side(picks, BROADCAST_GROUPS), keys).select(*keys, "__v", F.explode(holds).alias("__x"))
    equal = inside.groupBy(*keys, "__x.j", "__x.left", "__v").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys, "j").orderBy("__v"))
    found = equal.withColumn("__upto", upto).where(F.col("__upto") > F.col("left")).groupBy(*keys, "j").agg(F.min("__v").alias("__v"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("j") == j, F.col("__v"))).alias(name) for j, name in enumerate(stats)])
    return base.drop("__n").join(wide, keys, "left")


def middle(low: str, high: str) -> Column:
    """Median from the two middle values."""
    return (F.col(low) + F.col(high)) / 2
