"""Time series per (cell, band): trends, forecasts, runs, rolling baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .aggregate import counted_median
from .tables import small_side


def trend(series: DataFrame) -> DataFrame:
    """Least-squares slope per slot of every key with at least three points."""
    g = series.groupBy("key").agg(F.regr_slope("num", "t").alias("slope"), F.count("*").alias("parents"))
    return g.where("parents >= 3")


def seasonal_forecast(series: DataFrame, lookback: int = 6, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """One step ahead: 0.6 (value nearest to 12 slots back, within one slot, among the last
    ``lookback`` points, else the mean) + 0.3 (last + slope) + 0.1 mean, clamped."""
    order = Window.partitionBy("key").orderBy(F.desc("t"))
    cut = series.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= lookback)
    last = F.max(F.struct("t", "num"))
    g = cut.groupBy("key").agg(
        last.alias("last"), F.avg("num").alias("mean"), F.coalesce(F.regr_slope("num", "t"), F.lit(0.0)).alias("slope"),
        F.collect_list(F.struct("t", "num")).alias("points"),
    )
    lag = F.filter("points", lambda p: F.abs(p["t"] - (F.col("last.t") - 12)) <= 1)
    near = F.array_min(F.transform(lag, lambda p: F.struct(F.abs(p["t"] - (F.col("last.t") - 12)).alias("d"), p["t"].alias("t"), p["num"].alias("num"))))
    value = 0.6 * F.coalesce(near["num"], F.col("mean")) + 0.3 * (F.col("last.num") + F.col("slope")) + 0.1 * F.col("mean")
    return g.select("key", F.greatest(F.least(value, F.lit(hi)), F.lit(lo)).alias("forecast"))


def lag_pairs(vintages: DataFrame, lags: int = 3) -> DataFrame:
    """Sliding (``lags`` vectors, next vector) pairs of the longest run of consecutive years of every
    cell (first on ties), the newest pair held out."""
    years = vintages.groupBy("cell", "year").agg(F.min("vec").alias("vec"))
    w = Window.partitionBy("cell").orderBy("year")
    islands = years.withColumn("island", F.col("year") - F.row_number().over(w))
    size = islands.groupBy("cell", "island").agg(F.count("*").alias("n")).where(F.col("n") > lags)
    best = size.groupBy("cell").agg(F.max(F.struct("n", (-F.col("island")).alias("i"))).alias("b")).select("cell", (-F.col("b.i")).alias("island"))
    run = islands.join(best, ["cell", "island"])
    back = Window.partitionBy("cell").orderBy("year").rowsBetween(-lags, -1)
    pairs = run.withColumn("inputs", F.collect_list("vec").over(back)).where(F.size("inputs") == lags)
    newest = Window.partitionBy("cell")
    return pairs.select("cell", "year", "inputs", F.col("vec").alias("target"), (F.col("year") == F.max("year").over(newest)).alias("held_out"))


def persistence_forecast(vintages: DataFrame) -> DataFrame:
    """Newest vector as the forecast of the next year, for cells with three vintages or more."""
    g = vintages.groupBy("cell").agg(F.countDistinct("year").alias("n"), F.max(F.struct("year", "vec")).alias("last")).where("n >= 3")
    return g.select("cell", (F.col("last.year") + 1).alias("year"), F.col("last.vec").alias("forecast"))


def persistence_score(vintages: DataFrame) -> DataFrame:
    """Cosine and squared error of the last vintage but one as the forecast of the last, for cells with
    three vintages or more."""
    from .vectors import cosine, l2

    years = vintages.groupBy("cell", "year").agg(F.min("vec").alias("vec"))
    w = Window.partitionBy("cell")
    last = years.select(
        "cell", "year", "vec", F.lag("vec").over(w.orderBy("year")).alias("before"), F.max("year").over(w).alias("newest"), F.count("*").over(w).alias("n")
    ).where("n >= 3 and year = newest")
    a, b = F.col("vec"), F.col("before")
    return last.select("cell", "year", cosine(a, b).alias("cosine"), (l2(a, b) * l2(a, b)).alias("squared_error"))


def temporal_recipe(facts: DataFrame, recipe: DataFrame, now: int) -> DataFrame:
    """One value per (cell, recipe step). ``recipe``: (band, lookback, aggregator, purpose, trigger), one
    row per step; a lookback of 0 is a static step, which takes slot 0. A step with a trigger is run for
    cells whose newest value of the band, up to ``now``, reaches it."""
    recipe = small_side(recipe, 100_000)
    primary = facts.where(F.col("kind") == "primary")
    if "event_id" not in facts.columns:
        primary = primary.withColumn("event_id", F.lit(0).cast("bigint"))
    guarded = recipe.where("trigger is not null").select("band").distinct()
    snapshot = (
        primary.where(F.col("tslot") <= now).join(guarded, "band", "left_semi").groupBy("cell", "band")
        .agg(F.max_by("num", F.struct("tslot", "event_id")).alias("snapshot"))
    )
    f = primary.join(recipe, "band").join(snapshot, ["cell", "band"], "left")
    window = F.when(F.col("lookback") == 0, F.col("tslot") == 0).otherwise((F.col("tslot") <= now) & (F.col("tslot") > now - F.col("lookback")))
    inside = f.where(window & (F.col("trigger").isNull() | (F.col("snapshot") >= F.col("trigger"))))
    g = inside.groupBy("cell", "band", "aggregator", "purpose").agg(
        F.sum("num").alias("sum"), F.avg("num").alias("mean"), F.max("num").alias("max"), F.min("num").alias("min"),
        F.max(F.struct("tslot", "event_id", "num")).alias("latest"), F.min(F.struct("tslot", "event_id", "num")).alias("first"),
    )
    middle = counted_median(inside.where("aggregator = 'median'"), ["cell", "band", "purpose"], "num")
    g = g.join(middle, ["cell", "band", "purpose"], "left")
    value = F.col("sum")
    for name in ("mean", "max", "min", "median"):
        value = F.when(F.col("aggregator") == name, F.col(name)).otherwise(value)
    value = F.when(F.col("aggregator") == "latest", F.col("latest.num")).when(F.col("aggregator") == "first", F.col("first.num")).otherwise(value)
    return g.select("cell", "band", "purpose", value.alias("value"))


def rolling_zscore(facts: DataFrame, n: int) -> DataFrame:
    """z of each value against the n values before it of its own (cell, band)."""
    w = Window.partitionBy("cell", "band").orderBy("tslot", "event_id").rowsBetween(-n, -1)
    base = facts.select("cell", "band", "tslot", "event_id", "num", F.avg("num").over(w).alias("m"), F.stddev_samp("num").over(w).alias("sd"), F.count("num").over(w).alias("k"))
    return base.select("event_id", F.when((F.col("k") == n) & (F.col("sd") > 0), (F.col("num") - F.col("m")) / F.col("sd")).alias("z"))
