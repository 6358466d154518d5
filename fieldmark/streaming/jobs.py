"""Structured Streaming versions of ingest, ticks, rolling windows, counters and the change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from fieldmark.operators.lookup import latest_facts


def fact_stream(spark: SparkSession, path: str, glob: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """The event table as a stream of facts."""
    schema = spark.read.parquet(f"{path}/{glob}" if glob else path).schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(path)
    return e.select(
        F.col("user_id").alias("cell"), F.col("event_type").alias("band"), F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("bigint").alias("tslot"),
        F.col("value").alias("num"), F.col("ts").cast("timestamp").alias("signed_at"), F.col("event_id"), F.col("event_id").cast("string").alias("fact_cid"),
        (F.col("user_id") % 7).alias("signer"),
    )


def finish(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet, and read the sink back."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(target).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def ingest(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Append facts once per content id (within a day of event time); readers take the last write of
    every key."""
    once = stream.withWatermark("signed_at", "1 day").dropDuplicatesWithinWatermark(["fact_cid"])
    return latest_facts(finish(once, target, checkpoint))


def finish_counts(stream: DataFrame, target: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run an aggregating stream in update mode: every trigger adds the groups that changed under its own
    number (again after a failure, with the same result), readers take a group's last row."""

    def add(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/trigger={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    told = stream.sparkSession.read.parquet(target).groupBy(*keys).agg(F.max_by(F.struct(*rest), "trigger").alias("r"))
    return told.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in stream.columns])


def tick(seconds: int) -> Column:
    """Tumbling window of a tick, 5 to 300 seconds long."""
    return F.window("signed_at", f"{min(max(seconds, 5), 300)} seconds")


def corpus_ticks(stream: DataFrame, seconds: int = 15) -> DataFrame:
    """Facts and an estimate of distinct cells per tumbling window."""
    w = tick(seconds)
    return stream.withWatermark("signed_at", "1 day").groupBy(w.alias("w")).agg(F.count("*").alias("facts"), F.approx_count_distinct("cell").alias("cells")).select(
        F.col("w.start").alias("start"), "facts", "cells"
    )


def exact_ticks(facts: DataFrame, seconds: int = 15) -> DataFrame:
    """Ticks of a table, with the exact number of distinct cells."""
    return facts.groupBy(tick(seconds).alias("w")).agg(F.count("*").alias("facts"), F.count_distinct("cell").alias("cells")).select(F.col("w.start").alias("start"), "facts", "cells")


def band_ticks(stream: DataFrame, seconds: int = 15) -> DataFrame:
    """Facts per band and tumbling window."""
    g = stream.withWatermark("signed_at", "1 day").groupBy(tick(seconds).alias("w"), "band")
    return g.agg(F.count("*").alias("facts")).select(F.col("w.start").alias("start"), "band", "facts")


def top_bands(ticks: DataFrame, most: int = 3) -> DataFrame:
    """The bands with most facts of every tick, from the sink of ``band_ticks``."""
    order = Window.partitionBy("start").orderBy(F.desc("facts"), "band")
    return ticks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def fire_windows(stream: DataFrame) -> DataFrame:
    """Detections and largest power of the last 24 hours, every hour."""
    w = F.window("signed_at", "24 hours", "1 hour")
    return stream.withWatermark("signed_at", "24 hours").groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.max("num").alias("largest")).select(F.col("w.end").alias("end"), "n", "largest")


def fire_rows(stream: DataFrame, target: str, checkpoint: str, hours: int = 24) -> DataFrame:
    """Detections of a stream; those more than ``hours`` older than the newest one seen, their own
    trigger's included, are late and become absences. Every trigger writes its rows and its newest time
    under its own number, so that a repeated trigger gives the same rows."""
    spark = stream.sparkSession

    def add(df: DataFrame, number: int) -> None:
        here = df.agg(F.max(F.unix_micros("signed_at")).alias("newest"))
        if number > 0:
            before = spark.read.schema("newest long, trigger long").parquet(f"{target}/newest").where(F.col("trigger") < number)
            here = here.unionByName(before.select("newest"))
        newest = here.agg(F.max("newest").alias("newest")).first()["newest"]
        spark.createDataFrame([(newest,)], "newest long").coalesce(1).write.mode("overwrite").parquet(f"{target}/newest/trigger={number}")
        floor = F.lit(newest).cast("bigint") - hours * 3_600_000_000
        late = F.coalesce(F.unix_micros("signed_at") < floor, F.lit(False))
        told = df.withColumns({"kind": F.when(late, "absence").otherwise("primary"), "reason": F.when(late, "outside_window"), "num": F.when(~late, F.col("num"))})
        told.write.mode("overwrite").parquet(f"{target}/rows/trigger={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{target}/rows").drop("trigger")


def citation_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("signer").agg(F.count("*").alias("citations"), F.max("signed_at").alias("last_cited"))


CHANGES = "event_id long, old double, new double, delta double"


def change_feed(rows: DataFrame, last: DataFrame) -> DataFrame:
    """A change row for every write of a key that had a value before: in ``rows`` (cell, band, num,
    signed_at, event_id, trigger) or, before all of them, in ``last`` (the same without event_id, at most
    one row per key). One grouping by key; a key of any size is sorted on disk."""
    order = [F.col("trigger"), *[F.asc_nulls_last(c) for c in ("signed_at", "event_id", "num")]]
    both = last.withColumn("event_id", F.lit(None).cast("bigint")).unionByName(rows.withColumn("own", F.lit(True)), allowMissingColumns=True)
    told = both.withColumn("old", F.lag("num").over(Window.partitionBy("cell", "band").orderBy(*order))).where(F.col("own") & F.col("old").isNotNull())
    return told.select("event_id", "old", F.col("num").alias("new"), (F.col("num") - F.col("old")).alias("delta"))


def last_values(rows: DataFrame) -> DataFrame:
    """The last value of every key, in the order of ``change_feed``."""
    order = F.struct("trigger", *[x for c in ("signed_at", "event_id", "num") for x in (F.col(c).isNull(), F.col(c))])
    r = rows.groupBy("cell", "band").agg(F.max_by(F.struct("num", "signed_at", "trigger"), order).alias("r"))
    return r.select("cell", "band", "r.*")


def runs_of_triggers(n: int) -> list[int]:
    """Ends of the runs that make up the triggers 1 to ``n``, newest first: a run that ends at trigger k is
    as long as k's lowest bit, so there are log2 n at most and a key's value is written again as often."""
    out = []
    while n:
        out.append(n)
        n -= n & -n
    return out


def run_change_feed(stream: DataFrame, target: str, checkpoint: str, ttl_ms: int | None = None) -> DataFrame:
    """The changes of all that is there; the next run with the same checkpoint and target goes on from
    their state. The state is each key's last value. With ``ttl_ms`` it is forgotten once the newest write
    of earlier triggers is more than twice that later than the key's own, and writes that come more than
    ``ttl_ms`` behind that newest one are left out; else neither. Every trigger writes its changes, the
    last values of the run of triggers that it ends and the newest time under its own number, so that a
    repeated trigger gives the same rows."""
    spark = stream.sparkSession
    rows = stream.select("cell", "band", "num", "signed_at", "event_id")
    state = StructType([*[f for f in rows.schema if f.name != "event_id"], StructField("trigger", LongType())])

    def known(ends: list[int]) -> DataFrame:
        return spark.read.schema(state).parquet(*[f"{target}/last/{k}" for k in ends]) if ends else spark.createDataFrame([], state)

    def add(df: DataFrame, number: int) -> None:
        n = number + 1
        ends, first = runs_of_triggers(n - 1), n - (n & -n)
        df, last = df.withColumn("trigger", F.lit(n).cast("bigint")), known(ends)
        here, alive = known([k for k in ends if k > first]), F.lit(True)
        last = last_values(last.withColumn("event_id", F.lit(None).cast("bigint"))) if len(ends) > 1 else last
        if ttl_ms is not None:
            newest = spark.read.schema("newest long").parquet(f"{target}/newest/{number}").first()["newest"] if number else None
            own = df.agg(F.max(F.unix_micros("signed_at")).alias("newest")).first()["newest"]
            most = max((x for x in (newest, own) if x is not None), default=None)
            spark.createDataFrame([(most,)], "newest long").coalesce(1).write.mode("overwrite").parquet(f"{target}/newest/{n}")
            if newest is not None:
                at = F.unix_micros("signed_at")
                df = df.where(F.coalesce(at >= newest - ttl_ms * 1000, F.lit(True)))
                alive = F.coalesce(at >= newest - 2 * ttl_ms * 1000, F.lit(True))
        change_feed(df, last.where(alive)).write.mode("overwrite").parquet(f"{target}/changes/trigger={n}")
        # a run from the first trigger on has nothing before it that a forgotten value could uncover
        merged = last_values(here.withColumn("event_id", F.lit(None).cast("bigint")).unionByName(df))
        (merged.where(alive) if first == 0 else merged).write.mode("overwrite").parquet(f"{target}/last/{n}")

    spark.createDataFrame([], CHANGES).write.mode("overwrite").parquet(f"{target}/changes/trigger=0")
    rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(CHANGES).parquet(f"{target}/changes").drop("trigger")
