"""Shared helpers of the training-data operators: staging, small columns, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.ship import ship

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent in a local session (a test) a temporary folder is made, once per
    application, and also registered for ``checkpoint()``; elsewhere that would be each machine's own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="fieldmark-")
        spark.sparkContext.setCheckpointDir(_OWN_DIRS[app])
    return _OWN_DIRS[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, so a lost
    executor costs at most the tasks that follow. The caller's job clears the folder when it ends."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, tag: str, key: str) -> DataFrame:
    """``stage`` with files dealt by ``key``, so that groupings by it do not move these rows. The table's
    name is given back at once; its files stay."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", new_path(spark, tag)).saveAsTable(name)
    out = spark.table(name)
    out.schema  # found before the name goes
    spark.sql(f"DROP TABLE {name}")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of few splits (a small file is one split) to all cores; a table of as many splits as
    cores is left as it is. Results do not depend on it. At most the first splits are looked at."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    split = F.spark_partition_id()
    wide = cores <= 1 or df.select(split.alias("split")).where(F.col("split") >= cores - 1).take(1)
    return df if wide else df.repartition(cores)


def ids_as_text(df: DataFrame, *names: str) -> DataFrame:
    """Ids as decimal text: a nullable long would reach pandas as a double and lose its low bits."""
    return df.withColumns({c: F.col(c).cast("string") for c in names})


def ids_as_long(df: DataFrame, *names: str) -> DataFrame:
    """Back from ``ids_as_text``."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in names})


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` (a lambda over a Column)."""
    return F.transform(F.array(value), body)[0]


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``: the contract's folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast if a count shows at most ``max_rows`` rows; else leave the join
    strategy (shuffle, with adaptive skew handling) to Spark."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
