"""Views over the supplied tables, one per input schema of the operators, and their SQL twins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark) -> str:
    """A new path in the folder that driver and executors share; a temporary one in a local session only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fieldmark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("cell"),
        F.col("event_type").alias("band"),
        F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("tslot"),
        F.col("value").alias("num"),
        F.when(F.col("event_type") == "error", "absence").otherwise("primary").alias("kind"),
        F.col("event_id").cast("string").alias("fact_cid"),
        F.col("ts").alias("signed_at"),
        (F.col("user_id") % 7).alias("signer"),
        F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string")).alias("fn_key"),
        F.col("event_id"),
    )


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.expr("vec_id div 5").alias("cell"),
        (F.lit(2017) + F.col("vec_id") % 5).alias("tslot"),
        F.lit("emb").alias("band"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label"),
        F.col("vec_id"),
    )


def with_point(df: DataFrame, key: str, dense: bool = False) -> DataFrame:
    """lat and lng of an integer key; ``dense`` shrinks the spread a thousandfold."""
    k = F.col(key)
    scale = 1000.0 if dense else 1.0
    return df.withColumns(
        {
            "lat": ((k * 7919) % 16000) / 100 / scale - 80 / scale,
            "lng": ((k * 104729) % 36000) / 100 / scale - 180 / scale,
        }
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.expr("o_orderkey div 100").alias("row"), (F.col("o_orderkey") % 100).alias("col"), (F.col("o_totalprice") / 1000).alias("value")
    )


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("key"), F.trunc("l_shipdate", "month").alias("month")).agg(F.sum("l_quantity").alias("num"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    c: dict[str, Column] = {
        "ndvi": F.col("l_discount") * 10 - 0.3,
        "swr": F.col("l_quantity") * 2,
        "cop": F.col("l_extendedprice") / 1000,
        "gmrt": F.col("l_extendedprice") / 1000 + F.col("l_tax") * 100 - 4,
        "s1": F.col("l_linenumber") - 20.0,
        "temp": F.col("l_quantity") - 10,
        "rh": F.col("l_tax") * 1000,
        "precip": F.col("l_linenumber") * F.col("l_quantity") / 5 - 1,
    }
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[v.alias(k) for k, v in c.items()])


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("domain"),
        F.col("value").alias("elapsed"),
        ((F.col("event_id") % 10) != 0).alias("pass"),
        F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "very_high"))), (F.col("user_id") % 4 + 1).cast("int")).alias("volume"),
        (F.lit(1) + F.col("event_id") % 5).alias("severity"),
        F.col("user_id"),
    )


#: The same views for the SQL twins.
SQL = {
    "facts": """facts AS (SELECT user_id AS cell, event_type AS band, CAST(floor(epoch(ts)/86400) AS BIGINT) AS tslot, value AS num,
      CASE WHEN event_type='error' THEN 'absence' ELSE 'primary' END AS kind, CAST(event_id AS VARCHAR) AS fact_cid, ts AS signed_at,
      user_id % 7 AS signer, 'f' || (event_id % 5) AS fn_key, event_id FROM events)""",
    "latest": """latest AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY cell, band, tslot ORDER BY signed_at DESC, event_id DESC)=1)""",
    "vecs": """vecs AS (SELECT vec_id // 5 AS cell, 2017 + vec_id % 5 AS tslot, 'emb' AS band, CAST(embedding AS DOUBLE[]) AS vec, label, vec_id FROM embeddings)""",
    "pixels": """pixels AS (SELECT o_orderkey // 100 AS "row", o_orderkey % 100 AS col, o_totalprice/1000 AS value FROM orders)""",
    "monthly": """monthly AS (SELECT l_suppkey AS key, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS num FROM lineitem GROUP BY ALL)""",
    "samples": """samples AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount*10-0.3 AS ndvi, l_quantity*2 AS swr, l_extendedprice/1000 AS cop,
      l_extendedprice/1000 + l_tax*100 - 4 AS gmrt, l_linenumber-20.0 AS s1, l_quantity-10 AS temp, l_tax*1000 AS rh, l_linenumber*l_quantity/5 - 1 AS precip FROM lineitem)""",
    "results": """results AS (SELECT event_type AS domain, value AS elapsed, event_id % 10 <> 0 AS pass,
      ['low','medium','high','very_high'][user_id % 4 + 1] AS volume, 1 + event_id % 5 AS severity, user_id FROM events)""",
}


def point_sql(key: str, dense: bool = False) -> str:
    s = 1000.0 if dense else 1.0
    return f"(({key}*7919)%16000)/100/{s}-80/{s} AS lat, (({key}*104729)%36000)/100/{s}-180/{s} AS lng"


def with_(*names: str, extra: str = "") -> str:
    """WITH clause of the named views."""
    return "WITH " + ", ".join([*(SQL[n] for n in names), *([extra] if extra else [])]) + " "
