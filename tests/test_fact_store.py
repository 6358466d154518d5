"""The bucketed store of facts: pruning, joins without moving facts, compaction, reopening."""

import re

import pytest
from pyspark.sql import functions as F

from fieldmark.operators.lookup import latest_facts
from fieldmark.sources import fact_store
from fieldmark.sources.fact_store import FactStore

SCHEMA = "cell bigint, band string, tslot bigint, num double, kind string, signed_at bigint, event_id bigint"


@pytest.fixture()
def facts(spark):
    k = F.col("id")
    return spark.range(3000).select(
        (k % 97).alias("cell"), F.concat(F.lit("b"), (k % 5).cast("string")).alias("band"), (k % 3).alias("tslot"), (k * 1.5).alias("num"),
        F.when(k % 50 == 0, "derivative").otherwise("primary").alias("kind"), (k % 700).alias("signed_at"), k.alias("event_id"),
    )


def rows(df):
    return sorted(tuple(r) for r in df.select("cell", "band", "tslot", "num", "kind", "signed_at", "event_id").collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def fact_side_exchanges(text):
    """Exchanges on the way from the scan of the store."""
    return [x for x in re.findall(r"Exchange hashpartitioning\([^)]*\)", text)]


def test_store_answers_as_plain_facts(spark, facts, tmp_path):
    s = FactStore.create(facts.where("event_id < 1500"), str(tmp_path / "s"), 8)
    s.append(facts.where("event_id >= 1500"))
    assert rows(s.bodies()) == rows(facts) and rows(s.latest()) == rows(latest_facts(facts))
    c = s.compacted()
    want = sorted(rows(latest_facts(facts)) + rows(facts.where("kind = 'derivative'")))
    assert rows(c.bodies()) == want and c.generation == 1
    cells = spark.createDataFrame([(3,), (11,), (3,), (None,), (500,)], "cell long")
    got = c.lookup(cells, ["b1", "b2"], (0, 1))
    assert rows(got) == [r for r in want if r[0] in (3, 11) and r[1] in ("b1", "b2") and r[2] <= 1]
    again = FactStore.open(spark, str(tmp_path / "s"), SCHEMA, 8)
    assert again.generation == 1 and rows(again.bodies()) == want


def test_lookups_prune_buckets_and_push_cells(spark, facts, tmp_path):
    s = FactStore.create(facts, str(tmp_path / "s"), 8)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not tell
    got = s.lookup(spark.createDataFrame([(3,)], "cell long"))
    text = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in text and re.search(r"PushedFilters: \[.*cell", text)


def test_joins_and_last_writes_move_no_facts(spark, facts, tmp_path, monkeypatch):
    monkeypatch.setattr(fact_store, "PUSHED_CELLS", 3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = FactStore.create(facts, str(tmp_path / "s"), 8)
        assert "Exchange hashpartitioning" not in plan(s.latest())
        asked = spark.range(60).select((F.col("id") % 40).alias("cell"), F.col("id").alias("req"))
        text = plan(s.latest().join(asked, "cell"))
        assert len(fact_side_exchanges(text)) == 1  # the requests alone
        named = asked.select("*", F.lit("b1").alias("band"))
        text = plan(s.latest().join(named, ["cell", "band"]))
        assert len(fact_side_exchanges(text)) == 1
        assert s.latest().join(named, ["cell", "band"]).count() == latest_facts(facts).join(named, ["cell", "band"]).count()
        many = s.lookup(asked)
        assert many.count() == facts.where("cell < 40").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
