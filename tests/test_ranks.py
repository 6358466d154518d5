"""Order statistics, best rows of groups, registration."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import ranks, tables


def plain(values, p, how):
    v = sorted(x for x in values if x is not None and not math.isnan(x))
    if not v:
        return None
    at = (len(v) - 1) * p
    return v[{"nearest": math.floor(at + 0.5), "low": math.floor(at), "high": math.ceil(at)}[how]]


STATS = {"m0": (0.5, "low"), "m1": (0.5, "high"), "p90": (0.9, "nearest"), "p95": (0.95, "nearest"), "least": (0.0, "low"), "most": (1.0, "high")}


@pytest.mark.parametrize("small", [50_000, 1])
def test_order_statistics_of_groups_of_all_sizes(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(ranks, "SMALL_GROUP", small)
    rng = random.Random(3)
    groups = {0: [rng.gauss(0, 9) for _ in range(20_000)], 1: [5.0] * 3000 + [6.0, -0.0, 0.0], 2: [1.5], 3: [2.0, 1.0], 4: [None, float("nan")], 5: [float(rng.randint(0, 3)) for _ in range(4001)], 6: [None, 3.0, float("nan"), 1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "g long, v double").repartition(4).write.parquet(str(tmp_path / "t"))
    got = ranks.order_statistics(spark.read.parquet(str(tmp_path / "t")), ["g"], "v", STATS, [F.count("*").alias("rows")])
    found = {r["g"]: r for r in got.collect()}
    assert set(found) == set(groups)
    for g, vs in groups.items():
        assert found[g]["rows"] == len(vs)
        for name, (p, how) in STATS.items():
            assert found[g][name] == plain(vs, p, how), (g, name)


def test_a_misleading_sketch_changes_nothing(spark, tmp_path, monkeypatch):
    """The range that holds a rank is found by counts: a sketch that proposes one place for every rank is
    as good as any."""
    monkeypatch.setattr(ranks, "SMALL_GROUP", 1)
    monkeypatch.setattr(ranks.F, "percentile_approx", lambda v, points, accuracy: F.array_repeat(F.min(v) + 1, len(points)))
    values = [float(k % 977) for k in range(5000)]
    spark.createDataFrame([(1, v) for v in values], "g long, v double").write.parquet(str(tmp_path / "t"))
    r = ranks.order_statistics(spark.read.parquet(str(tmp_path / "t")), ["g"], "v", STATS).first()
    assert {name: r[name] for name in STATS} == {name: plain(values, *s) for name, s in STATS.items()}


def test_a_hot_group_is_not_sorted_in_one_task(spark, tmp_path):
    """The only window runs over equal values of the picked range, a small share of a large group."""
    spark.range(400_000).select(F.lit(1).alias("g"), F.rand(5).alias("v")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = ranks.order_statistics(df, ["g"], "v", {"m": (0.5, "nearest"), "p95": (0.95, "nearest")})
    v = np.sort([r["v"] for r in df.select("v").collect()])
    r = got.first()
    assert (r["m"], r["p95"]) == (v[math.floor(399_999 * 0.5 + 0.5)], v[math.floor(399_999 * 0.95 + 0.5)])
    plan = got._jdf.queryExecution().executedPlan()
    seen = []

    def windows(node):
        if node.nodeName() == "Window":
            seen.append(node.child().metrics())
        for i in range(node.children().size()):
            windows(node.children().apply(i))
        if node.nodeName() == "AdaptiveSparkPlan":
            windows(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            windows(node.plan())

    got.collect()
    windows(plan)
    text = got._jdf.queryExecution().toString()
    assert text.count("Window [") >= 1 and "__c" in text.split("Window [")[1]


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("v"), "id")
    best = tables.top_k(df, ["g"], [F.desc("v"), F.col("id")], 4)
    plan = best._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    want = {g: sorted((-(i * 7919 % 1000), i) for i in range(5000) if i % 3 == g)[:4] for g in range(3)}
    got = {g: [(-r["v"], r["id"]) for r in best.where(F.col("g") == g).orderBy("rank").collect()] for g in range(3)}
    assert got == want
    many = tables.top_k(df, ["g"], [F.desc("v"), F.col("id")], 1200)
    assert many.count() == 3600 and many.agg(F.max("rank")).first()[0] == 1200
    assert many.where("rank <= 4").count() == 12 and {r["id"] for r in many.where("rank <= 4").collect()} == {i for w in want.values() for _, i in w}


def test_names_are_registered_once():
    from fieldmark.plans.base import catalog

    queries, twins, query = catalog()

    @query("select 1")
    def a(spark, d):
        return None

    assert list(queries) == ["a"] and twins == {"a": "select 1"}
    with pytest.raises(ValueError, match="twice"):

        @query(None)
        def a(spark, d):  # noqa: F811
            return None


def test_small_side_checks_the_size(spark):
    assert "ResolvedHint" in tables.small_side(spark.range(3), 3)._jdf.queryExecution().toString()
    assert "ResolvedHint" not in tables.small_side(spark.range(4), 3)._jdf.queryExecution().toString()
