"""Nearest neighbours by metric blocks against scoring all pairs."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import nearest as N
from fieldmark.operators import vectors


def answer(df):
    return sorted((r["q"], r["rank"], r["cell"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((30, 16))
    rows = [(i % 700, (centre[i % 30] + rng.standard_normal(16) * 0.15).tolist()) for i in range(2000)]
    rows += [(800 + i, rows[3][1]) for i in range(60)]  # copies: ties by cell
    return rows + [(900, [0.0] * 16), (901, [0.0] * 16), (902, []), (903, [float("nan")] * 16), (904, [None] * 16), (905, rows[5][1][:8]), (906, [1e300] * 16)]


def test_cosine_blocks_equal_all_pairs_and_meet_few(spark, clustered, tmp_path):
    spark.createDataFrame(clustered, "cell long, key array<double>").repartition(3).write.parquet(str(tmp_path / "v"))
    rows = spark.read.parquet(str(tmp_path / "v"))
    queries = rows.where("cell % 7 = 0 or cell >= 900").dropDuplicates(["cell"]).select(F.col("cell").alias("q"), "key")
    want = answer(N.ranked(N.nearest(queries, rows, 5, N.COSINE), 5))
    found, met = N.in_blocks(queries, rows, 5, N.COSINE, rows.count(), pivots=30)
    assert answer(N.ranked(found, 5)) == want
    blocks = met.select("block").distinct().count()
    share = met.where("q < 900").count() / (queries.where("q < 900").count() * blocks)
    assert blocks >= 20 and share < 0.4


def test_hamming_blocks_equal_all_pairs_and_meet_few(spark, tmp_path):
    rng = np.random.default_rng(9)
    base = rng.integers(-(2**63), 2**63 - 1, (12, 2))
    rows = []
    for i in range(1500):
        word = base[i % 12].copy()
        for b in rng.integers(0, 128, 5):
            word[b // 64] ^= np.int64(1) << np.int64(b % 64) if b % 64 < 63 else np.int64(-(2**63))
        rows.append((i, [128, *map(int, word)]))
    rows += [(2000, [64, 5]), (2001, [64, 7]), (2002, [0]), (2003, [128, 0, 0])] + [(2100 + k, rows[0][1]) for k in range(20)]
    spark.createDataFrame(rows, "cell long, key array<long>").repartition(3).write.parquet(str(tmp_path / "b"))
    known = spark.read.parquet(str(tmp_path / "b"))
    queries = known.where("cell % 25 = 0 or cell >= 2000").select(F.col("cell").alias("q"), "key")
    want = answer(N.ranked(N.nearest(queries, known, 6, N.HAMMING), 6))
    found, met = N.in_blocks(queries, known, 6, N.HAMMING, known.count(), pivots=12)
    assert answer(N.ranked(found, 6)) == want
    blocks = met.select("block").distinct().count()
    assert blocks >= 10 and met.where("q < 2000").count() / (queries.where("q < 2000").count() * blocks) < 0.35


def test_blocks_are_admitted_for_few_queries_at_a_time(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(600)], "cell long, key array<double>").coalesce(1)
    queries = rows.select(F.col("cell").alias("q"), "key")
    step = N.QUERY_STEP

    def bound(distance, radius, keys):
        assert len(keys) <= step
        return N.COSINE.bound(distance, radius, keys)

    found, _ = N.in_blocks(queries, rows, 3, dataclasses.replace(N.COSINE, bound=bound), 600, pivots=20)
    assert answer(N.ranked(found, 3)) == answer(N.ranked(N.nearest(queries, rows, 3, N.COSINE), 3))


def test_blocks_of_awkward_tables(spark):
    empty = spark.createDataFrame([], "cell long, key array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "cell long, key array<double>")
    bad = spark.createDataFrame([(1, [float("nan")]), (2, [float("inf")])], "cell long, key array<double>")
    for rows, queries in ((empty, one), (one, empty), (bad, one), (one, bad), (one, one)):
        found, _ = N.in_blocks(queries.withColumnRenamed("cell", "q"), rows, 3, N.COSINE, rows.count())
        assert found.count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_running_recall_equals_the_plain_loop(spark, n):
    rng = np.random.default_rng(n)
    x = [(int(q), float(v)) for q, v in zip(rng.permutation(n) * 3, rng.random(n), strict=True)] + [(5, None)]
    got = sorted((r["q"], r["ewma"], r["warm"]) for r in vectors.recall_ewma(spark.createDataFrame(x, "q long, recall double").repartition(5), warm=20).collect())
    want, mean = [], None
    for k, (q, v) in enumerate(sorted(p for p in x if p[1] is not None)):
        mean = v if mean is None else 0.95 * mean + 0.05 * v
        want.append((q, mean, k + 1 >= 20))
    assert [(q, w) for q, _, w in got] == [(q, w) for q, _, w in want]
    assert [e for _, e, _ in got] == pytest.approx([e for _, e, _ in want], rel=1e-12)
