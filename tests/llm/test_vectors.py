"""Vector codes and hard negatives against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int, row long, x string, own int"


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    centre = rng.standard_normal((6, 8))
    out = []
    for i in range(420):
        v = (centre[i % 6] + rng.standard_normal(8) * rng.choice([0.1, 0.6])) * rng.choice([0.5, 1, 2])
        out.append((i * 5, [float(c) for c in v.astype(np.float32)], i % 4))
    out += [(50, out[0][1], 1), (50, out[3][1], 1), (50, out[3][1], 1)]  # repeated ids and rows
    out += [(2**60 + k, out[k][1], 2) for k in (1, 3)] + [(None, out[7][1], 3), (None, out[8][1], 0)]
    out += [(3000 + k, out[1][1], 1) for k in range(140)]  # a third of all rows are copies
    out += [(700, None, 1), (701, [1.0] * 7 + [None], 1), (702, [float("nan")] * 8, 2), (703, [1.0] * 7 + [float("inf")], 2)]
    out += [(710, [0.0] * 8, 2), (750, [0.0] * 8, 3), (800, [], 1), (801, [1.0] * 12, 1), (802, [1.0, 2.0, 3.0], 1), (900, out[5][1], None), (901, out[6][1], None)]
    return out


@pytest.fixture(scope="module")
def vectors(spark, rows, tmp_path_factory):
    from fieldmark.functions.ship import ship

    ship(spark)
    path = str(tmp_path_factory.mktemp("v") / "embeddings.parquet")
    spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def plain_codes(rows, parts, entries, rounds, scale):
    kept = [(i, label, np.array([math.floor(scale * float(np.float32(c))) for c in v])) for i, v, label in rows if usable(v) and len(v) == 8]
    x = np.stack([k[2] for k in kept]).reshape(len(kept), parts, -1)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2].tolist()))[:entries]
    books = x[first].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        own = d.argmin(axis=2)
        if r < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    mine = x[own[:, p] == e, p]
                    if len(mine):
                        books[p, e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    error = d.min(axis=2).sum(axis=1)
    total = {}
    for (_, label, _), e in zip(kept, error, strict=True):
        total[label] = total.get(label, 0) + int(e)
    sha = hashlib.sha256(",".join(str(c) for c in books.ravel()).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for e in own[k]), int(error[k]), total[label], sha) for k, (i, label, _) in enumerate(kept)]


@pytest.mark.parametrize("parts,entries,rounds", [(4, 256, 4), (2, 37, 6), (4, 5, 3), (1, 1, 2)])
def test_codes_against_plain_rounds(vectors, rows, parts, entries, rounds):
    from fieldmark.llm.vector_codes import code_digest, compress, decode

    out = compress(vectors, parts, entries, rounds)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted((tuple(r) for r in code_digest(out).collect()), key=key)
    assert got == sorted(plain_codes(rows, parts, entries, rounds, 1024), key=key)
    every = len(got) * parts * min(entries, len(got))
    assert out.compared[0] == every and all(n <= every for n in out.compared)
    if entries == 37:
        assert out.compared[-1] < 0.7 * every  # bounds pass groups over
        decoded = decode(out.codes, out.codebooks).first()
        assert len(decoded["decoded"]) == 8


def test_bounds_are_never_above_the_distance():
    from fieldmark.llm.vector_codes import GROUPS, Codebooks, assign, grouped

    rng = np.random.default_rng(5)
    x = rng.integers(-900, 900, (300, 6))
    start = x[:40].reshape(40, 2, 3).transpose(1, 0, 2)
    books, bounds, skipped = Codebooks(start[None], [grouped(e, GROUPS) for e in start]), None, 0
    for _ in range(12):
        bounds, error, compared = assign(x, books, bounds)
        d = ((x.reshape(300, 2, 1, 3) - books.now()[None]) ** 2).sum(axis=3)
        assert (bounds.own == d.argmin(axis=2)).all() and (error == d.min(axis=2)).all()
        skipped += int((compared < 80).sum())
        for p in range(2):
            moved = books.moved(p)
            for k, g in enumerate(books.groups[p]):
                others = np.where(g[None, :] == bounds.own[:, p][:, None], np.inf, np.sqrt(d[:, p, g])).min(axis=1)
                assert (bounds.low[:, p, k] - moved[bounds.stamp[:, p, k], k] <= others + 1e-6).all()
        step = rng.integers(-25, 26, books.now().shape)  # there and back: net moves stay small
        books = Codebooks(np.concatenate([books.history, (books.now() + step)[None]]), books.groups)
    assert skipped > 300


def test_codes_without_rows_and_beyond_long(spark, vectors):
    from fieldmark.llm.vector_codes import code_digest, compress

    assert code_digest(compress(vectors.limit(0))).count() == 0
    assert code_digest(compress(vectors.where("embedding is null"))).count() == 0
    wide = spark.createDataFrame([(1, [1e30, 0.0, 0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large|OVERFLOW"):
        compress(wide).codes.count()


def plain_negatives(rows, every=50):
    kept = []
    for n, (i, v, label) in enumerate(rows):
        if usable(v) and label is not None:
            kept.append((n, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in v]))
    out = []
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for n, i, label, x in kept:
        if i is None or i % every:
            continue
        near, far = [], []
        for m, j, other, y in kept:
            if m != n and len(y) == len(x):
                (near if other == label else far).append((sum(a * b for a, b in zip(x, y, strict=True)), j))
        far.sort(key=order)
        for ps, p in sorted(near, key=order)[:5]:
            hits = [(s, j) for s, j in far if 50 * ps <= 100 * s <= 95 * ps][:3]
            out += [(i, p, r + 1, j, ps, s) for r, (s, j) in enumerate(hits)]
    return out


def key(r):
    return tuple((v is None, v or 0) for v in r)


@pytest.mark.parametrize("block_anchors,block_rows", [(2048, 4096), (9, 40), (3, 1000)])
def test_negatives_against_all_pairs(vectors, rows, block_anchors, block_rows):
    from fieldmark.llm.hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0, block_anchors=block_anchors, block_rows=block_rows)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain_negatives(rows), key=key)


def test_negatives_of_awkward_tables(spark, vectors):
    from fieldmark.llm.hard_negatives import hard_negatives

    assert hard_negatives(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives(vectors, F.lit(None).cast("boolean")).count() == 0
    assert hard_negatives(vectors.where("label = 1"), F.col("vec_id") % 50 == 0).count() == 0


def test_walk_stops_early_and_is_exact():
    from fieldmark.llm.hard_negatives import LONG, NONE, walk

    rng = random.Random(4)
    np_rng = np.random.default_rng(4)
    centre = np_rng.standard_normal((20, 16)) * 400
    x = np.round(centre[np.arange(6000) % 20] + np_rng.standard_normal((6000, 16)) * 60).astype(np.int64)
    a = x[rng.sample(range(6000), 50)]
    low, high = np.full((50, 2), NONE + 1), np.full((50, 2), LONG - 1)
    high[:, 1] = 2_000_000
    best, scored = walk(a, low, high, x, lambda i, k: np.ones((len(i), len(k)), bool), 4)
    keys = (a @ x.T) * 6000 + (5999 - np.arange(6000))[None, :]
    for j in range(2):
        ok = np.where((a @ x.T) <= high[0, j], keys, NONE)
        assert (np.sort(best[:, j], axis=1) == np.sort(ok, axis=1)[:, -4:]).all()
    high[:, 1] = NONE
    low[:, 1] = LONG  # asks for nothing
    _, scored = walk(a, low, high, x, lambda i, k: np.ones((len(i), len(k)), bool), 4)
    assert scored < 0.4 * 50 * 6000
