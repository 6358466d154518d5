"""Hard negatives: exact top inner products by lists that clusters of anchors share.

Anchors are clustered. For a cluster with centre u and widest angle t, no member a can score more than
|a| |x| cos(max(0, angle(u, x) - t)) with a candidate x, so the candidates sorted once by
|x| cos(max(0, angle(u, x) - t)) serve all members: each walks the list from the top, keeps its best, and
stops at the first place whose bound is below everything it still asks for. The stop certifies the result.

An anchor asks for the best so many candidates within a range of scores: its positives are the best of
its own label; for every positive it then asks for the best of other labels in a range below it.

At scale, rows are dealt to cells of similar direction. A task holds one block of anchors and one block of
candidates, of bounded sizes, clusters its anchors and walks its list. Blocks of equal cells meet first;
what an anchor then has bounds what it can still gain, and other pairs of blocks meet only where the
angle between their cells admits it. Tasks return at most what an anchor asks for, merged by rank.

Defined cases: rows with a null label, a null vector or null or non-finite components take no part; every
row is an anchor or candidate of its own, also with a repeated id; equal scores rank by id, null ids last;
vectors of different lengths have no score; an anchor without positives, or without negatives in range,
gives no row; zero vectors score 0; an empty table gives an empty result; components beyond exact 64-bit
products raise an error; extra columns are not returned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_as_long, ids_as_text, small_side, spread, stage
from .whole_vectors import LONG, exact, largest, matrix, whole

#: Anchors and candidates of one task, and places of a list looked at together.
BLOCK_ANCHORS, BLOCK_ROWS, STEP = 2048, 4096, 512
#: Most cells of directions, and vectors that they are fitted on.
CELLS, SAMPLE = 256, 4096
#: Pairs of blocks, and sizes of cells, that are broadcast; more are joined by shuffle.
BROADCAST = 1_000_000
#: No score.
NONE = -LONG


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, norms); a zero vector stays."""
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def centres(unit: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k directions by spherical means, from evenly spaced starts."""
    out = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (unit @ out.T).argmax(axis=1)
        mean = np.zeros_like(out)
        np.add.at(mean, own, unit)
        mean, norm = units(mean)
        out = np.where((norm > 0)[:, None], mean, out)
    return out


def angles(unit: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centre, -1, 1))


def walk(a: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray, fits, want: int) -> tuple[np.ndarray, int]:
    """(keys of the best, scores computed). keys[i, j] holds the ``want`` best keys of anchor i within
    [low[i, j], high[i, j]], or NONE; a key is score * len(x) + (len(x) - 1 - place), so that of equal
    scores the earlier row of ``x`` is better. ``fits(i, k)`` is a mask of allowed pairs."""
    n = len(x)
    reach = a.shape[1] * max(1, largest(a)) * max(1, largest(x))
    if reach * n >= LONG:
        raise ValueError("components are too large for exact 64-bit products")
    (unit, norm), (unit_x, norm_x) = units(a), units(x)
    fa, fx = exact(reach, a, x)
    low, best = low.copy(), np.full((*low.shape, want), NONE, np.int64)
    own = (unit @ centres(unit, math.isqrt(len(a))).T).argmax(axis=1)
    scored = 0
    for c in np.unique(own):
        live = np.flatnonzero(own == c)
        centre = units(unit[live].mean(axis=0)[None])[0][0]
        wide = angles(unit[live], centre).max()
        bound = norm_x * np.cos(np.maximum(0, angles(unit_x, centre) - wide))
        order = np.argsort(-bound, kind="stable")
        slack = 1e-9 * norm_x.max(initial=0)
        for at in range(0, n, STEP):
            most = norm[live] * (bound[order[at]] + slack) + 1e-6
            live = live[most >= low[live].min(axis=1)]
            if not len(live):
                break
            k = order[at : at + STEP]
            score = (fa[live] @ fx[k].T).astype(np.int64)
            scored += score.size
            allowed = fits(live, k)
            key = score * n + (n - 1 - k)[None, :]
            for j in range(low.shape[1]):
                ok = allowed & (score >= low[live, j][:, None]) & (score <= high[live, j][:, None])
                hit = np.flatnonzero(ok.any(axis=1))
                if not len(hit):
                    continue
                rows = live[hit]
                both = np.concatenate([best[rows, j], np.where(ok[hit], key[hit], NONE)], axis=1)
                best[rows, j] = np.partition(both, both.shape[1] - want, axis=1)[:, -want:]
                least = best[rows, j].min(axis=1)
                low[rows, j] = np.where(least == NONE, low[rows, j], np.maximum(low[rows, j], least // n))
    return best, scored


HITS = "row long, ask int, score long, id long, no_id boolean"


def _met(pairs: DataFrame, anchors: DataFrame, candidates: DataFrame, same: bool, want: int) -> DataFrame:
    """Best of every anchor in every block of candidates that it meets: pairs (group, block)."""

    def run(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(c):
            return pd.DataFrame(columns=["row", "ask", "score", "id", "no_id"]).astype({"row": "int64", "ask": "int32", "score": "int64", "id": "int64", "no_id": "bool"})
        c = c.sort_values(["no_id", "id", "row"], ignore_index=True)
        label = np.unique(np.concatenate([a["label"].to_numpy(str), c["label"].to_numpy(str)]), return_inverse=True)[1]
        la, lc, ra, rc = label[: len(a)], label[len(a) :], a["row"].to_numpy(), c["row"].to_numpy()
        asks = max(len(x) for x in a["low"])
        low = np.stack([np.append(x, np.full(asks - len(x), LONG)) for x in a["low"]]).astype(np.int64)
        high = np.stack([np.append(x, np.full(asks - len(x), NONE)) for x in a["high"]]).astype(np.int64)

        def fits(i: np.ndarray, k: np.ndarray) -> np.ndarray:
            return ((la[i][:, None] == lc[k][None, :]) == same) & (ra[i][:, None] != rc[k][None, :])

        best, _ = walk(matrix(a["x"]), low, high, matrix(c["x"]), fits, want)
        i, j, _ = at = np.nonzero(best != NONE)
        key = best[at]
        place = len(c) - 1 - key % len(c)
        return pd.DataFrame({"row": ra[i], "ask": j.astype(np.int32), "score": key // len(c), "id": c["id"].to_numpy()[place], "no_id": c["no_id"].to_numpy()[place]})

    side = small_side(pairs, BROADCAST)
    left = anchors.select("group", "row", "label", "low", "high", "x").join(side, "group")
    right = candidates.select("block", "row", "label", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"), "x").join(side, "block")
    right = right.toDF(*right.columns)  # columns of its own: both sides may come from one table
    return left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInPandas(run, HITS)


def best(hits: DataFrame, want: int) -> DataFrame:
    """The first ``want`` hits of every ask with their rank: higher scores first, then smaller ids."""
    order = Window.partitionBy("row", "ask").orderBy(F.desc("score"), "no_id", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want)


def search(anchors: DataFrame, cells: DataFrame, turns: DataFrame | None, same: bool, want: int) -> DataFrame:
    """``best`` of the asks (low, high) of every anchor among all rows. Blocks of one cell meet first,
    then those whose cells (``turns``: angles between cells, none for one cell) admit a better score."""
    blocks = cells.groupBy("dim", "cell", "block").agg(F.max("angle").alias("wide_x"), F.max("norm").alias("norm_x"))
    groups = anchors.groupBy("dim", "cell", "group").agg(F.max("angle").alias("wide"), F.max("norm").alias("norm"))
    home = stage(groups.join(blocks, ["dim", "cell"]).select("group", "block"), "home")
    hits = stage(_met(home, anchors, cells, same, want), "hits")
    if turns is None:
        return best(hits, want)
    floors = best(hits, want).where(F.col("rank") == want).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("ask", "score"))).alias("floor"))
    raised = F.transform("low", lambda v, k: F.greatest(v, F.coalesce(F.try_element_at("floor", k), v)))
    anchors = stage(anchors.join(floors, "row", "left").withColumn("low", raised).drop("floor"), "asks")
    groups = anchors.groupBy("dim", "cell", "group").agg(
        F.max("angle").alias("wide"), F.max("norm").alias("norm"), F.min(F.array_min("low")).alias("low")
    )
    gap = F.greatest(F.lit(0.0), F.col("turn") - F.col("wide") - F.col("wide_x") - 1e-6)
    most = F.col("norm") * F.col("norm_x") * F.greatest(F.lit(0.0), F.cos(F.least(gap, F.lit(3.2))))
    others = blocks.withColumnRenamed("cell", "other")
    away = groups.join(F.broadcast(turns), "cell").join(others, ["dim", "other"]).where(most * (1 + 1e-9) + 1e-3 >= F.col("low"))
    return best(hits.union(_met(stage(away.select("group", "block"), "away"), anchors, cells, same, want)), want)


def _cells(rows: DataFrame, n_anchors: int, block_anchors: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows with a cell of similar directions and the angle to its centre, angles between cells)."""
    k = min(-(-n_anchors // block_anchors), CELLS)
    some = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("x").collect() if k > 1 else []
    dims, times = np.unique([len(r["x"]) for r in some], return_counts=True)
    if k < 2 or not dims[times.argmax()]:
        return rows.withColumns({"cell": F.lit(0), "angle": F.lit(np.pi)}), None
    dim = int(dims[times.argmax()])
    centre = centres(units(np.array([r["x"] for r in some if len(r["x"]) == dim]))[0], k)

    def run(batches):
        for batch in batches:
            cell, angle = np.zeros(len(batch), np.int32), np.full(len(batch), np.pi)
            own = np.flatnonzero(batch["x"].str.len() == dim)
            if len(own):
                unit, norm = units(matrix(batch["x"].iloc[own]))
                cosine = unit @ centre.T
                cell[own] = cosine.argmax(axis=1)
                angle[own] = np.where(norm > 0, np.arccos(np.clip(cosine.max(axis=1), -1, 1)), 0)
            yield batch.assign(cell=cell, angle=angle)

    schema = "id string, label string, anchor boolean, x array<long>, row long, norm double, dim int, cell int, angle double"
    placed = ids_as_long(ids_as_text(rows, "id").mapInPandas(run, schema), "id")
    turn = np.arccos(np.clip(centre @ centre.T, -1, 1))
    spark = rows.sparkSession
    turns = spark.createDataFrame([(i, j, float(turn[i, j])) for i in range(k) for j in range(k) if i != j], "cell int, other int, turn double")
    return placed, turns


def _percent(score: Column, share: int) -> Column:
    """floor(score * share / 100) in whole numbers."""
    x = score * F.lit(share).cast("bigint")
    left = F.pmod(x, F.lit(100).cast("bigint"))
    return F.call_function("div", x - left, F.lit(100).cast("bigint"))


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    block_anchors: int = BLOCK_ANCHORS,
    block_rows: int = BLOCK_ROWS,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """For every row with ``anchor`` and each of its best ``positives`` of the same label: the best
    ``negatives`` of other labels that score ``low`` to ``high`` per cent of the positive."""
    every = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole(F.col(vec_col), scale).alias("x")
    ).where("x is not null and label is not null")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    numbered = every.withColumns({"row": F.monotonically_increasing_id(), "norm": norm, "dim": F.size("x")})
    rows = stage(spread(numbered), "rows")
    cells, turns = _cells(rows, rows.where("anchor").count(), block_anchors)
    cells = stage(cells, "cells") if turns is not None else cells
    sizes = cells.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block_rows).alias("parts_x"), F.ceil(F.sum(F.col("anchor").cast("int")) / block_anchors).alias("parts"))

    def part(name: str, parts: str) -> Column:
        number = F.pmod(F.xxhash64("row"), F.greatest(F.col(parts), F.lit(1)))
        return F.concat_ws(":", "dim", "cell", number).alias(name)

    dealt = cells.join(small_side(stage(sizes, "sizes"), BROADCAST), ["dim", "cell"])
    cells = stage(dealt.select("row", "id", "label", "anchor", "x", "norm", "dim", "cell", "angle", part("group", "parts"), part("block", "parts_x")), "dealt")
    anchors = cells.where("anchor").drop("block", "anchor")
    wide = lambda v: F.array(F.lit(v).cast("bigint"))
    near = stage(search(anchors.withColumns({"low": wide(NONE + 1), "high": wide(LONG - 1)}), cells, turns, True, positives), "positives")
    scored = near.select("row", F.col("rank").alias("k"), F.when(~F.col("no_id"), F.col("id")).alias("positive_id"), F.col("score").alias("positive_score"))
    ranged = scored.withColumns({"lo": -_percent(-F.col("positive_score"), low), "hi": _percent(F.col("positive_score"), high)}).where("lo <= hi")
    asks = ranged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "lo", "hi"))).alias("asks"))  # at most ``positives`` each
    asking = anchors.join(asks, "row").withColumns({"low": F.col("asks.lo"), "high": F.col("asks.hi"), "k": F.col("asks.k")}).drop("asks")
    asking = stage(asking, "asking")
    hard = search(asking.drop("k"), cells, turns, False, negatives)
    named = asking.select("row", F.col("id").alias("anchor_id"), F.posexplode("k").alias("ask", "k"))
    return (
        hard.join(named, ["row", "ask"])
        .join(scored, ["row", "k"])
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("no_id"), F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
