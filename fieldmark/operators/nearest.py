"""Exact k nearest neighbours of many queries by metric blocks.

Rows are dealt to blocks around pivots; a block knows its radius, the largest distance of its rows to
the pivot. Every query first meets the block of its own pivot. What it finds there bounds what it still
wants, and by the triangle inequality a block whose pivot lies farther from the query than the radius and
that bound allow holds nothing better, so only the other blocks meet it. Results equal scoring all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.ship import ship

from .tables import top_k, written

#: Queries and rows of one task, and queries scored together.
BLOCK_QUERIES, BLOCK_ROWS, QUERY_STEP = 1024, 16_384, 128
#: Pairs up to which the queries go to every task and all pairs are scored.
FEW_PAIRS = 4_000_000
#: Rows that the pivots are drawn from, rows of a block aimed at, and most pivots.
SAMPLE, ROWS_OF_PIVOT, PIVOTS = 2048, 256, 256
#: The block of rows that have no place among the pivots.
APART = -1
#: Scores are compared after rounding to nine places.
SLACK = 2e-9


@dataclass(frozen=True)
class Metric:
    """score(x keys, y keys): matrix of scores, larger is nearer, NaN for none. place(keys, pivots): matrix
    of distances to the pivots, a row of NaN for keys that have no place among them. usable(keys): rows
    that can score at all. bound(distance, radius, keys): largest score of a query with any row of a block.
    apart(keys): largest score with rows that have no place, per query. kind(keys): a number each; pivots
    are of the most frequent kind."""

    score: Callable
    place: Callable
    usable: Callable
    bound: Callable
    apart: Callable
    kind: Callable


def best_cells(asked: pd.DataFrame, known: pd.DataFrame, k: int, score) -> pd.DataFrame:
    """(q, cell, score) of the k best cells of every query among ``known``: best row per cell, the query
    itself left out, ties by cell; scores that are not a number are dropped."""
    cell, at = np.unique(known["cell"].to_numpy(), return_inverse=True)
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(len(cell)))
    ids, rows, out = asked["q"].to_numpy(), known["key"].to_numpy()[order], []
    for lo in range(0, len(ids), QUERY_STEP):
        s = score(asked["key"].to_numpy()[lo : lo + QUERY_STEP], rows)
        best = np.maximum.reduceat(np.where(np.isnan(s), -np.inf, s), first, axis=1)
        own = ids[lo : lo + QUERY_STEP]
        best[own[:, None] == cell[None, :]] = -np.inf
        # a cell of the overall top k is among the k best of the rows that hold its best one
        top = np.argsort(-np.round(best, 9), axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(best, top, axis=1).ravel()
        found = pd.DataFrame({"q": np.repeat(own, top.shape[1]), "cell": cell[top.ravel()], "score": value})
        out.append(found[np.isfinite(value)])
    return pd.concat(out, ignore_index=True)


FOUND = "q long, cell long, score double"


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best of every query with their rank: rounded scores, then smaller cells."""
    return top_k(scored, ["q"], [F.desc(F.round("score", 9)), F.col("cell")], k)


def _per_cell(found: DataFrame) -> DataFrame:
    return found.groupBy("q", "cell").agg(F.max("score").alias("score"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, metric: Metric, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """(q, cell, score) that holds the k best cells of every query. ``queries``: (q, key), ``rows``: (cell,
    key), keys not null."""
    ship(rows.sparkSession)
    n, m = queries.count(), rows.count()
    if n <= BLOCK_QUERIES and n * m <= few_pairs:
        asked = queries.toPandas()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and len(asked):
                    yield best_cells(asked, batch, k, metric.score)

        return _per_cell(rows.mapInPandas(run, FOUND))
    return in_blocks(queries, rows, k, metric, m)[0]


def spread_pivots(keys: list, metric: Metric, most: int) -> list:
    """Keys far from one another: each is the farthest from those before it."""
    if not keys:
        return []
    away = metric.place(keys, keys)
    placed = np.flatnonzero(~np.isnan(away).any(axis=1))
    if not len(placed):
        return keys[:1]
    away = away[np.ix_(placed, placed)]
    np.fill_diagonal(away, 0)
    chosen = [0]
    near = away[:, 0].copy()
    while len(chosen) < min(most, len(placed)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, away[:, chosen[-1]])
    return [keys[placed[i]] for i in chosen]


def in_blocks(queries: DataFrame, rows: DataFrame, k: int, metric: Metric, m: int, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(best cells of every query in the blocks that it meets, the (q, block) pairs met): the same k best
    as among all rows."""
    some = [r["key"] for r in rows.orderBy(F.xxhash64("key"), F.xxhash64("cell")).limit(SAMPLE).select("key").collect()]
    some = [v for v, ok in zip(some, metric.usable(some), strict=True) if ok]
    _, at, times = np.unique(metric.kind(some), return_inverse=True, return_counts=True)
    some = [v for v, j in zip(some, at, strict=True) if j == times.argmax()]
    centres = spread_pivots(some, metric, pivots or min(max(m // ROWS_OF_PIVOT, 1), PIVOTS))

    def located(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch[metric.usable(batch["key"].to_numpy())]
        if not len(batch) or not centres:
            return batch.assign(block=APART, away=0.0)
        away = metric.place(batch["key"].to_numpy(), centres)
        apart = np.isnan(away).any(axis=1)
        away = np.where(apart[:, None], 0, away)
        return batch.assign(block=np.where(apart, APART, away.argmin(axis=1)), away=away.min(axis=1))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(located, batches)

    kind = dict(rows.dtypes)["key"]
    known = written(rows.mapInPandas(locate, f"cell long, key {kind}, block long, away double"))
    asked = written(queries.mapInPandas(locate, f"q long, key {kind}, block long, away double").drop("away"))
    blocks = {r["block"]: r for r in known.groupBy("block").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()}
    parts = {b: -(-r["n"] // BLOCK_ROWS) for b, r in blocks.items()}
    if not blocks:
        return known.select(F.col("cell").alias("q"), "cell", "away").toDF("q", "cell", "score"), asked.select("q", "block").limit(0)
    cuts = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])

    def meet(asking: DataFrame) -> DataFrame:
        """Best cells of (q, key, block) in their blocks, both sides cut to bounded parts."""
        sizes = {r["block"]: -(-r["n"] // BLOCK_QUERIES) for r in asking.groupBy("block").agg(F.count("*").alias("n")).collect()}
        if not sizes:
            return asking.sparkSession.createDataFrame([], FOUND)
        of = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
        left = asking.withColumns({"qb": F.pmod(F.xxhash64("q"), of[F.col("block")]), "rb": F.explode(F.sequence(F.lit(0), cuts[F.col("block")] - 1))})
        right = known.where(F.col("block").isin(*sizes)).drop("away")
        right = right.withColumns({"rb": F.pmod(F.xxhash64("cell", F.monotonically_increasing_id()), cuts[F.col("block")]).cast("int"), "qb": F.explode(F.sequence(F.lit(0).cast("bigint"), (of[F.col("block")] - 1).cast("bigint")))})

        def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"q": [], "cell": [], "score": []})
            return best_cells(a, b, k, metric.score)

        keys = ["block", "qb", "rb"]
        left, right = left.select("q", "key", *keys), right.select("cell", "key", *keys)
        return left.groupBy(*keys).cogroup(right.toDF(*right.columns).groupBy(*keys)).applyInPandas(pair, FOUND)

    home = written(_per_cell(meet(asked.where(F.col("block").isin(*blocks)))))
    worst = ranked(home, k).where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    numbers = np.array(sorted(b for b in blocks if b != APART), dtype=np.int64)
    radius = np.array([blocks[b]["radius"] for b in numbers])

    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            for lo in range(0, len(batch), QUERY_STEP):
                part = batch.iloc[lo : lo + QUERY_STEP]
                keys = part["key"].to_numpy()
                least = part["least"].fillna(-np.inf).to_numpy()
                most = metric.bound(metric.place(keys, [centres[b] for b in numbers]), radius, keys) if len(numbers) else np.zeros((len(part), 0))
                most, names = np.column_stack([most, metric.apart(keys)]), np.append(numbers, APART)
                want = (most + SLACK >= least[:, None]) & (names[None, :] != part["block"].to_numpy()[:, None]) & np.isin(names, list(blocks))[None, :]
                i, j = np.nonzero(want)
                # numbers only: a query's key is joined to its blocks again outside Python
                yield pd.DataFrame({"q": part["q"].to_numpy()[i], "block": names[j]})

    others = written(asked.join(worst, "q", "left").mapInPandas(admit, "q long, block long"))
    met = asked.select("q", "block").union(others)
    again = others.join(asked.select("q", "key"), "q")
    return _per_cell(home.union(meet(again))), met


def unit_rows(vectors, dim: int) -> np.ndarray:
    """Vectors of any lengths as unit rows, padded with zeros; zero stays zero, null and NaN components
    become NaN."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.asarray(v, dtype=float)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _longest(*sides) -> int:
    return max(1, *(len(v) for side in sides for v in side))


def _cosines(x, y) -> np.ndarray:
    dim = _longest(x, y)
    return unit_rows(x, dim) @ unit_rows(y, dim).T


def _angles(x, pivots) -> np.ndarray:
    """Angles in radians; a zero vector has no direction."""
    out = np.arccos(np.clip(_cosines(x, pivots), -1, 1))
    zero = np.array([not np.any(np.asarray(v, dtype=float)) for v in x])
    out[zero] = np.nan
    return out


def _angle_bound(distance: np.ndarray, radius: np.ndarray, keys) -> np.ndarray:
    # a zero query scores 0 with every row
    return np.where(np.isnan(distance), 0.0, np.cos(np.maximum(0, distance - radius[None, :] - 1e-7)))


#: Cosine of vectors; of unequal lengths the longer one's rest counts in its norm only.
COSINE = Metric(
    score=_cosines,
    place=_angles,
    usable=lambda x: np.array([bool(np.isfinite(np.asarray(v, dtype=float)).all()) for v in x], dtype=bool),
    bound=_angle_bound,
    apart=lambda keys: np.zeros(len(keys)),
    kind=lambda x: np.array([bool(np.any(np.asarray(v, dtype=float))) for v in x], dtype=int),
)


def _words(x, wide: int) -> np.ndarray:
    out = np.zeros((len(x), wide), np.int64)
    for i, v in enumerate(x):
        out[i, : len(v) - 1] = v[1:]
    return out


def _bits(x, y) -> np.ndarray:
    """Differing bits of sketches whose first element is the number of dimensions; NaN across numbers."""
    wide = max(_longest(x, y) - 1, 1)
    dims_x, dims_y = (np.array([v[0] if len(v) else 0 for v in s]) for s in (x, y))
    a, b = _words(x, wide), _words(y, wide)
    out = np.zeros((len(x), len(y)))
    for w in range(wide):
        out += np.bitwise_count((a[:, w, None] ^ b[None, :, w]).view(np.uint64))
    return np.where((dims_x[:, None] == dims_y[None, :]) & (dims_x[:, None] > 0), out, np.nan)


def _likeness(x, y) -> np.ndarray:
    """1 - 2 d / dims for Hamming distance d."""
    dims = np.array([max(v[0], 1) if len(v) else 1 for v in x])
    return 1 - 2 * _bits(x, y) / dims[:, None]


def _bits_bound(distance: np.ndarray, radius: np.ndarray, keys) -> np.ndarray:
    dims = np.array([max(v[0], 1) for v in keys])
    return np.where(np.isnan(distance), -np.inf, 1 - 2 * np.maximum(0, distance - radius[None, :]) / dims[:, None])


#: Likeness of sign sketches (dimensions, then words of 64 bits) of the same number of dimensions.
HAMMING = Metric(
    score=_likeness,
    place=_bits,
    usable=lambda x: np.array([len(v) > 0 and v[0] > 0 for v in x], dtype=bool),
    bound=_bits_bound,
    apart=lambda keys: np.full(len(keys), -np.inf),  # rows apart have other dimensions
    kind=lambda x: np.array([v[0] for v in x], dtype=int),
)
