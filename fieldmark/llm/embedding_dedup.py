"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact rerank.

The model (principal axes and rotations that balance the signs of the centred projections) is fitted
on at most ``SAMPLE`` vectors in the order of a hash of their ids; every vector is indexed. Codes are
signs of projections of the uncentred unit vectors, since links are on their angle: a pair at cosine
c differs in a share acos(c) / pi of its bits, also where all vectors share a direction.

A code is cut into substrings of about log2 n bits, so that a place holds few unrelated vectors at any
size of the table; there are as many substrings, each with a table of its own, as it takes for a pair
at the threshold to agree in one with probability 1 - ``MISS``, closer pairs with more. Pairs that
meet and whose first 128 bits differ in at most ``radius`` bits are candidates; the more direction
the vectors share, the more pairs are.

Equal vectors are one class with a weight. Candidates are not written as pairs: each table reports
for which pairs of code blocks a class is wanted, every block pair is scored once as a matrix of
cosines in double precision, and gives link counts and a spanning forest of its links. Tables with
very full places and very full blocks are split, so that no task holds an unbounded group.

Defined cases: vectors that are null, zero, hold null or non-finite components, or differ in length
from most of the sample link with nothing; every row is a vector and vertex of its own, also with a
repeated id or none; a component is named by its smallest id, and has none if none of its rows has one;
a row without an id is kept only then; an empty table gives an empty result; extra columns are not
returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, small_side, stage
from .components import connected_components, forest

SAMPLE = 4096
#: Bits that candidates are compared in, and the widths of a substring.
BITS = 128
SUBS = (12, 32)
#: Probability that a pair at the threshold meets in no table.
MISS = 0.02
ITERATIONS = 30
#: Rows of one place in a table, and classes of one block, above which they are split.
FULL_PLACE = 1024
FULL_BLOCK = 1024
#: Vectors coded together.
CODED = 1024


@dataclass(frozen=True)
class Quantiser:
    axes: np.ndarray  # dimension x bits: principal axes times rotations
    sub: int  # bits of a substring
    tables: int
    radius: int


def table_plan(n: int, threshold: float) -> tuple[int, int, int]:
    """(bits of a substring, number of tables, radius among the first BITS bits) for n vectors."""
    differs = math.acos(min(max(threshold, -1.0), 1.0)) / math.pi
    sub = min(max(math.ceil(math.log2(max(n, 2))), SUBS[0]), SUBS[1])
    agrees = (1 - differs) ** sub
    tables = 1 if agrees >= 1 - MISS else math.ceil(math.log(MISS) / math.log1p(-agrees))
    radius = math.ceil(BITS * differs + 4 * math.sqrt(BITS * differs * (1 - differs)))
    return sub, tables, min(radius, BITS)


def fit_quantiser(x: np.ndarray, n: int, threshold: float, seed: int = 7) -> Quantiser:
    """Principal axes and, for each share of the bits, a rotation by iterative quantisation."""
    sub, tables, radius = table_plan(n, threshold)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(axis=0)
    k = min(x.shape[1], 64)
    _, vectors = np.linalg.eigh(x.T @ x if len(x) > 1 else np.eye(x.shape[1]))
    top = np.atleast_2d(vectors)[:, ::-1][:, :k]
    flat = (x - mean) @ top
    rng = np.random.default_rng(seed)
    bits = max(BITS, sub * tables)
    out: list[np.ndarray] = []
    while sum(a.shape[1] for a in out) < bits:
        rotation = np.linalg.qr(rng.standard_normal((k, k)))[0]
        for _ in range(ITERATIONS):
            signs = np.where(flat @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ flat)
            rotation = (left @ right).T
        out.append(top @ rotation)
    return Quantiser(np.concatenate(out, axis=1)[:, :bits], sub, tables, radius)


def codes(x: np.ndarray, q: Quantiser) -> tuple[np.ndarray, np.ndarray]:
    """(first BITS bits of each row's code as unsigned integers, its place in every table)."""
    words, places = [], []
    weights = np.int64(1) << np.arange(q.sub, dtype=np.int64)
    table = np.arange(q.tables, dtype=np.int64) << SUBS[1]
    for at in range(0, len(x), CODED):
        part = x[at : at + CODED]
        bits = (part / np.linalg.norm(part, axis=1, keepdims=True)) @ q.axes >= 0
        words.append(np.packbits(bits[:, :BITS], axis=1).view(">u8").astype(np.uint64))
        places.append(bits[:, : q.sub * q.tables].reshape(len(part), q.tables, q.sub) @ weights + table)
    return np.concatenate(words), np.concatenate(places)


def usable(vector: Column, dim: int | None = None) -> Column:
    """The vector as array<double> where it can link (and has ``dim`` components), else null. Vectors
    whose squares would leave the range of doubles are divided by their largest component."""
    x = vector.cast("array<double>")
    fits = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    if dim is not None:
        fits = fits & (F.size(x) == dim)
    largest = F.array_max(F.transform(x, F.abs))
    scaled = let(largest, lambda m: F.when((m > 1e100) | (m < 1e-100), F.transform(x, lambda v: v / m)).otherwise(x))
    return F.when(fits, scaled)


def vector_keys(x: Column) -> list[Column]:
    """128 bits of hash that stand for a vector; null for none."""
    return [F.when(x.isNotNull(), F.xxhash64(x)).alias("k1"), F.when(x.isNotNull(), F.xxhash64(F.lit("second"), x)).alias("k2")]


def _pairs_in_runs(keys: np.ndarray, side: np.ndarray, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of near pairs among rows of equal, sorted keys; rows that carry a side (0 or 1, else
    -1) pair only with the other side."""
    i = np.arange(len(keys) - 1)
    a_out, b_out = [], []
    shift = 1
    while len(i):
        i = i[i + shift < len(keys)]
        i = i[keys[i] == keys[i + shift]]
        if not len(i):
            break
        j = i + shift
        near = np.bitwise_count(code[i] ^ code[j]).sum(axis=1) <= radius
        near &= (side[i] < 0) | (side[i] != side[j])
        a_out.append(i[near])
        b_out.append(j[near])
        shift += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(a_out), np.concatenate(b_out)) if a_out else (none, none)


def _wanted(radius: int):
    """From rows sorted by place: (bi, bj, id) of every class that block pair (bi <= bj) needs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            code = np.stack([rows["c0"].to_numpy(), rows["c1"].to_numpy()], axis=1).view(np.uint64)
            a, b = _pairs_in_runs(rows["place"].to_numpy(), rows["side"].to_numpy(), code, radius)
            ids, blocks = rows["id"].to_numpy(), rows["block"].to_numpy()
            lo, hi = np.minimum(blocks[a], blocks[b]), np.maximum(blocks[a], blocks[b])
            both = np.concatenate([np.stack([lo, hi, ids[a]], 1), np.stack([lo, hi, ids[b]], 1)])
            return pd.DataFrame(np.unique(both, axis=0) if len(both) else both, columns=["bi", "bj", "id"])

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            tail = rows["place"].to_numpy() == rows["place"].iloc[-1]
            held = rows[tail].reset_index(drop=True)
            done = rows[~tail].reset_index(drop=True)
            if len(done):
                yield found(done)
        if held is not None:
            yield found(held)

    return run


def _scored(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def found(rows: pd.DataFrame) -> list[tuple[int, int, int]]:
            x = np.stack(rows["x"].to_numpy())
            norm = np.sqrt((x * x).sum(axis=1))
            linked = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
            np.fill_diagonal(linked, False)
            if rows["bi"].iloc[0] != rows["bj"].iloc[0]:
                own = rows["block"].to_numpy()
                linked &= own[:, None] != own[None, :]
            ids, weight = rows["id"].to_numpy(), rows["weight"].to_numpy()
            root = forest(linked)
            return [(i, i, n) for i, n in zip(ids, linked @ weight, strict=True) if n] + [
                (ids[r], ids[k], 0) for k, r in enumerate(root) if k != r
            ]

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (rows["bi"] == rows["bi"].iloc[-1]) & (rows["bj"] == rows["bj"].iloc[-1])
            held = rows[last]
            out: list[tuple[int, int, int]] = []
            for _, own in rows[~last].groupby(["bi", "bj"], sort=False):
                out += found(own)
            yield pd.DataFrame(out, columns=["a", "b", "n"])
        if held is not None:
            yield pd.DataFrame(found(held), columns=["a", "b", "n"])

    return run


def similar_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    every = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    some = every.select("id", usable(F.col("v")).alias("x")).where("x is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = [np.array(r["x"]) for r in some.select("x").collect()]
    if not sample:
        alone = {"n_links": F.lit(0).cast("bigint"), "component_id": F.col("id"), "kept": F.lit(True)}
        return every.select(F.col("id").alias(id_col), *[c.alias(k) for k, c in alone.items()])
    lengths, times = np.unique([len(x) for x in sample], return_counts=True)
    dim = int(lengths[times.argmax()])
    keyed = every.select("id", usable(F.col("v"), dim).alias("x")).select("id", "x", *vector_keys(F.col("x")))
    grouped = keyed.where("x is not null").groupBy("k1", "k2")
    found = grouped.agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("x").alias("x"))
    classes = stage(found.withColumn("id", F.monotonically_increasing_id()), "vectors")  # from here on the class's own number
    n = classes.count()
    model = fit_quantiser(np.stack([x for x in sample if len(x) == dim]), n, threshold)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                c, places = codes(np.stack(batch["x"].to_numpy()), model)
                c = c.view(np.int64)
                yield batch.assign(c0=c[:, 0], c1=c[:, 1], places=list(places))

    indexed = classes.select("id", "weight", "x").mapInPandas(coded, "id long, weight long, x array<double>, c0 long, c1 long, places array<long>")
    indexed = stage(indexed, "codes")
    prefix = F.shiftrightunsigned("c0", 64 - max(1, min(20, int(np.log2(max(n / 256, 2))))))
    crowd = indexed.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("size"))
    # blocks: at most 2 ** 20 prefixes, each split by id where it is full
    blocks = indexed.withColumn("prefix", prefix).join(small_side(crowd, 1 << 20), "prefix")
    parts = F.ceil(F.col("size") / FULL_BLOCK)
    blocks = stage(
        blocks.withColumn("block", F.col("prefix") * (1 << 32) + F.pmod(F.xxhash64("id"), parts)).select("id", "x", "weight", "c0", "c1", "places", "block"),
        "blocks",
    )
    places = blocks.select("id", "block", "c0", "c1", F.explode("places").alias("place"))
    full = places.groupBy("place").agg(F.count("*").alias("size")).where(F.col("size") > FULL_PLACE)
    split = places.join(small_side(stage(full, "full"), 1 << 16), "place", "left")
    parts = F.ceil(F.coalesce("size", F.lit(1)) / FULL_PLACE).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    spread = split.select("id", "block", "c0", "c1", "place", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    rows = spread.select(
        "id",
        "block",
        "c0",
        "c1",
        F.xxhash64("place", F.least("own", "other"), F.greatest("own", "other")).alias("place"),
        F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"),
    )
    wanted = rows.repartition("place").sortWithinPartitions("place").mapInPandas(_wanted(model.radius), "bi long, bj long, id long").distinct()
    needed = wanted.join(blocks.select("id", "x", "weight", "block"), "id")
    scored = stage(
        needed.select("bi", "bj", "id", "block", "weight", "x")
        .repartition("bi", "bj")
        .sortWithinPartitions("bi", "bj", "id")
        .mapInPandas(_scored(threshold), "a long, b long, n long"),
        "scored",
    )
    links = scored.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    components = stage(connected_components(scored.where("a <> b").select("a", "b")), "components")
    least = components.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("lowest"))
    named = (
        classes.select("id", "weight", "k1", "k2", "least")
        .join(links, "id", "left")
        .join(components.join(least, "component").select("id", "lowest"), "id", "left")
        .select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("lowest", "least").alias("lowest"), F.lit(True).alias("linked"))
    )
    result = keyed.select("id", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("linked"), F.col("lowest")).otherwise(F.col("id"))
    return result.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )
