"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds the distinct runs of ``shingle`` words. Its sketch has ``BANDS * ROWS``
coordinates: in round i every element is thrown into a bin (a random one in the first half of the
rounds, bin i - t in the second half, so that every coordinate fills) and a coordinate keeps the
smallest value of its first round with an element. Rounds end when all coordinates are filled.

Documents with equal sets are one class, named by a hash of the set and compared through the text of
its smallest id. Classes that share a band are candidates. In each bucket every class is first compared with one pivot, the member that shares
most with others; links are exact (whole sets). Buckets that then hold more than one component are
compared in blocks of classes inside tasks (``block_links``): no link across components is lost, and
the pairs of a large group are never written out.

Defined cases: a null or empty text, or one without words, has an empty set and stays alone; a text
of fewer words than a shingle is one run; repeated rows fall into one class; rows that share an id
but not the set are documents of their own, each in its text's group; a row without an id is grouped
with equal sets only, has the smallest id among them (else none) and is kept if there is none; an
empty table gives an empty result; extra columns, whatever their names, are not returned by
``near_duplicates`` and untouched by ``drop_near_duplicates``, which keeps one of repeated rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_as_long, ids_as_text, small_side, spread, stage
from .components import connected_components, forest
from .words import mix, shingle_set, word_hashes

#: A pair at similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 1 - 5e-8.
BANDS, ROWS = 32, 4
#: Ids of candidate documents that are broadcast to the text scan; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Classes and set elements of one block.
BLOCK_CLASSES, BLOCK_ELEMENTS = 1024, 300_000
#: Classes of one component that make it worth blocks of its own.
OWN_BLOCK = 64
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(elements: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes."""
    out = np.full(t, np.iinfo(np.uint64).max, dtype=np.uint64)
    n = len(elements)
    step = max(1, 512 // n)  # rounds at a time
    for first in range(0, 2 * t, step):
        rounds = np.arange(first, min(first + step, 2 * t))
        h = mix(elements[None, :] ^ _SEEDS[rounds][:, None])
        bins = np.where((rounds < t)[:, None], (h % np.uint64(t)).astype(np.int64), (rounds - t)[:, None])
        value = (rounds.astype(np.uint64) << np.uint64(54))[:, None] | (h >> np.uint64(10))
        np.minimum.at(out, bins.ravel(), value.ravel())
        if (out >> np.uint64(54)).max() < first + step and out.max() != np.iinfo(np.uint64).max:
            break
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def sketched(docs: DataFrame, shingle: int, text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, set_key, id, bands); th is a hash of the text, id one of the set. Key, id
    and bands are null for empty sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, keys, bands = [], [], []
            for text in batch["text"]:
                s = shingle_set(word_hashes(text or ""), shingle)
                n.append(len(s))
                keys.append(_set_key(s) if len(s) else None)
                bands.append(band_keys(sketch(s)) if len(s) else None)
            ids = pd.array([None if k is None else _short(k) for k in keys], dtype="Int64")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "th": batch["th"], "n_shingles": n, "set_key": keys, "id": ids, "bands": bands})

    rows = spread(docs.select("doc_id", F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")))
    schema = "doc_id string, th long, n_shingles long, set_key binary, id long, bands array<long>"
    return ids_as_long(ids_as_text(rows, "doc_id").mapInPandas(run, schema), "doc_id")


def _set_key(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def shingle_sets(docs: DataFrame, chosen: DataFrame, shingle: int, text_col: str = "text") -> DataFrame:
    """(id, elements) of the classes in ``chosen`` (id, doc_id): their whole sets as sorted 64-bit
    hashes. Other texts of a chosen doc_id are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(word_hashes(t or ""), shingle) for t in batch["text"]]
            own = [len(s) > 0 and _short(_set_key(s)) == i for s, i in zip(sets, batch["id"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "elements": [s.tobytes() for s in sets]})[own]

    rows = docs.select("doc_id", F.col(text_col).alias("text")).join(small_side(chosen, BROADCAST_IDS), "doc_id")
    return rows.select("id", "text").mapInPandas(run, "id long, elements binary").dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A and B| >= percent * |A or B|, on whole sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.loc[np.array(ok, dtype=bool), ["a", "b"]]

    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept). ``docs`` is read twice: pass a table."""
    return _grouped(docs, shingle, percent, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each group, with all its columns."""
    removed = stage(_grouped(docs, shingle, percent, text_col).where("not kept").select("doc_id", "th").distinct(), "removed")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_col).alias("h"))
    gone = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))
    rows = rows.join(small_side(removed, BROADCAST_IDS), gone, "left_anti")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        rows = rows.dropDuplicates(["id", "h"])
    return rows.select("row.*")


def _grouped(docs: DataFrame, shingle: int, percent: int, text_col: str) -> DataFrame:
    sketches = stage(sketched(docs, shingle, text_col), "sketches")
    classes = stage(
        sketches.where("n_shingles > 0")
        .groupBy("set_key")
        .agg(F.first("id").alias("id"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "classes",
    )
    components = class_components(docs, classes.where("doc_id is not null"), shingle, percent, text_col)
    least = components.join(classes.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("least"))
    merged = (
        classes.select("set_key", "id", "doc_id")
        .join(components.join(least, "component").select("id", "least"), "id", "left")
        .select("set_key", F.coalesce("least", "doc_id").alias("least"))
    )
    named = sketches.join(merged, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return named.select("doc_id", "th", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def class_components(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, text_col: str) -> DataFrame:
    """(id, component) of the classes with a link."""
    members = classes.select("id", "n", "doc_id", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = stage(members.join(sizes, "key"), "shared")

    weight = shared.groupBy("id").agg(F.sum(F.log2("size")).alias("weight"))
    weighted = shared.join(weight, "id")
    rank = F.struct(F.col("weight"), (-F.col("id")).alias("r"))
    pivots = weighted.groupBy("key").agg(F.max(F.struct(rank.alias("r"), F.col("id").alias("pivot"), F.col("n").alias("pn"))).alias("p"))
    fits = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    first = stage(
        shared.join(pivots.select("key", "p.pivot", "p.pn"), "key")
        .where((F.col("id") != F.col("pivot")) & fits)
        .select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
        .distinct(),
        "pairs",
    )
    sets = stage(shingle_sets(docs, stage(shared.select("id", "doc_id").distinct(), "chosen"), shingle, text_col), "sets")
    links = stage(verified(first, sets, percent), "links")
    joined = connected_components(links)

    held = stage(
        shared.select("key", "id", "n", "size")
        .join(joined, "id", "left")
        .withColumn("component", F.coalesce("component", "id")),
        "held",
    )
    mixed = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    more = stage(block_links(stage(held.join(mixed, "key"), "open"), sets, percent), "links")
    if more.limit(1).count() == 0:
        return joined
    return connected_components(links.union(more))


def block_links(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the members (key, id, n, size, component) of buckets that hold several components.

    A class lives in the block of the fullest bucket that a member of its buckets is in, so that a group
    shares few blocks; blocks are split by id where they are large, and a component
    with OWN_BLOCK classes there has blocks of its own, which are not compared again. A bucket asks
    for the pairs of its blocks that hold different components; each block pair is compared once, as
    a product of set matrices inside a task, and gives a spanning forest of its links. So a group of
    m alike classes moves m * m / BLOCK_CLASSES sets, and no pairs."""
    fullest = open_.groupBy("id").agg(F.max(F.struct("size", "key")).alias("home"))
    near = open_.join(fullest, "id").groupBy("key").agg(F.max("home").alias("home"))
    homes = open_.join(near, "key").groupBy("id").agg(
        F.max("home").alias("home"), F.first("n").alias("n"), F.first("component").alias("component")
    )
    homes = homes.select("id", "n", "component", F.col("home.key").alias("home"))
    own = homes.groupBy("home", "component").agg(F.count("*").alias("alike")).where(F.col("alike") >= OWN_BLOCK)
    homes = homes.join(own, ["home", "component"], "left").select(
        "id", "n", F.xxhash64("home", F.when(F.col("alike").isNotNull(), F.col("component"))).alias("home")
    )
    load = homes.groupBy("home").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_ELEMENTS)).cast("int").alias("parts")
    )
    blocks = stage(
        homes.join(load, "home").select("id", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")), "blocks"
    )
    asked = (
        open_.join(blocks, "id").groupBy("key", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    )
    right = asked.select("key", F.col("block").alias("bj"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = (
        asked.withColumnRenamed("block", "bi")
        .join(right, "key")
        .where((F.col("bi") <= F.col("bj")) & (F.least("lo", "lo2") < F.greatest("hi", "hi2")))
        .select("bi", "bj")
        .distinct()
    )
    members = pairs.select("bi", "bj", F.explode(F.array_distinct(F.array("bi", "bj"))).alias("block")).join(blocks, "block")
    return (
        members.join(sets, "id")
        .repartition("bi", "bj")
        .sortWithinPartitions("bi", "bj", "id")
        .mapInPandas(_block_forest(percent), "a long, b long")
    )


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections; elements of one set only are left out first."""
    elements, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = np.bincount(column, minlength=len(elements)) > 1
    place = np.cumsum(common) - 1
    row, column = row[common[column]], place[column[common[column]]]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    wide = max(1, (1 << 22) // len(sets))
    for first in range(0, int(common.sum()), wide):
        lo, hi = np.searchsorted(column, [first, first + wide])
        x = np.zeros((len(sets), wide), dtype=np.float32)
        x[row[lo:hi], column[lo:hi] - first] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _block_forest(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            sets = [np.frombuffer(x, np.uint64) for x in rows["elements"]]
            size = np.array([len(s) for s in sets])
            common = _intersections(sets)
            linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
            root = forest(linked)
            ids = rows["id"].to_numpy()
            other = root != np.arange(len(ids))
            return pd.DataFrame({"a": ids[root[other]], "b": ids[other]})

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (rows["bi"] == rows["bi"].iloc[-1]) & (rows["bj"] == rows["bj"].iloc[-1])
            held = rows[last]
            for _, own in rows[~last].groupby(["bi", "bj"], sort=False):
                yield found(own)
        if held is not None:
            yield found(held)

    return run
